"""Column functions: text, URLs, dates, weights, arrays and HTML."""
