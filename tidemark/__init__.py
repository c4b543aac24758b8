"""tidemark: a PySpark-native analytics engine for daily news-sentiment research."""
