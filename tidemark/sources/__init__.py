"""Sources: tables by year, files, spreadsheets, images, folders and pages."""

from tidemark.sources.files import files, images, labelled_images, market, read_any, table_exists, table_years, years
from tidemark.sources.pages import PageSource, page_urls
from tidemark.sources.xlsx import read_xlsx, write_xlsx

__all__ = ["PageSource", "files", "images", "labelled_images", "market", "page_urls", "read_any", "read_xlsx", "table_exists", "table_years", "write_xlsx", "years"]
