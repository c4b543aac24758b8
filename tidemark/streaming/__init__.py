"""Streams: the daily index, new addresses, and batches written by year."""

from tidemark.streaming.daily import daily_index, new_urls, run_once, upsert_stream

__all__ = ["daily_index", "new_urls", "run_once", "upsert_stream"]
