"""Dates in several writings. What is no date is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _try(x: Column, form: str) -> Column:
    return F.try_to_date(x, form)


def parse_any(x: Column, formats: tuple[str, ...] = ("y-M-d", "y/M/d", "d/M/y")) -> Column:
    return F.coalesce(*[_try(x, f) for f in formats])


def compact(x: Column) -> Column:
    """yyyymmdd."""
    return _try(x, "yyyyMMdd")


def publish_date(x: Column) -> Column:
    """The first year, month and day with dashes or Han signs between, as text with zeros put before."""
    form = r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})"
    parts = [F.regexp_extract(x, form, k) for k in (1, 2, 3)]
    joined = F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0"))
    return F.when(parts[0] != "", joined)


def article_date(written: Column, url: Column, today: Column) -> Column:
    """The date given, one within what is given, the one in the URL's path, or today."""
    known = reduce(lambda a, b: F.coalesce(a, b), [_try(written, f) for f in ("y-M-d", "y/M/d", "y.M.d", "y年M月d日")])
    within = _try(F.translate(F.regexp_extract(written, r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})", 1), "/.", "--"), "y-M-d")
    in_url = _try(F.regexp_extract(url, r"/(\d{4}-\d{2}-\d{2})/", 1), "y-M-d")
    return F.coalesce(known, within, in_url, today)
