"""Filters and the predicates that make them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SIDE, MOST_SIDE, MOST_ASPECT, LEAST_CONTENT, LEAST_BYTES = 150, 4000, 3.0, 0.15, 1024


def truthy(x: Column) -> Column:
    """Neither null nor empty, nor false, nor a number that is 0."""
    kind, written = F.typeof(x), x.cast("string")
    number = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    there = F.when(kind == "boolean", written == "true").when(number, written.try_cast("double") != 0).otherwise(written != "")
    return F.coalesce(there, F.lit(False))


def size_ok(width: Column, height: Column) -> Column:
    """Both sides and their ratio within bounds, bounds included; nulls are not."""
    low, high = F.least(width, height), F.greatest(width, height)
    return F.coalesce(width.isNotNull() & height.isNotNull() & (low >= LEAST_SIDE) & (high <= MOST_SIDE) & (high <= MOST_ASPECT * low), F.lit(False))


def payload_ok(status: Column, content_type: Column, size: Column) -> Column:
    return F.coalesce((status == 200) & content_type.startswith("image/") & (size >= LEAST_BYTES), F.lit(False))


def reject_reason(valid: Column, width: Column, height: Column, content: Column, has_qr: Column) -> Column:
    """The first test that an image fails, null for none. An unknown content or QR code is no reason."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid_image")
        .when(~size_ok(width, height), "size_ratio")
        .when(F.coalesce(content < LEAST_CONTENT, F.lit(False)), "content_area")
        .when(F.coalesce(has_qr, F.lit(False)), "qr_code")
    )


def purge_invalid(df: DataFrame, content: str = "content", links: str = "image_links") -> DataFrame:
    """Articles with text and at least one image link."""
    return df.where(truthy(F.col(content)) & (F.coalesce(F.size(links), F.lit(0)) > 0))


def retryable(df: DataFrame, url: str = "url", broken: str = "article_processing_failed") -> DataFrame:
    return df.where(F.coalesce(F.col(url) != broken, F.lit(False)))


def in_dates(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows from the first to the last day, both included."""
    return df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def without_tail(df: DataFrame, value: str, share: float = 0.995) -> DataFrame:
    """Rows up to the exact percentile."""
    return df.crossJoin(df.agg(F.percentile(value, F.lit(share)).alias("_top"))).where(F.col(value) <= F.col("_top")).drop("_top")


def days_with_null(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows of the span in which any other column is null."""
    missing = reduce(or_, [F.col(f"`{c}`").isNull() for c in df.columns if c != date], F.lit(False))
    return in_dates(df, date, first, last).where(missing)


def drop_first(df: DataFrame, order: str) -> DataFrame:
    """Without the first row; for tables by day, whose order one task can hold."""
    return df.withColumn("_n", F.row_number().over(Window.orderBy(order))).where("_n > 1").drop("_n")


def head_and_more(df: DataFrame, *order: Column | str, n: int = 10) -> DataFrame:
    """The first n rows, each with `more`: how many there are besides these."""
    rest = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(rest))  # one row
