"""Joins and what goes with them: keeping the latest row, rows that are new, updates, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import zip_join
from tidemark.operators.filters import truthy


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by the order given, which should be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def new_rows(found: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows whose key isn't known yet."""
    return found.join(known.select(F.col(known_key or key).alias(key)), key, "left_anti")


def first_seen(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """df with `skipped`: whether the key came in an earlier row."""
    return df.withColumn("skipped", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def without_files(mappings: DataFrame, files: DataFrame, folder: str = "folder_path") -> DataFrame:
    """mappings with has_images: whether their folder has a file in the listing; all are processed."""
    there = files.select(F.col(folder), F.lit(True).alias("_there")).distinct()
    return mappings.join(there, folder, "left").withColumn("has_images", F.coalesce("_there", F.lit(False))).withColumn("processed", F.lit(True)).drop("_there")


def sync_image_quality(images: DataFrame, scores: DataFrame, compat: bool = False) -> DataFrame:
    """images (original_id, image_index, quality_score) with quality_score set from scores (original_id and the array
    scores by index): the image's own, else the article's first, else the old one. compat takes the first for all."""
    joined = images.join(scores.select("original_id", "scores"), "original_id", "left")
    own = F.lit(None).cast("double") if compat else F.get(F.col("scores"), F.col("image_index").cast("int"))
    return joined.withColumn("quality_score", F.coalesce(own, F.get(F.col("scores"), F.lit(0)), "quality_score")).drop("scores")


def sync_average(news: DataFrame, quality: DataFrame) -> DataFrame:
    """news with avg_quality_score from quality where it has one."""
    fresh = quality.select("original_id", F.col("avg_quality_score").alias("_new"))
    return news.join(fresh, "original_id", "left").withColumn("avg_quality_score", F.coalesce("_new", "avg_quality_score")).drop("_new")


def enrich(market: DataFrame, index: DataFrame, date: str = "Date", index_date: str = "news_date") -> DataFrame:
    """The market's days, with the index where it has the day."""
    return market.join(index.withColumnRenamed(index_date, date), date, "left")


def match_stats(enriched: DataFrame, value: str) -> DataFrame:
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.count(value), F.count("*")), F.lit(0.0)), 6)
    return enriched.agg(F.count("*").alias("total"), F.count(value).alias("updated"), rate.alias("percent"))


def outer(left: DataFrame, right: DataFrame, date: str) -> DataFrame:
    """Days of either, their key in one column."""
    return left.join(right, date, "full_outer")


def present(df: DataFrame, *names: str) -> DataFrame:
    """Those of the named columns that df has."""
    return df.select(*[c for c in names if c in df.columns])


def with_date_column(df: DataFrame, date: str = "Date", parts: tuple[str, ...] = ("date", "日期")) -> DataFrame:
    """df with its first column whose name speaks of a date named so."""
    if date in df.columns:
        return df
    found = [c for c in df.columns if any(p in c.lower() for p in parts)]
    if not found:
        raise ValueError("no column of dates")
    return df.withColumnRenamed(found[0], date)


def with_likelihood(df: DataFrame, *names: str) -> DataFrame:
    """Weighted{X}_likelihood, where it is missing, is {X}_likelihood."""
    add = {f"Weighted{n}_likelihood": F.col(f"{n}_likelihood") for n in names if f"Weighted{n}_likelihood" not in df.columns and f"{n}_likelihood" in df.columns}
    return df.withColumns(add) if add else df


def first_existing(df: DataFrame, listing: DataFrame, *candidates: Column, path: str = "path") -> DataFrame:
    """df with `found`: the first of the candidate paths that the listing has, null for none. One join, on all of them."""
    tried = df.withColumn("_row", F.xxhash64(*candidates)).withColumn("_tried", F.array(*candidates))
    each = tried.select(F.posexplode(F.array_compact(F.col("_tried"))).alias("_n", "_path"), "_row").distinct()
    there = listing.select(F.col(path).alias("_path")).distinct()
    best = each.join(there, "_path").groupBy("_row").agg(F.min_by("_path", "_n").alias("found"))
    return tried.join(best, "_row", "left").drop("_row", "_tried")


def pair_images(quality: DataFrame, filtered: DataFrame, scored: str = "images", paths: str = "valid_images") -> DataFrame:
    """Scored images of an article with their paths by position: (original_id, pos, left_item, right_item) and quality's
    other columns. Articles without id, without scored images or without paths have no rows; the longer list is cut."""
    known = filtered.where(F.size(paths) > 0).select("original_id", paths)
    there = quality.where(truthy(F.col("original_id").cast("string")) & (F.size(scored) > 0))
    return zip_join(there.join(known, "original_id"), scored, paths)


def combined(index: DataFrame, scraped: DataFrame, link: str = "link", url: str = "url") -> DataFrame:
    """One record for each address of the index that was scraped: title and date of the index where it has them, content,
    fetch date and image links as scraped, category empty where unknown."""
    i, s = index.alias("i"), scraped.alias("s")
    return i.join(s, F.col(f"i.{link}") == F.col(f"s.{url}")).select(
        F.coalesce("i.title", "s.title").alias("title"), F.coalesce("i.category", F.lit("")).alias("category"), F.coalesce("i.news_date", "s.publish_date").alias("news_date"),
        "s.content", F.col(f"i.{link}").alias("url"), "s.fetch_date", "s.image_links",
    )
