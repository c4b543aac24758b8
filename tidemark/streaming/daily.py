"""Structured Streaming forms of the daily index and of ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import weighted_mean
from tidemark.sinks import upsert_years


def daily_index(images: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The daily index of images (predicted_class, negative_likelihood, quality_score) by the day of ts; works on a
    stream, whose days are final a `late` after they end, and on a table."""
    p, q = F.col("negative_likelihood"), F.coalesce("quality_score", F.lit(0.5))
    known = images.where(p.isNotNull())
    if images.isStreaming:
        known = known.withWatermark(ts, late)
    negative = (F.coalesce("predicted_class", F.lit(0)) == 1).cast("double")
    return (
        known.groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("total_images"), F.sum(negative).cast("bigint").alias("negative_count"), F.avg(negative).alias("PhotoPes"), F.avg(p).alias("PhotoPes_likelihood"), weighted_mean(p, q, F.lit(0.0)).alias("WeightedPhotoPes"), F.avg(q).alias("avg_quality_score"))
        .select(F.col("w.start").cast("date").alias("news_date"), "total_images", "negative_count", "PhotoPes", "PhotoPes_likelihood", "WeightedPhotoPes", "avg_quality_score")
    )


def new_urls(pages: DataFrame, url: str = "url", ts: str | None = None, late: str = "7 days") -> DataFrame:
    """Pages whose address hasn't come before (within `late`, if a time is given: state is dropped after)."""
    if ts and pages.isStreaming:
        return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark([url])
    return pages.dropDuplicates([url])


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], *order: Column):
    """A query that puts each batch into a table partitioned by year; writing a batch again changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: upsert_years(df, path, keys, *order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, run through a stream, as a table in memory; for tables by day."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
