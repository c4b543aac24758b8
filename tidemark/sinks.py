"""Sinks: files by extension, tables by year, upserts in place, dead letters and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.updates import upsert
from tidemark.sources.files import table_exists
from tidemark.sources.xlsx import write_xlsx


def write_any(df: DataFrame, path: str) -> None:
    """A table by day as one file of CSV, an array of JSON records (.json), JSON lines (.jsonl) or XLSX in a folder of that
    name, by the extension; CSV otherwise."""
    kind = path.rpartition(".")[2].lower()
    if kind == "xlsx":
        write_xlsx(df, path)
    elif kind == "json":
        records = F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])), {"ignoreNullFields": "false"})
        df.coalesce(1).agg(records.alias("value")).write.mode("overwrite").text(path)
    elif kind == "jsonl":
        df.coalesce(1).write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_years(df: DataFrame, path: str, append: bool = False) -> None:
    """A table partitioned by year; only the years that df has are written over."""
    out = df.write.partitionBy("year")
    (out.mode("append") if append else out.mode("overwrite").option("partitionOverwriteMode", "dynamic")).parquet(path)


def upsert_years(new: DataFrame, path: str, keys: list[str], *order: Column) -> None:
    """Rows put into a table partitioned by year, of each key the first by the order. The years concerned are written
    beside the table first: a plan that reads a table can't overwrite it."""
    spark = new.sparkSession
    if not table_exists(spark, path):
        write_years(upsert(new.limit(0), new, ["year", *keys], *order), path)
        return
    concerned = [r[0] for r in new.select("year").distinct().collect()]  # years
    old = spark.read.parquet(path).where(F.col("year").isin(concerned))
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    upsert(old, new, ["year", *keys], *order).write.partitionBy("year").parquet(aside)
    write_years(spark.read.parquet(aside), path)
    p = spark._jvm.org.apache.hadoop.fs.Path(aside)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def split_failures(df: DataFrame, ok: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are well, and the others with their error and time."""
    well = F.coalesce(ok, F.lit(False))
    return df.where(well), df.where(~well).withColumn("error", error).withColumn("timestamp", F.current_timestamp())


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").json(path)


def write_payloads(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Binary contents as files of their own, written by the executors into a folder that all of them have mounted. The
    driver leaves a mark there first; an executor that doesn't see it has another disk, and fails instead of writing."""
    from pathlib import Path

    mark = Path(folder, f".{uuid.uuid4().hex}")
    mark.parent.mkdir(parents=True, exist_ok=True)
    mark.touch()

    def each(rows) -> None:
        if not mark.exists():
            raise FileNotFoundError(f"{folder} is not shared with the driver")
        for r in rows:
            half = Path(folder, f".{uuid.uuid4().hex}")
            half.write_bytes(bytes(r[content]))
            half.replace(Path(folder, r[name]))  # whole or not at all, also when a task runs twice

    try:
        df.select(name, content).foreachPartition(each)
    finally:
        mark.unlink(missing_ok=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
