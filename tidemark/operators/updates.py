"""Upserts and updates without a table format: tables are rewritten by partition, never read and overwritten in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of both, of each key the first by the order; a new row goes before an old one in a tie."""
    both = new.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, *order, F.col("_old")).drop("_old")


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(total, new, duplicate) of the new rows' keys against the old."""
    wanted, there = new.select(*keys).distinct(), old.select(*keys).distinct().withColumn("_there", F.lit(1))
    return wanted.join(there, keys, "left").agg(F.count("*").alias("total"), F.count_if(F.col("_there").isNull()).alias("new"), F.count("_there").alias("duplicate"))


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set in the rows for which the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in df.columns else F.when(hit, v) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run hasn't done: those whose key isn't in its table."""
    return df.join(done.select(key), key, "left_anti")


def affected(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """(matched, changed): rows for which the condition holds, and those of them in which set_where changes a value."""
    hit = F.coalesce(condition, F.lit(False))
    other = F.lit(False)
    for c, v in values.items():
        other = other | ~F.col(c).eqNullSafe(v)
    return df.agg(F.count_if(hit).alias("matched"), F.count_if(hit & other).alias("changed"))
