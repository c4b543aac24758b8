"""Samples by strata, examples and splits, the same for the same seed and ids whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(key: str, seed: int) -> Column:
    """A lot to order by: the hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")))


def allocation(df: DataFrame, stratum: str, rate: float) -> DataFrame:
    """(stratum, size, take): shares of floor(rate * rows), rounded half to even, then one more or less for each stratum
    in order of name, over and over until they sum to it, within what strata have. Rows without stratum count for the whole
    alone. Strata are few enough to be ordered by one task."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.floor(F.sum("size") * rate).alias("_target"), F.sum("size").alias("_rows"))
    first = sizes.where(F.col(stratum).isNotNull()).crossJoin(total)
    first = first.withColumn("_own", F.least(F.bround(F.col("size") / F.col("_rows") * F.col("_target")).cast("bigint"), F.col("size")))
    every = Window.partitionBy()
    first = first.withColumn("_off", F.least(F.col("_target"), F.sum("size").over(every)) - F.sum("_own").over(every))
    # whole passes go as far as `_level`, at which strata of less room are exhausted; the first of the others get one of the rest
    first = first.withColumn("_room", F.when(F.col("_off") > 0, F.col("size") - F.col("_own")).otherwise(F.col("_own")))
    by_room = Window.orderBy("_room", stratum)
    left = F.count("*").over(every) - F.row_number().over(by_room)
    filled = F.sum("_room").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) + left * F.col("_room")
    level = F.when(filled <= F.abs("_off"), F.col("_room") + F.when(left > 0, F.floor((F.abs("_off") - filled) / left)).otherwise(0))
    first = first.withColumn("_at", level).withColumn("_level", F.greatest(F.max("_at").over(every), F.floor(F.abs("_off") / F.count("*").over(every))))
    more = F.col("_room") > F.col("_level")
    rest = F.abs("_off") - F.sum(F.least("_room", "_level")).over(every)
    nth = F.sum(F.when(more, 1).otherwise(0)).over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, 0))
    given = F.least("_room", "_level") + F.when(more & (nth <= rest), 1).otherwise(0)
    fixed = first.withColumn("take", F.col("_own") + F.signum("_off").cast("bigint") * given)
    return fixed.select(stratum, "size", F.col("take").cast("bigint").alias("take"))


def stratified(df: DataFrame, stratum: str, key: str, rate: float, seed: int = 42) -> DataFrame:
    """A sample without replacement of each stratum's allocation."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(lot(key, seed), key))
    return df.withColumn("_n", n).join(allocation(df, stratum, rate).drop("size"), stratum).where("_n <= take").drop("_n", "take")


def simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(lot(key, seed), key).limit(n)


def examples(df: DataFrame, category: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Up to n rows of each category."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(lot(key, seed), key))).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with _n, each row's number from 1 in the order of lots, and _rows, how many there are. Rows are ranked in 4,096
    buckets of their lots, so that no task has to order the whole table."""
    d = df.withColumn("_lot", lot(key, seed)).withColumn("_bucket", F.substring("_lot", 1, 3))
    before = d.groupBy("_bucket").agg(F.count("*").alias("_k"))
    before = before.withColumn("_before", F.sum("_k").over(Window.orderBy("_bucket")) - F.col("_k")).withColumn("_rows", F.sum("_k").over(Window.partitionBy())).drop("_k")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy("_lot", key))).join(before, "_bucket").withColumn("_n", F.col("_n") + F.col("_before")).drop("_lot", "_bucket", "_before")


def epoch(df: DataFrame, key: str, nth: int, seed: int = 42) -> DataFrame:
    """df with `position` from 0 in the shuffled order of an epoch of training; each epoch has an order of its own."""
    return numbered(df, key, seed + nth).withColumn("position", (F.col("_n") - 1).cast("bigint")).select(*df.columns, "position")


def split(df: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.1), seed: int = 42) -> DataFrame:
    """df with `split`: train, validation or test, of floor(share * rows) rows, the rest for test."""
    ranked = numbered(df, key, seed)
    train, valid = F.floor(F.col("_rows") * F.lit(shares[0])), F.floor(F.col("_rows") * F.lit(shares[1]))
    named = F.when(F.col("_n") <= train, "train").when(F.col("_n") <= train + valid, "validation").otherwise("test")
    return ranked.withColumn("split", named).select(*df.columns, "split")
