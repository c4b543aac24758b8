"""Arrays of structs, such as the images of an article."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of(array: Column, value: Callable[[Column], Column]) -> Column:
    """The mean over an array; 0 for an empty or null one."""
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x).cast("double"))
    return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, total / F.size(array)).otherwise(0.0)


def zipped(left: Column, right: Column) -> Column:
    """Pairs by position, as many as the shorter has."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, 1, n).alias("l"), F.slice(right, 1, n).alias("r"))


def zip_join(df: DataFrame, left: str, right: str) -> DataFrame:
    """A row for each pair: pos, left_item and right_item with df's other columns."""
    others = [c for c in df.columns if c not in (left, right)]
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(F.col(left), 1, n).alias("left_item"), F.slice(F.col(right), 1, n).alias("right_item"))
    return df.select(*others, F.posexplode(pairs).alias("pos", "_pair")).select(*others, "pos", "_pair.left_item", "_pair.right_item")


def flatten(df: DataFrame, array: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each element that is kept: its position and its fields with df's other columns."""
    others = [c for c in df.columns if c != array]
    rows = df.select(*others, F.posexplode(array).alias("pos", "_item"))
    return (rows.where(keep(F.col("_item"))) if keep else rows).select(*others, "pos", "_item.*")


def rewrite(array: Column, **fields: Callable[[Column], Column]) -> Column:
    """Each element with fields set, the others as they are."""

    def one(x: Column) -> Column:
        out = x
        for name, value in fields.items():
            out = out.withField(name, value(x))
        return out

    return F.transform(array, one)


def first_or(array: Column, index: Column, otherwise: Column) -> Column:
    """The element at an index from 0, the first where there is none, or what is given."""
    return F.coalesce(F.get(array, index), F.get(array, F.lit(0)), otherwise)
