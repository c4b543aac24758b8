"""Ordered operators over tables by day: filling gaps and returns. Their order is that of the whole table, so they come
after aggregation to days, which one task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.filters import drop_first


def forward_fill(df: DataFrame, order: str, *values: str) -> DataFrame:
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def backward_fill(df: DataFrame, order: str, *values: str) -> DataFrame:
    w = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({v: F.first(v, ignorenulls=True).over(w) for v in values})


def fill(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Each gap by the last value before it, else the first after, else the column's mean."""
    if not values:
        return df
    back = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({v: F.coalesce(F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead), F.avg(v).over(Window.partitionBy())) for v in values})


def returns(df: DataFrame, order: str, *values: str) -> DataFrame:
    """{value}_returns and {value}_log_returns against the row before; null without it, or where it is 0."""
    w = Window.orderBy(order)
    out = {}
    for v in values:
        ratio = F.try_divide(F.col(f"`{v}`").cast("double"), F.lag(f"`{v}`").over(w).cast("double"))
        out[f"{v}_returns"] = ratio - 1
        out[f"{v}_log_returns"] = F.when(ratio > 0, F.ln(ratio))
    return df.withColumns(out)


def drop_first_returns(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Gaps filled, returns of each index, and the first row, which has none, left out."""
    names = values or tuple(c for c in df.columns if c != order)
    return drop_first(returns(fill(df, order, *names), order, *names), order)
