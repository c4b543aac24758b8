"""Connected components of a graph that no task holds, and of one that a task does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node of edges (u, v) the least node of its component, except for that one; by alternating
    large and small stars until nothing changes, each round written to the shared folder.

    The least neighbour of a node is a grouped minimum, combined before the shuffle, and joined back: a node that very
    many others are linked to is no group of one task, and its join can be split. Edges with a null end and loops are
    left out; repeated edges count once. No edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
        if large:
            e = e.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:
            e = e.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        return e.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, state(e)
    while now != before and now[0]:
        last, e = e, stored(star(star(e, True), False), "star")
        before, now = now, state(e)
        dropped(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def join_up(label: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
    """label, the least node that each node is known to reach, brought up to date, in place, for further links u - w."""
    while True:
        a, b = label[u], label[w]
        apart = a != b
        if not apart.any():
            return
        a, b, u, w = a[apart], b[apart], u[apart], w[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further
