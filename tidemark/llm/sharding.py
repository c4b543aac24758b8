"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has points on a ring of hashes (60 bits of md5, which other engines have too); a key belongs to the first point clockwise. No shard takes more than
ceil((1 + slack) * keys / shards); keys that find it full continue to the next point clockwise. Which keys of an arc
go on follows from counts alone: keys hop together, and where several arcs meet at a shard that fills, arcs in ring
order, within an arc keys in hash order, are taken first. So the driver walks a few thousand arc counts, a shard fills
once, and at most one arc for each shard is cut at a hash. The result is a table of cut positions that any row can be
looked up in, without join, window or shuffle of the rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read

SHARDS, VNODES, SLACK = 64, 128, 0.05


@dataclass
class Ring:
    """points: sorted ends of the arcs, the last arc being the one beyond the last point; owner: each arc's shard."""

    points: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, shards: list[str], vnodes: int = VNODES) -> Ring:
        at = sorted((int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:15], 16), i) for i, s in enumerate(shards) for v in range(vnodes))
        return cls(np.array([p for p, _ in at], np.int64), np.array([i for _, i in at] + [at[0][1]], np.int32))

    def arc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, position, "left").astype(np.int32)


def walk(ring: Ring, counts: np.ndarray, slack: float = SLACK) -> dict[int, list[tuple[int, int]]]:
    """For each arc with keys the runs (keys up to this rank, shard) its keys fall into, in hash order."""
    shards, total, n_points = int(ring.owner.max()) + 1, int(counts.sum()), len(ring.points)
    cap = int(np.ceil(round((1 + slack) * total / shards, 9)))
    room = np.full(shards, cap, np.int64)
    runs: dict[int, list[tuple[int, int]]] = {}
    waiting = [(arc, 0, int(counts[arc])) for arc in np.flatnonzero(counts)]
    hop = 0
    while waiting:
        after = []
        for arc, lo, hi in waiting:
            shard = int(ring.owner[(arc + hop) % n_points])
            take = int(min(room[shard], hi - lo))
            if take:
                room[shard] -= take
                runs.setdefault(int(arc), []).append((lo + take, shard))
            if lo + take < hi:
                after.append((arc, lo + take, hi))
        waiting, hop = after, hop + 1
    return runs


def position_of(key: Column) -> Column:
    """A key's place on the ring; null is hashed as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def shard(df: DataFrame, id_col: str, shards: list[str], vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """(id_col, home_shard, shard, overflowed) for each row of df.

    Loads count distinct keys: repeated rows of a key, and ties of its hash, go where the first goes. Null is a key like
    any other. Keys may be of any length. Other columns of df, whatever their names, are left out. An empty table gives no
    rows; no shards are an error.
    """
    if len(shards) < 1:
        raise ValueError("no shards")
    spark, ring = df.sparkSession, Ring.of(shards, vnodes)
    sent = spark.sparkContext.broadcast(ring)  # shards * vnodes points, whatever the input

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(sent.value.arc(position.to_numpy(np.int64)))

    rows = df.select(F.col(f"`{id_col}`").alias("id")).select("id", position_of(F.col("id")).alias("position"))
    keys = rows.select("position").distinct().select("position", arc_of("position").alias("arc"))
    counts = np.zeros(len(ring.points) + 1, np.int64)
    for r in keys.groupBy("arc").count().collect():
        counts[r[0]] = r[1]
    runs = walk(ring, counts, slack)
    cut = {arc: x for arc, x in runs.items() if len(x) > 1}
    at: dict[tuple[int, int], int] = {}
    if cut:
        wanted = spark.createDataFrame([(a, rank) for a, x in cut.items() for rank, _ in x[:-1]], "arc int, rank long")  # a shard fills once
        ranked = keys.where(F.col("arc").isin(*cut)).withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("position")).cast("long"))
        at = {(r[0], r[1]): r[2] for r in ranked.join(F.broadcast(wanted), ["arc", "rank"]).select("arc", "rank", "position").collect()}
    ends, owner = [], []
    for a in range(len(ring.points) + 1):
        end = int(ring.points[a]) if a < len(ring.points) else 2**63 - 1
        parts = runs.get(a, [(0, int(ring.owner[a]))])
        for rank, s in parts[:-1]:
            ends.append(at[a, rank])
            owner.append(s)
        ends.append(end)
        owner.append(parts[-1][1])
    table = spark.sparkContext.broadcast((np.array(ends, np.int64), np.array(owner, np.int32), np.array(shards, object)))

    @F.pandas_udf("home_shard string, shard string")
    def place(position: pd.Series) -> pd.DataFrame:
        p = position.to_numpy(np.int64)
        end, own, names = table.value
        return pd.DataFrame({"home_shard": names[sent.value.owner[sent.value.arc(p)]], "shard": names[own[np.searchsorted(end, p, "left")]]})

    placed = rows.select("id", place("position").alias("p"))
    return placed.select(F.col("id").alias(id_col), "p.home_shard", "p.shard", (F.col("p.home_shard") != F.col("p.shard")).alias("overflowed"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)])


ORACLE = {
    "op6_sharding": f"""
    WITH RECURSIVE points AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY p, shard) - 1 AS k, p, shard
        FROM (SELECT s AS shard, CAST('0x' || substr(md5(printf('shard-%03d#%d', s, v)), 1, 15) AS BIGINT) AS p FROM range({SHARDS}) a(s), range({VNODES}) b(v))),
      many AS (SELECT count(*) AS points FROM points),
      keys AS MATERIALIZED (SELECT DISTINCT CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS position FROM documents),
      placed AS MATERIALIZED (SELECT position, coalesce(k, (SELECT points FROM many)) AS arc FROM keys ASOF LEFT JOIN points ON keys.position <= points.p),
      ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY position) AS rank FROM placed),
      state AS (
        SELECT 0 AS hop, 'arc' AS kind, arc AS x, CAST(0 AS BIGINT) AS lo, count(*) AS hi FROM placed GROUP BY arc
        UNION ALL SELECT 0, 'room', shard, CAST(ceil(round(CAST({1 + SLACK} AS DOUBLE) * (SELECT count(*) FROM keys) / {SHARDS}, 9)) AS BIGINT), 0 FROM range({SHARDS}) r(shard)
        UNION ALL (
          WITH met AS (
              SELECT a.hop, a.x, a.lo, a.hi, r.x AS shard, r.lo AS room, sum(a.hi - a.lo) OVER (PARTITION BY r.x ORDER BY a.x) - (a.hi - a.lo) AS before
              FROM state a JOIN points p ON p.k = (a.x + a.hop) % (SELECT points FROM many) JOIN state r ON r.kind = 'room' AND r.x = p.shard WHERE a.kind = 'arc'),
            took AS (SELECT *, CAST(greatest(0, least(hi - lo, room - before)) AS BIGINT) AS n FROM met),
            used AS (SELECT shard, CAST(sum(n) AS BIGINT) AS n FROM took GROUP BY 1)
          SELECT hop + 1, 'arc', x, lo + n, hi FROM took WHERE lo + n < hi
          UNION ALL SELECT hop + 1, 'room', x, lo - coalesce(n, 0), 0 FROM state LEFT JOIN used ON shard = x WHERE kind = 'room' AND EXISTS (SELECT 1 FROM state WHERE kind = 'arc')
          UNION ALL SELECT hop + 1, printf('shard-%03d', shard), x, lo, lo + n FROM took WHERE n > 0)),
      runs AS MATERIALIZED (SELECT kind AS shard, x AS arc, lo, hi FROM state WHERE kind LIKE 'shard-%')
    SELECT doc_id, printf('shard-%03d', p.shard) AS home_shard, runs.shard, printf('shard-%03d', p.shard) <> runs.shard AS overflowed
    FROM documents d JOIN ranked r ON r.position = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
      JOIN runs ON runs.arc = r.arc AND r.rank > runs.lo AND r.rank <= runs.hi JOIN points p ON p.k = r.arc % (SELECT points FROM many)""",
}
