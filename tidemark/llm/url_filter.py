"""URL filters: a Bloom filter cascade that answers membership exactly for every key of a known universe.

Level 0 encodes the listed keys; level 1 the keys of the rest of the universe that level 0 takes for listed; level 2
the listed keys that level 1 takes for such errors; and so on until a level errs on nothing. Keys are spread over
shards by hash, each with a cascade of its own, so a shard is built in one bounded group and no filter grows with the
corpus. A row is probed where its shard's filter is: only its id and two hashes go there, and nothing is joined. A shard
with very many rows (one URL in a third of all, say) is cut into parts of PART_ROWS, each with a copy of the filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, pick, read, shared_dir, stored

SHARD_KEYS, PART_ROWS = 500_000, 1_000_000
BLOCKED_HOSTS = ("spam-farm", "cheap-pills", "adult-x", "casino-win", "free-bets", "ads-track")
FILTER_SCHEMA = "shard int, level int, k int, n_bits bigint, bits binary"


def _positions(h1: np.ndarray, h2: np.ndarray, k: int, n_bits: int, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = mix64(h1.view(np.uint64) + np.uint64(level * 0x9E3779B9)), mix64(h2.view(np.uint64) ^ np.uint64(level + 1)) | np.uint64(1)
        return (a[None, :] + np.arange(k, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(n_bits)


def _holds(h1: np.ndarray, h2: np.ndarray, level: int, k: int, n_bits: int, bits: bytes) -> np.ndarray:
    if not len(h1):
        return np.zeros(0, bool)
    at, raw = _positions(h1, h2, k, n_bits, level), np.frombuffer(bits, np.uint8)
    return ((raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(k, n_bits, bits) of each level, over the distinct keys (h1, h2) and their flags."""
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    levels: list[tuple[int, int, bytes]] = []
    rate = min(0.5, max(1e-4, len(inside[0]) / max(1, len(outside[0])) / np.sqrt(2)))
    while len(inside[0]):
        if len(levels) > 64:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        n_bits = max(64, int(np.ceil(len(inside[0]) * -np.log(rate) / np.log(2) ** 2 / 8)) * 8)
        k = max(1, round(-np.log2(rate)))
        raw = np.zeros(n_bits, np.uint8)
        raw[_positions(*inside, k, n_bits, len(levels)).ravel()] = 1
        level = (k, n_bits, np.packbits(raw, bitorder="little").tobytes())
        wrong = _holds(*outside, len(levels), *level)
        levels.append(level)
        inside, outside, rate = (outside[0][wrong], outside[1][wrong]), inside, 0.5
    return levels


def in_cascade(h1: np.ndarray, h2: np.ndarray, levels: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Exact for keys of the universe: the first level that lacks a key tells its side."""
    answer = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = _holds(h1[left], h2[left], i, *level)
        answer[left[~held]] = i % 2 == 1
        left = left[held]
    answer[left] = len(levels) % 2 == 1
    return answer


def _keys(df: DataFrame, key: Column, shards: int, *others: Column) -> DataFrame:
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    return df.select(*others, F.when(key.isNotNull(), h1).alias("h1"), F.when(key.isNotNull(), h2).alias("h2"), F.pmod(h1, F.lit(shards)).cast("int").alias("shard"))


def build(universe: DataFrame, url_col: str, listed: Column | DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The filters of the listed keys over a universe, and the number of shards. What is listed is told by a condition on
    the universe's rows, or by a table, whose first column has the keys; those the universe lacks are added to it.

    Null keys belong to no side. A key in several rows is listed if any row says so; a null flag says no. Keys may be of
    any length. With no listed key, or an empty universe, there are no filters and nothing is listed. Other columns of
    universe are looked at by the condition alone.
    """
    url = F.col(f"`{url_col}`")
    if isinstance(listed, DataFrame):
        flagged = universe.select(url.alias("url"), F.lit(False).alias("listed")).unionByName(listed.select(F.col(f"`{listed.columns[0]}`").alias("url"), F.lit(True).alias("listed")))
    else:
        flagged = universe.select(url.alias("url"), F.coalesce(listed, F.lit(False)).alias("listed"))
    flagged = flagged.where("url IS NOT NULL")
    shards = max(1, -(-flagged.count() // shard_keys))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_cascade(pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64), pdf["listed"].to_numpy(bool))
        return pd.DataFrame([(int(key[0]), i, *x) for i, x in enumerate(made)], columns=["shard", "level", "k", "n_bits", "bits"])

    keys = _keys(flagged, F.col("url"), shards, F.col("listed"))
    keys = keys.groupBy("shard", "h1", "h2").agg(F.max("listed").alias("listed"))
    return stored(keys.groupBy("shard").applyInPandas(one, FILTER_SCHEMA), "filters"), shards


def probe(df: DataFrame, id_col: str, url_col: str, filters: DataFrame, shards: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(id_col, listed) for each row of df, repeated rows included; a null key is not listed. The answer is exact for keys
    of the universe that the filters are of; of any other it means nothing. Null ids, long keys and an empty df are as any
    others; other columns of df, whatever their names, are left out."""
    kind = dict(df.dtypes)[id_col]
    keyed = _keys(pick(df, id_col, url_col), F.col(f"`{url_col}`"), shards, F.col(f"`{id_col}`").alias("id"))
    known = keyed.where("h1 IS NOT NULL")
    crowded = known.groupBy("shard").count().where(F.col("count") > part_rows).select("shard", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    crowded = stored(crowded, "crowded")  # fewer rows than df has part_rows
    rows = known.join(crowded, "shard", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "h1"), F.coalesce("parts", F.lit(1)))).cast("int"))
    copies = filters.join(crowded, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    def meet(rows: pa.Table, levels: pa.Table) -> pa.Table:
        made = [(r["k"], r["n_bits"], r["bits"]) for r in levels.sort_by("level").to_pylist()]
        answer = in_cascade(rows.column("h1").to_numpy(), rows.column("h2").to_numpy(), made)
        return pa.table([rows.column("id"), pa.array(answer)], ["id", "listed"])

    met = rows.select("id", "h1", "h2", "shard", "part").groupBy("shard", "part").cogroup(copies.drop("parts").groupBy("shard", "part")).applyInArrow(meet, f"id {kind}, listed boolean")
    return met.unionByName(keyed.where("h1 IS NULL").select("id", F.lit(False).alias("listed"))).withColumnRenamed("id", id_col)


def host_listed(url: Column) -> Column:
    """Whether the host has a blocked name as one of its labels."""
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]*)", 1).rlike(rf"(^|\.)({'|'.join(BLOCKED_HOSTS)})\.")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and whether its URL is listed; the universe is every URL of pages, the list those of blocked hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    filters, shards = build(pages, "url", host_listed(F.col("url")))
    return probe(pages, "page_id", "url", filters, shards)


ORACLE = {"op9_url_filter": f"SELECT page_id, coalesce(regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '(^|\\.)({'|'.join(BLOCKED_HOSTS)})\\.'), false) AS listed FROM pages"}
