"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. With integer weights that sum to the period, block j of a source of weight
w is released at floor(j * period / w) and due at ceil((j + 1) * period / w); taking the earliest deadline among the
released blocks gives each source, at every moment, less than one block more or less than its share. Releases and
deadlines repeat with the period, so one period is scheduled on the driver, and each block finds its slot in that table
by division. The period follows the sources: it holds the least share PRECISE times, so no weight is off its share by more
than 1 / PRECISE.

Documents are ranked within their source by the md5 of their id. Ranks are counted in buckets of leading md5 digits,
so that a source of any size is sorted in many small parts.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, read

ADDED = ("mix_rank", "mix_block", "mix_slot", "mix_position", "in_mix")
PERIOD, BLOCK_DOCS, ALPHA, BUCKET_ROWS = 1000, 8, 0.5, 20_000
PRECISE, LONGEST, SENT_ROWS = 10, 1_000_000, 200_000


def period_of(shares: dict[str, float], period: int = PERIOD) -> int:
    """The least multiple of period that holds the least share PRECISE times. Beyond LONGEST, or PRECISE times the number
    of sources if that is more, it doesn't grow: shares under PRECISE / LONGEST are only as exact as a slot of it."""
    if not shares:
        return period
    need = min(PRECISE * sum(shares[s] for s in sorted(shares)) / min(shares.values()), max(LONGEST, PRECISE * len(shares)))
    return period * max(1, math.ceil(need / period - 1e-9))


def integer_weights(shares: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Positive shares as integers that sum to the period, by largest remainder, ties by name; each is 1 at least."""
    if not shares:
        return {}
    if len(shares) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(shares[s] for s in sorted(shares))
    exact = {s: period * x / total for s, x in shares.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(shares, key=lambda s: (int(exact[s]) - exact[s], s)):
        if left <= 0:
            break
        out[s] += 1
        left -= 1
    while left < 0:  # where the least weight of 1 took too much
        out[max(out, key=lambda s: (out[s], s))] -= 1
        left += 1
    return out


def schedule(weights: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period, earliest deadline first, ties by name."""
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[s]), s, j))
        if ready:
            _, s, j = heapq.heappop(ready)
            out.append((s, j, slot))
            if j + 1 < weights[s]:
                heapq.heappush(waiting, ((j + 1) * period // weights[s], s, j + 1))
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, period: int | None = None, block_docs: int = BLOCK_DOCS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (columns of documents) with mix_rank, mix_block, mix_slot, mix_position and in_mix.

    Target weights are given by source, or the corpus counts to the power alpha; the period is that of period_of. in_mix holds for blocks before the
    first slot whose source has no full block left: there the proportions are as promised, with no source repeated.
    Null is a source of its own; weights that name no source of docs are ignored, sources without a weight are out of
    the mix and have no slot. A null id ranks as an empty one; repeated rows rank one after the other. An empty table
    gives no rows. Texts are carried along, not looked at. Columns of docs that are named like those added give way to them;
    all others stay, whatever their names.
    """
    placed, columns = _placed(docs, weights, alpha, period, block_docs, bucket_rows)
    return placed.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c.lower() not in ADDED], *ADDED)


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, period: int | None, block_docs: int, bucket_rows: int) -> tuple[DataFrame, list[str]]:
    """(_row, the columns of ADDED): docs' rows, with all of their columns in one so that no name can clash, and those."""
    spark, columns = docs.sparkSession, docs.columns
    d = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    d = d.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = {r[0]: r[1] for r in d.groupBy("_source").count().collect()}
    given = {s: float(n) ** alpha for s, n in sizes.items()} if weights is None else {("null" if s is None else f"={s}"): float(x) for s, x in weights.items() if x > 0}
    given = {s: x for s, x in given.items() if s in sizes}
    period = period or period_of(given)
    shares = integer_weights(given, period)
    table = schedule(shares, period)
    slot_of = {(s, j): slot for s, j, slot in table}
    full = {s: sizes[s] // block_docs for s in shares}
    horizon = min(((full[s] // w) * period + slot_of[s, full[s] % w] for s, w in shares.items()), default=0)
    digits = 1
    while max(sizes.values(), default=0) > bucket_rows * 16**digits:
        digits += 1
    d = d.withColumn("_bucket", F.substring("_key", 1, digits))
    before = d.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = before.select("_source", "_bucket", (F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = d.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id"))).join(before, ["_source", "_bucket"])
    ranked = ranked.withColumn("mix_rank", (F.col("_before") + F.col("_rank") - 1).cast("bigint")).withColumn("mix_block", F.floor(F.col("mix_rank") / block_docs).cast("bigint"))
    plan = spark.createDataFrame([(s, shares[s], j, slot) for s, j, slot in table], "_source string, _w bigint, _j bigint, _slot bigint")
    width = spark.createDataFrame(list(shares.items()), "_source string, _w bigint")
    ranked = ranked.join(F.broadcast(width), "_source", "left").withColumn("_j", F.col("mix_block") % F.col("_w"))
    plan = plan.drop("_w")
    placed = ranked.join(F.broadcast(plan) if len(table) <= SENT_ROWS else plan, ["_source", "_j"], "left")  # a period's slots, and one row for each source in them
    slot = (F.floor(F.col("mix_block") / F.col("_w")) * period + F.col("_slot")).cast("bigint")
    placed = placed.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block_docs + F.col("mix_rank") % block_docs)
    return placed.select("_row", "mix_rank", "mix_block", "mix_slot", "mix_position", F.coalesce(F.col("mix_slot") < horizon, F.lit(False)).alias("in_mix")), columns


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, period: int | None = None, block_docs: int = BLOCK_DOCS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All documents of sources with a weight, sorted by their place in the mix. A source that has run out leaves its
    slots idle, so the others go on in their proportions among each other; none is dropped.

    Null is a source of its own; null ids, null, empty and long texts and repeated rows are placed like any others. All
    columns of docs stay, whatever their names. An empty table gives no rows.
    """
    placed, columns = _placed(documents_of(docs), weights, alpha, period, block_docs, bucket_rows)
    return placed.where("mix_position IS NOT NULL").orderBy("mix_position").select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)


ORACLE = {
    "op3_mixing": f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
      n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
      e AS (SELECT s, n, {PERIOD} * pow(n, {ALPHA}) / (SELECT sum(pow(n, {ALPHA}) ORDER BY s) FROM n) AS x FROM n),
      w AS (SELECT s, n, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, s) <= {PERIOD} - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS w FROM e),
      l AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws FROM w),
      edf AS (
        SELECT -1 AS slot, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, ws FROM l
        UNION ALL
        SELECT slot, pick, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), ws
        FROM (SELECT slot + 1 AS slot, done, ws,
            list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND (done[i] * {PERIOD}) // ws[i] <= slot + 1),
              lambda i: (((done[i] + 1) * {PERIOD} + ws[i] - 1) // ws[i]) * 100000 + i)) % 100000 AS pick
          FROM edf WHERE slot < {PERIOD - 1})),
      plan AS (SELECT (SELECT names FROM l)[pick] AS s, done[pick] - 1 AS j, slot FROM edf WHERE slot >= 0),
      first_missing AS (SELECT min(((n // {BLOCK_DOCS}) // w) * {PERIOD} + slot) AS horizon FROM w JOIN plan USING (s) WHERE j = (n // {BLOCK_DOCS}) % w),
      r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS mix_rank FROM d),
      b AS (SELECT r.*, mix_rank // {BLOCK_DOCS} AS mix_block, w FROM r JOIN w USING (s))
    SELECT doc_id, source, mix_rank, mix_block, (mix_block // w) * {PERIOD} + slot AS mix_slot,
      ((mix_block // w) * {PERIOD} + slot) * {BLOCK_DOCS} + mix_rank % {BLOCK_DOCS} AS mix_position,
      (mix_block // w) * {PERIOD} + slot < (SELECT horizon FROM first_missing) AS in_mix
    FROM b JOIN plan ON plan.s = b.s AND plan.j = b.mix_block % w""",
}
