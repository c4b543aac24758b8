"""Embedding near-dedup: a subspace pigeonhole join.

Cosine of at least t between unit vectors is a squared distance of at most D = 2 - 2t. Equal vectors are made one first.
The rest are rotated by a fixed random rotation, which spreads their variance evenly, and split into blocks of WIDTH
dimensions. If the whole squared distance is within D, some block's is within D in proportion to its dimensions, so the
union of one range join for each block misses no pair. A block's range join puts vectors into cells of a grid over its
leading dimensions; a vector visits those neighbouring cells, on one side, that lie within the block's radius. Within a
cell block distances are one matrix product, and what is within the budget is verified on the whole vectors. Blocks of
16 dimensions let few pairs by that are far from each other: at a cosine of 0.9, 2 in a million random ones.

A pair counts in the first block that finds it, so none counts twice. Cells give no pairs, but for each vector how many
links it has there and one that it is joined to, so what comes out is never more than what went in, however many near
vectors a group has. Crowded cells are split into pairs of chunks of bounded bytes; no partner is dropped. A group of m
different vectors near each other still costs m * m / 2 distances.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, read, shared_dir, stored
from tidemark.llm.graph import components, join_up

THRESHOLD, WIDTH, GRID, CELL_BYTES, SEED = 0.9, 16, 2, 64 << 20, 7
SLACK = 1e-5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a column of lists of dim numbers, scaled to length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(vectors: DataFrame, dim: int, threshold: float = THRESHOLD, width: int = WIDTH, grid: int = GRID, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(id, n, other) for different vectors (id, v) of dim dimensions: n of the vectors of at least the threshold's cosine,
    and one that it is joined to. A vector has a row for each cell in which it has either; n is to be summed."""
    kind = dict(vectors.dtypes)["id"]
    cell_rows = max(2, cell_bytes // (24 * dim + 64))
    cuts = np.linspace(0, dim, -(-dim // width) + 1).round().astype(int)
    parts = [(int(a), int(b)) for a, b in itertools.pairwise(cuts)]
    budget = np.array([(2 - 2 * threshold) * (b - a) / dim for a, b in parts])
    turn = rotation(dim)
    offsets = {g: [o for o in itertools.product((0, 1, -1), repeat=g) if o > (0,) * g or not any(o)] for g in range(1, grid + 1)}

    def cells(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            x = _unit(v, dim) @ turn
            for b, (lo, hi) in enumerate(parts):
                g, r = min(grid, hi - lo), float(np.sqrt(budget[b] * (1 + SLACK)) + SLACK)
                y = x[:, lo : lo + g]
                home = np.floor(y / (2 * r)).astype(np.int64)
                frac = y - home * 2 * r
                for o in offsets[g]:
                    near = np.ones(len(y), bool)
                    for d, s in enumerate(o):
                        near &= (frac[:, d] >= r) if s > 0 else (frac[:, d] <= r) if s < 0 else True
                    at = np.flatnonzero(near)
                    cell = np.zeros(len(at), np.int64)
                    for d in range(g):
                        cell = (cell << 20) + (home[at, d] + o[d] + (1 << 19))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([ids.take(take), v.take(take), pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(np.full(len(at), any(o)))], ["id", "v", "b", "cell", "visits"])

    rows = vectors.select("id", "v").mapInArrow(cells, f"id {kind}, v array<float>, b int, cell long, visits boolean")
    crowded = rows.groupBy("b", "cell").count().where(F.col("count") > cell_rows).select("b", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    rows = rows.join(stored(crowded, "crowded"), ["b", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("id", "v", "b", "cell", "visits", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        b, i, j = (key[k].as_py() for k in (0, 2, 3))
        visits, chunk = table.column("visits").to_numpy(), table.column("chunk").to_numpy()
        unit = _unit(table.column("v"), dim)
        x = unit @ turn
        lo, hi = parts[b]
        y = x[:, lo:hi].astype(np.float32)
        norm = (y * y).sum(axis=1)
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        n, label = np.zeros(len(y), np.int64), np.arange(len(y))
        one = np.ones(len(y), np.float32)
        rows_in, columns_in = np.stack([*(-2 * y.T), norm, one], axis=1)[left], np.stack([*y.T, one, norm])[:, right]  # their product is the distances
        step = max(1, 1_000_000 // max(1, len(right)))
        for s in range(0, len(left), step):
            from_ = s if i == j else 0  # pairs before have been seen from the other side
            near = rows_in[s : s + step] @ columns_in[:, from_:] <= np.float32(budget[b] + 1e-4)
            p, q = np.divmod(np.flatnonzero(near), near.shape[1])
            p, q = left[s + p], right[from_ + q]
            keep = ~(visits[p] & visits[q])
            if i == j:
                keep &= p < q
            p, q = p[keep], q[keep]
            for t in range(0, len(p), 50_000):
                u, w = p[t : t + 50_000], q[t : t + 50_000]
                like = np.einsum("ij,ij->i", unit[u], unit[w]) >= threshold
                u, w = u[like], w[like]
                gap = (x[u] - x[w]) ** 2
                within = np.stack([gap[:, k:m].sum(axis=1) <= budget[c] * (1 + SLACK) + 1e-9 for c, (k, m) in enumerate(parts)], axis=1)
                mine = within.argmax(axis=1) == b
                n += np.bincount(u[mine], minlength=len(n)) + np.bincount(w[mine], minlength=len(n))
                join_up(label, u, w)
        ids = table.column("id").combine_chunks()
        on = np.flatnonzero((n > 0) | (label != np.arange(len(n))))
        return pa.table([ids.take(pa.array(on)), pa.array(n[on]), ids.take(pa.array(label[on]))], ["id", "n", "other"])

    return rows.groupBy("b", "cell", "i", "j").applyInArrow(join, f"id {kind}, n long, other {kind}")


def classes(df: DataFrame, id_col: str, vector_col: str, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(id_col, class_id, links, copies), a row for each id: class_id is the least id that it is joined to by links, links
    the number of different vectors, other than its own, of at least the threshold, copies that of other ids of its vector.

    Null vectors, vectors of another dimension than most (the greater one of two as common), of norm 0, or with a null or
    non-finite part are classes of their own. Repeated rows of one id are one (of the least of its sound vectors). Rows
    without id come out together as one, without class, links and copies. An empty table gives no rows. Other columns of
    df, whatever their names, are left out.
    """
    spark = df.sparkSession
    shared_dir(spark)
    every = pick(df, id_col, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    sound = every.where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    common = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    every = every.select("id").distinct()
    if common is None:
        return every.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), *[F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias(c) for c in ("links", "copies")])
    sound = stored(sound.where(F.size("v") == int(common[0])).groupBy("id").agg(F.min("v").alias("v")), "sound")
    single = stored(sound.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "single")
    found = stored(links(single, int(common[0]), threshold, **how), "links")
    roots = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    known = single.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("v", F.coalesce("root", "id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("links"), (F.col("rows") - 1).alias("copies"))
    of = sound.join(known, "v").select("id", "class_id", "links", "copies")
    out = every.join(of, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), *[F.when(F.col("id").isNotNull(), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("links", "copies")])
    return out.withColumnRenamed("id", id_col)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


ORACLE = {
    "op2_embedding_dedup": f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1),
      one AS MATERIALIZED (SELECT v, min(vec_id) AS id, count(*) AS n FROM v GROUP BY v),
      pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
      reached AS (SELECT id AS x, id AS y FROM one UNION SELECT r.x, p.b FROM reached r JOIN pairs p ON r.y = p.a),
      root AS (SELECT x AS id, min(y) AS class_id FROM reached GROUP BY 1),
      many AS (SELECT a AS id, count(*) AS links FROM pairs GROUP BY 1)
    SELECT vec_id, class_id, coalesce(links, 0) AS links, n - 1 AS copies
    FROM v JOIN one USING (v) JOIN root ON root.id = one.id LEFT JOIN many ON many.id = one.id""",
}
