"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is a vector of shingles (runs of WIDTH words), each weighing its count times ln(1 + N / df), df being the
number of all N documents that have it. Every shingle's df is counted: documents are in blocks by hash, each block sends
its distinct shingles by range of hash, and gets back the df of those that it isn't alone with. No table of them is ever
on the driver or sent to all.

Each sample of consistent weighted sampling is a pair (shingle, level) that two documents share with the probability
of their weighted Jaccard similarity. BANDS bands of ROWS samples are hashed. Documents with equal vectors are set
aside first; the rest are linked to the least document of each band that they share. The linked components are brought
together and verified by exact similarity, whole: within one, a document is compared with all that no one has reached
yet, over the shingles they share, so a group of copies costs about its own size and no pair is capped. Components too
large for one task are split into chunks; after each chunk has been verified with the component's root, what isn't
joined to the root is compared with all chunks. Groups are the components of the verified pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, dropped, fresh, given_back, may_hold, mix64, pick, read, shared_dir, stored, text_bytes, text_chunks, word_hashes
from tidemark.llm.graph import components

WIDTH, RARE, THRESHOLD, BANDS, ROWS, SEED = 3, 0.0, 0.5, 20, 3, 11  # RARE: a share of documents below which shingles weigh the same
BLOCK_BYTES = 8 << 20
TASK_BYTES = 8 << 20
CHUNK_BYTES = 16 << 20
NODE = "struct<i:bigint,h:bigint>"
_NULL_ID = -(2**63)
_ARROW_NODE = pa.struct([("i", pa.int64()), ("h", pa.int64())])  # without "not null", which Spark would refuse


# ---------------------------------------------------------------- vectors


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text, sorted by text and shingle. A text of fewer words
    than width has one shingle of all its words, one without words none."""
    hashes, starts = word_hashes(data, off)
    words = np.diff(starts)
    n = np.where(words > 0, np.maximum(words - (width - 1), 1), 0)
    of = np.repeat(np.arange(len(words)), n)
    at = starts[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    end = starts[1:][of]
    mixed = np.zeros(len(of), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = at + k < end
            part = np.zeros(len(of), np.uint64)
            part[here] = hashes[(at + k)[here]]
            mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
    key = np.sort((of.astype(np.uint64) << np.uint64(44)) | (mix64(mixed) >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64(2**44 - 1), count


class Weights:
    """Weights of shingles: common are sorted shingles with their documents' numbers among n documents; others have one."""

    def __init__(self, n: int, common: np.ndarray, df: np.ndarray, rare: float = RARE):
        self.common, least = common, max(rare * n, 1.0)
        self.value = np.log(1 + n / np.maximum(df, least)).astype(np.float32)
        self.other = np.float32(np.log(1 + n / least)) if n else np.float32(1)

    def of(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(len(shingle), self.other, np.float32)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingle), len(self.common) - 1)
            hit = self.common[at] == shingle
            w[hit] = self.value[at[hit]]
        return w * count.astype(np.float32)


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / 65536: the value, its logarithm; and logarithms within the first step."""

    def inverse(u: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            less = -np.expm1(-mid) - mid * np.exp(-mid) < u
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return hi

    u = (np.arange(65536) + 0.5) / 65536
    value = inverse(u)
    fine = np.sqrt(2 * u / 65536)  # for small x the distribution function is x^2 / 2
    return value.astype(np.float32), np.log(value).astype(np.float32), np.log(fine).astype(np.float32)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, many: int, seed: int = SEED) -> np.ndarray:
    """(n, many) hashes of consistent weighted samples of n vectors, given by sorted doc; zero for an empty one."""
    out = np.zeros((n, many), np.uint64)
    if not len(doc):
        return out
    gamma, log_gamma, fine = _quantiles()
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size, own = np.diff(np.append(starts, len(doc))), doc[starts]
    log_w = np.log(weight)
    with np.errstate(over="ignore"):
        base = mix64(shingle)
        z, half = np.empty_like(base), np.empty_like(base)
        for k in range(many):
            np.multiply(base, np.uint64(2 * k + 3), out=z)
            z += np.uint64(seed)
            z ^= np.right_shift(z, np.uint64(32), out=half)
            z *= np.uint64(0xD6E8FEB86659FD93)
            z ^= np.right_shift(z, np.uint64(32), out=half)
            low, middle, high, top = z.astype("<u8", copy=False).view("<u2").reshape(-1, 4).T
            r, c = np.take(gamma, top), np.take(log_gamma, middle)
            tiny = np.flatnonzero(middle == 0)
            c[tiny] = fine[low[tiny]]
            b = high / np.float32(65536)
            t = log_w / r
            t += b
            np.floor(t, out=t)
            # a = c - r * (t - b) - r, in place
            np.subtract(t, b, out=b)
            b *= r
            c -= b
            c -= r
            least = np.minimum.reduceat(c, starts)
            at = np.flatnonzero(c == np.repeat(least, size))
            if len(at) > len(starts):  # of equal ones the first
                at = at[np.r_[True, doc[at[1:]] != doc[at[:-1]]]]
            out[own, k] = mix64(shingle[at] * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).view(np.uint64))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of the rows of each band."""
    out = np.empty((len(signature), bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signature), b + 1, np.uint64)
            for k in range(rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, b * rows + k])
            out[:, b] = key.view(np.int64)
    return out


def vectors(column, width: int, weights: Weights | None):
    """(i, j, text, shingle, count, weight) of the texts i to j of a column, in chunks; text counts from i."""
    data, off = text_bytes(column)
    for i, j in text_chunks(off):
        doc, shingle, count = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
        yield i, j, doc, shingle, count, weights.of(shingle, count) if weights else None


# ---------------------------------------------------------------- document frequencies


def packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by bytes of the same rank, which compress well."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def document_frequencies(texts: DataFrame, ranges: int, width: int = WIDTH) -> DataFrame:
    """(block, keys, df) for texts (block, text): of each block's shingles those that two documents at least have, with
    the number of all documents that do. A block has a row for each of `ranges` ranges of hashes."""

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        found = [shingle for _, _, _, shingle, _, _ in vectors(table.column("text"), width, None)]
        s, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        cut = np.searchsorted(s, np.array([(b << 44) // ranges for b in range(ranges)] + [1 << 44], np.uint64))
        on = np.flatnonzero(np.diff(cut))
        parts = [(cut[b], cut[b + 1]) for b in on]
        return pa.table([pa.array([key[0].as_py()] * len(on), pa.int64()), pa.array(on, pa.int64()), pa.array([packed(s[a:b]) for a, b in parts], pa.binary()), pa.array([count[a:b].astype(np.int32).tobytes() for a, b in parts], pa.binary())], ["block", "range", "keys", "n"])

    def summed(table: pa.Table) -> pa.Table:
        keys = [unpacked(k) for k in table.column("keys").to_pylist()]
        count = np.concatenate([np.frombuffer(n, np.int32) for n in table.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(at, count).astype(np.int64)[at]
        cut = np.cumsum([0, *map(len, keys)])
        own = [(k[d > 1], d[d > 1]) for k, d in ((k, df[a:b]) for k, a, b in zip(keys, cut[:-1], cut[1:], strict=True))]
        return pa.table([table.column("block"), pa.array([packed(k) for k, _ in own], pa.binary()), pa.array([d.tobytes() for _, d in own], pa.binary())], ["block", "keys", "df"])

    sent = texts.groupBy("block").applyInArrow(lambda key, table: given_back(distinct(key, table)), "block long, range long, keys binary, n binary")
    return sent.groupBy("range").applyInArrow(lambda table: given_back(summed(table)), "block long, keys binary, df binary")


def weights_of(known: pa.Table, n: int, rare: float) -> Weights:
    """The weights of a block, by its rows of document_frequencies."""
    keys = [unpacked(k) for k in known.column("keys").to_pylist()]
    if not keys:
        return Weights(n, np.zeros(0, np.uint64), np.zeros(0), rare)
    s, df = np.concatenate(keys), np.concatenate([np.frombuffer(d, np.int64) for d in known.column("df").to_pylist()])
    order = np.argsort(s)
    return Weights(n, s[order], df[order].astype(np.float64), rare)


# ---------------------------------------------------------------- verification


def _reach(own: np.ndarray, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, total: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (document, document) of the threshold at least that join the documents `own` as all such pairs would.
    doc, shingle and weight are their vectors' parts, sorted by document; total is each document's sum of weights."""
    lo, hi = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
    spans = dict(zip(own.tolist(), zip(lo.tolist(), hi.tolist(), strict=True), strict=True))
    if len(own) == 2:
        (a, b), (c, d) = spans[int(own[0])], spans[int(own[1])]
        _, x, y = np.intersect1d(shingle[a:b], shingle[c:d], assume_unique=True, return_indices=True)
        shared = float(np.minimum(weight[a:b][x], weight[c:d][y]).sum(dtype=np.float64))
        near = shared >= threshold * (total[own[0]] + total[own[1]] - shared) * (1 - 1e-6)
        return [(int(own[0]), int(own[1]))] if near else []
    order = np.argsort(shingle, kind="stable")
    p_shingle, p_doc, p_weight = shingle[order], doc[order], weight[order]
    left = np.zeros(len(total), bool)
    left[own] = True
    held, out = len(own), []
    for start in own.tolist():
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            rest = int(left[own].sum())
            if not rest:
                return out
            if rest < held / 2:
                keep = left[p_doc]
                p_shingle, p_doc, p_weight, held = p_shingle[keep], p_doc[keep], p_weight[keep], rest
            a, b = spans[u]
            first, last = np.searchsorted(p_shingle, shingle[a:b], "left"), np.searchsorted(p_shingle, shingle[a:b], "right")
            n = last - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            shared = np.bincount(p_doc[at], np.minimum(p_weight[at], np.repeat(weight[a:b], n)), len(total))
            near = np.flatnonzero(left & (shared >= threshold * (total[u] + total - shared) * (1 - 1e-6)) & (shared > 0))
            left[near] = False
            out += [(u, int(v)) for v in near]
            queue += near.tolist()
    return out


def near_edges(shingle_sets: list[np.ndarray], weight_sets: list[np.ndarray], component: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs of rows (their vectors are given) of one component that join its rows as all pairs of the threshold at least would."""
    if not len(component):
        return []
    doc = np.repeat(np.arange(len(component)), [len(x) for x in shingle_sets])
    shingle, weight = np.concatenate(shingle_sets), np.concatenate(weight_sets)
    total = np.bincount(doc, weight, len(component))
    order = np.argsort(component, kind="stable")
    cut = np.flatnonzero(np.r_[True, component[order][1:] != component[order][:-1], True])
    starts = np.searchsorted(doc, np.arange(len(component) + 1), "left")
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = np.sort(order[a:b])
        if len(own) > 1:
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in own])
            local = np.searchsorted(own, doc[at])
            out += [(int(own[u]), int(own[v])) for u, v in _reach(np.arange(len(own)), local, shingle[at], weight[at], total[own], threshold)]
    return out


# ---------------------------------------------------------------- groups


def _node() -> F.Column:
    return F.struct(F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, rare: float = RARE, task_bytes: int = TASK_BYTES, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, n, root) of every document: node is its id and its text's hash, n how many rows it has, root the least
    node of its group. Groups are joined by pairs whose similarity is the threshold at least, among documents that bands
    link, directly or by others.

    Texts without words (null and empty ones too) are in groups of their own. A null id counts as the least of bigints.
    Texts of any length are compared whole; rows of the same id and text are one document, and lie in one block. Columns
    besides doc_id and text are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    own = pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})
    total, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = int(-(-(size + 64 * total) // block_bytes)) or 1
    texts = own.select(_node().alias("node"), "text").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)))
    known = stored(document_frequencies(texts.select("block", "text"), blocks, width), "frequencies")

    def sign(own: pa.Table, known: pa.Table) -> pa.Table:
        column, weights = own.column("text"), weights_of(known, total, rare)
        size = np.diff(text_bytes(column)[1])
        keys, prints, some = np.zeros((len(size), bands), np.int64), np.zeros((2, len(size)), np.uint64), np.zeros(len(size), bool)
        for i, j, doc, shingle, count, weight in vectors(column, width, weights):
            if not len(doc):
                continue
            keys[i:j] = band_keys(samples(doc, shingle, weight, j - i, bands * rows), bands, rows)
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            with np.errstate(over="ignore"):
                for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    prints[k, i + doc[starts]] = np.add.reduceat(mix64(shingle * np.uint64(odd) + count.astype(np.uint64)), starts)
            some[i + doc[starts]] = True
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
        return pa.table([own.column("node").cast(_ARROW_NODE), pa.array(size), pa.array(some), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), listed], ["node", "size", "some", "p", "q", "keys"])

    signed = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda own, known: given_back(sign(own, known)), f"node {NODE}, size long, some boolean, p long, q long, keys array<long>")
    signed = stored(signed, "signed")
    # of equal vectors the least document stands for all; grouped minima are combined before the shuffle
    least = signed.where("some").groupBy("p", "q").agg(F.min("node").alias("least"))
    lined = signed.where("some").join(least, ["p", "q"]).select("node", "least", "size", F.when(F.col("node") == F.col("least"), F.col("keys")).alias("keys"))
    lined = stored(lined, "lined")
    equal = lined.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    banded = lined.where("node = least").select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    linked = banded.join(shared, "key").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    parts = components(linked)
    members = parts.select(F.col("node").alias("node"), "root").unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(lined.where("node = least").select("node", "size").distinct(), "node")
    bulk = members.groupBy("root").agg(F.sum("size").alias("bytes"))
    members = stored(members.join(bulk, "root").withColumn("chunks", F.ceil(F.col("bytes") / chunk_bytes).cast("int")), "members")
    small = members.where("chunks <= 1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = int(max(1, -(-small // task_bytes)))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ri", "rh", "i", "h"], kind="stable").reset_index(drop=True)
        component = pdf.groupby(["ri", "rh"], sort=False).ngroup().to_numpy()
        vectors = [unpacked(s) for s in pdf["s"]], [np.frombuffer(w, np.float32) for w in pdf["w"]]
        found = np.array(near_edges(*vectors, component, threshold), np.int64).reshape(-1, 2)
        i, h = pdf["i"].to_numpy(), pdf["h"].to_numpy()
        return pd.DataFrame({"ui": i[found[:, 0]], "uh": h[found[:, 0]], "vi": i[found[:, 1]], "vh": h[found[:, 1]]})

    def weighed(own: pa.Table, known: pa.Table) -> pa.Table:
        weights, s, w = weights_of(known, total, rare), [], []
        for i, j, doc, shingle, _, weight in vectors(own.column("text"), width, weights):
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            s += [packed(shingle[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            w += [weight[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([own.column("node").cast(_ARROW_NODE), pa.array(s, pa.binary()), pa.array(w, pa.binary())], ["node", "s", "w"])

    texts = texts.where(may_hold(members, F.xxhash64("node"))(F.xxhash64("node")))  # texts that have nothing to meet stay where they are
    compared = stored(texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda own, known: given_back(weighed(own, known)), f"node {NODE}, s binary, w binary"), "vectors")
    repeated = not signed.groupBy("node").count().where("count > 1").limit(1).isEmpty()

    def verified(placed: DataFrame) -> DataFrame:
        """Edges (u, v) of the tasks of placed (node, root, task)."""
        met = compared.join(placed, "node").select("task", F.col("root.i").alias("ri"), F.col("root.h").alias("rh"), F.col("node.i").alias("i"), F.col("node.h").alias("h"), "s", "w")
        met = met.dropDuplicates(["task", "i", "h"]) if repeated else met
        found = met.groupBy("task").applyInPandas(lambda pdf: given_back(verify(pdf)), "ui long, uh long, vi long, vh long")
        return found.select(F.struct(F.col("ui").alias("i"), F.col("uh").alias("h")).alias("u"), F.struct(F.col("vi").alias("i"), F.col("vh").alias("h")).alias("v"))

    def task(*parts: str) -> F.Column:
        return F.concat_ws("_", "root.i", "root.h", *parts).alias("task")

    # components that fit one task share it with others; of a larger one each chunk is a task, with the root's text too
    whole = members.where("chunks <= 1").select("node", "root", F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("task"))
    large = members.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    heads = large.select("root", "chunks").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunked = large.select("node", "root", task("chunk")).unionByName(heads.select(F.col("root").alias("node"), "root", task("chunk"))).distinct()
    edges = found = stored(verified(whole.unionByName(chunked)), "verified")
    if not large.limit(1).isEmpty():
        # what isn't joined to the root by now is compared with every chunk; the rest is one group already
        marked = large.join(components(edges).withColumnRenamed("root", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node"))
        marked = stored(marked.join(marked.where("node = root").select("root", F.col("joined").alias("head")), "root"), "marked")
        loose = marked.where("joined <> head")
        share = loose.groupBy("root").agg(F.ceil(F.sum("size") / chunk_bytes).cast("int").alias("parts"))
        loose = loose.join(share, "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
        loose = loose.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "root", task("chunk", "part"))
        against = large.join(share, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "root", task("chunk", "part"))
        edges = edges.unionByName(verified(loose.unionByName(against).distinct()))
    roots = components(equal.unionByName(edges))
    dropped(known, lined, members, compared, found)
    every = signed.groupBy("node").agg(F.count("*").alias("n"))
    return every.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but one of each group, the one of the least id (ties by hash of the text); of repeated
    rows one stays, those without words too.

    Texts that are null, empty or without words, of any ids, are like no other. Null ids come before all others. Whole texts
    are compared, of any length. All columns of docs stay, whatever their names. An empty table gives no rows.
    """
    own = documents_of(docs)
    found = stored(groups(own, **how), "groups")
    node, may = fresh(own, "node", "may")
    keyed = own.withColumn(node, _node())
    copies = found.where("node <> root").select(F.col("node").alias(node))
    tested = keyed.withColumn(may, may_hold(copies, F.xxhash64(node))(F.xxhash64(node)))  # texts that surely stay are not shuffled
    out = tested.where(F.col(may)).join(copies, node, "left_anti").unionByName(tested.where(~F.col(may))).drop(may)
    again = found.where("node = root AND n > 1").select(F.col("node").alias(node))
    if not again.limit(1).isEmpty():
        once = out.join(again, node, "left_semi").dropDuplicates([node])
        out = out.join(again, node, "left_anti").unionByName(once)
    return out.select(*own.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group's least id, and whether it stays; rows of the same id and text count as one."""
    found = groups(read(spark, sf_dir, "documents"))
    return found.select(F.when(F.col("node.i") != _NULL_ID, F.col("node.i")).alias("doc_id"), F.when(F.col("root.i") != _NULL_ID, F.col("root.i")).alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))
