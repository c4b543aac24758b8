"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the bytes of whole texts, vectorised over a batch of documents. Trees are grown level by
level on histograms of binned statistics, with logistic loss, and kept as flat arrays (feature, threshold and leaf of
complete trees), which numpy walks for all documents of a batch at once. Only the fit runs on the driver, on a bounded
sample of labelled rows; every document is scored where it lies, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, fresh, mix64, pick, read, schema_and, text_bytes, text_chunks, word_hashes

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 60, 4, 64, 0.2, 10, 1.0
KEEP = 0.5
FEATURES = ("log_bytes", "log_words", "word_length", "letters", "digits", "spaces", "stops", "symbols", "pipes", "upper", "lines", "beyond_ascii", "symbols_a_word", "stops_a_word", "distinct_words", "distinct_bigrams")

_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _PIPE, _BEYOND, _SYMBOL = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[124] = _LETTER, _UPPER, _DIGIT, _BEYOND, _PIPE
for _c in b" \t\r\v\f":
    _CLASS[_c] = _SPACE
for _c in b".,;:?!'\"()-":
    _CLASS[_c] = _STOP
_CLASS[10] = _LINE


def _distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts, how many different hashes it has; of tells each hash's text."""
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all zero, but for ratios of nothing (which are zero too), for an empty one."""
    out = np.zeros((len(off) - 1, len(FEATURES)), np.float32)
    for i, j in text_chunks(off):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        n, size = j - i, np.diff(at)
        count = np.bincount(np.repeat(np.arange(n, dtype=np.int64) * 9, size) + _CLASS[part], minlength=9 * n).reshape(n, 9).astype(np.float64)
        hashes, starts = word_hashes(part, at)
        words = np.diff(starts)
        of = np.repeat(np.arange(n), words)
        with np.errstate(over="ignore"):
            pairs = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
        within = of[:-1] == of[1:]
        b, w, twos = np.maximum(size, 1), np.maximum(words, 1), np.maximum(words - 1, 1)
        inside = count[:, [_LETTER, _UPPER, _DIGIT, _BEYOND]].sum(axis=1)
        out[i:j] = np.stack(
            [np.log1p(size), np.log1p(words), inside / w, count[:, _LETTER] / b, count[:, _DIGIT] / b, count[:, _SPACE] / b, count[:, _STOP] / b, count[:, _SYMBOL] / b, count[:, _PIPE] / b, count[:, _UPPER] / b, count[:, _LINE] / b, count[:, _BEYOND] / b]
            + [(count[:, _SYMBOL] + count[:, _PIPE]) / w, count[:, _STOP] / w, _distinct(hashes, of, n) / w, _distinct(pairs[within], of[:-1][within], n) / twos],
            axis=1,
        )
    return out


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes by level order, and the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality for each row."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].sum() < inner and len(x):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST, l2: float = L2) -> Trees:
    """Trees for labels y of 0 and 1. With no rows or one class: no trees, and that class's (smoothed) share; with no rows 1."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 1) if not len(y) or y[0] else 1 / (len(y) + 2)
        share = min(share, 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.float32), np.zeros((0, 2**depth)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, inner = np.full(n, base), 2**depth - 1
    features, thresholds, leaves = [], [], []
    spread = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + spread + codes).ravel()
            hist = [np.bincount(at, np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gt, ht, nt = (v[:, :1, -1:] for v in hist)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most `rows` labelled documents: those whose ids have the least hashes.

    Labels without id or quality are left out; an id labelled differently in several rows counts as good from a mean of
    a half. Repeated documents count as often as they come, ids without a document not at all.
    """
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def each(batches):
        for batch in batches:
            x = statistics(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    found = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")  # `rows` ids at most
    got = found.mapInArrow(each, "doc_id long, quality int, x array<float>").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T[::-1], got["quality"].to_numpy(), got["doc_id"].to_numpy()))
    return fit(x[order], got["quality"].to_numpy()[order])


def score(docs: DataFrame, model: Trees, keep: float | None = None, name: str = "score") -> DataFrame:
    """docs with a column `name` (any of that name is replaced); with keep, only rows of that score at least.

    A null text is scored as an empty one, texts of any length whole. Repeated rows score alike; an empty table gives no
    rows. Other columns of docs stay.
    """
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, name]

    def each(batches):
        for batch in batches:
            p = sent.value.score(statistics(*text_bytes(batch.column("text"))))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names)
            yield out if keep is None else out.filter(pa.array(p >= keep))

    return docs.mapInArrow(each, schema_and(docs, **{name: "double"}))


def kept(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier, fitted on these documents' labels, does not reject.

    Null and empty texts are scored like others; where no document has a label all stay. All columns of docs stay,
    whatever their names; repeated rows stay or go together; an empty table gives no rows.
    """
    own = documents_of(docs)
    return score(own, trained(own, labels), keep, *fresh(own, "score")).select(*own.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score(docs, trained(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= KEEP).alias("keep"))
