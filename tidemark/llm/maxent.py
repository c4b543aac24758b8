"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) P(word | class, context). Active features of a position are a bias, the word
before, the two words before, and, skipping, the second and the third word before; each is hashed to a row of weights,
one for each class, and together with the class to a row of one for each word of the class. The commonest words of the
corpus, counted over all of it, have classes by rank; all others share hashed places in the remaining classes, and have
P(word | place) as a further factor: n / (N + 1), of the word's and its place's counts over the whole corpus. The 1 is
for all words that the corpus doesn't have, so the probabilities of a place's words sum to one.

Training goes over every document once, in ROUNDS disjoint parts. A document's part and shard follow from a hash of its id
and text, and the number of shards from the corpus's bytes, so the model is the same however the rows are laid out in
files. In a round each shard starts from the weights sent out, descends the gradient of its own batches (AdaGrad with a
rate for each row), and gives back the change of the rows that it touched with how often it did. Changes are averaged by
that over all shards, by blocks of rows, in a tree whose nodes have FAN branches at most: a task never holds more than FAN
blocks, however many shards there are. So what is gathered grows with the corpus, while the model, of a fixed size, can
be sent to every executor. Scoring is one pass over the texts: rows of weights are gathered for a batch of positions,
added up and normalised in numpy. The counts of all words don't fit an executor: they are joined to the distinct words of
each run of texts, and go back to the run.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import PIECE, dropped, mix64, pick, read, schema_and, shared_dir, stored, text_bytes, text_chunks, word_hashes

CLASSES, IN_CLASS, TAIL_CLASSES = 32, 32, 8
CLASS_ROWS, WORD_ROWS, FEATURES = 1 << 14, 1 << 15, 5
ROUNDS, BATCH, RATE, SHARD_BYTES = 2, 4096, 0.2, 8 << 20
BLOCK_ROWS, RUN_BYTES, FAN, COUNTED = 1024, 8 << 20, 64, 8
FAR = 60  # exp of it, and the sum of as many as a row has, are well within 32 bits
START = np.uint64(0x5851F42D4C957F2D)  # stands for the words before a text


@dataclass
class Model:
    """own: sorted hashes of words with places of their own, place: theirs; by_class and by_word: rows of weights.
    rest: (word, n) of all other words, on the driver only; held: the sum of n of each of their places."""

    own: np.ndarray
    place: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray
    rest: DataFrame | None = None
    held: np.ndarray | None = None

    @classmethod
    def of(cls, ranked: np.ndarray, class_rows: int = CLASS_ROWS, word_rows: int = WORD_ROWS) -> Model:
        """A model without any knowledge for words ranked by how common they are."""
        order = np.argsort(ranked)
        return cls(ranked[order], order.astype(np.int32), np.zeros((class_rows, CLASSES), np.float32), np.zeros((word_rows, IN_CLASS), np.float32))

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place: its class is place // IN_CLASS."""
        first = (CLASSES - TAIL_CLASSES) * IN_CLASS
        out = (first + ((words >> np.uint64(20)) % np.uint64(TAIL_CLASSES * IN_CLASS)).astype(np.int32)).astype(np.int32)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            hit = self.own[at] == words
            out[hit] = self.place[at[hit]]
        return out


def contexts(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(n, FEATURES) hashes of the features of each position of texts, whose words begin at starts."""
    n = len(words)
    nth = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    before = []
    for k in (1, 2, 3):
        w = np.full(n, START, np.uint64)
        w[k:][nth[k:] >= k] = words[:-k][nth[k:] >= k] if n > k else words[:0]
        before.append(w)
    one, two, three = before
    with np.errstate(over="ignore"):
        odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
        return np.stack([np.full(n, np.uint64(12345)), mix64(one * odd[0]), mix64(one * odd[1] ^ two * odd[2]), mix64(two * odd[3]), mix64(three * odd[2] + np.uint64(7))], axis=1)


def rows_of(feature: np.ndarray, klass: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the class weights and, given each position's class, of the word weights; 16 bits sort fast."""
    c = (feature & np.uint64(len(model.by_class) - 1)).astype(np.uint16)
    with np.errstate(over="ignore"):
        w = ((feature >> np.uint64(17)) + (klass.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(23)
    return c, (w & np.uint64(len(model.by_word) - 1)).astype(np.uint16)


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(weights, rows[:, 0], axis=0)
    part = np.empty_like(z)
    for f in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, f], axis=0, out=part, mode="clip")  # rows are below the weights' number: nothing is clipped
    if max(z.max(initial=0), -z.min(initial=0)) > FAR:  # only where exp could leave the range of its type
        far = np.flatnonzero((np.abs(z) > FAR).any(axis=1))
        z[far] -= z[far].max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / np.einsum("ij->i", z))[:, None]
    return z


def log2_probabilities(model: Model, words: np.ndarray, starts: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """log2 P of each word of texts given those before it in its text."""
    out = np.empty(len(words))
    place = model.places(words)
    feature = contexts(words, starts)
    for a in range(0, len(words), batch):
        p = place[a : a + batch]
        klass, inner, at = p // IN_CLASS, p % IN_CLASS, np.arange(len(p))
        c, w = rows_of(feature[a : a + batch], klass, model)
        out[a : a + batch] = np.log2(np.maximum(_softmax(model.by_class, c)[at, klass].astype(np.float64) * _softmax(model.by_word, w)[at, inner], 1e-30))
    return out


def _sums(x: np.ndarray, of: np.ndarray, first: np.ndarray, count: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(order, sums) of runs of x[of], the longer runs first; x[of] itself is never made. Most runs are short, and are added
    up a row of all of them at a time; what long ones have beyond `few` rows is left to reduceat, which is slow only by run."""
    order = np.argsort((few + 1 - np.minimum(count, few + 1)).astype(np.uint8), kind="stable")
    first, count = first[order], count[order]
    longer = np.searchsorted(-np.minimum(count, few + 1), -np.arange(few + 1), "left")  # by k, how many runs have more than k rows
    out = np.take(x, of[first], axis=0)
    for k in range(1, few):
        if not (n := longer[k]):
            break
        out[:n] += np.take(x, of[first[:n] + k], axis=0)
    if n := longer[few]:
        rest = count[:n] - few
        at = np.repeat(first[:n] + few - np.cumsum(rest) + rest, rest) + np.arange(int(rest.sum()))
        out[:n] += np.add.reduceat(np.take(x, of[at], axis=0), np.cumsum(rest) - rest, axis=0)
    return order, out


def _descend(weights: np.ndarray, past: np.ndarray, touched: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step on the positions of a batch; past: by row the sum of its steps' mean squares, touched: its positions."""
    grad = _softmax(weights, rows)
    grad[np.arange(len(target)), target] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.append(first, len(flat)))
    longest, step = _sums(grad, np.repeat(np.arange(len(rows)), rows.shape[1])[order], first, count)
    hit, count = ordered[first][longest], count[longest]
    touched[hit] += count
    # a row that many positions share moves further, by the root of their number
    seen = past[hit] + np.einsum("ij,ij->i", step, step) / (count * weights.shape[1])
    past[hit] = seen
    step *= (rate / np.sqrt(count * (seen + 1e-4))).astype(np.float32)[:, None]
    weights[hit] -= step


class Shard:
    """Weights of a shard of the corpus on their way."""

    def __init__(self, model: Model):
        self.model = Model(model.own, model.place, model.by_class.copy(), model.by_word.copy())
        self.begun = (model.by_class, model.by_word)
        self.past = tuple(np.zeros(len(w)) for w in self.begun)
        self.touched = tuple(np.zeros(len(w), np.float32) for w in self.begun)

    def learn(self, words: np.ndarray, starts: np.ndarray, batch: int = BATCH, rate: float = RATE) -> None:
        place, feature = self.model.places(words), contexts(words, starts)
        for a in range(0, len(words), batch):
            p = place[a : a + batch]
            c, w = rows_of(feature[a : a + batch], p // IN_CLASS, self.model)
            _descend(self.model.by_class, self.past[0], self.touched[0], c, p // IN_CLASS, rate)
            _descend(self.model.by_word, self.past[1], self.touched[1], w, p % IN_CLASS, rate)

    def changes(self) -> list[tuple[int, int, bytes, bytes, bytes]]:
        """(matrix, block, rows, touched, change) of the rows of each block that were touched."""
        out = []
        for m, (now, then, touched) in enumerate(zip((self.model.by_class, self.model.by_word), self.begun, self.touched, strict=True)):
            for b in range(0, len(now), BLOCK_ROWS):
                on = np.flatnonzero(touched[b : b + BLOCK_ROWS])
                if len(on):
                    change = (now[b + on] - then[b + on]).astype(np.float16)
                    out.append((m, b, on.astype(np.int16).tobytes(), touched[b + on].tobytes(), change.tobytes()))
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word's hash comes in all the texts. A task hashes a piece of a batch at a time, however large
    the batch (a longer text is a piece of its own), and holds the distinct words of COUNTED pieces."""

    def each(batches):
        held = []

        def given():
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            count = np.zeros(len(words), np.int64)
            np.add.at(count, at, np.concatenate([n for _, n in held]))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count)], ["word", "n"])

        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in text_chunks(off):
                held.append(np.unique(word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])[0], return_counts=True))
                if len(held) == COUNTED:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return texts.mapInArrow(each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def summed(changes: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """(m, b, total, count): by block of rows the sum of shards' changes, weighed by how often each touched a row, and of
    those weights; in a tree, each node of which adds at most `fan` shards or nodes, in their order."""

    def leaves(key: tuple, table: pa.Table) -> pa.Table:
        return added(key, table, lambda r, width: (np.frombuffer(r["rows"], np.int16), np.frombuffer(r["touched"], np.float32).astype(np.float64)), lambda r, width, n: np.frombuffer(r["change"], np.float16).reshape(-1, width).astype(np.float64) * n[:, None])

    def nodes(key: tuple, table: pa.Table) -> pa.Table:
        return added(key, table, lambda r, width: (np.arange(BLOCK_ROWS), np.frombuffer(r["count"], np.float64)), lambda r, width, n: np.frombuffer(r["total"], np.float32).reshape(-1, width))

    def added(key, table, weight, change):
        if table.num_rows > fan:
            raise ValueError("a node with too many branches")
        m, b, node = (k.as_py() for k in key)
        width = (CLASSES, IN_CLASS)[m]
        total, count = np.zeros((BLOCK_ROWS, width)), np.zeros(BLOCK_ROWS)
        for r in table.sort_by("node").to_pylist():
            at, n = weight(r, width)
            total[at] += change(r, width, n)
            count[at] += n
        return pa.table([pa.array([m], pa.int32()), pa.array([b], pa.int32()), pa.array([node], pa.int64()), pa.array([total.astype(np.float32).tobytes()]), pa.array([count.tobytes()])], ["m", "b", "node", "total", "count"])

    def up(level: DataFrame, add) -> DataFrame:
        return level.groupBy("m", "b", F.floor(F.col("node") / fan).alias("up")).applyInArrow(add, "m int, b int, node long, total binary, count binary")

    level, left = up(changes, leaves), -(-shards // fan)
    while left > 1:
        level, left = up(level, nodes), -(-left // fan)
    return level


def trained(docs: DataFrame, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES, rate: float = RATE) -> Model:
    """The model that all texts of docs give, in whatever partitions they are. Null, empty and wordless texts teach nothing
    (of no texts the model is blank); repeated rows count as often as they come; texts of any length are read whole. Ids
    may be null. Columns besides doc_id and text are not looked at."""
    spark = docs.sparkSession
    shared_dir(spark)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // (rounds * shard_bytes)))
    texts = texts.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    texts = texts.select("h", "text", F.pmod("h", F.lit(rounds)).alias("part"), F.pmod(F.xxhash64("h"), F.lit(shards)).alias("node"))
    own, shared = (CLASSES - TAIL_CLASSES) * IN_CLASS, TAIL_CLASSES * IN_CLASS
    counts = stored(word_counts(texts.select("text")), "words")
    ranked = counts.orderBy(F.desc("n"), "word").limit(own).toPandas()["word"].to_numpy(np.int64)
    rest = counts.join(F.broadcast(spark.createDataFrame([(int(w),) for w in ranked], "word long")), "word", "left_anti")
    held = np.zeros(shared)
    for place, n in rest.groupBy((F.shiftrightunsigned("word", 20) % shared).alias("place")).agg(F.sum("n")).collect():
        held[place] = n
    model = Model.of(ranked.view(np.uint64))
    for part in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches, sent=sent):
            names = ["node", "m", "b", "rows", "touched", "change"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            now, shard, held, size = None, None, [], 0

            def read_held():
                """The texts held back, as one run: runs begin with a shard and end by its bytes, wherever batches do."""
                if held:
                    at = np.cumsum(np.concatenate([[0], *[np.diff(o) for _, o in held]]))
                    shard.learn(*word_hashes(np.concatenate([d for d, _ in held]), at), rate=rate)

            def given():
                found = shard.changes()
                return pa.RecordBatch.from_arrays([pa.array([now] * len(found), pa.int64()), *[pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds[1:])]], names)

            for batch in batches:
                nodes = batch.column(0).to_numpy()
                data, off = text_bytes(batch.column(1))
                i, edges = 0, np.append(np.flatnonzero(np.diff(nodes)) + 1, len(nodes))
                for edge in edges.tolist():
                    if nodes[i] != now:
                        if shard:
                            read_held()
                            yield given()
                        now, shard, held, size = int(nodes[i]), Shard(sent.value), [], 0
                    while i < edge:
                        j = min(edge, int(np.searchsorted(off, off[i] + PIECE - size, "left")))  # up to the text that fills the run
                        j = max(j, i + 1)
                        held.append((data[off[i] : off[j]], off[i : j + 1]))
                        size += int(off[j] - off[i])
                        i = j
                        if size >= PIECE:
                            read_held()
                            held, size = [], 0
            if shard:
                read_held()
                yield given()

        changes = texts.where(F.col("part") == part).repartition("node").sortWithinPartitions("node", "h").select("node", "text")
        changes = changes.mapInArrow(learn, "node long, m int, b int, rows binary, touched binary, change binary")
        kept = stored(summed(changes, shards), "moved")  # the texts that a round shuffled leave no files for the next
        moved = kept.toPandas()  # the model's size
        dropped(kept)
        now = (model.by_class.copy(), model.by_word.copy())
        for m, b, total, count in zip(moved["m"], moved["b"], moved["total"], moved["count"], strict=True):
            w = now[m]
            change = np.frombuffer(total, np.float32).reshape(-1, w.shape[1]) / np.maximum(np.frombuffer(count, np.float64), 1e-9)[:, None]
            w[b : b + BLOCK_ROWS] += change[: len(w) - b].astype(np.float32)
        model = Model(model.own, model.place, *now)
    return replace(model, rest=rest, held=held)


def counted(scored: DataFrame, rest: DataFrame, id_col: str) -> DataFrame:
    """(id_col, n_words, bits): bits of runs of texts less log2 n of their words in rest, the other part of P(word | place)."""

    def listed(batches):
        for batch in batches:
            for run, words in zip(batch.column(0), batch.column(1), strict=True):
                w = np.frombuffer(words.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), run.as_py(), np.int64)), pa.array(w), pa.array(np.arange(len(w), dtype=np.int32))], ["run", "word", "k"])

    def less(texts: pa.Table, found: pa.Table) -> pa.Table:
        k, n = [found.column(c).to_numpy() for c in ("k", "n")]
        lg = np.zeros(int(k.max()) + 1 if len(k) else 0)
        lg[k] = np.log2(n)
        bits = []
        for b, at in zip(texts.column("bits").to_pylist(), texts.column("at").to_pylist(), strict=True):
            at = np.frombuffer(at, np.int32)
            bits.append(b - float(lg[at[at < len(lg)]].sum()))  # a word without a count has the place's 1
        return pa.table([texts.column(id_col), texts.column("n_words"), pa.array(bits, pa.float64())], [id_col, "n_words", "bits"])

    words = scored.where("words IS NOT NULL").select("run", "words").mapInArrow(listed, "run long, word long, k int")
    found = words.join(rest, "word").select(F.col("run").alias("_run"), "k", "n")
    texts = scored.select(id_col, "n_words", "bits", F.col("run").alias("_run"), "at")
    return texts.groupBy("_run").cogroup(found.groupBy("_run")).applyInArrow(less, scored.select(id_col, "n_words", "bits").schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, bits, bits_a_word, perplexity) of each row of docs, repeated rows included.

    Null, empty and wordless texts have 0 words and bits, and null for the rest. Texts of any length are scored whole; words
    that the corpus doesn't have share the 1 of their place. An empty table gives no rows. Other columns of docs, whatever
    their names, are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    own = pick(docs, id_col, "text").withColumn("text", F.col("text").cast("string"))
    names = [id_col, "n_words", "bits", "run", "at", "words"]

    def each(batches):
        """Rows of runs of texts: at has the numbers of a text's words in words, which only a run's first row has."""
        model, first = sent.value, (CLASSES - TAIL_CLASSES) * IN_CLASS
        name = TaskContext.get().partitionId() << 32

        def given(run):
            nonlocal name
            if not run:
                return
            words, at = np.unique(np.concatenate([x[3] for x in run]), return_inverse=True)
            sizes = np.concatenate([x[4] for x in run])
            cut = np.cumsum(np.r_[0, sizes])
            at, name = at.astype(np.int32), name + 1
            columns = [
                pa.concat_arrays([x[0] for x in run]), pa.array(np.concatenate([x[1] for x in run])), pa.array(np.concatenate([x[2] for x in run])), pa.array(np.full(len(sizes), name)),
                pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([words.tobytes(), *[None] * (len(sizes) - 1)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

        run, size = [], 0
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in text_chunks(off):
                words, starts = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                lg = log2_probabilities(model, words, starts)
                place = model.places(words)
                shared = place >= first if model.held is not None else np.zeros(len(words), bool)
                if shared.any():
                    lg[shared] -= np.log2(model.held[place[shared] - first] + 1)
                total, before, some = np.zeros(j - i), np.zeros(len(words) + 1, np.int64), np.flatnonzero(np.diff(starts))
                if len(some):
                    total[some] = -np.add.reduceat(lg, starts[some])  # text by text: the same beside any others
                np.cumsum(shared, out=before[1:])
                run.append((batch.column(0).slice(i, j - i), np.diff(starts), total, words[shared], before[starts[1:]] - before[starts[:-1]]))
                size += int(off[j] - off[i])
                if size >= RUN_BYTES:
                    yield from given(run)
                    run, size = [], 0
        yield from given(run)

    scored = own.mapInArrow(each, schema_and(own.select(id_col), n_words="bigint", bits="double", run="bigint", at="binary", words="binary"))
    if model.rest is not None:
        scored = counted(stored(scored, "scored"), model.rest, id_col)
    rate = F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words"))
    return scored.select(id_col, "n_words", F.round("bits", 3).alias("bits"), F.round(rate, 6).alias("bits_a_word"), F.round(F.pow(F.lit(2.0), rate), 4).alias("perplexity"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, trained(docs))
