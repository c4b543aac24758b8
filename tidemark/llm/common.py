"""What the training-data operators share: the shared folder, column picking, text bytes and word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

DOC_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: columns that the caller has besides can then clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def schema_and(df: DataFrame, **more: str) -> StructType:
    """df's schema with further columns; df's own, which add() would change, stays as it is."""
    return StructType([*df.schema.fields, *[StructField(n, DataType.fromDDL(t)) for n, t in more.items()]])


def documents_of(df: DataFrame) -> DataFrame:
    """The five columns of documents, in their types, one that is missing being null; then all other columns of df. Where
    df has a name twice but for capitals, as Spark compares them, the first stays."""
    have = set(df.columns)
    own = [(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in DOC_COLUMNS.items()]
    seen = set(DOC_COLUMNS)
    others = [n for n in df.columns if n.lower() not in seen and not seen.add(n.lower())]
    return df.select(*own, *[F.col(f"`{n}`") for n in others])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in have:
            n = f"_{n}"
        out.append(n)
        have.add(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary one is set for a
    session on one machine; on a cluster that is an error, as executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isEmpty():
            return own.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(where)
        return where
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: they go from all executors when its query ends, not when the driver
    comes to collect its garbage. (Spark before 4.1 doesn't know the setting, and keeps them.)"""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: it is made once, and a lost executor takes nothing of it along.
    Its files go when the driver ends, and sooner by dropped(); the shuffles that made it go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that no one will read again."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._tidemark_path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def in_order(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, made of df's, with place: numbers that rise as df's rows follow each other. Rows read from files follow
    each other by the number in the file's name that Spark gives the parts of a sorted table, and within a file; those of
    other tables as they come. The texts are read once; what is kept of them is stored."""
    files = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    own = [c.alias(n) for n, c in columns.items()]
    if not files:
        return in_order(stored(df.select(*own), "rows"), **{n: F.col(n) for n in columns})
    at = df.metadataColumn("_metadata")
    rows = stored(df.select(*own, at["file_name"].alias("_name"), at["file_path"].alias("_path"), at["row_index"].alias("_row")), "rows")
    number = F.regexp_extract("_name", r"^part-(\d+)", 1)
    held = rows.groupBy("_path").agg(F.first(number).alias("_part"), (F.max("_row") + 1).alias("_held"))
    # one row for each file: few enough for one task
    before = held.select("_path", (F.sum("_held").over(Window.orderBy(F.length("_part"), "_part", "_path")) - F.col("_held")).alias("_before"))
    return rows.join(before, "_path").select(*columns, (F.col("_before") + F.col("_row")).alias("place"))


def given_back[T](result: T) -> T:
    """The result, after freed memory of Arrow and of C's heap has gone back to the system: a worker that is kept for the
    next stage then holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return result


SIEVE_BITS, SIEVE_BYTES, SIEVE_HASHES = 12, 16 << 20, 4


def may_hold(keys: DataFrame, key: Column, most_bytes: int = SIEVE_BYTES) -> Callable[[Column], Column]:
    """A test, true of every key (bigint) of keys and of few others, by a Bloom filter that every executor gets. It keeps
    rows that meet nothing out of the shuffle of an exact join. The filter never has more than most_bytes, whatever the
    number of keys: of more than it is made for it lets more others pass, and the join after it is as exact."""
    spark = keys.sparkSession
    hashed = keys.select(key.alias("h"))
    bits = 64 * min(max(1, -(-hashed.count() * SIEVE_BITS // 64)), max(1, most_bytes // 8))
    # two numbers under 2^31, so that nothing overflows: SIEVE_HASHES places are (a + k * b) % bits
    a, b = F.col("h").bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned("h", 33).bitwiseOR(F.lit(1))
    places = hashed.select(F.explode(F.array(*[(a + b * k) % bits for k in range(SIEVE_HASHES)])).alias("at"))
    made = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toPandas()  # bits / 64 rows at most
    whole = np.zeros(bits // 64, np.int64)
    whole[made["word"].to_numpy(np.int64)] = made["mask"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(whole.view(np.uint8))  # little-endian, so bit i of the words is bit i % 8 of byte i / 8

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64)
        a, b = x & np.int64(2**31 - 1), (x.view(np.uint64) >> np.uint64(33)).astype(np.int64) | 1
        out = np.ones(len(x), bool)
        for k in range(SIEVE_HASHES):
            at = (a + b * k) % bits
            out &= (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return held


def portable_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, by expressions that DuckDB has too; none for null."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


# ---------------------------------------------------------------- bytes and words of Arrow text

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = True
_IS_WORD[128:] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["p"]) < n + 1:
        with np.errstate(over="ignore"):
            for k, base in (("p", _P), ("i", _P_INV)):
                a = np.full(max(n, PIECE) + 1, base, dtype=np.uint64)
                a[0] = 1
                _POW[k] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    low = _LOWER[data]
    if len(low) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][up] += 32
    return low


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (run of letters, digits and bytes beyond ASCII, in lower case) of each text: all
    hashes in a row, and n+1 offsets into them. Whole texts, in pieces of a megabyte that end between words."""
    n = len(off) - 1
    word = _IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = word[tails]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = lowered(data)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
            lo, hi = int(starts[a]), int(ends[b - 1])
            p, inv = _powers(hi - lo)
            s = np.empty(hi - lo + 1, np.uint64)
            s[0] = 0
            v = _BYTE[low[lo:hi]]
            v *= p[: hi - lo]
            np.cumsum(v, out=s[1:])
            x = starts[a:b] - lo
            hashes[a:b] = (s[ends[a:b] - lo] - s[x]) * inv[x]
            a = b
    return mix64(hashes), np.searchsorted(starts, off, "left") if n else np.zeros(1, np.int64)


def text_chunks(off: np.ndarray, most: int = PIECE) -> list[tuple[int, int]]:
    """Runs [i, j) of texts of about `most` bytes together; a longer text is a run of its own."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out
