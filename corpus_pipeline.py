"""A corpus from raw documents to training sequences: rejected by quality, freed of near copies and of private values,
mixed by source and packed. Each stage works on all that the one before kept.

All stages take null, empty and very long texts, null ids, ties, repeated rows and empty tables (which give no rows); they
work on whole texts. Columns that documents have besides its five stay until packing, whatever their names, and a column of
the five that is missing is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, pii, quality
from tidemark.llm.common import documents_of, read, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that trees fitted on the labels of these documents reject. Repeated rows are judged alike; without
    labels nothing is rejected."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; repeated rows are copies, texts without words are not."""
    return minhash.deduplicated(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With private values masked, in rows as many as before; a null text stays null."""
    return pii.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources, which packing keeps; null is a source of its own."""
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their bins: the columns of packing.pack, by the number of words. A document without words has
    one row, without bin. Bins are filled from runs of the documents in the order that mixing gave them, and numbered in it."""
    return packing.pack(docs, "doc_id", packing.words(F.col("text")), group_rows=packing.GROUP_ROWS, ordered=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("pii", pii_masking),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

ORACLE_SQL = None  # trees, sampling by hash and an LSTM are beyond SQL: tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage before it gives is written to the shared folder and read again."""
    docs = documents_of(read(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
