"""The pipeline's stages against brute force, each on its own input."""

import re
import time

import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import PATTERNS, brute_groups

import corpus_pipeline
from tidemark.llm import packing, quality
from tidemark.llm.common import DOC_COLUMNS, documents_of, stored, text_bytes


def test_stages(spark):
    docs = documents_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]
    before, kept = docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == list(DOC_COLUMNS)
            docs = stored(out, f"test-{name}")
            kept[name] = docs.toPandas()
        else:
            kept[name] = out.toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    x = before.merge(labels, on="doc_id").sort_values("doc_id")
    model = quality.fit(quality.statistics(*text_bytes(pa.array(x["text"]))), x["quality"].to_numpy())
    good = model.score(quality.statistics(*text_bytes(pa.array(before["text"])))) >= quality.KEEP
    assert abs(int(good.sum()) - len(kept["quality"])) <= 2
    clean = x[(x["quality"] == 1)]["doc_id"]
    assert clean.isin(kept["quality"]["doc_id"]).mean() > 0.98
    first = kept["quality"].sort_values("doc_id").reset_index(drop=True)
    roots = np.array(brute_groups(first["text"].tolist()))
    want = set(first["doc_id"][roots == np.arange(len(first))])
    got = set(kept["near_dedup"]["doc_id"])
    assert want <= got and len(got - want) <= 0.1 * max(1, len(first) - len(want))
    assert set(kept["pii"]["doc_id"]) == got
    left = sum(bool(re.search(p, t)) for t in kept["pii"]["text"] for p in PATTERNS.values())
    assert left == 0
    assert set(kept["mixing"]["doc_id"]) <= got and len(kept["mixing"])
    n = {i: len(t.split()) for i, t in zip(kept["mixing"]["doc_id"], kept["mixing"]["text"], strict=True)}
    packed = kept["packing"].groupby("doc_id")["length"].sum().to_dict()
    assert packed == n


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_packing_keeps_the_order_of_the_mix(spark, monkeypatch):
    """Sequences hold runs of the mix, each with the sources in their proportions; without mixing they are others."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 900)), "en", "a" if i < 180 else "b", 0) for i in range(240)] + [(None, "", None, None, 0)]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartitionByRange(7, "doc_id"), "test-docs")
    mixed = stored(corpus_pipeline.source_mixing(spark, docs, DATA).repartition(1).orderBy("doc_id").unionByName(docs.limit(0)), "test-sorted")  # another order in files
    order = corpus_pipeline.source_mixing(spark, mixed, DATA)
    want = [r[0] for r in order.select("doc_id").collect()]
    packed = corpus_pipeline.sequence_packing(spark, stored(order, "test-mixed"), DATA).toPandas()
    assert len(packed) >= 241 and sorted(packed["doc_id"].dropna()) == list(range(240))
    packed = packed.dropna(subset="bin_id")
    packed[["group", "bin"]] = packed["bin_id"].str.split("-", expand=True).astype(int)
    at = packed["doc_id"].map({d: k for k, d in enumerate(want) if d is not None})
    assert (at // 40 == packed["group"]).all()
    for _, own in packed.assign(at=at).groupby("group"):
        first = own.groupby("bin")["at"].min()
        assert first.is_monotonic_increasing and first.index.tolist() == list(range(len(first)))
    early = packed[packed["group"] == 0]["doc_id"]
    assert 0.25 < (early >= 180).mean() < 0.5  # b has a share of 0.37 by the roots of 180 and 60, though it is last by id
    unmixed = corpus_pipeline.sequence_packing(spark, docs, DATA).toPandas()
    assert set(zip(unmixed["doc_id"], unmixed["bin_id"], strict=True)) != set(zip(packed["doc_id"], packed["bin_id"], strict=True))
    one = corpus_pipeline.sequence_packing(spark, spark.createDataFrame(rows, docs.schema).coalesce(1), DATA).toPandas()  # rows of no file
    assert (one.dropna(subset="bin_id")["bin_id"].str.split("-").str[0].astype(int) == one.dropna(subset="bin_id")["doc_id"] // 40).all()


def test_packing_reads_texts_once(spark):
    docs = stored(documents_of(spark.read.parquet(f"{DATA}/documents.parquet")), "test-once")
    packed = corpus_pipeline.sequence_packing(spark, docs, DATA)
    assert "text" not in packed._jdf.queryExecution().executedPlan().toString()  # lengths were stored: no text is split again
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stored_tables_leave_no_shuffle_files(spark):
    """Shuffles of a stage go when it is written, not when the driver comes to collect its garbage."""

    def shuffles():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name, None), shuffles()
    out = stored(spark.range(20_000).repartition(5).groupBy((F.col("id") % 1000).alias("k")).count(), "test-shuffles")
    for _ in range(50):  # they go in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 1000 and spark.conf.get(name, None) == was
