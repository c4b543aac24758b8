"""The ten operators on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

import itertools
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA, normal
from pandas.testing import assert_frame_equal
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, fingerprints, maxent, minhash, mixing, packing, pii, quality, sharding, url_filter
from tidemark.llm.common import may_hold, text_bytes, word_hashes
from tidemark.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (None, "one two three four five"), (None, None), (4, "!!! ..."), (5, LONG), (6, "x" * 200_000), (2**60 + 1, "a b")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(ODD)]
    clash = ["id", "v", "node", "h", "u", "n", "words", "score", "keep", "piece", "mix_rank", "_rank", "listed", "pii_spans", "position", "root", "quality"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in clash])


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables in which each operator has something to find, with nulls, ties, repeated rows and clashing columns."""
    where, rng = str(tmp_path_factory.mktemp("planted")), np.random.default_rng(21)
    texts = near_copies() + [t for _, t in ODD if t is None or len(t) < 1000]
    items = [" ".join(f"b{k}w{i}" for i in range(60)) for k in range(4)]
    texts += [texts[0] + " " + items[0], items[1] + " " + texts[9], " ".join(items[2].split()[:40]), "mail jane.42@mail3.example.com or +1 (415) 555-0134 now"]
    docs = [(None if k % 41 == 40 else k // 2 if k % 50 == 49 else k, t, "en", None if k % 7 == 0 else "hot" if k % 3 else f"s{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs += [docs[5], docs[5]]
    spark.createDataFrame(docs, DOCS).select("*", F.lit(3).alias("node"), F.lit("x").alias("h")).write.parquet(f"{where}/documents.parquet")
    x = rng.standard_normal((80, 16))
    x[30:] = x[rng.integers(0, 30, 50)] + rng.standard_normal((50, 16)) * rng.uniform(0.0, 0.5, (50, 1))
    x[70], x[71] = x[3], x[3]
    spark.createDataFrame([(int(i), [float(y) for y in v], 0) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    hosts = ["a.example.com", "spam-farm.example.net", "x.casino-win.org", "notspam-farm.com"]
    pages = [(k, None if k % 31 == 30 else f"http://{hosts[k % 4]}/{k % 90}{'y' * (9000 if k == 5 else 1)}", "<p>x</p>") for k in range(300)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate([*items, None, ""])], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 100, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql_on_planted_rows(spark, planted, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{planted}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, planted).toPandas(), con.execute(ORACLES[name]).df()
    assert len(got)
    assert_frame_equal(normal(got), normal(want))
    if name == "op2_embedding_dedup":
        assert got["links"].sum() > 50 and got["copies"].sum() > 2 and got["class_id"].nunique() < 60
    if name == "op9_url_filter":
        assert 0 < got["listed"].sum() < len(got)
    if name == "op8_containment":
        assert len(got) >= 3


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_all_planted_rows(spark, planted, name):
    got = QUERIES[name](spark, planted)
    ids = {r[0] for r in spark.read.parquet(f"{planted}/documents.parquet").select("doc_id").collect()}
    assert {r[0] for r in got.select("doc_id").collect()} == ids


# ---------------------------------------------------------------- 1


def test_packing(spark, odd):
    got = packing.pack(odd, "doc_id", packing.words(F.col("text")), sizes=(8, 64, 4096)).toPandas()
    assert got["length"].sum() == sum(len((t or "").split()) for _, t in ODD)
    assert {r[0] for r in packing.pack(odd, "doc_id", packing.words(F.col("text")), sizes=(8, 64, 4096)).collect()} == {i for i, _ in ODD}
    full = got.dropna(subset=["bin_id"]).sort_values(["bin_id", "offset"])
    for _, b in full.groupby("bin_id"):
        ends = (b["offset"] + b["length"]).tolist()
        assert b["offset"].tolist() == [0, *ends[:-1]]
        size = b["capacity"].iloc[0]
        assert ends[-1] <= size == min(s for s in (8, 64, 4096) if s >= ends[-1])
    assert packing.pack(odd.limit(0), "doc_id", packing.words(F.col("text"))).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offset, capacity = packing.best_fit(np.array([6, 5, 3, 2]), (8,))
    assert bins.tolist() == [0, 1, 1, 0] and offset.tolist() == [0, 0, 5, 6] and set(capacity.tolist()) == {8}
    rng = np.random.default_rng(0)
    n = rng.integers(1, 100, 500)
    sizes = (16, 32, 128)
    bins, offset, capacity = packing.best_fit(n, sizes)
    cost = sum(packing.cost(int(capacity[bins == b][0])) for b in np.unique(bins))
    alone = sum(packing.cost(min(s for s in sizes if s >= x)) for x in n)
    assert cost < alone


def plain_best_fit(lengths, sizes):
    """(bin, offset, capacity) of each piece, looking at every bin for each: longest first, the fullest bin that has room
    (of equals the one filled last), else the size that costs least for what can still come into it."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins, place, clock = [], {}, 0
    for n, k in enumerate(order):
        need = lengths[k]
        fits = [b for b in bins if b["room"] >= need]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["at"]))
        else:
            still = sum(lengths[x] for x in order[n + 1 :])
            free = sum(b["room"] for b in bins)
            worth = {}
            for s in sorted(sizes):
                if s >= need:
                    short = sum(x for x in lengths if x <= s - need)
                    worth[s] = packing.cost(s) / (need + min(s - need, max(0, min(still, short) - free)))
            s = min(worth, key=lambda s: (worth[s], s))
            b = {"id": len(bins), "room": s, "used": 0}
            bins.append(b)
        place[k] = (b["id"], b["used"])
        clock += 1
        b["room"], b["used"], b["at"] = b["room"] - need, b["used"] + need, clock
    size = [min(s for s in sizes if s >= b["used"]) for b in bins]
    return [(*place[k], size[place[k][0]]) for k in range(len(lengths))]


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(4)
    for n, top, sizes in ((300, 100, (16, 32, 128)), (200, 9, (10,)), (150, 512, (64, 512)), (1, 5, (8,)), (250, 40, (8, 40, 41))):
        lengths = np.minimum(rng.integers(1, top + 1, n), rng.integers(1, top + 1, n))
        got = list(zip(*(x.tolist() for x in packing.best_fit(lengths, sizes)), strict=True))
        assert got == plain_best_fit(lengths.tolist(), sizes)


def test_op1_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = packing.op1_packing(spark, DATA).toPandas()
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    n = texts.fillna("").map(lambda t: len(t.split()))
    top = max(packing.LENGTHS)
    pieces = sorted((-w, str(i), k) for i, w in n.items() if w for k in range(-(-w // top)))
    lengths = [min(-w - k * top, top) for w, _, k in pieces]  # longest documents first, ties by id, as a group is packed
    want = {(int(i), k): (length, offset, capacity, b) for (_, i, k), length, (b, offset, capacity) in zip(pieces, lengths, plain_best_fit(lengths, packing.LENGTHS), strict=True)}
    rows = got.dropna(subset=["bin_id"])
    assert {(r.doc_id, r.piece): (r.length, r.offset, r.capacity, int(r.bin_id.split("-")[1])) for r in rows.itertuples()} == want
    assert set(got["doc_id"]) == set(n.index) and (got.groupby("doc_id")["length"].sum() == n).all()


# ---------------------------------------------------------------- 2


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + rng.standard_normal((150, 16)) * rng.uniform(0.05, 0.6, (150, 1))
    x[200:240] = x[200] + rng.standard_normal((40, 16)) * 0.05  # a group of near copies
    x[10] = x[20] = x[30]
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0]), (None, rows[0][1]), (None, None), rows[3], (504, [None] * 16)]
    df = spark.createDataFrame(rows, "k bigint, e array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v"), F.lit(3).alias("b"))
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    near[[20, 30]] = near[:, [20, 30]] = False  # copies of 10
    np.fill_diagonal(near, False)
    root = np.arange(300)
    for i, j in np.argwhere(near):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    many = near.sum(axis=1)
    want = {i: (int(root[i]), int(many[i]), 2 * (i == 10)) for i in range(300)} | {i: (int(root[10]), int(many[10]), 2) for i in (20, 30)}
    want |= {i: (i, 0, 0) for i in range(500, 505)} | {None: (None, None, None)}
    for how in ({}, {"cell_bytes": 7 * 448}, {"width": 4, "grid": 3}):
        got = embedding_dedup.classes(df, "k", "e", **how).collect()
        assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    assert embedding_dedup.classes(df.limit(0), "k", "e").count() == 0
    assert {tuple(r) for r in embedding_dedup.classes(df.where("e IS NULL"), "k", "e").collect()} == {(500, 500, 0, 0), (None, None, None, None)}


# ---------------------------------------------------------------- 3


def test_mix_keeps_to_its_shares(spark, odd):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    weights = {"a": 0.5, "b": 0.2, None: 0.3}
    got = mixing.mix(docs, weights, block_docs=4).toPandas()
    assert len(got) == 4000 and got["mix_position"].is_unique
    inside = got[got["in_mix"]].drop_duplicates("mix_slot").sort_values("mix_slot")
    assert inside["mix_slot"].tolist() == list(range(len(inside)))
    for s, w in weights.items():
        seen = (inside["source"].isna() if s is None else inside["source"] == s).cumsum()
        assert (abs(seen - w * np.arange(1, len(inside) + 1)) < 1).all()
    got = mixing.mix(odd)
    assert got.count() == len(ODD) and got.columns.count("mix_rank") == 1
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.integer_weights({"a": 1e9, "b": 1.0}, 10) == {"a": 9, "b": 1}


def test_mixed_keeps_all_documents(spark):
    docs = spark.range(2003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 1000, "a").when(F.col("id") < 2000, "b").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    got = [r["doc_id"] for r in mixing.mixed(docs).collect()]  # the null source has 3 documents: no full block
    assert sorted(got) == list(range(2003))
    ahead = np.cumsum([1 if i < 1000 else -1 if i < 2000 else 0 for i in got])
    assert abs(ahead).max() <= 2 * mixing.BLOCK_DOCS
    assert {r["doc_id"] for r in mixing.mixed(docs, weights={"a": 1.0}).collect()} == set(range(1000))


def test_mix_of_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    got = mixing.mix(docs, block_docs=1).toPandas()
    assert len(got) == 3000 and got["mix_position"].notna().all() and got["mix_position"].is_unique
    shares = {f"s{i}": 1.0 + (i == 0) * 500 for i in range(1500)}
    period = mixing.period_of(shares)
    weights = mixing.integer_weights(shares, period)
    assert sum(weights.values()) == period and all(abs(w / period * 2000 / shares[s] - 1) <= 0.1 for s, w in weights.items())
    assert mixing.period_of({"a": 1.0, "b": 1.0}) == mixing.PERIOD and mixing.period_of({"a": 1.0, "b": 1e-12}) == mixing.LONGEST
    assert mixing.period_of({}) == mixing.PERIOD


def plain_edf(weights, period):
    """source and block of each slot, looking at every source for each slot."""
    done = dict.fromkeys(weights, 0)
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // w), s) for s, w in weights.items() if done[s] < w and done[s] * period // w <= slot]
        if ready:
            _, s = min(ready)
            yield s, done[s], slot
            done[s] += 1


def test_schedule_equals_brute_force_and_keeps_every_document(spark):
    shares = {f"s{i:04d}": 1.0 + (i % 7) + (i == 3) * 900 for i in range(1200)}
    period = mixing.period_of(shares)
    weights = mixing.integer_weights(shares, period)
    plan = mixing.schedule(weights, period)
    assert plan == list(plain_edf(weights, period)) and len(plan) == period
    docs = spark.createDataFrame([(k, f"s{min(k // 3, 1199):04d}" if k < 6000 else None if k < 6003 else "big") for k in range(9000)], "doc_id bigint, source string")
    got = mixing.mix(docs).toPandas()
    sizes = got.groupby(got["source"].fillna("null").map(lambda s: s if s == "null" else f"={s}")).size().to_dict()
    given = {s: n**mixing.ALPHA for s, n in sizes.items()}
    period = mixing.period_of(given)
    weights = mixing.integer_weights(given, period)
    slot = {(s, j): t for s, j, t in plain_edf(weights, period)}
    assert len(got) == 9000 and got["mix_position"].notna().all() and got["mix_position"].is_unique
    for r in got.itertuples():
        s = "null" if r.source is None else f"={r.source}"
        assert r.mix_block == r.mix_rank // mixing.BLOCK_DOCS
        assert r.mix_slot == r.mix_block // weights[s] * period + slot[s, r.mix_block % weights[s]]
    assert mixing.mixed(docs).count() == 9000


# ---------------------------------------------------------------- 4


def words_of(*texts):
    return word_hashes(*text_bytes(pa.array(texts)))


def test_maxent_learns_and_sums_to_one(spark, odd):
    rng = np.random.default_rng(0)
    nexts = {w: rng.choice(40, 2) for w in range(40)}

    def text(n):
        w, out = 0, []
        for _ in range(n):
            w = int(nexts[w][rng.integers(0, 2)])
            out.append(f"w{w}")
        return " ".join(out)

    train = spark.createDataFrame([(i, text(400)) for i in range(60)], "doc_id bigint, text string")
    model = maxent.trained(train, rounds=2, shard_bytes=20_000, rate=0.3)
    held = -maxent.log2_probabilities(model, *words_of(text(3000))).mean()
    assert held < 2.5  # a word has two followers; words alone would take 5 bits
    words, starts = words_of("w1 w2 w3")
    klass = np.arange(maxent.CLASSES, dtype=np.int32)
    feature = np.repeat(maxent.contexts(words, starts)[2:3], maxent.CLASSES, axis=0)
    c, w = maxent.rows_of(feature, klass, model)
    total = sum(maxent._softmax(model.by_class, c)[k, k] * maxent._softmax(model.by_word, w)[k].sum() for k in klass)
    assert total == pytest.approx(1, abs=1e-5)
    got = {r[0]: r for r in maxent.score(odd, model).collect() if r[0] is not None}
    assert got[2][1:] == (0, 0.0, None, None) and got[5][1] == 60_000
    assert maxent.score(odd.limit(0), maxent.trained(odd.limit(0))).count() == 0


def test_maxent_equals_a_plain_softmax():
    rng = np.random.default_rng(3)
    words, starts = words_of("a b c d a b", "", "b c")
    model = maxent.Model.of(np.unique(words)[:3])
    model.by_class[:], model.by_word[:] = rng.standard_normal(model.by_class.shape), rng.standard_normal(model.by_word.shape)
    got = maxent.log2_probabilities(model, words, starts, batch=3)
    places, feature = model.places(words), maxent.contexts(words, starts)
    for k, p in enumerate(places):
        c, w = maxent.rows_of(feature[k : k + 1], np.array([p // 32]), model)
        zc, zw = sum(model.by_class[r] for r in c[0]), sum(model.by_word[r] for r in w[0])
        want = np.log2(np.exp(zc[p // 32]) / np.exp(zc).sum() * np.exp(zw[p % 32]) / np.exp(zw).sum())
        assert got[k] == pytest.approx(want, rel=1e-4)
    assert (feature[0, 1:] == maxent.contexts(*words_of("z"))[0, 1:]).all() and (feature[6] == feature[0]).all()


def plain_step(weights, past, rows, target, rate):
    """What _descend does, position by position."""
    sums, count = {}, {}
    for own, t in zip(rows.tolist(), target.tolist(), strict=True):
        z = np.exp(sum(weights[r].astype(np.float64) for r in own))
        grad = z / z.sum()
        grad[t] -= 1
        for r in own:
            sums[r] = sums.get(r, 0) + grad
            count[r] = count.get(r, 0) + 1
    for r, g in sums.items():
        past[r] += (g * g).mean() / count[r]
        weights[r] = weights[r] - rate * g / np.sqrt(count[r] * (past[r] + 1e-4))
    return count


def test_maxent_sums_gradients_without_a_copy_for_each_feature():
    rng = np.random.default_rng(12)
    n, classes = maxent.BATCH, maxent.CLASSES
    rows = rng.integers(0, 2000, (n, maxent.FEATURES)).astype(np.uint16)
    target = rng.integers(0, classes, n)
    weights = rng.standard_normal((maxent.CLASS_ROWS, classes)).astype(np.float32)
    weights[:20] *= 60  # scores beyond what exp can take
    now, past, touched = weights.copy(), np.zeros(len(weights)), np.zeros(len(weights), np.float32)
    tracemalloc.start()
    maxent._descend(now, past, touched, rows, target, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.size * classes * 4
    p = weights.astype(np.float64)[rows].sum(axis=1)
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), target] -= 1
    grad, count = np.zeros(weights.shape), np.bincount(rows.ravel(), minlength=len(weights))
    np.add.at(grad, rows.ravel(), np.repeat(p, maxent.FEATURES, axis=0))
    hit = np.flatnonzero(count)
    mean = (grad[hit] ** 2).sum(axis=1) / (count[hit] * classes)
    assert np.allclose(past[hit], mean, rtol=1e-3) and (touched == count).all()
    assert np.allclose(now[hit], weights[hit] - 0.1 * grad[hit] / np.sqrt(count[hit] * (mean + 1e-4))[:, None], atol=1e-3)


def test_maxent_trains_as_plain_gradient_steps_do(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 90, int(rng.integers(1, 60)))) for _ in range(40)] + ["", None, "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shards = max(1, -(-sum(len(t or "") for t in texts) // (2 * 700)))
    hashed = docs.where("text <> ''").select(F.xxhash64("doc_id", "text").alias("h"), "text").withColumn("part", F.pmod("h", F.lit(2))).withColumn("node", F.pmod(F.xxhash64("h"), F.lit(shards))).toPandas().sort_values("h")
    model = maxent.trained(docs, rounds=2, shard_bytes=700, rate=0.3)
    mats = [np.zeros_like(model.by_class, np.float64), np.zeros_like(model.by_word, np.float64)]
    assert shards > 3
    for part in range(2):
        total, weight = [np.zeros_like(m) for m in mats], [np.zeros(len(m)) for m in mats]
        for _, own in hashed[hashed["part"] == part].groupby("node"):
            words, starts = words_of(*own["text"])
            now, past = [m.copy() for m in mats], [np.zeros(len(m)) for m in mats]
            place = model.places(words)
            c, w = maxent.rows_of(maxent.contexts(words, starts), place // maxent.IN_CLASS, model)
            for k, (rows, target) in enumerate(((c, place // maxent.IN_CLASS), (w, place % maxent.IN_CLASS))):
                for r, n in plain_step(now[k], past[k], rows, target, 0.3).items():
                    total[k][r] += (now[k][r] - mats[k][r]) * n
                    weight[k][r] += n
        mats = [m + t / np.maximum(n, 1e-9)[:, None] for m, t, n in zip(mats, total, weight, strict=True)]
    for got, want in zip((model.by_class, model.by_word), mats, strict=True):
        assert np.abs(want).max() > 0.1 and np.allclose(got, want, atol=2e-3)


def test_maxent_is_the_same_in_any_layout(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 5000")
    got = []
    for parts in (1, 3, 8):
        own = docs.repartition(parts, "doc_id")
        got.append(maxent.score(own, maxent.trained(own, shard_bytes=20_000)).toPandas().sort_values("doc_id").reset_index(drop=True))
    assert len(got[0]) and got[0]["bits"].sum() > 0
    assert_frame_equal(got[0], got[1])
    assert_frame_equal(got[0], got[2])


def test_maxent_sums_changes_in_a_tree(spark):
    rng = np.random.default_rng(3)
    rows, total, count = [], np.zeros((maxent.BLOCK_ROWS, 32)), np.zeros(maxent.BLOCK_ROWS)
    for node in range(11):
        at = np.sort(rng.choice(maxent.BLOCK_ROWS, 50, replace=False))
        n, change = rng.integers(1, 9, 50).astype(np.float32), rng.standard_normal((50, 32)).astype(np.float16)
        rows.append((node, 1, 0, at.astype(np.int16).tobytes(), n.tobytes(), change.tobytes()))
        total[at] += change * n[:, None]
        count[at] += n
    changes = spark.createDataFrame(rows, "node long, m int, b int, rows binary, touched binary, change binary")
    for fan in (64, 3, 2):
        got = maxent.summed(changes, 11, fan).collect()
        assert len(got) == 1
        assert np.allclose(np.frombuffer(got[0]["total"], np.float32).reshape(-1, 32), total, atol=1e-2) and (np.frombuffer(got[0]["count"], np.float64) == count).all()
    with pytest.raises(Exception, match="too many branches"):
        maxent.summed(changes.withColumn("node", F.lit(0).cast("long")), 11, 4).collect()


def test_maxent_counts_words_without_arrays_of_a_whole_batch(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 2000) % 50_000) for _ in range(1200)] + ["", None, "!!!", "w1 W1 w2"]
    column, peak = pa.array(texts), 0

    class Texts:
        """Gives its batches to what would run in a task, and the result as a table."""

        def mapInArrow(self, each, schema):
            nonlocal peak
            word_hashes(*text_bytes(column[:9]))  # its table of powers stays
            tracemalloc.start()
            found = list(each(iter([pa.record_batch([column], ["text"]), pa.record_batch([column[1200:]], ["text"]), pa.record_batch([column[:0]], ["text"])])))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return spark.createDataFrame(pa.Table.from_batches(found).to_pandas(), schema)

    got = {r["word"]: r["n"] for r in maxent.word_counts(Texts()).collect()}
    words, n = np.unique(words_of(*texts, *texts[1200:])[0], return_counts=True)
    assert got == dict(zip(words.view(np.int64).tolist(), n.tolist(), strict=True))
    assert column.nbytes > 8 << 20 and peak < 5 * column.nbytes


def test_op4_equals_plain_scoring(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in maxent.op4_lm_scoring(spark, DATA).collect()}
    texts = {r[0]: r[1] for r in docs.collect()}
    assert got.keys() == texts.keys()
    model = maxent.trained(docs)
    hashes, n = np.unique(words_of(*texts.values())[0], return_counts=True)
    many, first = dict(zip(hashes.tolist(), n.tolist(), strict=True)), (maxent.CLASSES - maxent.TAIL_CLASSES) * maxent.IN_CLASS
    for i in sorted(texts, key=lambda i: len(texts[i]))[5:100:20]:
        words, starts = words_of(texts[i])
        bits = 0.0
        for k, p in enumerate(model.places(words)):
            c, w = maxent.rows_of(maxent.contexts(words, starts)[k : k + 1], np.array([p // 32]), model)
            zc, zw = sum(model.by_class[r].astype(float) for r in c[0]), sum(model.by_word[r].astype(float) for r in w[0])
            bits -= np.log2(np.exp(zc[p // 32]) / np.exp(zc).sum() * np.exp(zw[p % 32]) / np.exp(zw).sum())
            bits -= np.log2(many[int(words[k])] / (model.held[p - first] + 1)) if p >= first else 0
        assert got[i]["n_words"] == len(words) and got[i]["bits"] == pytest.approx(bits, rel=1e-3)


def test_maxent_tells_rare_words_apart(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]  # word k comes about 1 / (k + 1) of the time, and once at least
    drawn = rng.choice(words, 20_000, p=(1 / np.arange(1, 3001)) / (1 / np.arange(1, 3001)).sum()).tolist() + words
    texts = [" ".join(drawn[i : i + 500]) for i in range(0, len(drawn), 500)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = maxent.trained(train)
    hashes, count = np.unique(words_of(" ".join(drawn))[0], return_counts=True)
    place = model.places(hashes)
    first = (maxent.CLASSES - maxent.TAIL_CLASSES) * maxent.IN_CLASS
    own = np.bincount(place, count, maxent.CLASSES * maxent.IN_CLASS)
    # alone in a text each word has the same context; all the words' and the unseen ones' probabilities sum to one
    got = {r[0]: r["bits"] for r in maxent.score(spark.createDataFrame([*enumerate(words), (9000, "neverseen")], "doc_id bigint, text string"), model).collect()}
    of = [words_of(w)[0][0] for w in words]
    plain = {h: maxent.log2_probabilities(model, np.array([h]), np.array([0, 1]))[0] for h in of}
    at = dict(zip(hashes, zip(place, count, strict=True), strict=True))
    for k, h in enumerate(of):
        p, n = at[h]
        assert got[k] == pytest.approx(-(plain[h] + (np.log2(n / (own[p] + 1)) if p >= first else 0)), abs=2e-3)
    assert (place >= first).sum() == 3000 - first and got[9000] > 0
    assert 0.9 < sum(2.0 ** -got[k] for k in range(3000)) <= 1 + 1e-3


# ---------------------------------------------------------------- 5


def brute_groups(texts, threshold=minhash.THRESHOLD, width=minhash.WIDTH, rare=minhash.RARE):
    """Root (least position) of each text by comparing all pairs on the exact weights."""
    parts = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    vec = []
    for w in parts:
        s = {}
        for i in range(max(1, len(w) - width + 1) if w else 0):
            s[tuple(w[i : i + width])] = s.get(tuple(w[i : i + width]), 0) + 1
        vec.append(s)
    df, n = {}, len(texts)
    for v in vec:
        for s in v:
            df[s] = df.get(s, 0) + 1
    vec = [{s: c * np.log(1 + n / max(df[s], rare * n, 1)) for s, c in v.items()} for v in vec]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        both = sum(min(x, vec[b][s]) for s, x in vec[a].items() if s in vec[b])
        if both and both >= threshold * (sum(vec[a].values()) + sum(vec[b].values()) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(x) for x in range(n)]


def near_copies():
    rng = np.random.default_rng(7)
    texts = []
    for g in range(25):
        base = [f"w{rng.integers(0, 3000)}" for _ in range(int(rng.integers(8, 200)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(own) // 12))):
                own[int(rng.integers(0, len(own)))] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    shared = " ".join(f"licence{i}" for i in range(55))
    return texts + [f"{shared} " + " ".join(f"q{k}r{i}" for i in range(90)) for k in range(12)]


def test_minhash_equals_brute_force(spark):
    texts = near_copies()
    want = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for how in ({}, {"chunk_bytes": 2000, "task_bytes": 3000}):
        got = {r["node"]["i"]: r["root"]["i"] for r in minhash.groups(df, **how).collect()}
        pairs = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if want[a] == want[b]}
        found = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if got[a] == got[b]}
        assert found <= pairs and len(found) >= 0.9 * len(pairs) > 0
    assert len(set(got[k] for k in range(len(texts) - 12, len(texts)))) == 12  # a shared passage makes no copies


def test_minhash_weighs_by_every_document_frequency(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(300))  # 14 of 3,014 documents have it: fewer than 1/128
    texts = [passage + " " + " ".join(f"q{k}r{i}" for i in range(130)) for k in range(14)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(3000)]
    assert brute_groups(texts[:14] + texts[14:40], rare=1.0) != list(range(40))  # all alike where all shingles weigh the same
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for how in ({}, {"block_bytes": 30_000}):
        got = [r["root"]["i"] == r["node"]["i"] for r in minhash.groups(df, **how).collect()]
        assert len(got) == 3014 and all(got)


def test_samples_agree_as_often_as_vectors_are_alike():
    rng = np.random.default_rng(2)
    shingle = np.arange(400, dtype=np.uint64) * np.uint64(77777)
    a, b = rng.uniform(0.2, 5, 400), rng.uniform(0.2, 5, 400)
    a[:50], b[350:] = 0, 0
    s = np.concatenate([shingle[a > 0], shingle[b > 0]])
    w = np.concatenate([a[a > 0], b[b > 0]]).astype(np.float32)
    doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    got = minhash.samples(doc, s, w, 2, 3000)
    assert (got[0] == got[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_minhash_on_odd_rows(spark, odd):
    got = minhash.deduplicated(odd)
    assert got.columns == odd.columns  # all that the caller has
    rows = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "")[:9]) for r in got.collect()])
    assert [x[:2] for x in rows] == [(False, 0), (False, 0), (True, 2), (True, 3), (True, 4), (True, 5), (True, 6), (True, 2**60 + 1)]
    assert minhash.deduplicated(odd.limit(0)).count() == 0
    keys = spark.range(5000).withColumn("h", F.xxhash64("id"))
    test = may_hold(keys, F.col("h"))
    assert keys.where(test("h")).count() == 5000 and spark.range(10_000, 20_000).where(test(F.xxhash64("id"))).count() < 600
    small = may_hold(keys, F.col("h"), most_bytes=16)  # lets others pass, but misses none
    assert keys.where(small("h")).count() == 5000
    assert spark.range(50).where(may_hold(keys.limit(0), F.col("h"))(F.xxhash64("id"))).count() == 0


def test_minhash_on_a_hot_group(spark):
    """Equal texts by the thousand, near copies of one another and a chain, with ties and nulls between."""
    rng = np.random.default_rng(12)
    hot = " ".join(f"h{k}" for k in range(60))
    near = [hot.replace("h59", f"n{k}") for k in range(80)]
    chain = [" ".join(f"c{i}" for i in range(k * 6, k * 6 + 40)) for k in range(12)]
    texts = [hot] * 400 + near + chain + [" ".join(f"x{v}" for v in rng.integers(0, 10**6, 30)) for _ in range(100)] + [None, "", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", F.lit(1).alias("node"), F.lit(2).alias("root"), F.lit(3).alias("keys"))
    distinct = list(dict.fromkeys(t for t in texts if t and "x" not in t and t != "..."))
    counts = {t: texts.count(t) for t in distinct}
    every = brute_groups(texts)
    for how in ({}, {"chunk_bytes": 1500, "task_bytes": 2000, "block_bytes": 20_000}):
        got = {r["node"]["i"]: r["root"]["i"] for r in minhash.groups(df, **how).collect()}
        assert len(got) == len(texts) and counts[hot] == 400
        assert [got[k] for k in range(480)] == [0] * 480 == every[:480]
        assert [got[k] for k in range(480, 492)] == every[480:492]
        assert all(got[k] == k for k in range(492, len(texts)))


def test_op5_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").toPandas()
    want = brute_groups(docs["text"].tolist())
    got = {r["doc_id"]: r for r in minhash.op5_minhash(spark, DATA).collect()}
    ids = docs["doc_id"].tolist()
    assert {i: got[i]["group_id"] for i in ids} == {i: ids[want[k]] for k, i in enumerate(ids)}
    assert all(r["keep"] == (r["doc_id"] == r["group_id"]) for r in got.values()) and len(got) == len(ids)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r[0]: r[1] for r in minhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}


# ---------------------------------------------------------------- 6


def test_ring_equals_brute_force(spark, odd):
    keys = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("position"))
    names = [f"n{i}" for i in range(7)]
    got = {r[0]: r for r in sharding.shard(keys, "k", names, vnodes=5, slack=0.02).collect()}
    ring = sharding.Ring.of(names, 5)
    at = {r[0]: r[1] for r in keys.select("k", sharding.position_of(F.col("k"))).collect()}
    cap = int(np.ceil(round(1.02 * 3000 / 7, 9)))
    left, waiting, hop = [cap] * 7, sorted(at, key=lambda k: at[k]), 0
    want = {}
    while waiting:  # keys hop together; arcs in ring order, keys in hash order
        after = []
        for k in waiting:
            s = int(ring.owner[(int(ring.arc(np.array([at[k]]))[0]) + hop) % len(ring.points)])
            if left[s]:
                left[s] -= 1
                want[k] = names[s]
            else:
                after.append(k)
        waiting, hop = after, hop + 1
    assert {k: r["shard"] for k, r in got.items()} == want
    assert max(sum(s == n for s in want.values()) for n in names) <= cap
    assert sharding.shard(odd, "doc_id", names).count() == len(ODD) and sharding.shard(odd.limit(0), "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, "doc_id", [])


def test_ring_moves_few_keys_when_a_shard_comes(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    names = [f"n{i}" for i in range(16)]
    before = {r[0]: r[2] for r in sharding.shard(keys, "k", names).collect()}
    after = {r[0]: r[2] for r in sharding.shard(keys, "k", [*names, "new"]).collect()}
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 0.3 * len(before)  # 1/17 is the least; modulo would move 16/17
    assert max(sum(s == n for s in after.values()) for n in [*names, "new"]) <= np.ceil(1.05 * 20_000 / 17)


# ---------------------------------------------------------------- 7

PATTERNS = {"email": r"[^\s@|]+@mail\d\.example\.com", "phone": r"\+1 \(\d{3}\) 555-\d{4}", "card": r"(?<!\d)\d{16}(?!\d)", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", "secret": r'(?i)(?<=token = ")[0-9a-f]{40}(?=")'}


def test_pii_gradient_is_that_of_the_loss():
    texts, spans = pii.examples(6, 24)
    ids = np.array([[min(ord(c), 127) for c in t] for t in texts], np.uint8).T
    gold = np.zeros(ids.shape, np.int64)
    gold[3:9, 2], gold[10:15, 4] = 1, 3
    model = pii.blank(4)
    for a in model.arrays():
        a += np.random.default_rng(1).standard_normal(a.shape).astype(np.float32) * 0.1
    _, grads = pii._steps(model, ids, gold)
    for a, g in zip(model.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, losses = a[at], []
        for d in (1e-2, -1e-2):
            a[at] = was + d
            losses.append(pii._steps(model, ids, gold)[0])
        a[at] = was
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(g[at]), rel=0.03, abs=2e-3)


def test_pii_windows_and_bound_change_nothing():
    model = pii.blank(6)
    model.trans += np.random.default_rng(4).standard_normal(model.trans.shape).astype(np.float32)
    model.bias[0] += 1.5
    text = "call +1 (555) 555-1234 or é@b.com " * 3
    chars, off = pii.symbols(*text_bytes(pa.array([text, "", "x"])))
    assert off.tolist() == [0, len(text), len(text), len(text) + 1]
    own = pii.tag(model, chars, off)
    ids = chars[: len(text), None]
    scores = pii._run(model, ids, np.ones(len(text), np.int64))
    assert (own[: len(text)] == pii._viterbi(model, scores, np.array([len(text)]))[:, 0]).all()
    best = max(itertools.product(range(len(pii.KINDS)), repeat=4), key=lambda p: model.start[p[0]] + sum(scores[t, k, 0] for t, k in enumerate(p)) + sum(model.trans[a, b] for a, b in itertools.pairwise(p)))
    assert tuple(pii._viterbi(model, scores[:4], np.array([4]))[:, 0]) == best


def test_pii_on_documents(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = pii.redact(docs).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").toPandas()
    hit = missed = extra = 0
    for _, r in got.iterrows():
        want = [m for p in PATTERNS.values() for m in re.finditer(p, r["was"])]
        mask = np.zeros(len(r["was"]), bool)
        for s in r["pii_spans"]:
            mask[s["start"] : s["end"]] = True
        for m in want:
            hit, missed = hit + mask[m.start() : m.end()].all(), missed + (not mask[m.start() : m.end()].all())
            mask[m.start() : m.end()] = False
        extra += mask.sum() > 2
        if not len(r["pii_spans"]):
            assert r["text"] == r["was"]
    assert hit >= 0.98 * (hit + missed) > 0 and extra <= 0.01 * len(got)
    rows = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert pii.masked(odd).columns == odd.columns and {r["pii_spans"] for r in pii.masked(odd).collect()} == {7}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[2]["pii_spans"] == [] and len(rows) == 8
    assert pii.redact(odd.limit(0)).count() == 0


def test_pii_joins_a_span_across_windows(spark):
    filler = "the one and of " * 90
    text = filler[:996] + " mail thione.42@mail7.example.com and " + filler
    chars, off = pii.symbols(*text_bytes(pa.array([text])))
    spans = [(a, b, k) for _, a, b, k in pii.spans_of(pii.tag(pii.trained(spark), chars, off), off)]
    assert [text[a:b] for a, b, _ in pii.reconciled(text, spans)] == ["thione.42@mail7.example.com"]
    assert pii.reconciled("a 1234567 b 1234567c 1234567", [(2, 9, 3)]) == [(2, 9, 3), (21, 28, 3)]


def marked(model, *texts):
    """What is found in each text: (value, kind)."""
    chars, off = pii.symbols(*text_bytes(pa.array(texts)))
    found = [[] for _ in texts]
    for d, a, b, k in pii.spans_of(pii.tag(model, chars, off), off):
        found[d].append((a, b, k))
    return [[(t[a:b], pii.KINDS[k]) for a, b, k in pii.reconciled(t, s)] for t, s in zip(texts, found, strict=True)]


PRIVATE = [
    "Call me at 01 42 68 53 00 tomorrow, or write.", "Berlin office 030/1234567 is open", "ring +44 20 7946 0958 today", "pay with 4111 1111 1111 1111 today", "server 192.168.10.254 is down",
    "The host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answers.", "mail jane.doe@cs.cam.ac.uk today", "user john_smith+news@gmail.com wrote", "IBAN DE89 3704 0044 0532 0130 00 please pay", "My SSN is 078-05-1120, thanks",
    "ghp_16C7e42F292c6912E7710c838347Ae178B4a leaked", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U was the token", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
]
VALUES = ["01 42 68 53 00", "030/1234567", "+44 20 7946 0958", "4111 1111 1111 1111", "192.168.10.254", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "jane.doe@cs.cam.ac.uk", "john_smith+news@gmail.com", "DE89 3704 0044 0532 0130 00", "078-05-1120", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", PRIVATE[11].split()[0], PRIVATE[12].split()[-1]]
HARMLESS = [
    "we use version 10.2.31.4 of it", "fixed in commit 9fceb02d0ae598e95dc970b74767f19372d61af8 by them", "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 of the file", "The meeting is on 12.05.2023, room 101.",
    "order 4839201 shipped, total $45.99", "He said the password is secret and left.", "Call me Ishmael. Some years ago, never mind how long precisely, having little or no money.",
]


def test_pii_of_forms_not_in_training(spark):
    """Sentences and values from elsewhere: the training makes up all of its own."""
    model = pii.trained(spark)
    found = marked(model, *PRIVATE)
    assert sum(v in [x for x, _ in f] for v, f in zip(VALUES, found, strict=True)) >= len(VALUES) - 1
    assert sum(bool(f) for f in marked(model, *HARMLESS)) <= 1
    texts, spans = pii.examples(600, seed=77)  # drawn anew
    chars, off = pii.symbols(*text_bytes(pa.array(texts)))
    tags = pii.tag(model, chars, off)
    hit = [bool((tags[off[j] + a : off[j] + b] > 0).all()) for j, own in enumerate(spans) for a, b, _ in own]
    assert np.mean(hit) > 0.9


def test_pii_keeps_its_model_in_the_shared_folder(spark, monkeypatch):
    first = pii.trained(spark)
    monkeypatch.setattr(pii, "fitted", lambda: 1 / 0)
    assert all((a == b).all() for a, b in zip(first.arrays(), pii.trained(spark).arrays(), strict=True))


def test_op7_is_redact_on_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, want in zip(texts, marked(pii.trained(spark), *texts.values()), strict=True):
        assert [(texts[i][s["start"] : s["end"]], s["kind"]) for s in got[i]["pii_spans"]] == want
        assert len(got[i]["text"]) == got[i]["n_chars"] and all(v not in got[i]["text"] for v, _ in want)


# ---------------------------------------------------------------- 8


def test_fingerprints(spark, odd):
    got = {r[0]: r for r in fingerprints.sketch(odd.where("doc_id IS NOT NULL"), scaled=1).collect()}
    assert got[1]["n_shingles"] == 1 and len(got[1]["sketch"]) == 1 and got[2]["sketch"] == [] and got[4]["n_shingles"] == 0
    assert got[5]["n_shingles"] == 60_000 - 4
    sketches = fingerprints.sketch(odd).withColumn("g", F.lit(1))
    union = {h for r in sketches.collect() for h in r["sketch"]}
    assert {r["h"] for r in fingerprints.hashes(sketches, "g").collect()} == union
    merged = fingerprints.merge(sketches.withColumn("g", F.when(F.col("doc_id") > 2, 1)), "g").collect()
    assert {r["g"]: r["n_shingles"] for r in merged} == {1: sum(r["n_shingles"] for r in sketches.collect() if (r["doc_id"] or 0) > 2), None: 3}
    assert {r["g"]: r["sketch_size"] for r in merged}[1] == len({h for r in sketches.collect() if (r["doc_id"] or 0) > 2 for h in r["sketch"]})
    assert fingerprints.merge(sketches.limit(0), "g").count() == 0
    part = spark.createDataFrame([(9, " ".join(LONG.split()[1000:1400]))], "p bigint, text string")
    found = fingerprints.containment(fingerprints.sketch(part, "p"), fingerprints.sketch(odd), "p", "doc_id").collect()
    rng = np.random.default_rng(6)
    sets = [sorted({f"{x:03d}" for x in np.minimum(rng.integers(0, 60, 20), rng.integers(0, 60, 20))})[: int(rng.integers(0, 20))] for _ in range(60)]  # small numbers are in most
    many = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(sets)], "k bigint, n_shingles bigint, sketch array<string>")
    for least in (0.3, 0.5, 1.0):
        got = {tuple(r)[:3] for r in fingerprints.containment(many.where("k < 30"), many.where("k >= 30").withColumnRenamed("k", "w"), "k", "w", least).collect()}
        assert got == {(i, j, len({*sets[i]} & {*sets[j]})) for i in range(30) for j in range(30, 60) if sets[i] and len({*sets[i]} & {*sets[j]}) >= least * len(sets[i])}
    assert [tuple(r)[:2] for r in found] == [(9, 5)] and found[0]["containment"] == 1
    assert fingerprints.sketch(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def test_cascade_is_exact(spark):
    urls = spark.range(6000).select(F.col("id").alias("k"), F.concat(F.lit("http://x/"), F.col("id") % 5000).alias("u"), (F.col("id") % 7 == 0).alias("flag"), F.lit(1).alias("listed"), F.lit(2).alias("h1"))
    urls = urls.unionByName(spark.createDataFrame([(None, "http://x/0", None, 1, 2), (7000, None, True, 1, 2)], "k bigint, u string, flag boolean, listed int, h1 int"))
    want = {u for u, f in urls.select("u", "flag").collect() if f and u}
    for shard_keys, part_rows in ((500_000, 1_000_000), (700, 1_000_000), (700, 50)):
        filters, shards = url_filter.build(urls, "u", F.col("flag"), shard_keys)
        got = url_filter.probe(urls, "k", "u", filters, shards, part_rows).join(urls.select("k", "u"), "k").collect()
        assert len(got) == 6001 and all(r["listed"] == (r["u"] in want) for r in got)
    filters, shards = url_filter.build(urls, "u", F.lit(False))
    assert url_filter.probe(urls, "k", "u", filters, shards).where("listed").count() == 0
    block = spark.createDataFrame([("http://x/7",), ("http://elsewhere/",), (None,), ("http://x/7",)], "anything string")
    filters, shards = url_filter.build(urls, "u", block)
    got = url_filter.probe(urls, "k", "u", filters, shards).join(urls.select("k", "u"), "k").collect()
    assert {r["u"] for r in got if r["listed"]} == {"http://x/7"}
    hot = urls.limit(1).crossJoin(spark.range(3000).select("id")).withColumn("k", F.col("id"))  # one URL in all rows
    assert url_filter.probe(hot, "k", "u", filters, shards, 100).count() == 3000
    filters, shards = url_filter.build(urls.limit(0), "u", F.col("flag"))
    assert url_filter.probe(urls.limit(0), "k", "u", filters, shards).count() == 0


# ---------------------------------------------------------------- 10


def test_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    model = quality.fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    for row, score in zip(x[2000:2050], p, strict=False):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:5], np.zeros(5)).score(x[:2]).max() < 0.5 < quality.fit(x[:0], y[:0]).score(x[:2]).min()


def plain_trees(x, y, trees, depth, bins, rate, least, l2):
    """The scores of the rows after each tree's values, by trying every edge of every feature at every node."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                total[rows] += rate * g[rows].sum() / (h[rows].sum() + l2) if len(rows) else 0
                return
            best = (1e-6, None, None)
            for f, own in enumerate(edges):
                for e in own:
                    left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(len(left), len(right)) >= least:
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, e)
            _, f, e = best
            grow(rows if f is None else rows[x[rows, f] <= e], level + 1)
            grow(rows[:0] if f is None else rows[x[rows, f] > e], level + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-total))


def test_split_search_equals_trying_every_edge():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((220, 4)).astype(np.float32)
    x[:, 3] = rng.integers(0, 3, 220)  # ties
    y = ((x[:, 0] + x[:, 3] > 0.5) ^ (rng.random(220) < 0.1)).astype(float)
    how = {"trees": 4, "depth": 3, "bins": 16, "rate": 0.3, "least": 8, "l2": 1.0}
    assert np.allclose(quality.fit(x, y, **how).score(x), plain_trees(x, y, **how), atol=1e-5)


def test_op10_equals_trees_fitted_apart(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    x = docs.merge(labels, on="doc_id")
    stats = quality.statistics(*text_bytes(pa.array(x["text"])))
    order = np.lexsort((*stats.T[::-1], x["quality"].to_numpy(), x["doc_id"].to_numpy()))
    model = quality.fit(stats[order], x["quality"].to_numpy()[order])
    want = dict(zip(docs["doc_id"], model.score(quality.statistics(*text_bytes(pa.array(docs["text"])))), strict=True))
    got = quality.op10_quality(spark, DATA).toPandas()
    assert set(got["doc_id"]) == set(want) and all(abs(r.score - want[r.doc_id]) < 2e-6 and r.keep == (r.score >= 0.5) for r in got.itertuples())


def test_statistics_equal_counting():
    texts = ["The CAT | sat, the cat 12!", "", None, "é$$"]
    got = dict(zip(quality.FEATURES, quality.statistics(*text_bytes(pa.array(texts))).T, strict=True))
    n = len(texts[0])
    assert got["log_bytes"][0] == pytest.approx(np.log1p(n)) and got["upper"][0] == pytest.approx(4 / n) and got["pipes"][0] == pytest.approx(1 / n) and got["digits"][0] == pytest.approx(2 / n)
    assert got["distinct_words"][0] == pytest.approx(4 / 6) and got["distinct_bigrams"][0] == pytest.approx(4 / 5)
    assert all(v[1] == v[2] == 0 for v in got.values())


def test_quality_on_documents(spark, odd):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.score(docs, quality.trained(docs, labels)).join(labels, "doc_id").select("score", "quality").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95
    odd_labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7), (None, 1, 7), (2, None, 7), (99, 0, 7)], "doc_id bigint, quality int, text int")
    assert quality.kept(odd, odd_labels).count() == len(ODD)
    assert quality.kept(odd, odd_labels.limit(0)).count() == len(ODD)
    assert quality.score(odd.limit(0), quality.trained(odd.limit(0), odd_labels)).count() == 0
