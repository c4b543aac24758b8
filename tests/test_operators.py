"""Operators, sources, sinks, scorers and streams on small tables."""

import io
import json
import threading
import zlib
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import cli, plans, sinks, streaming
from tidemark.operators import aggregates, filters, joins, sampling, updates, windows
from tidemark.schemas import SCHEMAS
from tidemark.scoring import Lexicon, blur_score, content_ratio, gray, has_qr, pixels, score, text_lengths, train_head
from tidemark.sources import PageSource, files, images, labelled_images, market, page_urls, read_any, table_years, years
from tidemark.sources.xlsx import build, parse


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_image_index(spark):
    df = spark.createDataFrame([(2024, "d", 0.9, 1, 0.8), (2024, "d", 0.2, 0, 0.4), (2024, "d", 0.6, 1, 0.0), (2024, "e", 0.5, 0, 0.0), (2024, None, 0.5, 0, 0.0), (2024, "d", None, 0, 1.0)], "year int, news_date string, negative_likelihood double, predicted_class int, quality_score double")
    got = rows(aggregates.image_index(df).orderBy("news_date"))
    assert got[0][2:4] == (3, 2) and got[0][4:7] == pytest.approx((2 / 3, 0.566667, 0.666667), abs=1e-6)
    assert got[1][6] == 0.0


def test_text_index_falls_back(spark):
    df = spark.createDataFrame([(2024, "d", 0.9, 0, 0.0), (2024, "d", 0.1, 1, 0.0)], "year int, news_date string, textneg_likelihood double, sentiment_class int, avg_quality_score double")
    got = aggregates.text_index(df).first()
    assert got["WeightedTextPes"] == pytest.approx(0.5) and got["negative_count"] == 1


def test_fill_and_returns(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 5.0, None, None), (3, None, 7.0, None)], "d int, a double, b double, c double")
    assert rows(windows.fill(df, "d", "a", "b", "c").orderBy("d")) == [(1, 5.0, 7.0, None), (2, 5.0, 7.0, None), (3, 5.0, 7.0, None)]
    df = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 99.0), (4, 0.0), (5, 1.0)], "d int, x double")
    got = [r["x_returns"] for r in windows.returns(df, "d", "x").orderBy("d").collect()]
    assert got[0] is None and got[1:4] == pytest.approx([0.1, -0.1, -1.0]) and got[4] is None
    assert windows.drop_first_returns(df, "d").count() == 4


def test_fill_is_idempotent(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(1, 20)], "d int, x double")
    once = windows.fill(df, "d", "x")
    assert rows(once.orderBy("d")) == rows(windows.fill(once, "d", "x").orderBy("d"))


def test_distribution(spark):
    got = aggregates.distribution(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double"), "x").first()
    assert (got["p10"], got["p50"], got["p95"]) == pytest.approx((1.3, 2.5, 8.95))
    assert aggregates.series_stats(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x").first()["std"] == pytest.approx(1.527525, abs=1e-6)


def test_correlations_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert {(a, b): r for a, b, r in rows(aggregates.correlations(df, "a", "b"))}[("a", "b")] is None


def test_sizes_and_reasons(spark):
    df = spark.createDataFrame([(150, 450), (150, 451), (149, 300), (4000, 4001), (None, 200)], "w int, h int")
    assert [r[0] for r in rows(df.select(filters.size_ok(F.col("w"), F.col("h"))))] == [True, False, False, False, False]
    df = spark.createDataFrame([(False, 1, 0.0, True), (True, 1, 0.0, True), (True, 200, 0.0, True), (True, 200, None, True), (True, 200, 1.0, None)], "v boolean, s int, c double, q boolean")
    assert [r[0] for r in rows(df.select(filters.reject_reason(F.col("v"), F.col("s"), F.col("s"), F.col("c"), F.col("q"))))] == ["invalid_image", "size_ratio", "content_area", "qr_code", None]
    assert [r[0] for r in rows(spark.createDataFrame([(200, "image/png", 1024), (200, "text/html", 2000), (None, None, None)], "s int, t string, n int").select(filters.payload_ok(F.col("s"), F.col("t"), F.col("n"))))] == [True, False, False]


def test_joins(spark):
    left = spark.createDataFrame([("d1", 1), ("d2", 2)], "news_date string, a int")
    right = spark.createDataFrame([("d2", 3), ("d3", 4)], "news_date string, b int")
    assert rows(joins.outer(left, right, "news_date").orderBy("news_date")) == [("d1", 1, None), ("d2", 2, 3), ("d3", None, 4)]
    images_ = spark.createDataFrame([("x", 1, 0.1), ("x", 9, 0.1), ("y", 0, 0.3)], "original_id string, image_index int, quality_score double")
    scores = spark.createDataFrame([("x", [0.5, 0.6])], "original_id string, scores array<double>")
    assert sorted(r["quality_score"] for r in joins.sync_image_quality(images_, scores).collect()) == [0.3, 0.5, 0.6]
    assert sorted(r["quality_score"] for r in joins.sync_image_quality(images_, scores, compat=True).collect()) == [0.3, 0.5, 0.5]
    assert joins.with_date_column(spark.createDataFrame([(1, 2)], "x int, Trade_Date int")).columns == ["x", "Date"]
    with pytest.raises(ValueError):
        joins.with_date_column(left.select("a"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.sampled_from([0.1, 0.33, 0.5, 1.0]))
def test_allocation_sums_to_its_target(spark, sizes, rate):
    df = spark.createDataFrame([(f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)], "s string, i int")
    got = rows(sampling.allocation(df, "s", rate))
    assert all(0 <= take <= size for _, size, take in got)
    assert sum(t for _, _, t in got) == int(np.floor(sum(sizes) * rate))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6), st.integers(0, 60), st.sampled_from([0.1, 0.5, 0.9]))
def test_allocation_equals_passes(spark, sizes, undated, rate):
    total = sum(sizes) + undated
    target = int(total * rate)
    want = [min(round(n / total * target), n) for n in sizes]
    off = min(target, sum(sizes)) - sum(want)
    while off:
        for k in range(len(sizes)):
            if off > 0 and want[k] < sizes[k]:
                want[k], off = want[k] + 1, off - 1
            elif off < 0 and want[k] > 0:
                want[k], off = want[k] - 1, off + 1
    df = spark.createDataFrame([(f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)] + [(None, 0)] * undated, "s string, i int")
    assert [r["take"] for r in sampling.allocation(df, "s", rate).orderBy("s").collect()] == want


def test_truth(spark):
    df = spark.createDataFrame([(0, 0.0, False, "", "0"), (1, 0.5, True, "x", "0"), (None, None, None, None, None)], "i int, d double, b boolean, s string, z string")
    assert rows(df.select(*[filters.truthy(F.col(c)) for c in df.columns])) == [(False, False, False, False, True), (True,) * 5, (False,) * 5]


def test_shuffled_epochs(spark):
    df = spark.range(50)
    one, two = ([r["id"] for r in sampling.epoch(df, "id", k).orderBy("position").collect()] for k in (0, 1))
    assert sorted(one) == sorted(two) == list(range(50)) and one != two


def test_heads_and_pairs(spark):
    df = spark.range(12)
    assert rows(filters.head_and_more(df, "id")) == [(k, 2) for k in range(10)] and rows(filters.head_and_more(df.where("id < 3"), "id"))[0] == (0, 0)
    q = spark.createDataFrame([("a", [1, 2]), ("b", []), ("", [1]), ("c", [1]), (None, [1])], "original_id string, images array<int>")
    f = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("", ["x"]), ("c", [])], "original_id string, valid_images array<string>")
    assert rows(joins.pair_images(q, f)) == [("a", 0, 1, "x")]
    assert rows(updates.affected(df, F.col("id") < 4, id=F.lit(1))) == [(4, 3)]


def test_payloads_and_qr(spark, tmp_path):
    df = spark.createDataFrame([("a", b"1"), ("b", b"")], "name string, content binary")
    sinks.write_payloads(df, f"{tmp_path}/p")
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "p").iterdir()) == [("a", b"1"), ("b", b"")]
    assert [r[0] for r in has_qr(df, lambda b: 1 / len(b) > 0, "content").select("has_qr").collect()] == [True, False]
    assert not has_qr(df, None).first()["has_qr"]


def test_upsert_and_years(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.createDataFrame([(2023, "a", 1), (2024, "b", 1)], "year int, k string, v int")
    sinks.upsert_years(old, path, ["k"], F.desc("v"))
    sinks.upsert_years(spark.createDataFrame([(2024, "b", 5), (2024, "c", 1)], "year int, k string, v int"), path, ["k"], F.desc("v"))
    assert sorted((r["year"], r["k"], r["v"]) for r in years(spark, path).collect()) == [(2023, "a", 1), (2024, "b", 5), (2024, "c", 1)]
    assert table_years(spark, path) == [2023, 2024] and table_years(spark, f"{tmp_path}/none") == []
    assert years(spark, path, [2023]).count() == 1
    assert rows(updates.upsert_counts(old, spark.createDataFrame([("a",), ("z",)], "k string"), ["k"])) == [(2, 1, 1)]


def test_files_of_each_kind(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), 1.5, "x&<"), (date(2024, 1, 3), None, "y")], "Date date, v double, s string")
    for kind in ("csv", "json", "jsonl", "xlsx", "parquet"):
        sinks.write_any(df, f"{tmp_path}/o.{kind}")
        got = market(read_any(spark, f"{tmp_path}/o.{kind}"), "Date").select("Date", "v")
        assert sorted(rows(got)) == [(date(2024, 1, 2), 1.5), (date(2024, 1, 3), None)]
    assert json.loads(next((tmp_path / "o.json").glob("part-*")).read_text())[1] == {"Date": "2024-01-03", "v": None, "s": "y"}
    assert parse(build(["a"], [(True,), (None,), ("t",)])) == [["a"], [True], [], ["t"]]


def test_failures(spark, tmp_path):
    df = spark.createDataFrame([("u", 1), ("w", None)], "url string, x int")
    good, bad = sinks.split_failures(df, F.col("x") == 1, F.lit("missing"))
    sinks.append_failures(bad, f"{tmp_path}/dead")
    assert good.count() == 1 and filters.retryable(spark.read.json(f"{tmp_path}/dead")).count() == 1


def png(x: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    h, w = x.shape[:2]
    raw = b"".join(b"\0" + r.tobytes() for r in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for name, body in (("positive/a.png", png(x)), ("negative/b.png", png(np.full((4, 4, 3), 9, np.uint8))), ("negative/._c.png", b"no"), ("negative/d.png", b"broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["origin"].rpartition("/")[2]: r for r in images(spark, str(tmp_path)).withColumn("m", pixels("height", "width", "nChannels", "data")).collect()}
    assert sorted(got) == ["a.png", "b.png", "d.png"]
    own = gray(5, 7, 3, x[:, :, ::-1].tobytes())
    pad = np.pad(own, 1, mode="reflect")
    brute = np.array([[pad[i - 1, j] + pad[i + 1, j] + pad[i, j - 1] + pad[i, j + 1] - 4 * pad[i, j] for j in range(1, 8)] for i in range(1, 6)]).var()
    assert got["a.png"]["m"]["blur"] == pytest.approx(brute) == pytest.approx(blur_score(own)) and got["b.png"]["m"]["blur"] == 0 and got["d.png"]["m"]["content"] is None
    assert got["b.png"]["m"]["content"] == 1 and content_ratio(own) == pytest.approx((own <= 127).mean())
    assert sorted(r["label"] for r in labelled_images(spark, str(tmp_path)).where("nChannels > 0").collect()) == [0, 1]
    assert sorted(r["name"] for r in files(spark, str(tmp_path)).collect()) == ["a.png", "b.png", "d.png"]


def test_scorers(spark):
    df = spark.createDataFrame([(1, "bad bad"), (2, "good"), (3, None), (4, "")], "id int, t string")
    got = {r[0]: r[1:] for r in rows(score(df, "id", "t", lambda: Lexicon(["bad"], ["good"])))}
    assert got[1][0] == 1 and got[2][0] == 0 and got[3] == (None, None) and got[4] == (0, 0.5)

    def fails(raw):
        raise OSError

    assert text_lengths(df.withColumnRenamed("t", "text"), None).where("id = 1").first()["text_length"] == 7
    assert text_lengths(df.select(F.encode("t", "utf-8").alias("data")), fails).agg(F.sum("text_length")).first()[0] == 0


def test_first_existing(spark):
    df = spark.createDataFrame([("a", "b"), ("x", "b"), ("x", "y"), (None, "b"), ("a", "b")], "p string, q string")
    listing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    got = joins.first_existing(df, listing, F.col("p"), F.col("q")).select("p", "q", "found")
    assert sorted(rows(got), key=str) == sorted([("a", "b", "a"), ("a", "b", "a"), ("x", "b", "b"), ("x", "y", None), (None, "b", "b")], key=str)


def test_pages_by_http(spark):
    class Handler(BaseHTTPRequestHandler):
        seen = 0

        def do_GET(self):
            Handler.seen += 1
            code = 404 if self.path == "/none" else 503 if self.path == "/busy" and Handler.seen < 3 else 200
            self.send_response(code)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>hi</p>")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(PageSource)
    got = spark.read.format("pages").option("urls", json.dumps([f"{base}/busy", f"{base}/none"])).option("wait", "0").load().collect()
    server.shutdown()
    assert {r["url"][len(base) :]: (r["status"], r["body"] is not None) for r in got} == {"/busy": (200, True), "/none": (404, False)}


def test_trained_head(spark):
    df = spark.createDataFrame([([float(k), 1.0], int(k > 10)) for k in range(20)], "x array<double>, y int")
    got = train_head(df, "x", "y")
    assert got.summary.accuracy > 0.8


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 01:00:00", 0.2, 0, 0.5), ("2024-01-01 05:00:00", 0.9, 1, 0.7), ("2024-01-02 00:00:00", 0.4, 0, None)], "ts string, negative_likelihood double, predicted_class int, quality_score double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert sorted(rows(streaming.run_once(streaming.daily_index(stream)))) == sorted(rows(streaming.daily_index(df)))
    urls_ = spark.createDataFrame([("a", 2024, 1), ("a", 2024, 1), ("b", 2024, 1)], "url string, year int, v int")
    urls_.write.parquet(f"{tmp_path}/urls")
    again = spark.readStream.schema(urls_.schema).parquet(f"{tmp_path}/urls")
    assert streaming.run_once(streaming.new_urls(again), "append").count() == 2
    for _ in range(2):
        streaming.upsert_stream(again, f"{tmp_path}/t", f"{tmp_path}/c", ["url"], F.desc("v")).awaitTermination()
    assert years(spark, f"{tmp_path}/t").count() == 2


def test_cli(spark, tmp_path):
    assert cli.chosen(["merge", "requality"], None) == ["requality", "merge"] and cli.chosen(None, ["merge"])[-2:] == ["text_index", "enrich"]
    assert cli.main(["--data", "x", "--steps", "nonsense"]) == 1
    assert len(page_urls("http://x/{day}{edition}", date(2024, 1, 30), date(2024, 2, 1))) == 6
    img = spark.createDataFrame([{"original_id": "a", "image_index": 0, "negative_likelihood": 0.9, "predicted_class": 1, "quality_score": 0.5}], SCHEMAS["image_sentiment"]).withColumn("year", F.lit(2024))
    news = spark.createDataFrame([{"original_id": "a", "news_date": "2024-01-02", "content": "x", "has_valid_images": True}, {"original_id": "b", "news_date": "2024-01-02", "content": "", "has_valid_images": True}], SCHEMAS["news_filtered"]).withColumn("year", F.lit(2024))
    quality = spark.createDataFrame([{"original_id": "a", "images": [{"path": "p", "clarity_weight": 0.5, "text_weight": 1.0}]}], SCHEMAS["news_quality"]).withColumn("year", F.lit(2024))
    texts = spark.createDataFrame([{"original_id": k, "news_date": "2024-01-02", "sentiment_class": 0, "textneg_likelihood": p} for k, p in (("a", 0.7), ("b", 0.1))], SCHEMAS["text_sentiment"]).withColumn("year", F.lit(2024))
    for name, df in (("image_sentiment", img), ("news_filtered", news), ("news_quality", quality), ("text_sentiment", texts)):
        sinks.write_years(df, f"{tmp_path}/{name}")
    sinks.write_any(spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 2.0)], "Date date, x double"), f"{tmp_path}/market.xlsx")
    s = cli.Settings(str(tmp_path), 2024, 2024, market=f"{tmp_path}/market.xlsx", output="m.jsonl")
    for name in cli.STEPS:
        cli.STEPS[name](spark, s)
    got = read_any(spark, f"{tmp_path}/m.jsonl").first()
    assert [r["WeightedPhotoPes"] for r in read_any(spark, f"{tmp_path}/market_with_WeightedPhotoPes.xlsx").orderBy("Date").collect()] == [None, 0.9]
    assert (got["PhotoPes"], got["TextPes_likelihood"]) == (1.0, 0.7)
    assert years(spark, f"{tmp_path}/news_requality").first()["avg_quality_score"] == pytest.approx(0.85)


def test_flagship_plan_reads_only_its_columns(spark):
    from conftest import DATA

    out = io.StringIO()
    df = plans.QUERIES["daily_image_index"](spark, DATA)
    out.write(df._jdf.queryExecution().toString())
    assert "text:string" not in out.getvalue().rpartition("Physical Plan")[2]
