"""Column functions against values worked out by hand."""

import datetime as dt
import os
import re
import threading
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, dates, html, text, urls, weights


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_weights(spark):
    got = [r[0] for r in values(spark, [(x,) for x in (0, 50, 200, 290, 1000)], "n int", weights.text_weight(F.col("n")))]
    assert got == pytest.approx([0.953062, 0.925145, 0.739855, 0.55, 0.100742], abs=1e-6)
    got = [r[0] for r in values(spark, [(x,) for x in (0.0, 100.0, 150.0, 500.0)], "n double", weights.clarity_weight(F.col("n")))]
    assert got == pytest.approx([0.185815, 0.388739, 0.55, 0.995302], abs=1e-6)
    assert values(spark, [(0.8, 0.5)], "c double, t double", weights.image_weight(F.col("c"), F.col("t")))[0][0] == pytest.approx(0.631556, abs=1e-6)
    assert values(spark, [(0.7,)], "x double", weights.squash(F.col("x")))[0][0] == pytest.approx(0.598688, abs=1e-6)


def test_levels(spark):
    got = values(spark, [(n,) for n in (0, 49, 50, 51, 200, 290, None)], "n int", weights.text_level(F.col("n")), weights.is_text_image(F.col("n")))
    assert got == [("none", False), ("none", False), ("low", False), ("low", True), ("medium", True), ("high", True), (None, None)]


def test_softmax_and_labels(spark):
    (row,) = values(spark, [([1000.0, 1000.0],)], "x array<double>", weights.softmax(F.col("x")), weights.argmax(F.col("x")))
    assert row == ([0.5, 0.5], 0)
    assert values(spark, [(0,), (1,)], "k int", weights.class_label(F.col("k"))) == [("negative",), ("positive",)]
    assert values(spark, [("positive",), ("negative",), ("?",)], "k string", weights.label_class(F.col("k"))) == [(0,), (1,), (None,)]


def test_quality_ratio_scales_ratios(spark):
    a, b = values(spark, [(0.5, 1.0, 0.5)], "c double, t double, d double", weights.quality_ratio(F.col("c"), F.col("t"), F.col("d"), 7, 3, 0), weights.quality_ratio(F.col("c"), F.col("t"), F.col("d"), 0.5, 0.3, 0.2))[0]
    assert (a, b) == pytest.approx((0.85, 0.65 * 0.9))


def test_clean(spark):
    assert values(spark, [("a  <b>x</b>！！？ ( )",), ("　q\t\x07r【】",), (None,)], "x string", text.clean(F.col("x"))) == [("a x！",), ("q r",), (None,)]
    assert values(spark, [("a/b?", 1), ("", 7), (None, 8)], "x string, k int", text.safe_title(F.col("x"), F.col("k"))) == [("a_b_",), ("untitled_7",), ("untitled_8",)]
    assert values(spark, [("a, ,b",), ("No images",), (None,)], "x string", text.split_list(F.col("x"))) == [(["a", "b"],), ([],), ([],)]
    assert values(spark, [("中",), ("abc",), ("",), (None,)], "x string", text.has_script(F.col("x"))) == [(True,), (False,), (False,), (False,)]


def test_decode(spark):
    rows = [("中文".encode("gb18030"),), ("plain".encode(),), (b"\xff\xfe\xfa",), (None,)]
    assert [r[0] for r in values(spark, rows, "b binary", text.decode_index(F.col("b")))][:2] == ["中文", "plain"]
    rows += [("上证指数上涨百分之五".encode(),)]
    got = [r[0] for r in values(spark, rows, "b binary", text.decode(F.col("b")))]
    assert got[:2] == ["中文", "plain"] and got[3] is None and got[4] == "上证指数上涨百分之五"
    named = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("中文".encode("gb18030"), "text/html; charset=none-such"), ("中".encode(), "text/html"), ("中".encode(), 'a; charset="UTF-8"')]
    assert [r[0] for r in values(spark, named, "b binary, t string", text.decode(F.col("b"), text.charset_of(F.col("t"))))] == ["é", "中文", "中", "中"]


def test_categories(spark):
    rows = [("blk_gnxw_01",), ("blk_ndxw_01",), ("blk_cjxwlcsh_01",), ("other",), (None,)]
    assert [r[0] for r in values(spark, rows, "b string", text.category(F.col("b")))] == ["Domestic News", "Domestic News", "Finance·Life", None, None]
    assert sum(map(len, text.CATEGORIES.values())) == 9


def test_image_urls_word_by_word(spark):
    rows = [("http://a.com/header/x.jpg", False), ("http://p.v.iask.com/x.jpg", False), ("http://a.com/pixel/x.jpg", True), ("http://a.com/?f=x.jpg", True), ("http://a.com/x.jpg/y", True), ("http://a.com/?f=x.jpg&g", False), ("http://pxvxiask.com/x.jpg", True)]
    assert [r[0] for r in values(spark, rows, "u string, k boolean", urls.is_image_url(F.col("u")))] == [k for _, k in rows]
    names = [r[0] for r in values(spark, [("http://a.com/a.js",), ("http://a.com/abc.js",), ("http://a.com/.png",)], "u string", urls.image_filename(F.col("u")))]
    assert names[0].startswith("image_") and names[0].endswith(".jpg") and names[1] == "abc.js" and names[2].endswith(".jpg")


def test_urls(spark):
    rows = [("http://A.com/x/pic.JPG?q=1#f",), ("http://a.com/logo/x.png",), ("ftp://a.com/x.png",), ("http://a.com/",), (None,)]
    u = F.col("u")
    assert [r[0] for r in values(spark, rows, "u string", urls.is_image_url(u))] == [True, False, False, False, False]
    assert [r[0] for r in values(spark, rows, "u string", urls.normalize(u))] == ["http://a.com/x/pic.jpg", "http://a.com/logo/x.png", "ftp://a.com/x.png", "http://a.com", None]
    names = [r[0] for r in values(spark, rows, "u string", urls.image_filename(u))]
    assert names[:3] == ["pic.JPG", "x.png", "x.png"] and names[3].startswith("image_") and names[3].endswith(".jpg")
    assert values(spark, [("http://a.com/b/c", "../d"), (None, "x"), ("http://a.com", None)], "b string, l string", urls.absolute(F.col("b"), F.col("l"))) == [("http://a.com/d",), ("x",), (None,)]


def test_dates(spark):
    d = F.col("d")
    rows = [("2024-3-1",), ("2024/03/01",), ("1/3/2024",), ("soon",), (None,)]
    day = dt.date(2024, 3, 1)
    assert [r[0] for r in values(spark, rows, "d string", dates.parse_any(d))] == [day, day, day, None, None]
    assert values(spark, [("2024年3月1日 08:00",), ("none",)], "d string", dates.publish_date(d)) == [("2024-03-01",), (None,)]
    got = values(spark, [("2024.3.1", None), ("on 2024/3/1 at", None), (None, "http://x/2024-03-01/a"), (None, None)], "d string, u string", dates.article_date(d, F.col("u"), F.lit("2020-01-01").cast("date")))
    assert [r[0] for r in got] == [day, day, day, dt.date(2020, 1, 1)]


def test_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["x", "y"]), (2, [], ["z"])], "id int, a array<int>, b array<string>")
    assert [tuple(r) for r in arrays.zip_join(df, "a", "b").collect()] == [(1, 0, 1, "x"), (1, 1, 2, "y")]
    assert [r[0] for r in df.select(arrays.mean_of(F.col("a"), lambda x: x)).collect()] == [2.0, 0.0]
    assert [r[0] for r in df.select(arrays.first_or(F.col("a"), F.lit(9), F.lit(-1))).collect()] == [1, -1]


PAGE = '<html><script>var a="</p><p>no";</script><nav id="n"><a href="/a"> A <b>b</b></a><a>none</a></nav><a href="/out">out</a><article><h1>T <i>t</i></h1><span class="date">2024-01-02</span><p>one<p>two <img src="i.png">more</p><p> </p></article><p>after</p></html>'


def test_html(spark):
    df = spark.createDataFrame([(PAGE, "http://x.com/d/p"), ("", "http://x.com"), (None, None)], "h string, u string")
    got = [tuple(r) for r in df.select(html.links(F.col("h"), ("nav", "#n")), html.article(F.col("h"), F.col("u"))).collect()]
    assert [tuple(x) for x in got[0][0]] == [("nav", "A b", "/a")]
    assert tuple(got[0][1]) == ("T t", "one\ntwo more", ["http://x.com/d/i.png"], "2024-01-02")
    assert got[1][0] == [] and tuple(got[2][1]) == (None, None, None, None)


def test_html_links_are_absolute_where_the_page_has_a_url(spark):
    page = '<nav><a href="/a">1</a><a href="b?c#d">2</a><a href="http://y.com/">3</a></nav>'
    df = spark.createDataFrame([(1, page, "http://x.com/d/p"), (2, page, None), (3, page, ""), (4, None, "http://x.com"), (5, "<nav><a>none</a></nav>", "http://x.com")], "id int, h string, u string").repartition(1)
    got = {r[0]: [x["link"] for x in r[1]] for r in df.select("id", html.links(F.col("h"), url=F.col("u"))).collect()}
    own = ["/a", "b?c#d", "http://y.com/"]
    assert got == {1: ["http://x.com/a", "http://x.com/d/b?c#d", "http://y.com/"], 2: own, 3: own, 4: [], 5: []}


def test_html_results_go_back_by_the_megabyte():
    pages = ["x" * (html.PIECE // 2), None, "y" * (html.PIECE // 2), "", "z" * (3 * html.PIECE), None]
    got = list(html.results(iter([(pa.array(pages), pa.array(range(6))), (pa.array([], pa.string()), pa.array([], pa.int64())), (pa.array(["w"]), pa.array([6]))]), lambda p, k: [f"{k}{(p or '-')[:1]}"], pa.list_(pa.string())))
    assert [x.to_pylist() for x in got] == [[["0x"], ["1-"], ["2y"]], [["3-"], ["4z"]], [["5-"]], [["6w"]]]


def workers_mb() -> float:
    """Anonymous memory of the Python workers that this process's sessions have."""
    parents = {}
    for at in Path("/proc").glob("[0-9]*/stat"):
        try:
            parents[int(at.parent.name)] = int(at.read_text().rpartition(")")[2].split()[1])
        except OSError:
            continue
    total = 0
    for pid in parents:
        up = pid
        while up in parents and up != os.getpid():
            up = parents[up]
        try:
            if up == os.getpid() and b"pyspark.daemon" in Path(f"/proc/{pid}/cmdline").read_bytes():
                total += int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1])
        except OSError:
            continue
    return total / 1024


@pytest.mark.parametrize("what", ["links", "article"])
def test_html_workers_hold_little_besides_the_batch(spark, what):
    """20,000 pages of 6 KB are 60 MB a batch; as Python's text, of four bytes a character, they are four times that."""
    h = F.concat(F.lit('<nav><a href="/a">t</a></nav><article><h1>\U0001f600</h1><p>'), F.repeat(F.lit("ab "), 2000), F.col("id").cast("string"))
    df = spark.range(0, 20_000, 1, 1).select("id", h.alias("h"))
    own = F.explode(html.links(F.col("h"))) if what == "links" else html.article(F.col("h"), F.lit("http://x.com"))
    before, most, over = workers_mb(), 0.0, threading.Event()

    def watch() -> None:
        nonlocal most
        while not over.wait(0.02):
            most = max(most, workers_mb())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        rows = df.select("id", own.alias("a")).agg(F.count("*"), F.sum(F.length(F.col("a.title")))).first()
    finally:
        over.set()
        watcher.join()
    assert tuple(rows) == (20_000, 20_000)
    assert 0 < most < before + 260, (before, most)
