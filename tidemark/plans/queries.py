"""One query for each operator, over whole tables: events stand for scored images, documents for articles, orders for
the market, pages for what was crawled. QUERIES makes them, ORACLES has the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.functions import arrays, dates, html, text, urls, weights
from tidemark.operators import aggregates, filters, joins, sampling, updates, windows
from tidemark.scoring import Lexicon, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LAST, MERGED = "2024-12-31", ("TextPes", "PhotoPes")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in keys])


# ---------------------------------------------------------------- the tables as images, news and market


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    p = F.col("value") / (F.col("value") + 50)
    return e.select(
        "event_id", F.col("user_id").alias("original_id"), "event_type", "ts", "value", F.col("ts").cast("date").alias("day"), p.alias("negative_likelihood"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted_class"),
        weights.clarity_weight(F.col("value")).alias("clarity_weight"), weights.clarity_weight(k, 50.0, 0.06).alias("quality_score"), k.alias("k"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("original_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("news_date"), F.col("text").alias("content"), "n_chars", F.col("source").alias("category"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean prices, a column for each priority: the indices, found when the query runs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("Date"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("i"), "o_totalprice")
    return o.groupBy("Date").pivot("i").agg(F.avg("o_totalprice"))


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
IMAGES = f"""(SELECT event_id, user_id AS original_id, event_type, ts, value, CAST(ts AS DATE) AS day, value / (value + 50) AS p, CASE WHEN value / (value + 50) >= 0.5 THEN 1 ELSE 0 END AS c,
  0.1 + 0.9 / (1 + exp(-0.015 * (value - 150))) AS clarity, 0.1 + 0.9 / (1 + exp(-0.06 * ({K} - 50))) AS q, {K} AS k FROM events)"""
NEWS = "(SELECT doc_id AS original_id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS news_date, text AS content, n_chars, source AS category FROM documents)"
PRIORITIES = "12345"
MARKET = "(SELECT CAST(o_orderdate AS DATE) AS Date, " + ", ".join(f"avg(CASE WHEN substr(o_orderpriority, 1, 1) = '{p}' THEN o_totalprice END) AS p{p}" for p in PRIORITIES) + " FROM orders GROUP BY 1)"
TEXT_W = "(1.0 - 0.9 / (1 + exp(-0.01 * (n_chars - 290))))"

# ---------------------------------------------------------------- daily indices


IMAGE_INDEX = f"""SELECT year(news_date) AS year, news_date, count(*) AS total_images, CAST(sum(c) AS BIGINT) AS negative_count, round(avg(c), 6) AS "PhotoPes", round(avg(p), 6) AS "PhotoPes_likelihood",
  round(CASE WHEN sum(q) > 0 THEN sum(p * q) / sum(q) ELSE 0 END, 6) AS "WeightedPhotoPes", round(avg(q), 6) AS avg_quality_score
  FROM {IMAGES} i JOIN {NEWS} n USING (original_id) WHERE p IS NOT NULL GROUP BY news_date"""


def _image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = joins.latest(news(spark, sf_dir).select("original_id", "news_date").where(filters.truthy(F.col("original_id").cast("string"))), ["original_id"], F.desc("news_date"))
    joined = images(spark, sf_dir).select("original_id", "negative_likelihood", "predicted_class", "quality_score").join(build, "original_id")
    return aggregates.image_index(joined.withColumn("year", F.year("news_date")))


@query(IMAGE_INDEX)
def daily_image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_image_index(spark, sf_dir)).orderBy("news_date")


TEXTS = f"""(SELECT original_id, news_date, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS sc, {TEXT_W} AS p, CASE WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS w FROM {NEWS} n JOIN labels l ON l.doc_id = n.original_id WHERE content <> '')"""
TEXT_INDEX = f"""SELECT year(news_date) AS year, news_date, count(*) AS total_count, count(CASE WHEN sc = 0 THEN 1 END) AS negative_count, count(CASE WHEN sc = 1 THEN 1 END) AS positive_count, round(avg(CASE WHEN sc = 0 THEN 1.0 ELSE 0.0 END), 6) AS "TextPes",
  round(avg(p), 6) AS "TextPes_likelihood", round(CASE WHEN sum(w) > 0 THEN sum(p * w) / sum(w) ELSE avg(p) END, 6) AS "WeightedTextPes", round(avg(w), 6) AS avg_quality_score FROM {TEXTS} GROUP BY news_date"""


def _text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("original_id"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("sentiment_class"), F.when(F.col("quality") == 1, 1.0).otherwise(0.5).alias("avg_quality_score"))
    joined = news(spark, sf_dir).where(filters.truthy(F.col("content"))).select("original_id", "news_date", "n_chars").join(labels, "original_id")
    return aggregates.text_index(joined.withColumn("textneg_likelihood", weights.text_weight(F.col("n_chars"))).withColumn("year", F.year("news_date")))


@query(TEXT_INDEX)
def daily_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_text_index(spark, sf_dir)).orderBy("news_date")


@query(f"""SELECT day AS news_date, event_type AS title, round(avg(p), 6) AS avg_negative_likelihood, round(avg(clarity), 6) AS avg_clarity_weight, round(avg(q), 6) AS avg_quality_score, count(*) AS image_count,
  CAST(sum(c) AS BIGINT) AS negative_count, CAST(sum(1 - c) AS BIGINT) AS positive_count, round(CAST(sum(c) AS DOUBLE) / count(*), 6) AS negative_ratio FROM {IMAGES} GROUP BY 1, 2""")
def news_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir).withColumnRenamed("day", "news_date").withColumnRenamed("event_type", "title")
    return rounded(aggregates.news_rollup(i, "negative_likelihood", "clarity_weight", "quality_score")).orderBy("news_date", "title")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories FROM events GROUP BY 1")
def date_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.date_statistics(images(spark, sf_dir), "day", "event_type").withColumn("categories", F.array_join("categories", ",")).orderBy("day")


@query(f"SELECT count(CASE WHEN c = 0 THEN 1 END) AS positive, count(CASE WHEN c = 1 THEN 1 END) AS negative, round(avg(p), 6) AS mean, round(sum(p * clarity * q) / sum(clarity), 6) AS weighted FROM {IMAGES}")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir).withColumnRenamed("clarity_weight", "weight").withColumnRenamed("quality_score", "diversity_score")
    return rounded(aggregates.run_totals(i))


# ---------------------------------------------------------------- ingestion


UPSERTED = "(SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events)"


@query(f"SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, value FROM {UPSERTED} WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id", "value", "ts")
    old, new = e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")  # both halves together are the whole table
    return updates.upsert(old, new, ["user_id", "event_type", "day"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""WITH o AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 <> 0), n AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 = 0)
  SELECT count(*) AS total, count(CASE WHEN o.day IS NULL THEN 1 END) AS new, count(o.day) AS duplicate FROM n LEFT JOIN o USING (user_id, event_type, day)""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    return updates.upsert_counts(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type", "day"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_links_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.new_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def existing_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents WHERE text <> '' AND n_chars % 4 <> 0")
def purge_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("image_links", F.sequence(F.lit(1), (F.col("n_chars") % 4).cast("int")))
    d = d.withColumn("image_links", F.when(F.col("n_chars") % 4 == 0, F.array().cast("array<int>")).otherwise(F.col("image_links")))
    return filters.purge_invalid(d, "text").select("doc_id", "n_chars")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS skipped FROM documents")
def url_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("url"))
    return joins.first_seen(d, "url", F.col("doc_id")).select("doc_id", "skipped")


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g'), '<[^>]+>', '', 'g'), '([!?。！？，,])[!?。！？，,]+', '\\1', 'g'), '\\(\\s*\\)|\\[\\s*\\]|【\\s*】|（\\s*）', '', 'g')"


@query(f"""SELECT doc_id, title, regexp_matches(title, '[a-z]') AS lettered, substr(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), 1, 100) AS file_title
  FROM (SELECT doc_id, trim({CLEAN.format(x="split_part(text, chr(10), 1)")}) AS title FROM documents) WHERE title <> ''""")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.clean(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title")).where("title <> ''")
    return d.select("doc_id", "title", text.has_script(F.col("title"), "[a-z]").alias("lettered"), text.safe_title(F.col("title"), F.col("doc_id")).alias("file_title"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_length, md5(substr(text, 1, 2048)) AS head FROM documents")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.collapse(F.col("text"))).cast("bigint").alias("text_length"), F.md5(text.head(F.col("text"))).alias("head"))


PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, lower(regexp_replace(concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 1), '://', regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2), {PATH}), '/$', '')) AS url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


_BAD = r"icon|logo|p\.v\.iask|button|banner|avatar|loading|background|ad_|adv_|advertisement|favicon|footer|header|sidebar|thumbnail|placeholder"
_WITH = "concat(url, CASE page_id % 9 WHEN 0 THEN '/a.jpg' WHEN 1 THEN '/logo.png' WHEN 2 THEN '/x.webp?y=1' WHEN 3 THEN '/b' WHEN 4 THEN '/header/x.jpg' WHEN 5 THEN '/pixel/x.jpg' WHEN 6 THEN '/x?f=y.jpg' WHEN 7 THEN '/a.js' ELSE '.gif/c' END)"


@query(f"SELECT page_id, regexp_matches(lower(url), '^https?://') AND (regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|webp|bmp)$') OR regexp_matches(lower({PATH}), '\\.(jpg|jpeg|png|gif|webp|bmp)')) AND NOT regexp_matches(lower(url), '{_BAD}') AS valid FROM (SELECT page_id, {_WITH} AS url FROM pages)")
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_WITH).alias("url")).select("page_id", urls.is_image_url(F.col("url")).alias("valid"))


@query(f"""SELECT page_id, CASE WHEN length(base) < 5 OR position('.' IN base) = 0 THEN concat('image_', md5(url), '.jpg') ELSE base END AS name
  FROM (SELECT page_id, url, regexp_extract({PATH}, '([^/]*)$', 1) AS base FROM (SELECT page_id, {_WITH} AS url FROM pages))""")
def image_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_WITH).alias("url")).select("page_id", urls.image_filename(F.col("url")).alias("name"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"), url=F.col("url"))).alias("a"))
    return p.select("page_id", "a.block", text.clean(F.col("a.title")).alias("title"), "a.link")


@query()
def page_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.article(F.col("html"), F.col("url")).alias("a")).select("page_id", "a.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    nth = F.col("o_orderkey") % 5
    written = F.when(nth == 0, F.date_format("d", "yyyy-MM-dd")).when(nth == 1, F.date_format("d", "yyyy/M/d")).when(nth == 2, F.date_format("d", "d/M/yyyy")).when(nth == 3, F.date_format("d", "yyyyMMdd")).otherwise("soon")
    return o.select("o_orderkey", written.alias("w"), nth.alias("n")).select("o_orderkey", F.when(F.col("n") == 3, dates.compact(F.col("w"))).otherwise(dates.parse_any(F.col("w"))).alias("parsed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2024-01-01' END AS published FROM orders")
def date_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("http://a.example.com/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/x"))).otherwise("http://a.example.com/x")
    return o.select("o_orderkey", dates.article_date(F.lit(None).cast("string"), url, F.lit("2024-01-01").cast("date")).alias("published"))


# ---------------------------------------------------------------- image filters


SURROGATE = "(SELECT p_partkey, CAST(p_partkey * 7 % 4200 AS BIGINT) AS w, CAST(p_partkey * 13 % 3000 AS BIGINT) AS h, (p_size % 10) / 10.0 AS c, p_size % 9 = 0 AS qr, p_size % 11 <> 0 AS ok FROM part)"
REASON = f"""SELECT p_partkey, CASE WHEN NOT ok THEN 'invalid_image' WHEN NOT (least(w, h) >= 150 AND greatest(w, h) <= 4000 AND greatest(w, h) <= 3 * least(w, h)) THEN 'size_ratio' WHEN c < 0.15 THEN 'content_area' WHEN qr THEN 'qr_code' END AS reason FROM {SURROGATE}"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    w, h = (F.col("p_partkey") * 7) % 4200, (F.col("p_partkey") * 13) % 3000
    return p.select("p_partkey", filters.reject_reason(F.col("p_size") % 11 != 0, w, h, (F.col("p_size") % 10) / 10.0, F.col("p_size") % 9 == 0).alias("reason"))


@query(REASON)
def reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir)


@query(f"SELECT coalesce(reason, 'none') AS reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS percent FROM ({REASON}) GROUP BY 1")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reasons(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("none")))
    return rounded(aggregates.counts_with_share(r, "reason").withColumn("percent", F.col("percent").cast("double")))


# ---------------------------------------------------------------- weights


@query(f"SELECT doc_id, round({TEXT_W}, 6) AS weight FROM documents")
def text_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(weights.text_weight(F.col("n_chars"))).alias("weight"))


@query(f"SELECT event_id, round(clarity, 6) AS weight FROM {IMAGES}")
def clarity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("event_id", r6("clarity_weight").alias("weight"))


LEVEL = "CASE WHEN n_chars >= 290 THEN 'high' WHEN n_chars >= 200 THEN 'medium' WHEN n_chars >= 50 THEN 'low' ELSE 'none' END"


@query(f"SELECT doc_id, {LEVEL} AS level, n_chars > 50 AS is_text FROM documents")
def text_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", weights.text_level(F.col("n_chars")).alias("level"), weights.is_text_image(F.col("n_chars")).alias("is_text"))


@query(f"""SELECT level, coalesce(n, 0) AS n FROM (SELECT unnest(['high', 'medium', 'low', 'none']) AS level) LEFT JOIN (SELECT {LEVEL} AS level, count(*) AS n FROM documents GROUP BY 1) USING (level)""")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(weights.text_level(F.col("n_chars")).alias("level"))
    return aggregates.histogram_of_levels(d, "level", ("high", "medium", "low", "none"))


def _scored(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return images(spark, sf_dir).select("event_id", *more)


_Q = "quality_score"


@query(f"SELECT event_id, round(clarity * q, 6) AS quality, clarity * q >= 0.5 AS high FROM {IMAGES}")
def quality_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = weights.quality_product(F.col("clarity_weight"), F.col(_Q))
    return _scored(spark, sf_dir, r6(product).alias("quality"), weights.is_high(product).alias("high"))


@query(f"SELECT event_id, round(tanh(1.2 * (0.4 * clarity + 0.6 * q)), 6) AS weight, round(p * tanh(1.2 * (0.4 * clarity + 0.6 * q)) * 1.0, 6) AS weighted_score FROM {IMAGES}")
def image_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights.image_weight(F.col("clarity_weight"), F.col(_Q))
    return _scored(spark, sf_dir, r6(w).alias("weight"), r6(weights.weighted_score(F.col("negative_likelihood"), w, F.lit(None).cast("double"))).alias("weighted_score"))


@query(f"""SELECT event_id, round(0.7 * q + 0.3 * clarity, 6) AS base, round((tanh(0.7 * q + 0.3 * clarity - 0.5) + 1) / 2, 6) AS nonlinear,
  round((0.5 * q + 0.3 * clarity) * (0.8 + 0.2 * p), 6) AS diverse FROM {IMAGES}""")
def requality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (F.col("clarity_weight"), F.col(_Q), F.col("negative_likelihood"))
    return _scored(spark, sf_dir, r6(weights.quality_ratio(*own)).alias("base"), r6(weights.quality_ratio(*own, nonlinear=True)).alias("nonlinear"), r6(weights.quality_ratio(*own, 0.5, 0.3, 0.2)).alias("diverse"))


# ---------------------------------------------------------------- distributions and fits


def _percentiles(x: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p / 100}), 6) AS p{p}" for p in aggregates.PERCENTILES)


@query(f"SELECT count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, {_percentiles('value')} FROM events")
def dist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.distribution(images(spark, sf_dir), "value"))


@query("SELECT round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.75), 6) AS medium, round(quantile_cont(value, 0.95), 6) AS high FROM events WHERE value > 0")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.thresholds(aggregates.distribution(images(spark, sf_dir).where("value > 0"), "value")))


@query("""SELECT round(b, 6) AS midpoint, round(CASE WHEN b - a > 0 THEN greatest(0.01, least(1 / (b - a), 0.1)) ELSE 0.05 END, 6) AS steepness FROM (SELECT CAST(quantile_cont(n_chars, 0.9) AS DOUBLE) AS a, CAST(quantile_cont(n_chars, 0.95) AS DOUBLE) AS b FROM documents)""")
def fit_text_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = aggregates.distribution(table(spark, sf_dir, "documents").where("n_chars >= 0"), "n_chars")
    return s.select(r6("p95").alias("midpoint"), r6(weights.fitted_steepness(F.col("p95"), F.col("p90"))).alias("steepness"))


@query("""SELECT round(m, 6) AS midpoint, round(CASE WHEN b - a > 0 THEN greatest(0.01, least(1 / (b - a), 0.1)) ELSE 0.05 END, 6) AS steepness FROM (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events WHERE value > 0)""")
def fit_clarity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = aggregates.distribution(images(spark, sf_dir).where("value > 0"), "value")
    return s.select(r6("p50").alias("midpoint"), r6(weights.fitted_steepness(F.col("p75"), F.col("p25"))).alias("steepness"))


@query(f"SELECT {', '.join(f'round({f}({c}), 6) AS {n}_{a}' for c, a in (('clarity', 'clarity_weight'), ('q', 'quality_score')) for n, f in (('mean', 'avg'), ('median', 'median'), ('min', 'min'), ('max', 'max')))} FROM {IMAGES}")
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.weight_summary(images(spark, sf_dir), "clarity_weight", "quality_score"))


@query("SELECT event_id, CASE WHEN value < a THEN 'low' WHEN value < b THEN 'medium' ELSE 'high' END AS category FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)")
def clarity_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir).select("event_id", "value")
    return i.crossJoin(aggregates.thresholds(aggregates.distribution(i, "value"))).select("event_id", weights.category(F.col("value"), F.col("low"), F.col("medium")).alias("category"))


# ---------------------------------------------------------------- arrays


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("images"))


@query("SELECT l_orderkey, count(*) AS n, round(avg(l_discount), 6) AS avg_discount, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem GROUP BY 1")
def array_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select("l_orderkey", F.size("images").cast("bigint").alias("n"), r6(arrays.mean_of(F.col("images"), lambda x: x["l_discount"])).alias("avg_discount"), r6(arrays.mean_of(F.col("images"), lambda x: x["l_quantity"])).alias("avg_quantity"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10")
def array_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.flatten(_orders(spark, sf_dir), "images", lambda x: x["l_quantity"] >= 10).select("l_orderkey", "l_partkey", "l_quantity")


@query("""SELECT l_orderkey, n - 1 AS pos, l_partkey, k * 10 AS other FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS n FROM lineitem)
  JOIN (SELECT unnest([1, 2]) AS k) ON k = n""")
def zip_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("other", F.array(F.lit(10), F.lit(20)))
    return arrays.zip_join(o, "images", "other").select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "left_item.l_partkey", F.col("right_item").alias("other"))


@query("""SELECT l_orderkey, round(avg(l_discount * 0.7 + l_quantity / 50 * 0.3), 6) AS avg_quality, count(CASE WHEN l_discount * 0.7 + l_quantity / 50 * 0.3 >= 0.2 THEN 1 END) AS high FROM lineitem GROUP BY 1""")
def requality_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    one = lambda x: weights.quality_ratio(x["l_quantity"] / 50, x["l_discount"], F.lit(1.0))
    o = o.withColumn("images", arrays.rewrite(F.col("images"), quality=one))
    return o.select("l_orderkey", r6(arrays.mean_of(F.col("images"), lambda x: x["quality"])).alias("avg_quality"), F.size(F.filter("images", lambda x: x["quality"] >= 0.2)).cast("bigint").alias("high"))


# ---------------------------------------------------------------- updates


_BY_DOC = "(SELECT o_custkey AS original_id, list(o_totalprice ORDER BY o_orderkey) AS scores FROM orders GROUP BY 1)"


@query(f"SELECT event_id, round(coalesce(scores[CAST(k AS BIGINT) % 20 + 1], scores[1], q), 6) AS quality_score FROM {IMAGES} LEFT JOIN {_BY_DOC} USING (original_id)")
def sync_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("original_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x")).select("original_id", F.col("x.o_totalprice").alias("scores"))
    i = images(spark, sf_dir).select("event_id", "original_id", (F.col("k").cast("int") % 20).alias("image_index"), "quality_score")
    return joins.sync_image_quality(i, o).select("event_id", r6("quality_score").alias("quality_score"))


@query(f"SELECT doc_id, round(coalesce(a, 1.0), 6) AS avg_quality_score FROM documents LEFT JOIN (SELECT original_id AS doc_id, avg(q) AS a FROM {IMAGES} GROUP BY 1) USING (doc_id)")
def sync_avg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = images(spark, sf_dir).groupBy("original_id").agg(F.avg("quality_score").alias("avg_quality_score"))
    old = news(spark, sf_dir).select("original_id", F.lit(1.0).alias("avg_quality_score"))
    return joins.sync_average(old, fresh).select(F.col("original_id").alias("doc_id"), r6("avg_quality_score").alias("avg_quality_score"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'reset' ELSE lang END AS lang FROM documents WHERE NOT (n_chars < 100)")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = updates.set_where(table(spark, sf_dir, "documents"), F.col("source") == "src0", lang=F.lit("reset"))
    return updates.delete_where(d, F.col("n_chars") < 100).select("doc_id", "lang")


@query("SELECT original_id, has_images FROM (SELECT c_custkey AS original_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_images FROM customer)")
def folder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("original_id"), F.col("c_custkey").alias("folder_path"))
    return joins.without_files(mappings, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder_path"))).select("original_id", "has_images")


# ---------------------------------------------------------------- classes


@query("SELECT vec_id, round(exp(a - m) / (exp(a - m) + exp(b - m)), 6) AS p0, round(exp(b - m) / (exp(a - m) + exp(b - m)), 6) AS p1, CASE WHEN b > a THEN 1 ELSE 0 END AS predicted_class FROM (SELECT vec_id, a, b, greatest(a, b) AS m FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings))")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("x"))
    p = weights.softmax(F.col("x"))
    return e.select("vec_id", r6(p[0]).alias("p0"), r6(p[1]).alias("p1"), weights.argmax(F.col("x")).alias("predicted_class"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS label, toxic AS flipped, toxic <> quality AS changed FROM labels")
def label_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "labels").withColumn("label", weights.class_label(1 - F.col("toxic")))
    flipped = weights.label_class(F.col("label"))
    return named.select("doc_id", "label", flipped.alias("flipped"), (flipped != F.col("quality")).alias("changed"))


PREDICTED = "(SELECT doc_id, quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")


@query(f"SELECT quality, predicted, count(*) AS n FROM {PREDICTED} GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.confusion(_predicted(spark, sf_dir), "quality", "predicted")


@query(f"""WITH x AS (SELECT * FROM {PREDICTED}), c AS (SELECT k, (SELECT count(*) FROM x WHERE quality = k) AS s, (SELECT count(*) FROM x WHERE predicted = k) AS g, (SELECT count(*) FROM x WHERE quality = k AND predicted = k) AS h FROM (SELECT unnest([0, 1]) AS k)),
  m AS (SELECT s, h, coalesce(h / nullif(g, 0), 0) AS p, coalesce(h / nullif(s, 0), 0) AS r FROM c)
  SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) AS f1 FROM m""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.class_metrics(_predicted(spark, sf_dir), "quality", "predicted"))


_LEXICON = ("stupid", "idiot", "trash", "worthless", "pathetic", "scum", "loser", "moron", "clown", "disgusting")
_FOUND = f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({', '.join(repr(w) for w in _LEXICON)})))"


@query(f"SELECT doc_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS predicted_class, round(1 / (1 + exp(-n)), 6) AS negative_likelihood FROM (SELECT doc_id, CAST({_FOUND} AS DOUBLE) AS n FROM documents)")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(score(d, "doc_id", "text", lambda: Lexicon(_LEXICON)))


# ---------------------------------------------------------------- index statistics


@query(f"""SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT "WeightedPhotoPes" AS x FROM ({IMAGE_INDEX}))""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.series_stats(daily_image_index(spark, sf_dir), "WeightedPhotoPes"))


_VARIANTS = ("PhotoPes", "PhotoPes_likelihood", "WeightedPhotoPes")


@query(" UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round(corr("{a}", "{b}"), 4) AS r FROM ({IMAGE_INDEX})""" for a in _VARIANTS for b in _VARIANTS))
def index_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.correlations(daily_image_index(spark, sf_dir), *_VARIANTS).withColumn("r", F.round("r", 4))


@query(f"""SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT "WeightedPhotoPes" AS y, CAST(row_number() OVER (ORDER BY news_date) - 1 AS DOUBLE) AS x FROM ({IMAGE_INDEX}))""")
def index_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.trend(daily_image_index(spark, sf_dir), "WeightedPhotoPes", "news_date"))


_TRIM = "(SELECT value AS v FROM events WHERE value <= (SELECT quantile_cont(value, 0.995) FROM events))"


@query(f"SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 51) r(b) LEFT JOIN (SELECT least(floor((v - lo) * 50 / (hi - lo)) + 1, 50) AS b, count(*) AS n FROM {_TRIM}, (SELECT min(v) AS lo, max(v) AS hi FROM {_TRIM}) GROUP BY 1) USING (b)")
def hist50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(filters.without_tail(images(spark, sf_dir).select("value"), "value"), "value")


@query(f"""WITH d AS (SELECT v, count(*) AS c FROM {_TRIM} GROUP BY v), f AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, max(v) AS last FROM {_TRIM})
  SELECT CAST(i AS INTEGER) AS point, round(i * last / 299, 6) AS x, round(sum(exp(-0.5 * pow((i * last / 299 - v) / h, 2)) * c) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM d, f, (SELECT unnest(range(300)) AS i) GROUP BY i, last""")
def kde300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.density(filters.without_tail(images(spark, sf_dir).select("value"), "value"), "value"))


# ---------------------------------------------------------------- market


_IDX = [f"p{p}" for p in PRIORITIES]
_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), avg({c}) OVER ())"
FILLED = "(SELECT Date, " + ", ".join(f"{_FILL.format(c=c, d='Date')} AS {c}" for c in _IDX) + f" FROM {MARKET})"
RETURNS = f"""(SELECT * FROM (SELECT Date, row_number() OVER (ORDER BY Date) AS n, {', '.join(f'{c}, {c} / nullif(lag({c}) OVER (ORDER BY Date), 0) - 1 AS {c}_returns, ln({c} / nullif(lag({c}) OVER (ORDER BY Date), 0)) AS {c}_log_returns' for c in _IDX)} FROM {FILLED}) WHERE n > 1)"""
_RETURNED = [x for c in _IDX for x in (c, f"{c}_returns", f"{c}_log_returns")]


@query(f"SELECT Date, {', '.join(f'round({x}, 6) AS {x}' for x in _RETURNED)} FROM {RETURNS}")
def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.drop_first_returns(market(spark, sf_dir), "Date"))


SPARSE = "(SELECT Date, CASE WHEN dayofmonth(Date) % 4 = 0 THEN p1 END AS x, CASE WHEN dayofmonth(Date) % 7 = 3 THEN p2 END AS y FROM " + MARKET + ")"


@query(f"SELECT Date, round({_FILL.format(c='x', d='Date')}, 6) AS x, round({_FILL.format(c='y', d='Date')}, 6) AS y FROM {SPARSE}")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    sparse = m.select("Date", F.when(F.dayofmonth("Date") % 4 == 0, F.col("p1")).alias("x"), F.when(F.dayofmonth("Date") % 7 == 3, F.col("p2")).alias("y"))
    return rounded(windows.fill(sparse, "Date", "x", "y"))


# the days of the index begin where the market's last month does, so that calendars meet
SHIFT = "CAST((SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - DATE '2024-01-20' AS INTEGER)"


def _shifted(spark: SparkSession, sf_dir: str, index: DataFrame, date: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("_last"))
    days = F.datediff("_last", F.lit("2024-01-20").cast("date"))
    return index.crossJoin(last).withColumn("news_date", F.date_add("news_date", days)).drop("_last").withColumnRenamed("news_date", date)


_ENRICH = f"""SELECT m.Date, round(m.p1, 6) AS p1, i."WeightedPhotoPes" FROM {MARKET} m LEFT JOIN (SELECT CAST(news_date + {SHIFT} AS DATE) AS Date, "WeightedPhotoPes" FROM ({IMAGE_INDEX})) i ON i.Date = m.Date"""


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _shifted(spark, sf_dir, daily_image_index(spark, sf_dir), "news_date").select("news_date", "WeightedPhotoPes")
    return joins.enrich(market(spark, sf_dir).select("Date", "p1"), index)


@query(_ENRICH)
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("Date", r6("p1").alias("p1"), "WeightedPhotoPes")


@query(f"""SELECT count(*) AS total, count("WeightedPhotoPes") AS updated, round(100.0 * count("WeightedPhotoPes") / count(*), 6) AS percent FROM ({_ENRICH})""")
def enrich_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_stats(_enriched(spark, sf_dir), "WeightedPhotoPes").withColumn("percent", F.col("percent").cast("double"))


_OUTER = f"""(SELECT news_date, t."TextPes", t."TextPes_likelihood", p."PhotoPes", p."PhotoPes_likelihood", t."TextPes_likelihood" AS "WeightedTextPes_likelihood", p."PhotoPes_likelihood" AS "WeightedPhotoPes_likelihood"
  FROM ({TEXT_INDEX}) t FULL OUTER JOIN (SELECT * FROM ({IMAGE_INDEX}) WHERE dayofmonth(news_date) <> 5) p USING (news_date))"""


def _sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_part = joins.present(daily_text_index(spark, sf_dir), "news_date", "TextPes", "TextPes_likelihood", "missing")
    photo_part = joins.present(daily_image_index(spark, sf_dir), "news_date", "PhotoPes", "PhotoPes_likelihood").where(F.dayofmonth("news_date") != 5)  # a day without images
    return joins.with_likelihood(joins.outer(text_part, photo_part, "news_date"), "TextPes", "PhotoPes")


@query(f"SELECT * FROM {_OUTER}")
def sentiment_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentiment(spark, sf_dir).orderBy("news_date")


_SENT = ("TextPes", "TextPes_likelihood", "PhotoPes", "PhotoPes_likelihood", "WeightedTextPes_likelihood", "WeightedPhotoPes_likelihood")
_JOINED = f"""(SELECT Date, p1, p1_returns, {', '.join(f's."{c}"' for c in _SENT)} FROM (SELECT Date, p1, p1_returns FROM {RETURNS}) m FULL OUTER JOIN (SELECT CAST(news_date + {SHIFT} AS DATE) AS Date, {', '.join(f'"{c}"' for c in _SENT)} FROM {_OUTER}) s USING (Date))"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = windows.drop_first_returns(market(spark, sf_dir), "Date").select("Date", "p1", "p1_returns")
    return joins.outer(m, _shifted(spark, sf_dir, _sentiment(spark, sf_dir), "Date"), "Date")


@query(f"""SELECT Date, round(p1, 6) AS p1, round(p1_returns, 6) AS p1_returns, {', '.join(f'round({_FILL.format(c=chr(34) + c + chr(34), d="Date")}, 6) AS "{c}"' for c in _SENT)} FROM {_JOINED}""")
def merged_market_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _merged(spark, sf_dir)
    found = [c for c in joined.columns if any(k in c for k in MERGED)]
    return rounded(windows.fill(joined, "Date", *found).dropna(how="all")).orderBy("Date")


@query(f"""SELECT Date FROM {_JOINED} WHERE Date BETWEEN DATE '2000-01-01' AND DATE '2024-12-31' AND (p1 IS NULL OR p1_returns IS NULL OR {' OR '.join(f'"{c}" IS NULL' for c in _SENT)})""")
def null_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.days_with_null(_merged(spark, sf_dir), "Date", "2000-01-01", LAST).select("Date").orderBy("Date")


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    early, late = o.where("year < 1998"), o.where("year >= 1998")  # two tables of years
    return early.unionByName(late).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- samples


RATE = 0.1
_ALLOC = f"""(SELECT day, size, CASE WHEN can AND nth <= abs(off) THEN own + sign(off) ELSE own END AS take FROM (
  SELECT *, sum(CASE WHEN can THEN 1 ELSE 0 END) OVER (ORDER BY day) AS nth FROM (
  SELECT *, CASE WHEN off > 0 THEN size > own ELSE own > 0 END AS can FROM (
  SELECT *, least(target, sum(size) OVER ()) - sum(own) OVER () AS off FROM (
  SELECT day, size, target, least(CAST(round_even(size / total * target, 0) AS BIGINT), size) AS own FROM (SELECT day, count(*) AS size FROM {IMAGES} GROUP BY 1), (SELECT CAST(floor(count(*) * {RATE}) AS BIGINT) AS target, count(*) AS total FROM events))))))"""


@query(f"SELECT day, size, CAST(take AS BIGINT) AS take FROM {_ALLOC}")
def stratified_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.allocation(images(spark, sf_dir).select("day"), "day", RATE)


@query(f"""SELECT event_id, day FROM (SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS n FROM {IMAGES}) JOIN {_ALLOC} USING (day) WHERE n <= take""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(images(spark, sf_dir).select("event_id", "day"), "day", "event_id", RATE)


@query("""SELECT event_id, CASE WHEN n <= floor(total * 0.7) THEN 'train' WHEN n <= floor(total * 0.7) + floor(total * 0.1) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS n, count(*) OVER () AS total FROM events)""")
def split_70_10_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS n FROM events) WHERE n <= 5")
def category_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.examples(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("SELECT epoch, event_id, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat(CAST(42 + epoch AS VARCHAR), ':', CAST(event_id AS VARCHAR))), event_id) - 1 AS position FROM events, (SELECT unnest([0, 1]) AS epoch)")
def shuffled_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    one = lambda k: sampling.epoch(e, "event_id", k).select(F.lit(k).alias("epoch"), "event_id", "position")
    return one(0).unionByName(one(1))


# ---------------------------------------------------------------- articles, their images and blocks


@query("""SELECT l_orderkey AS original_id, n - 1 AS pos, l_partkey, concat('p', CAST(n AS VARCHAR)) AS path FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS n FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey WHERE n <= o_orderkey % 4""")
def pair_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.filter(F.array(*[F.when(F.col("o_orderkey") % 4 >= k, F.lit(f"p{k}")) for k in (1, 2, 3)]), lambda p: p.isNotNull())
    filtered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("original_id"), paths.alias("valid_images"))
    found = joins.pair_images(_orders(spark, sf_dir).withColumnRenamed("l_orderkey", "original_id"), filtered)
    return found.select("original_id", F.col("pos").cast("bigint").alias("pos"), "left_item.l_partkey", F.col("right_item").alias("path"))


@query("""SELECT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, t) AS title, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, '') AS category, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END, d) AS news_date,
  n AS content, o_orderkey AS url, f AS fetch_date, q AS image_links FROM orders JOIN (SELECT l_orderkey, max(l_returnflag) AS t, min(CAST(l_shipdate AS DATE)) AS d, count(*) AS n, max(CAST(l_shipdate AS DATE)) AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def combined_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    index = table(spark, sf_dir, "orders").select(k.alias("link"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("title"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("category"), F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("news_date"))
    shipped = F.col("l_shipdate").cast("date")
    scraped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg(F.max("l_returnflag").alias("title"), F.min(shipped).alias("publish_date"), F.count("*").alias("content"), F.max(shipped).alias("fetch_date"), F.sum("l_quantity").alias("image_links"))
    return joins.combined(index, scraped)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Headlines' WHEN 1 THEN 'Domestic News' WHEN 2 THEN 'Domestic News' END AS category FROM pages")
def block_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.element_at(F.array(*[F.lit(b) for b in ("blk_yw_01", "blk_gnxw_01", "blk_ndxw_01", "blk_other")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.category(block).alias("category"))


@query("SELECT event_id, value, greatest((SELECT count(*) FROM events WHERE value > 100) - 10, 0) AS more FROM events WHERE value > 100 ORDER BY value DESC, event_id LIMIT 10")
def failures_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of a list of failures and how many there are besides: the limit is the feature."""
    return filters.head_and_more(table(spark, sf_dir, "events").where("value > 100").select("event_id", "value"), F.desc("value"), "event_id")


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE value > 100")
def filtered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_dates(images(spark, sf_dir), "day", F.col("value") > 100)


@query(f"SELECT count(*) AS total, count(CASE WHEN q >= 0.5 THEN 1 END) AS high, round(100.0 * count(CASE WHEN q >= 0.5 THEN 1 END) / count(*), 6) AS percent FROM {IMAGES}")
def high_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.high_rate(images(spark, sf_dir), "quality_score"))


@query("SELECT count(CASE WHEN source = 'src0' THEN 1 END) AS matched, count(CASE WHEN source = 'src0' AND lang <> 'en' THEN 1 END) AS changed FROM documents")
def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.affected(table(spark, sf_dir, "documents"), F.col("source") == "src0", lang=F.lit("en"))


# ---------------------------------------------------------------- streams


DAILY = f"""SELECT day AS news_date, count(*) AS total_images, CAST(sum(c) AS BIGINT) AS negative_count, round(avg(c), 6) AS "PhotoPes", round(avg(p), 6) AS "PhotoPes_likelihood", round(sum(p * q) / sum(q), 6) AS "WeightedPhotoPes", round(avg(q), 6) AS avg_quality_score FROM {IMAGES} GROUP BY 1"""


@query(DAILY)
def stream_daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by a stream over all that is there; equal to that of the table."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    k, p = F.get_json_object("props", "$.k").cast("double"), F.col("value") / (F.col("value") + 50)
    scored = events.select(F.col("ts").cast("timestamp").alias("ts"), p.alias("negative_likelihood"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted_class"), weights.clarity_weight(k, 50.0, 0.06).alias("quality_score"))
    return rounded(streaming.run_once(streaming.daily_index(scored)))
