"""Document fingerprints: a threshold-scaled sketch keeps every shingle hash below a fixed fraction of the hash range.

A sketch is a set, so the sketch of a union is the union of sketches, and |A and B| / |A| of two sketches estimates
containment without bias however unequal the documents are. All of it is built-in expressions in one pass without a
shuffle. Sketches of groups, which may be as large as a corpus, are rows of one hash each.

Containment joins on the hash, but not on all: a whole that has at least a share of a part's hashes has one of any
(1 - share) of them, so only a part's rarest ones need to meet. A hash that a third of all documents have is met only
where a part has little else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, portable_words, read, stored

WIDTH = 5
SCALED = 16


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scaled: int = SCALED) -> DataFrame:
    """(id_col, n_shingles, sketch): the sorted distinct hashes (16 hex digits of md5) under 2^64 / scaled.

    A row for each row of docs, repeated rows included. A text of fewer words than width is one shingle of all its
    words; null, empty and wordless texts have none and an empty sketch; texts of any length are sketched whole. A null id
    stays null. Other columns of docs, whatever their names, are left out. An empty table gives no rows.
    """
    below = format(2**64 // scaled, "016x") if scaled > 1 else "g"
    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), portable_words(F.col(f"`{text_col}`")).alias("w"))
    d = d.select("id", "w", F.size("w").alias("n"))
    at = F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1)))
    hashed = F.transform(at, lambda i: F.md5(F.array_join(F.slice("w", i, width), " ")))
    kept = F.transform(F.filter(hashed, lambda h: h < below), lambda h: F.substring(h, 1, 16))
    return d.select(
        F.col("id").alias(id_col),
        F.when(F.col("n") > 0, F.greatest(F.col("n") - (width - 1), F.lit(1))).otherwise(0).cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.sort_array(F.array_distinct(kept))).otherwise(F.array().cast("array<string>")).alias("sketch"),
    )


def hashes(sketches: DataFrame, by: str) -> DataFrame:
    """(by, h): the distinct hashes of all sketches of each value of `by`, a row for each: the sketch that all shingles of
    its documents would have together. Null is a value like any other; values whose sketches are empty have no row."""
    return sketches.select(F.col(f"`{by}`"), F.explode("sketch").alias("h")).distinct()


def merge(sketches: DataFrame, by: str) -> DataFrame:
    """(by, n_shingles, sketch_size) of the merged sketch of each value of `by`, whose hashes are those of hashes(). It is
    counted without being brought together, whatever its size. Null is a value like any other; an empty table gives no
    rows."""
    key = F.col(f"`{by}`").alias("by")
    total = sketches.groupBy(key).agg(F.sum("n_shingles").alias("n_shingles"))
    size = hashes(sketches, by).groupBy(key).agg(F.count("*").alias("n"))
    both = total.join(size, total["by"].eqNullSafe(size["by"]), "left").select(total["by"], "n_shingles", F.coalesce("n", F.lit(0)).alias("sketch_size"))
    return both.withColumnRenamed("by", by)


def containment(parts: DataFrame, whole: DataFrame, part_id: str, whole_id: str, least: float = 0.5) -> DataFrame:
    """(part_id, whole_id, shared, containment) of every pair in which at least `least` (above 0) of the part's sketch lies
    in the whole's. Repeated rows of one id count as one document that has all their hashes; parts with an empty sketch and
    null ids pair with nothing, nor does any of an empty table.

    Both sketches are written to the shared folder first: put into one plan, the optimiser would move the splitting of a
    text into the hashing of each of its shingles.
    """
    a = stored(hashes(parts.where(F.col(f"`{part_id}`").isNotNull()), part_id).toDF("a", "h"), "parts")
    b = stored(hashes(whole.where(F.col(f"`{whole_id}`").isNotNull()), whole_id).toDF("b", "h"), "whole")
    common = b.join(a.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    own = Window.partitionBy("a")  # of one part's sketch
    ranked = a.join(common, "h", "left").withColumn("nth", F.row_number().over(own.orderBy(F.coalesce("n", F.lit(0)), "h"))).withColumn("size", F.count("*").over(own))
    need = F.ceil(F.col("size") * F.lit(least) - 1e-9)
    ranked = stored(ranked.where("n IS NOT NULL").select("a", "h", "size", (F.col("nth") <= F.col("size") - need + 1).alias("first")), "ranked")
    met = ranked.where("first").join(b, "h").select("a", "b").distinct()
    hits = met.join(ranked, "a").join(b, ["b", "h"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("size").alias("n"))
    return hits.where(F.col("shared") >= least * F.col("n")).select(F.col("a").alias(part_id), F.col("b").alias(whole_id), "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sketch(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_shingles", F.size("sketch").cast("bigint").alias("sketch_size"), F.array_join("sketch", " ").alias("sketch"))


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item; a finer sketch, since items are short."""
    items = sketch(read(spark, sf_dir, "benchmark"), "item_id", scaled=2)
    return containment(items, sketch(read(spark, sf_dir, "documents"), scaled=2), "item_id", "doc_id")


def _sql(table: str, key: str, scaled: int) -> str:
    return f"""
    SELECT {key}, n_shingles, list_sort(list_distinct(list_transform(list_filter(h, lambda x: x < '{format(2**64 // scaled, "016x")}'), lambda x: x[1:16]))) AS sketch
    FROM (SELECT {key}, CAST(CASE WHEN len(w) > 0 THEN greatest(len(w) - {WIDTH - 1}, 1) ELSE 0 END AS BIGINT) AS n_shingles,
        list_transform(range(1, CASE WHEN len(w) > 0 THEN greatest(len(w) - {WIDTH - 1}, 1) ELSE 0 END + 1), lambda i: md5(array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS h
      FROM (SELECT {key}, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {table}))"""


ORACLE = {
    "op8_fingerprints": f"SELECT doc_id, n_shingles, CAST(len(sketch) AS BIGINT) AS sketch_size, array_to_string(sketch, ' ') AS sketch FROM ({_sql('documents', 'doc_id', SCALED)})",
    "op8_containment": f"""
    WITH a AS (SELECT item_id, unnest(sketch) AS h FROM ({_sql("benchmark", "item_id", 2)})),
      b AS (SELECT doc_id, unnest(sketch) AS h FROM ({_sql("documents", "doc_id", 2)})),
      n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
      s AS (SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (h) GROUP BY 1, 2)
    SELECT item_id, doc_id, shared, round(shared / n, 6) AS containment FROM s JOIN n USING (item_id) WHERE shared >= 0.5 * n""",
}
