"""Aggregates: daily indices, roll-ups, distributions, fits, histograms and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def weighted_mean(x: Column, weight: Column, fallback: Column) -> Column:
    """The sum of x times weight over that of weights; the fallback where weights don't sum to more than 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.try_divide(F.sum(x * weight), total)).otherwise(fallback)


def image_index(images: DataFrame) -> DataFrame:
    """Daily index of images (year, news_date, negative_likelihood, predicted_class, quality_score)."""
    p, q = F.col("negative_likelihood"), F.coalesce("quality_score", F.lit(0.5))
    known = images.where(p.isNotNull() & F.col("news_date").isNotNull())
    return known.groupBy("year", "news_date").agg(
        F.count("*").alias("total_images"),
        F.count_if(F.coalesce("predicted_class", F.lit(0)) == 1).alias("negative_count"),
        F.avg((F.coalesce("predicted_class", F.lit(0)) == 1).cast("double")).alias("PhotoPes"),
        F.avg(p).alias("PhotoPes_likelihood"),
        weighted_mean(p, q, F.lit(0.0)).alias("WeightedPhotoPes"),
        F.avg(q).alias("avg_quality_score"),
    )


def text_index(texts: DataFrame) -> DataFrame:
    """Daily index of articles (year, news_date, textneg_likelihood, sentiment_class with 0 for negative, avg_quality_score)."""
    p, q = F.col("textneg_likelihood"), F.coalesce("avg_quality_score", F.lit(1.0))
    known = texts.where(p.isNotNull() & F.col("news_date").isNotNull())
    return known.groupBy("year", "news_date").agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("sentiment_class") == 0).alias("negative_count"),
        F.count_if(F.col("sentiment_class") == 1).alias("positive_count"),
        F.avg((F.col("sentiment_class") == 0).cast("double")).alias("TextPes"),
        F.avg(p).alias("TextPes_likelihood"),
        weighted_mean(p, q, F.avg(p)).alias("WeightedTextPes"),
        F.avg(q).alias("avg_quality_score"),
    )


def news_rollup(images: DataFrame, *means: str) -> DataFrame:
    """By day and title: means, number of images and how many are negative."""
    negative = F.count_if(F.col("predicted_class") == 1)
    return images.groupBy("news_date", "title").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in means],
        F.count("*").alias("image_count"),
        negative.alias("negative_count"),
        F.count_if(F.col("predicted_class") == 0).alias("positive_count"),
        F.try_divide(negative.cast("double"), F.count("*").cast("double")).alias("negative_ratio"),
    )


def date_statistics(df: DataFrame, date: str, category: str) -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(category)).alias("categories"))


def series_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Moments (population deviation) and exact, interpolated percentiles."""
    shares = F.array(*[F.lit(p / 100) for p in PERCENTILES])
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.percentile(value, shares).alias("_p"))
    return out.select("n", "min", "max", "mean", "median", "std", *[F.col("_p")[k].alias(f"p{p}") for k, p in enumerate(PERCENTILES)])


def weight_summary(df: DataFrame, *values: str) -> DataFrame:
    return df.agg(*[f(v).cast("double").alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))])


def high_rate(df: DataFrame, score: str, least: float = 0.5) -> DataFrame:
    """(total, high, percent): how many scores reach the least; 0 percent of none."""
    high = F.count_if(F.col(score) >= least)
    return df.agg(F.count("*").alias("total"), high.alias("high"), F.coalesce(F.try_divide(100.0 * high, F.count("*")).cast("double"), F.lit(0.0)).alias("percent"))


def distinct_dates(df: DataFrame, date: str, keep: Column) -> DataFrame:
    """The days of the rows that are kept, in order."""
    return df.where(keep & F.col(date).isNotNull()).select(date).distinct().orderBy(date)


def counts_with_share(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value and their share of all, in percent."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("_all"))).withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("_all")), F.lit(0.0))).drop("_all")


def histogram_of_levels(df: DataFrame, level: str, levels: tuple[str, ...]) -> DataFrame:
    """Rows of each level, levels without any too."""
    all_ = df.sparkSession.createDataFrame([(x,) for x in levels], f"{level} string")
    return all_.join(df.groupBy(level).agg(F.count("*").alias("_n")), level, "left").select(level, F.coalesce("_n", F.lit(0)).alias("n"))


def run_totals(images: DataFrame) -> DataFrame:
    """Counts by class, mean likelihood, and the weighted one with diversity in the numerator alone."""
    p, w, d = F.col("negative_likelihood"), F.col("weight"), F.coalesce("diversity_score", F.lit(1.0))
    return images.agg(F.count_if(F.col("predicted_class") == 0).alias("positive"), F.count_if(F.col("predicted_class") == 1).alias("negative"), F.avg(p).alias("mean"), F.coalesce(F.try_divide(F.sum(p * w * d), F.sum(w)), F.lit(0.0)).alias("weighted"))


def correlations(df: DataFrame, *values: str) -> DataFrame:
    """Pearson's r of each pair, null where a column doesn't vary."""
    def r(a: str, b: str) -> Column:
        varies = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
        return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))

    whole = df.dropna(subset=list(values))
    pairs = [(a, b) for a in values for b in values]
    wide = whole.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return wide.select(F.inline("x"))


def trend(df: DataFrame, value: str, order: str) -> DataFrame:
    """Slope and intercept of a line over positions from 0; for tables by day."""
    placed = df.withColumn("_x", (F.row_number().over(Window.orderBy(order)) - 1).cast("double"))
    return placed.agg(F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal bins from the least to the greatest value, which the last bin holds too; empty bins have 0."""
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    placed = df.where(F.col(value).isNotNull()).crossJoin(ends)
    at = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))) + 1, F.lit(bins)))
    counted = placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("_n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"))


def density(df: DataFrame, value: str, points: int = 300, last: Column | None = None) -> DataFrame:
    """(x, density) of a Gaussian kernel estimate with Scott's bandwidth, at points from 0 to `last` (the maximum). Equal
    values are counted first, so that the kernel meets each but once."""
    x = F.col(value).cast("double")
    kept = df.where(x.isNotNull())
    facts = kept.agg(F.count("*").alias("_n"), (F.stddev_samp(x) * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("_h"), (last if last is not None else F.max(x)).alias("_last"))
    spots = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("_v")) / F.col("_h"), 2)) * F.col("_c")
    pairs = kept.groupBy(x.alias("_v")).agg(F.count("*").alias("_c")).crossJoin(facts).where("_h > 0").crossJoin(F.broadcast(spots)).withColumn("x", F.col("point") * F.col("_last") / (points - 1))  # `points` rows
    return pairs.groupBy("point", "x", "_n", "_h").agg(F.sum(kernel).alias("_s")).select("point", "x", (F.col("_s") / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 as means weighted by support; a ratio of nothing is 0."""
    cells = confusion(df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()), label, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col(label).alias("k"), F.col("n").alias("support"), F.lit(0).alias("guessed"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(predicted).alias("k"), F.lit(0).alias("support"), F.col("n").alias("guessed"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    each = sides.groupBy("k").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    each = each.withColumn("p", ratio("hit", "guessed")).withColumn("r", ratio("hit", "support"))
    each = each.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return each.agg(F.coalesce(F.try_divide(F.sum("hit").cast("double"), F.sum("support").cast("double")), F.lit(0.0)).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def thresholds(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("p25").alias("low"), F.col("p75").alias("medium"), F.col("p95").alias("high"))
