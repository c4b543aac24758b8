"""python -m tidemark.cli: the steps of the pipeline in their order, chosen by name.

Steps are functions (spark, settings); each reads the tables of those before it, by year.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.weights import image_weight, is_high, quality_ratio, weighted_score
from tidemark.operators.aggregates import image_index, text_index
from tidemark.operators.filters import truthy
from tidemark.operators.joins import enrich, latest, match_stats, outer, present, sync_average, with_likelihood
from tidemark.operators.windows import drop_first_returns, fill
from tidemark.sinks import write_any, write_years
from tidemark.sources.files import market, read_any, years

log = logging.getLogger("tidemark")


@dataclass
class Settings:
    data: str
    first_year: int = 2014
    last_year: int = 2024
    market: str | None = None
    output: str = "merged.csv"
    ratios: tuple[float, float, float] = (0.7, 0.3, 0.0)
    nonlinear: bool = False
    wanted: list[int] = field(init=False)

    def __post_init__(self) -> None:
        if self.first_year > self.last_year:
            raise ValueError("the first year is after the last")
        self.wanted = list(range(self.first_year, self.last_year + 1))


def requality(spark: SparkSession, s: Settings) -> None:
    """news_quality scored anew by the ratios."""
    q = years(spark, f"{s.data}/news_quality", s.wanted)
    text, clarity, diversity = s.ratios
    one = lambda x: quality_ratio(x["clarity_weight"], x["text_weight"], F.col("diversity_score"), text, clarity, diversity, s.nonlinear)
    images = F.transform("images", lambda x: x.withField("quality_score", one(x)).withField("is_high_quality", is_high(one(x))))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["quality_score"]) / F.size(c)
    out = q.withColumn("images", images).withColumn("avg_quality_score", F.when(F.size("images") > 0, mean(F.col("images"))).otherwise(0.0))
    write_years(out, f"{s.data}/news_requality")


def image_indices(spark: SparkSession, s: Settings) -> None:
    images = years(spark, f"{s.data}/image_sentiment", s.wanted)
    news = latest(years(spark, f"{s.data}/news_filtered", s.wanted).where("original_id <> ''").select("year", "original_id", "news_date"), ["year", "original_id"], F.desc("news_date"))
    weighted = images.drop("news_date").join(news, ["year", "original_id"])
    weighted = weighted.withColumn("weight", image_weight(F.coalesce("clarity_weight", F.lit(0.5)), F.coalesce("text_weight", F.lit(0.5))))
    weighted = weighted.withColumn("weighted_score", weighted_score(F.col("negative_likelihood"), F.col("weight"), F.col("diversity_score")))
    write_years(image_index(weighted), f"{s.data}/daily_photopes")


def text_indices(spark: SparkSession, s: Settings) -> None:
    news = years(spark, f"{s.data}/news_filtered", s.wanted).where(F.coalesce("has_valid_images", F.lit(False)) & truthy(F.col("content")))
    texts = years(spark, f"{s.data}/text_sentiment", s.wanted).withColumn("avg_quality_score", F.lit(None).cast("double"))
    texts = texts.join(news.select("year", "original_id"), ["year", "original_id"], "left_semi")  # articles with images and text
    write_years(text_index(sync_average(texts, years(spark, f"{s.data}/news_requality", s.wanted))), f"{s.data}/daily_textpes")


def enriched(spark: SparkSession, s: Settings) -> None:
    """The market's workbook with each index, beside it as {name}_with_{index}.xlsx, and how many days met; none without a market."""
    if not s.market:
        return
    for stage, name in (("daily_photopes", "PhotoPes"), ("daily_textpes", "TextPes")):
        index = present(years(spark, f"{s.data}/{stage}", s.wanted), "news_date", f"Weighted{name}", name, f"{name}_likelihood")
        out = enrich(market(read_any(spark, s.market)), index.withColumn("news_date", F.try_to_date(F.col("news_date").cast("string"))))
        write_any(out.orderBy("Date"), f"{s.market.removesuffix('.xlsx')}_with_{'Weighted' if name == 'PhotoPes' else ''}{name}.xlsx")
        log.info("%s: %s", name, match_stats(out, f"Weighted{name}").first().asDict())


def merge(spark: SparkSession, s: Settings) -> None:
    def days(stage: str, name: str) -> DataFrame:
        df = years(spark, f"{s.data}/{stage}", s.wanted).withColumn("Date", F.try_to_date(F.col("news_date").cast("string"))).dropna(subset=["Date"])
        return with_likelihood(present(df, "Date", name, f"{name}_likelihood", f"Weighted{name}", f"Weighted{name}_likelihood"), name)

    sentiment = outer(days("daily_textpes", "TextPes"), days("daily_photopes", "PhotoPes"), "Date")
    if s.market:
        sentiment = outer(drop_first_returns(market(read_any(spark, s.market)), "Date"), sentiment, "Date")
    found = [c for c in sentiment.columns if "TextPes" in c or "PhotoPes" in c]
    write_any(fill(sentiment, "Date", *found).orderBy("Date"), f"{s.data}/{s.output}")


STEPS: dict[str, Callable[[SparkSession, Settings], None]] = {"requality": requality, "image_index": image_indices, "text_index": text_indices, "enrich": enriched, "merge": merge}


def chosen(steps: list[str] | None, skip: list[str] | None) -> list[str]:
    """Steps in order; unknown names are refused."""
    if unknown := sorted({*(steps or []), *(skip or [])} - set(STEPS)):
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    return [n for n in STEPS if (not steps or n in steps) and n not in (skip or [])]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--data", required=True)
    p.add_argument("--steps", nargs="+")
    p.add_argument("--skip", nargs="+")
    p.add_argument("--first-year", type=int, default=2014)
    p.add_argument("--last-year", type=int, default=2024)
    p.add_argument("--market")
    p.add_argument("--output", default="merged.csv")
    p.add_argument("--ratios", type=float, nargs=3, default=(0.7, 0.3, 0.0), metavar=("TEXT", "CLARITY", "DIVERSITY"))
    p.add_argument("--nonlinear", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    try:
        names, settings = chosen(a.steps, a.skip), Settings(a.data, a.first_year, a.last_year, a.market, a.output, tuple(a.ratios), a.nonlinear)
    except ValueError as e:
        log.error("%s", e)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in names:
        began = time.time()
        STEPS[name](spark, settings)
        log.info("%s: %.1f s", name, time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
