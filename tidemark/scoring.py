"""Scorers of images and texts: measures of pixels in numpy, and a protocol for models, loaded once in each worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.weights import argmax, softmax


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Luma of BGR bytes, rounded; none for what is no image."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) != height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0].astype(np.float64)
    return np.rint(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2])


def blur_score(x: np.ndarray) -> float:
    """The variance of the Laplacian, edges mirrored."""
    if min(x.shape) < 2:
        return 0.0
    p = np.pad(x, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


def content_ratio(x: np.ndarray) -> float:
    """The share of dark pixels."""
    return float((x <= 127).mean())


@F.pandas_udf(StructType([StructField("blur", DoubleType()), StructField("content", DoubleType())]))
def pixels(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Blur (0 for no image) and content (null for none) of the columns of Spark's image source."""
    out = []
    for h, w, c, d in zip(height, width, channels, data, strict=True):
        x = gray(int(h), int(w), int(c), bytes(d)) if d is not None and pd.notna(h) and pd.notna(w) and pd.notna(c) else None
        out.append((0.0, None) if x is None else (blur_score(x), content_ratio(x)))
    return pd.DataFrame(out, columns=["blur", "content"])


class Scorer(Protocol):
    """What makes two logits of a batch of inputs; None for an input that it can't read."""

    def __call__(self, batch: list) -> Iterable[tuple[float, float] | None]: ...


def score(df: DataFrame, id_col: str, input_col: str, make: Callable[[], Scorer], batch: int = 8, negative: int = 1) -> DataFrame:
    """(id_col, predicted_class, negative_likelihood) by a scorer that `make` makes once in each task. Logits of inputs
    without a result are null, and so is what follows from them."""
    kind = dict(df.select(id_col).dtypes)[id_col]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in frames:
            inputs = pdf["x"].tolist()
            logits: list = []
            for k in range(0, len(inputs), batch):
                part = inputs[k : k + batch]
                there = [x for x in part if x is not None and x == x]
                got = iter(scorer(there))
                logits += [next(got) if x is not None and x == x else None for x in part]
            yield pd.DataFrame({"id": pdf["id"], "logits": [None if v is None else [float(y) for y in v] for v in logits]})

    scored = df.select(F.col(id_col).alias("id"), F.col(input_col).alias("x")).mapInPandas(each, f"id {kind}, logits array<double>")
    p: Column = softmax(F.col("logits"))
    return scored.select(F.col("id").alias(id_col), argmax(F.col("logits")).alias("predicted_class"), F.element_at(p, negative + 1).alias("negative_likelihood"))


class Lexicon:
    """A scorer of texts by words: logits are counts of good and bad ones."""

    def __init__(self, bad: Iterable[str], good: Iterable[str] = ()):
        self.bad, self.good = frozenset(bad), frozenset(good)

    def __call__(self, batch: list[str]) -> list[tuple[float, float]]:
        words = [re.findall(r"\w+", t.lower()) for t in batch]
        return [(float(sum(w in self.good for w in ws)), float(sum(w in self.bad for w in ws))) for ws in words]


def text_lengths(df: DataFrame, read_text: Callable[[bytes], str] | None, data: str = "data") -> DataFrame:
    """df with text_length: characters of what a reader finds in an image, white space collapsed; 0 where it fails.
    Without a reader, the column text is taken."""
    if read_text is None:
        return df.withColumn("text_length", F.length(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))))

    @F.pandas_udf("int")
    def lengths(raw: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> int:
            try:
                return len(" ".join(read_text(bytes(d)).split())) if d is not None else 0
            except Exception:  # noqa: BLE001  a reader that fails has read nothing
                return 0

        return raw.map(one)

    return df.withColumn("text_length", lengths(data))


def has_qr(df: DataFrame, detect: Callable[[bytes], bool] | None, data: str = "data") -> DataFrame:
    """df with has_qr by a detector of QR codes; false where there is no detector or no image, or where it fails."""
    if detect is None:
        return df.withColumn("has_qr", F.lit(False))

    @F.pandas_udf("boolean")
    def found(raw: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> bool:
            try:
                return d is not None and bool(detect(bytes(d)))
            except Exception:  # noqa: BLE001  a detector that fails has found nothing
                return False

        return raw.map(one)

    return df.withColumn("has_qr", found(data))


def train_head(df: DataFrame, features: str, label: str):
    """A linear head on feature vectors (array<double>), by Spark's own logistic regression; its model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label")).dropna()
    return LogisticRegression(maxIter=30, regParam=0.02).fit(rows)
