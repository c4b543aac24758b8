"""Weights, scores, levels and classes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_MID, TEXT_STEEP, CLARITY_MID, CLARITY_STEEP = 290.0, 0.01, 150.0, 0.015
LEVELS = (("high", 290), ("medium", 200), ("low", 50))
LABELS = ("negative", "positive")


def _rise(x: Column, mid: float | Column, steep: float | Column) -> Column:
    return 0.9 / (1 + F.exp(-F.lit(steep) * (x - F.lit(mid)))) if not isinstance(mid, Column) else 0.9 / (1 + F.exp(-steep * (x - mid)))


def text_weight(length: Column, mid: float | Column = TEXT_MID, steep: float | Column = TEXT_STEEP) -> Column:
    """Falls from 1 to 0.1 as an image holds more text."""
    return 1.0 - _rise(length.cast("double"), mid, steep)


def clarity_weight(blur: Column, mid: float | Column = CLARITY_MID, steep: float | Column = CLARITY_STEEP) -> Column:
    """Rises from 0.1 to 1 as an image is sharper."""
    return 0.1 + _rise(blur.cast("double"), mid, steep)


def text_level(length: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(LEVELS):
        out = F.when(length >= least, name).otherwise(out)
    return F.when(length.isNull(), F.lit(None)).otherwise(out)


def is_text_image(length: Column) -> Column:
    return length > 50


def quality_product(clarity: Column, text: Column) -> Column:
    return clarity * text


def is_high(score: Column, least: float = 0.5) -> Column:
    return score >= least


def image_weight(clarity: Column, text: Column, clarity_share: float = 0.4, text_share: float = 0.6, gain: float = 1.2) -> Column:
    return F.tanh(gain * (clarity_share * clarity + text_share * text))


def weighted_score(likelihood: Column, weight: Column, diversity: Column) -> Column:
    return likelihood * weight * F.coalesce(diversity, F.lit(1.0))


def squash(score: Column, scale: float = 1.0, mid: float = 0.5) -> Column:
    return (F.tanh(scale * (score - mid)) + 1) / 2


def quality_ratio(clarity: Column, text: Column, diversity: Column, text_ratio: float = 0.7, clarity_ratio: float = 0.3, diversity_ratio: float = 0.0, nonlinear: bool = False) -> Column:
    """A mean of text and clarity, moved towards its product with diversity; ratios that don't sum to 1 are scaled."""
    total = text_ratio + clarity_ratio + diversity_ratio
    if abs(total - 1) > 0.001:
        text_ratio, clarity_ratio, diversity_ratio = text_ratio / total, clarity_ratio / total, diversity_ratio / total
    base = F.coalesce(text, F.lit(0.5)) * text_ratio + F.coalesce(clarity, F.lit(0.5)) * clarity_ratio
    if diversity_ratio > 0:
        base = base * (1 - diversity_ratio + diversity_ratio * F.coalesce(diversity, F.lit(1.0)))
    return squash(base) if nonlinear else base


def category(x: Column, low: Column, medium: Column, zero: str | None = None) -> Column:
    """low, medium or high by two thresholds; with zero, that for 0."""
    out = F.when(x < low, "low").when(x < medium, "medium").otherwise("high")
    return F.when(x == 0, zero).otherwise(out) if zero else out


def softmax(logits: Column) -> Column:
    """Of an array; its largest element is taken off first."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The first position of the largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_label(klass: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), klass.cast("int") + 1)


def label_class(label: Column, positive: str = "positive", negative: str = "negative") -> Column:
    """0 for the positive label, 1 for the negative; others keep null."""
    return F.when(label == positive, 0).when(label == negative, 1)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.try_divide(F.greatest(width, height).cast("double"), F.least(width, height).cast("double"))


def fitted_steepness(high: Column, low: Column) -> Column:
    """1 / range, within 0.01 and 0.1; 0.05 where the range isn't positive."""
    gap = high - low
    return F.when(gap > 0, F.greatest(F.lit(0.01), F.least(F.try_divide(F.lit(1.0), gap), F.lit(0.1)))).otherwise(0.05)
