"""URLs of pages and images."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
SKIPPED_PARTS = tuple("ad_ adv_ advertisement avatar background banner button favicon footer header icon loading logo p.v.iask placeholder sidebar thumbnail".split())
_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def path(url: Column) -> Column:
    """What lies between host and query; empty without."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize(url: Column) -> Column:
    """Scheme, host and path in lower case, without one trailing slash, query and fragment."""
    whole = F.concat(F.regexp_extract(url, _HOST, 1), F.lit("://"), F.regexp_extract(url, _HOST, 2), path(url))
    return F.lower(F.regexp_replace(whole, "/$", ""))


def is_image_url(url: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_PARTS) -> Column:
    """A web address with an image's extension in its path, or at its very end, and none of the skipped words in it."""
    low, kinds = F.lower(url), "|".join(extensions)
    good = low.rlike("^https?://") & (low.rlike(rf"\.({kinds})$") | path(low).rlike(rf"\.({kinds})"))
    return F.coalesce(good & ~low.rlike("|".join(re.escape(s) for s in skipped)), F.lit(False))


def image_filename(url: Column) -> Column:
    """The last part of the path. One of under five characters or without a dot gives way to a hash of the URL, which
    ends in .jpg: so short a name has no room for an image's extension after a name."""
    base = F.element_at(F.split(path(url), "/"), -1)
    hashed = F.concat(F.lit("image_"), F.md5(url), F.lit(".jpg"))
    return F.when((F.length(base) < 5) | ~F.contains(base, F.lit(".")), hashed).otherwise(base)


@F.pandas_udf(StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link, strict=True)], dtype=object)
