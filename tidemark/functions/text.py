"""Text clean-up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN = r"[一-鿿]"
ENCODINGS = ("gb18030", "gbk", "gb2312", "utf-8")


def has_script(x: Column, script: str = HAN) -> Column:
    """Whether a title is there and has a character of the script."""
    return F.coalesce((x != "") & x.rlike(script), F.lit(False))


def strip(x: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """Control characters, tags, repeated stops and empty brackets go; runs of white space become a blank."""
    for pattern, to in (
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"(?U)\s+", " "),
        (r"<[^>]+>", ""),
        (r"([!?。！？，,])[!?。！？，,]+", "$1"),
        (r"(?U)\(\s*\)|\[\s*\]|【\s*】|（\s*）", ""),
    ):
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def safe_title(x: Column, key: Column, most: int = 100) -> Column:
    """A file name from a title; an empty one is named by its key."""
    name = F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r'[<>:"/\\|?*]', "_"), 1, most)
    return F.when(name == "", F.concat(F.lit("untitled_"), key.cast("string"))).otherwise(name)


def head(x: Column, most: int = 2048) -> Column:
    """The first characters, of text that a model takes no more of."""
    return F.substring(x, 1, most)


def split_list(x: Column, none: str = "No images") -> Column:
    """The non-empty parts of a comma-separated list; none for the text that says so."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != none))
    return F.coalesce(parts, F.array().cast("array<string>"))


def is_hidden(name: Column) -> Column:
    return name.startswith("._")


def percent(part: Column, total: Column) -> Column:
    return F.concat(F.format_number(F.coalesce(F.try_divide(100.0 * part, total), F.lit(0.0)), 2), F.lit("%"))


CATEGORIES = {
    "Domestic News": ("gnxw_01", "ndxw_01"), "Domestic·International Finance": ("cjxwgngjcj_01",), "Finance·Life": ("cjxwlcsh_01",), "Finance·Tech·Auto·Real Estate": ("cjkjqcfc_01",),
    "Headlines": ("yw_01",), "Stocks·Hong Kong·US Stocks": ("cjxwgpggmg_01",), "Tech·Exploration": ("kjxwkjts_01",), "Tech·Internet": ("kjxwhlw_01",),
}


def category(block: Column) -> Column:
    """The category of a block of an index page, by its id; null for any other."""
    pairs = [F.lit(x) for name, blocks in sorted(CATEGORIES.items()) for b in blocks for x in (f"blk_{b}", name)]
    return F.element_at(F.create_map(*pairs), block)


def decode(raw: Column, charset: Column | None = None) -> Column:
    """Bytes of an article: by the charset that the server named; without one, or with one that is none, by the first of
    UTF-8 and the encodings of Chinese that takes them all. What no encoding takes is UTF-8 with marks. UTF-8 stays in the
    JVM; only other bytes go to Python."""
    named = F.lit(None).cast("string") if charset is None else F.nullif(F.lower(F.trim(charset)), F.lit("utf-8"))
    plain = F.try_validate_utf8(raw.cast("string"))
    own = named.isNull() & plain.isNotNull()
    return F.when(own, plain).otherwise(_decoded(F.when(~own, raw), F.when(~own, named)))


def charset_of(content_type: Column) -> Column:
    """The charset that a Content-Type names; null for none."""
    return F.nullif(F.regexp_extract(content_type, r"(?i)charset=\s*\"?([^\s;\"]+)", 1), F.lit(""))


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series, charset: pd.Series) -> pd.Series:
    def one(b: bytes | None, named: str | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode(named, "replace") if named else first(bytes(b))
        except LookupError:
            return first(bytes(b))

    def first(b: bytes) -> str:
        for encoding in ("utf-8", "gb18030"):  # gbk and gb2312 take nothing that gb18030 doesn't
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "replace")

    return pd.Series([one(b, n) for b, n in zip(raw, charset, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def decode_index(raw: pd.Series) -> pd.Series:
    """Bytes of an index page: the first of ENCODINGS that decodes and shows a Han character, or UTF-8 with marks for
    what isn't. Spark itself rejects gb18030."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ENCODINGS:
            try:
                text = bytes(b).decode(encoding)
            except UnicodeDecodeError:
                continue
            if any("一" <= c <= "鿿" for c in text):
                return text
        return bytes(b).decode("utf-8", "replace")

    return raw.map(one)
