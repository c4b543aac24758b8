"""Links and articles of HTML pages, by the standard library's parser: regular expressions go wrong on scripts that hold
tags and on paragraphs that are never closed. Pages come to Python in Spark's Arrow batches and are taken out of them one at
a time; what is found goes back by the megabyte of pages, so a worker holds little besides the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINKS = "array<struct<block:string,title:string,link:string>>"
ARTICLE = "title string, content string, images array<string>, published string"
PIECE = 1 << 20


class _Page(HTMLParser):
    """Collects links by block, and the title, paragraphs, images and date of the article."""

    def __init__(self, blocks: tuple[str, ...], body: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.blocks, self.body = blocks, body
        self.open: list[tuple[str, str | None, bool]] = []  # tag, block that it begins, whether the article begins
        self.links: list[list] = []
        self.link: list | None = None
        self.h1: list[str] | None = None
        self.paragraph: list[str] | None = None
        self.paragraphs: list[str] = []
        self.images: list[str] = []
        self.dated: list[str] | None = None
        self.date = ""
        self.silent = 0

    def _block(self) -> str | None:
        return next((b for _, b, _ in reversed(self.open) if b), None)

    def _end_paragraph(self) -> None:
        if self.paragraph is not None and (text := "".join(self.paragraph).strip()):
            self.paragraphs.append(text)
        self.paragraph = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        named = {tag, f"#{own.get('id') or ''}", *(f"{tag}.{c}" for c in (own.get("class") or "").split())}
        inside = any(a for _, _, a in self.open)
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "a" and own.get("href"):
            if (block := self._block()) is not None:
                self.link = [block, [], own["href"]]
                self.links.append(self.link)
        elif tag == "h1" and self.h1 is None:
            self.h1 = []
            self.open.append(("h1", None, False))
            return
        elif tag == "p":
            self._end_paragraph()
            if inside:
                self.paragraph = []
        elif tag == "img" and inside and own.get("src"):
            self.images.append(own["src"])
        elif tag == "span" and named & {"span.date", "span.time-source"} and not self.date:
            self.dated = []
        if tag not in VOID:
            self.open.append((tag, next((b for b in self.blocks if b in named), None), bool(named & set(self.body))))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag == "a":
            self.link = None
        elif tag == "p":
            self._end_paragraph()
        elif tag == "span" and self.dated is not None:
            self.date, self.dated = "".join(self.dated).strip(), None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if any(a for _, _, a in self.open[k:]):
                    self._end_paragraph()
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.link is not None:
            self.link[1].append(data)
        if self.h1 is not None and any(t == "h1" for t, _, _ in self.open):
            self.h1.append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)
        if self.dated is not None:
            self.dated.append(data)


def parse(html: str | None, blocks: tuple[str, ...], body: tuple[str, ...]) -> _Page:
    page = _Page(blocks, body)
    page.feed(html or "")
    page.close()
    page._end_paragraph()
    return page


def results(batches: Iterator[tuple], one: Callable[..., list | tuple], kind: pa.DataType) -> Iterator[pa.Array]:
    """What `one` makes of each row of Arrow columns, of which the first holds pages: an array whenever the pages since the
    last have PIECE characters together, and at the end of a batch."""
    for columns in batches:
        out, size = [], 0
        for row in zip(*columns, strict=True):
            page, *others = (v.as_py() for v in row)
            out.append(one(page, *others))
            size += len(page or "")
            if size >= PIECE:
                yield pa.array(out, kind)
                out, size = [], 0
        if out:
            yield pa.array(out, kind)


def _by_page(one: Callable[..., list | tuple], ddl: str) -> Callable[..., Column]:
    kind = to_arrow_type(DataType.fromDDL(ddl))

    @F.arrow_udf(ddl)
    def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return results(batches, one, kind)

    return each


def links(html: Column, blocks: tuple[str, ...] = ("nav",), url: Column | None = None) -> Column:
    """The links within blocks (a tag, #id or tag.class each): block, text with white space collapsed, and address, made
    absolute where the page's url is given."""

    def one(page: str | None, base: str | None) -> list[tuple]:
        return [(b, " ".join("".join(t).split()), u if base is None else urljoin(base, u)) for b, t, u in parse(page, blocks, ()).links]

    return _by_page(one, LINKS)(html, url if url is not None else F.lit(None).cast("string"))


def article(html: Column, url: Column, title: Column | None = None, body: tuple[str, ...] = ("article", "div.article", "#artibody")) -> Column:
    """The title (that given, or the first h1), paragraphs by lines, absolute addresses of images and the date written
    there; all null for a page without title or content."""

    def one(text: str | None, base: str | None, given: str | None) -> tuple:
        page = parse(text, (), body)
        name, content = given or " ".join("".join(page.h1 or []).split()), "\n".join(page.paragraphs)
        return (name, content, [urljoin(base or "", s) for s in page.images], page.date or None) if name and content else (None, None, None, None)

    return _by_page(one, ARTICLE)(html, url, title if title is not None else F.lit(None).cast("string"))
