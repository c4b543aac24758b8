"""Spreadsheets, by the standard library: a workbook is a zip of XML. Sheets hold at most a million rows, which one task
reads or writes; the file system is Hadoop's, so that any path will do that Spark can reach."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 1_048_575
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DAY_0 = datetime(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def parse(raw: bytes) -> list[list]:
    """The first sheet's rows; numbers in cells with a format of dates become dates."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = book.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            cells = styles.find(f"{_NS}cellXfs")
            for k, x in enumerate(cells if cells is not None else ()):
                form = int(x.get("numFmtId", 0))
                if 14 <= form <= 22 or re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(form, "")).lower()):
                    dated.add(k)
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_NS}row"):
            out: list = []
            for nth, cell in enumerate(row.iter(f"{_NS}c")):
                at = _column(cell.get("r")) if cell.get("r") else nth
                out += [None] * (at + 1 - len(out))
                value, kind = cell.find(f"{_NS}v"), cell.get("t")
                if kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    out[at] = shared[int(value.text)]
                elif kind in ("str", "d"):
                    out[at] = value.text
                elif kind == "b":
                    out[at] = value.text == "1"
                elif kind != "e":
                    x = float(value.text)
                    out[at] = (_DAY_0 + timedelta(days=x)) if int(cell.get("s") or 0) in dated else x
            rows.append(out)
        return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, its first row being names: columns of numbers are doubles, of dates dates, others strings."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = parse(bytes(raw))
    if not rows:
        raise ValueError("an empty sheet")
    names = [str(n) if n is not None else f"_{k}" for k, n in enumerate(rows[0])]
    columns, kinds = [], []
    for k, _ in enumerate(names):
        values = [r[k] if k < len(r) else None for r in rows[1:]]
        known = [v for v in values if v is not None]
        if known and all(isinstance(v, datetime) for v in known):
            kinds.append("date")
            columns.append([v.date() if v is not None else None for v in values])
        elif known and all(isinstance(v, float) for v in known):
            kinds.append("double")
            columns.append(values)
        else:
            kinds.append("string")
            columns.append([None if v is None else v.date().isoformat() if isinstance(v, datetime) else str(v) for v in values])
    return spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def build(names: list[str], rows: list[tuple]) -> bytes:
    def cell(at: str, value: object) -> str:
        if value is None or (isinstance(value, float) and value != value):
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime | date):
            day = datetime(value.year, value.month, value.day) if not isinstance(value, datetime) else value
            return f'<c r="{at}" s="1"><v>{(day - _DAY_0) / timedelta(days=1):.10g}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = ["".join(cell(f"{_letters(k)}{n}", v) for k, v in enumerate(r)) for n, r in enumerate([tuple(names), *rows], 1)]
    head, main = '<?xml version="1.0" encoding="UTF-8"?>', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel, office = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook {main} xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet {main}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"{head}<worksheet {main}><sheetData>" + "".join(f'<row r="{n}">{x}</row>' for n, x in enumerate(lines, 1)) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str) -> None:
    """One workbook of a table by day; more rows than a sheet holds are refused."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError("more rows than a sheet holds")
    rows = [tuple(r) for r in df.collect()]  # within the check above
    raw = build(df.columns, [tuple(None if v is pd.NaT else v for v in r) for r in rows])
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()


__all__ = ["build", "parse", "read_xlsx", "write_xlsx"]
