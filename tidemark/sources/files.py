"""Files and tables. Filters and columns chosen afterwards reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.dates import parse_any
from tidemark.operators.joins import with_date_column
from tidemark.sources.xlsx import read_xlsx

IMAGES = "*.[jJpPgG][pPnNiI]*[gGfF]"  # what globs can say; IMAGE_NAMES says it exactly
IMAGE_NAMES = r"(?i)\.(jpg|jpeg|png|gif)$"


def years(spark: SparkSession, path: str, wanted: list[int] | None = None, schema: StructType | None = None) -> DataFrame:
    """A table partitioned by year; only the folders of the years wanted are read."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.where(F.col("year").isin(wanted)) if wanted else df


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table_years(spark: SparkSession, path: str) -> list[int]:
    """The years whose folders a table has; from names alone."""
    if not table_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [s.getPath().getName() for s in found]
    return sorted(int(n[5:]) for n in names if n.startswith("year=") and n[5:].isdigit())


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV (with header), JSON lines, an array of JSON, XLSX, ORC or Parquet, by the extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "xlsx":
        return read_xlsx(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    if kind == "csv":
        return (reader if schema else reader.option("inferSchema", True)).option("header", True).csv(path)
    return reader.parquet(path)


def market(df: DataFrame, date: str = "Date") -> DataFrame:
    """A table of indices by day: its column of dates found and parsed, days that are none left out, the rest as numbers."""
    df = with_date_column(df, date)
    others = [c for c in df.columns if c != date]
    return df.select(parse_any(F.col(f"`{date}`").cast("string").substr(1, 10)).alias(date), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in others]).dropna(subset=[date])


def files(spark: SparkSession, folder: str, pattern: str = IMAGES, names: str | None = None) -> DataFrame:
    """(folder_path, name, path, length) of files below a folder, hidden ones (._*) left out; contents aren't read. names
    is a regular expression that names must match: without a pattern, that of images' extensions."""
    names = names or (IMAGE_NAMES if pattern == IMAGES else ".")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    parts = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2)
    return found.select(parts[0].alias("folder_path"), parts[1].alias("name"), "path", "length").where(~F.col("name").startswith(".") & F.col("name").rlike(names))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, data in BGR); what is none has no data."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*").load(folder).select("image.*")


def labelled_images(spark: SparkSession, folder: str, classes: tuple[str, ...] = ("positive", "negative")) -> DataFrame:
    """Images with `label`: the place in classes of the folder that holds them."""
    parent = F.element_at(F.split("origin", "/"), -2)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), parent)
    return images(spark, folder).withColumn("label", F.when(place > 0, (place - 1).cast("int"))).where("label IS NOT NULL")
