"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.operators.documents import check_columns
from granthika.schemas import CLAIM, LIVE_RECORD

RELEASE_COLUMNS = ["document_id", "url", "published_at", "language", "organization", "metadata_json", "content_json"]
TEXT_SUFFIXES = ("txt", "md")


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Release rows; the required columns are checked, others are pruned by what a query uses."""
    return check_columns(spark.read.parquet(path), RELEASE_COLUMNS)


def read_live_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested JSON records; broken ones keep their text in ``_broken``."""
    return spark.read.schema(f"{LIVE_RECORD}, _broken string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_broken").json(path)


def last_records(records: DataFrame, position: str, n: int = 5) -> DataFrame:
    """The last ``n`` records by position, the latest first."""
    return records.orderBy(F.desc(position)).limit(n)


def read_claims(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(CLAIM).option("multiLine", multi_line).json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, character_count of whole files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    read = files.where(kind.isin(*TEXT_SUFFIXES)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return read.withColumn("character_count", F.length("text"))


def route_files(spark: SparkSession, path: str) -> DataFrame:
    """path and route (text, image, pdf or unsupported) of each file, by its suffix; contents aren't read."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.when(kind.isin(*TEXT_SUFFIXES), "text").when(kind.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "image").when(kind == "pdf", "pdf").otherwise("unsupported")
    return spark.read.format("binaryFile").load(path).select("path", "length", route.alias("route"))
