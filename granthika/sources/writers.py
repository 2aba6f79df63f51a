"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("errorifexists").json(path)


def write_text(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(column).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def write_points(points: DataFrame, path: str, width: int) -> None:
    """Vector points, laid out by source type and language; a vector of another width stops the write."""
    bad = F.raise_error(F.concat(F.lit("vector width of "), F.col("point_id"))).cast("boolean")
    points.where(F.when(F.size("vector") != width, bad).otherwise(F.lit(True))).write.mode("errorifexists").partitionBy("source_type", "language").parquet(path)
