"""Incremental loads with Structured Streaming.

A file stream is read with ``availableNow``: what is new since the last run, then stop. Each micro-batch changes the table
through the same insert-or-ignore and upsert operators as a batch job. A batch that is run again after a failure writes
the same rows, as both operators are idempotent by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.operators.store import AppendedTable, BucketedTable


def ingest_new(spark: SparkSession, source: str, schema, table: AppendedTable, keys: list[str], order: str, checkpoint: str) -> None:
    """Adds rows of new files whose keys the table lacks."""
    _run(spark.readStream.schema(schema).parquet(source), lambda batch, _: table.add(batch, keys, order), checkpoint)


def ingest_documents(spark: SparkSession, source: str, schema, table: BucketedTable, checkpoint: str) -> None:
    """Replaces the documents that new files hold, each as a whole."""
    _run(spark.readStream.schema(schema).parquet(source), lambda batch, _: table.upsert(batch), checkpoint)


def _run(stream: DataFrame, each, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each kind in tumbling windows; batch or stream (with a watermark for late rows)."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    grouped = timed.groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), kind, "n", "total")
