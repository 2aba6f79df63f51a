"""Table changes without MERGE: insert-or-ignore, fill-in repair, document-atomic upsert, latest state, crawl progress.

``AppendedTable`` and ``BucketedTable`` keep their state in Parquet folders and touch no more of it than a load changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granthika.operators.dedup import last_by
from granthika.session import materialise, read_if_there

DAY = "d-M-yyyy"


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``incoming`` whose keys are new, each key on its own: a row goes in only if no target row, and no earlier
    incoming row, has any of its keys. Null keys never collide.
    """
    fresh = incoming
    for key in keys:
        fresh = fresh.join(target.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    for key in keys:
        first = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
        fresh = fresh.join(first, key, "left").where(F.col("_first").isNull() | (F.col(order) == F.col("_first"))).drop("_first")
    return fresh.select(*incoming.columns)


def fill_missing(target: DataFrame, repairs: DataFrame, key: str, column: str) -> DataFrame:
    """``target`` with null or empty ``column`` filled from ``repairs`` (one row a key); adds ``repaired``."""
    other = repairs.select(F.col(key), F.col(column).alias("_repair")).where(F.col("_repair").isNotNull() & (F.col("_repair") != ""))
    empty = F.col(column).isNull() | (F.col(column) == "")
    joined = target.join(other, key, "left")
    return joined.withColumns({"repaired": empty & F.col("_repair").isNotNull(),
        column: F.when(empty, F.coalesce("_repair", F.col(column))).otherwise(F.col(column))}).drop("_repair")


def upsert_documents(target: DataFrame, batch: DataFrame, document: str) -> DataFrame:
    """``target`` without any row of the batch's documents, and the batch: a document is replaced as a whole."""
    return target.join(batch.select(document).distinct(), document, "left_anti").unionByName(batch)


def delete_documents(target: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    return target.join(documents.select(document).distinct(), document, "left_anti")


def latest_state(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last event of each key; later rows with the same time and different values are told apart by all columns."""
    return last_by(events, [key], [at, *sorted(c for c in events.columns if c not in (key, at))])


def completed_days(progress: DataFrame) -> DataFrame:
    return progress.where(F.col("status") == "completed").select(F.try_to_timestamp("crawl_date",
        F.lit(DAY)).cast("date").alias("day")).where("day is not null").distinct()


def missing_days(progress: DataFrame) -> DataFrame:
    """Days from the first to the last listed one that aren't completed, with the status they have (null: not listed)."""
    listed = progress.select(F.try_to_timestamp("crawl_date", F.lit(DAY)).cast("date").alias("day"), "status").where("day is not null")
    span = listed.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(completed_days(progress), "day", "left_anti").join(listed.where("status <> 'completed'"), "day",
        "left").groupBy("day").agg(F.max("status").alias("status"))


def resume_day(progress: DataFrame) -> DataFrame:
    """One row: the first day that isn't completed, or the day after the last."""
    listed = progress.select(F.try_to_timestamp("crawl_date", F.lit(DAY)).cast("date").alias("day")).agg(F.max("day").alias("last"))
    return missing_days(progress).agg(F.min("day").alias("first")).crossJoin(F.broadcast(listed)).select(F.coalesce("first",
        F.date_add("last", 1)).alias("resume_day"))


def chunks_of(chunks: DataFrame, documents: DataFrame, limit: int = 1000, document: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """The first ``limit`` chunks of each wanted document, by their index; repeated documents are asked for once."""
    held = chunks.join(documents.select(document).distinct(), document, "left_semi")
    return held.withColumn("_rn", F.row_number().over(Window.partitionBy(document).orderBy(order))).where(F.col("_rn") <= limit).drop("_rn")


def with_metadata_value(metadata: Column, key: str, value: Column) -> Column:
    """``metadata`` (a JSON object as text) with ``key`` set to a text; what is no object counts as an empty one, and other values stay as they are."""
    held = F.from_json(F.when(F.json_object_keys(F.when(F.try_parse_json(metadata).isNotNull(), metadata)).isNotNull(), metadata), "map<string,variant>")
    others = F.map_filter(F.coalesce(held, F.expr("cast(map() as map<string,variant>)")), lambda k, _: k != key)
    own = F.from_json(F.to_json(F.struct(value.alias("v"))), "struct<v:variant>")["v"]
    return F.when(value.isNull(), metadata).otherwise(F.to_json(F.map_concat(others, F.create_map(F.lit(key), own))))


def started_days(progress: DataFrame, at: Column) -> DataFrame:
    """An event ``running`` for each day that isn't completed: missing ones, failed ones, and those that broke off while running."""
    day = F.date_format("day", "dd-MM-yyyy").alias("crawl_date")
    return missing_days(progress).select(day, F.lit("running").alias("status"), at.alias("started_at"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("completed_at", "string"), ("documents_found", "int"), ("documents_added", "int"), ("error", "string"))])


def ended_days(started: DataFrame, outcomes: DataFrame, at: Column, longest_error: int = 2000) -> DataFrame:
    """``started`` with what came of each day (crawl_date, found, added, error): a day with an error has failed, one without
    any document is completed with zeros, and a day without an outcome is still running.
    """
    o = outcomes.select("crawl_date", "found", "added", F.substring("error", 1, longest_error).alias("_error"), F.lit(True).alias("_ended"))
    joined = started.join(o, "crawl_date", "left")
    ended, failed = F.col("_ended").isNotNull(), F.col("_error").isNotNull()
    return joined.select(
        "crawl_date", F.when(~ended, F.col("status")).when(failed, "failed").otherwise("completed").alias("status"), "started_at",
            F.when(ended, at).alias("completed_at"),
        *[F.when(ended, F.coalesce(c, F.lit(0))).cast("int").alias(f"documents_{c}") for c in ("found", "added")], F.col("_error").alias("error"),
    )


def ensure_loaded(spark: SparkSession, path: str, points: DataFrame, least: int = 15_000, vector: str = "vector") -> DataFrame:
    """The table at ``path``; it is written from ``points`` if there is none, if it has fewer than ``least`` rows, or if its vectors have another width."""
    held, width = read_if_there(spark, path), F.max(F.size(vector))
    if held is not None and held.limit(least).count() >= least and held.agg(width).first()[0] == points.agg(width).first()[0]:
        return held
    points.write.mode("overwrite").partitionBy("source_type", "language").parquet(path)
    return spark.read.parquet(path)


class AppendedTable:
    """A Parquet table that only grows: rows whose keys it lacks are appended, so a load writes what is new and no more.

    A load that is run again adds nothing, as its keys are there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        return read_if_there(self.spark, self.path)

    def add(self, batch: DataFrame, keys: list[str], order: str) -> None:
        now = self.read()
        insert_or_ignore(batch.limit(0) if now is None else now, batch, keys, order).write.mode("append").parquet(self.path)


class BucketedTable:
    """A Parquet table in folders by hash of the document; an upsert rewrites the buckets of its documents alone.

    Buckets are replaced one by one; an upsert that broke off is repaired by running it again.
    """

    def __init__(self, spark: SparkSession, path: str, document: str, buckets: int = 64):
        self.spark, self.path, self.document, self.buckets = spark, path, document, buckets

    def read(self) -> DataFrame | None:
        held = read_if_there(self.spark, self.path)
        return held and held.drop("_bucket")

    def upsert(self, batch: DataFrame) -> None:
        """Replaces each document of ``batch`` as a whole."""
        own = materialise(batch.withColumn("_bucket", F.pmod(F.xxhash64(self.document), F.lit(self.buckets)).cast("int")), "upsert")
        held, touched = read_if_there(self.spark, self.path), [r[0] for r in own.select("_bucket").distinct().collect()]
        if held is not None:
            own = upsert_documents(held.where(F.col("_bucket").isin(touched)).select(*own.columns), own, self.document)
        own.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
