"""Queries on date texts (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.urls import host
from granthika.operators.timestamps import InstantDictionary, is_canonical, normalise, resolve_only
from granthika.session import broadcast_within, scratch_path, table

HOME_ZONE, HOME_ORDER = "Asia/Kolkata", "dmy"


def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date text of both tables: table_name, row_no, field_name, raw, zone, date_order."""
    releases = table(spark, sf_dir, "pib_releases").select(
        F.lit("pib_releases").alias("table_name"), F.col("id").alias("row_no"), F.lit("published_at").alias("field_name"),
        F.col("published_at").alias("raw"), F.lit(HOME_ZONE).alias("zone"), F.lit(HOME_ORDER).alias("date_order"),
    )
    sites = broadcast_within(
        table(spark, sf_dir, "site_profiles").select(
            F.regexp_replace(F.lower("organization"), r"^www\.", "").alias("site"), F.col("time_zone").alias("site_zone"), F.col("date_order").alias("site_order")
        )
    )
    pages = (
        table(spark, sf_dir, "webscraper_output")
        .select("record_no", F.col("dates.published_at").alias("pub"), F.col("dates.retrieved_at").alias("got"), host(F.col("source.source_url")).alias("site"))
        .join(sites, "site", "left")
        .select(
            F.lit("webscraper_output").alias("table_name"), F.col("record_no").alias("row_no"),
            F.explode(F.array(
                F.struct(F.lit("dates.published_at").alias("field_name"), F.col("pub").alias("raw"),
                    F.coalesce("site_zone", F.lit(HOME_ZONE)).alias("zone"), F.coalesce("site_order", F.lit(HOME_ORDER)).alias("date_order")),
                F.struct(F.lit("dates.retrieved_at").alias("field_name"), F.col("got").alias("raw"), F.lit("UTC").alias("zone"),
                    F.lit(HOME_ORDER).alias("date_order")),
            )).alias("v"),
        )
        .select("table_name", "row_no", "v.*")
    )
    return releases.unionByName(pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = date_values(spark, sf_dir).where(F.col("raw").isNotNull() & ~is_canonical(F.col("raw")))
    dictionary = InstantDictionary(spark, scratch_path(spark, "instants"))
    return resolve_only(values, dictionary).select("table_name", "row_no", "field_name", "instant_utc")


def p2_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date field of every row with its instant, or ``undecidable``."""
    dictionary = InstantDictionary(spark, scratch_path(spark, "instants"))
    return normalise(date_values(spark, sf_dir), dictionary).select(
        "table_name", "row_no", "field_name", "instant_utc", F.when(F.col("instant").isNull(), "undecidable").otherwise("instant").alias("outcome")
    )


def p2_in_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found by two loads from one stored dictionary: the releases first, then all rows by a dictionary opened anew, which parses only what it lacks."""
    values = date_values(spark, sf_dir).where(F.col("raw").isNotNull() & ~is_canonical(F.col("raw")))
    path = scratch_path(spark, "instants")
    InstantDictionary(spark, path).extend(values.where("table_name = 'pib_releases'"))
    return resolve_only(values, InstantDictionary(spark, path)).select("table_name", "row_no", "field_name", "instant_utc")


def p2_undecidable_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field fix an instant."""
    return (
        p2_instants(spark, sf_dir)
        .groupBy("table_name", "field_name")
        .agg(F.count("*").alias("n_values"), F.count("instant_utc").alias("n_instants"), F.min("instant_utc").alias("first_instant"),
            F.max("instant_utc").alias("last_instant"))
    )


QUERIES = {"p2_found": p2_found, "p2_instants": p2_instants, "p2_in_two_loads": p2_in_two_loads, "p2_undecidable_by_field": p2_undecidable_by_field}
