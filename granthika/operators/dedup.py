"""First and last of each key, in a stated order; nulls in a key count as one key unless they are left out before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which must tell rows apart.

    It is an aggregate, so a key with many rows is reduced before the shuffle, and no task sorts it.
    """
    return _picked(rows, keys, order, F.min)


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; nulls in ``order`` come first."""
    return _picked(rows, keys, order, F.max)


def _picked(rows: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    best = rows.groupBy(*keys).agg(choose(packed).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns if c in keys or c in order or c in rest])


def first_by_max(rows: DataFrame, keys: list[str], value: Column, tie: str) -> DataFrame:
    """The row of each key with the largest value; ties go to the smallest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(value.desc_nulls_last(), F.col(tie).asc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_texts(rows: DataFrame, scope: list[str], key: Column, order: list[str]) -> DataFrame:
    """``rows`` without those whose ``key`` already came earlier in the same scope; rows with a null key stay."""
    keyed = rows.withColumn("_key", key)
    return first_by(keyed.where(F.col("_key").isNotNull()), [*scope, "_key"], order).unionByName(keyed.where(F.col("_key").isNull())).drop("_key")


def best_pass(rows: DataFrame, keys: list[str], order: str, confidence: str, length: str, enough: float = 85, least: int = 20) -> DataFrame:
    """The best of several passes over each key, as if they were tried in ``order`` until one is good enough.

    Passes after the first with ``confidence`` >= enough and ``length`` >= least don't count, nor do those of length 0. The
    score is the confidence (null: 0) and up to 10 for the length; ties go to the earlier pass.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    good = (F.col(confidence) >= enough) & (F.col(length) >= least)
    tried = rows.withColumn("_stop", F.coalesce(F.max(F.coalesce(good, F.lit(False)).cast("int")).over(w),
        F.lit(0))).where((F.col("_stop") == 0) & (F.col(length) > 0)).drop("_stop")
    return first_by_max(tried, keys, F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)) + F.least(F.col(length), F.lit(500)) / 50, order)
