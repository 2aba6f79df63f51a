"""Corpus analytics: measures of each document, distributions, thresholds, duplicate groups, quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.text import word_count
from granthika.session import join_counted, materialise

WORD_THRESHOLDS = (500, 750, 1000, 1500, 2000)
SHORT_WORDS = 50
REPLACEMENT = "�"


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with character_count and word_count; null text counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumns({"character_count": F.length(value).cast("long"), "word_count": word_count(value)})


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, minimum, average, median, p90, p95, p99, maximum; percentiles interpolate. An empty table gives no row by group, one of nulls without.

    Exact percentiles keep a count for each distinct value, of which lengths have few.
    """
    v = F.col(value)
    found = [F.percentile(v, F.lit(p)).alias(name) for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("minimum"), F.avg(v).alias("average"), *found, F.max(v).alias("maximum"))


def over_thresholds(rows: DataFrame, value: str, thresholds: tuple[int, ...] = WORD_THRESHOLDS) -> DataFrame:
    """threshold, n_over (strictly) and percent, in one pass over the rows."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(value) > t).alias(f"t{t}") for t in thresholds])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_over")) for t in thresholds]))
    return counts.select("n", pairs.alias("p")).select("p.threshold", "p.n_over", F.when(F.col("n") > 0, 100.0 * F.col("p.n_over") / F.col("n")).alias("percent"))


def largest(rows: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(value), key).limit(k)


def duplicate_classes(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """text_hash, class_id (smallest key of the copies) and n_copies of each text that occurs more than once."""
    hashed = documents.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min(key).alias("class_id"), F.count("*").alias("n_copies")).where("n_copies > 1")


def exact_duplicates(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """class_id, n_copies and the key of each document whose text occurs more than once; a class may hold any share of them."""
    hashed = documents.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("text_hash"))
    return join_counted(hashed, materialise(duplicate_classes(documents, key, text), "copies"), "text_hash", "n_copies")


def has_repeated_paragraphs(text: Column) -> Column:
    parts = F.filter(F.split(text, "\n\n", -1), lambda p: p != "")
    return F.size(parts) != F.size(F.array_distinct(parts))


def has_table_like_text(text: Column) -> Column:
    return text.contains("\t") | text.contains("|") | F.lower(text).contains("table ")


def replacement_characters(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit(""))), F.lit(0))


def report(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """measure and value of the whole corpus: counts, distributions, thresholds, duplicates and quality marks."""
    value = F.coalesce(F.col(text), F.lit(""))
    base = measured(documents, text).select(
        key, "character_count", "word_count", has_repeated_paragraphs(value).alias("_repeated"), has_table_like_text(value).alias("_table"),
            replacement_characters(value).alias("_replaced")
    )
    names = {"n_documents": F.count("*"), "n_repeated_paragraphs": F.count_if("_repeated"), "n_table_like": F.count_if("_table"),
        "n_replacement_characters": F.sum("_replaced"), "n_short": F.count_if(F.col("word_count") < SHORT_WORDS)}
    for column in ("character_count", "word_count"):
        names |= {f"{column}_min": F.min(column), f"{column}_mean": F.avg(column), f"{column}_max": F.max(column)}
        names |= {f"{column}_p{round(p * 100)}": F.percentile(column, F.lit(p)) for p in (0.5, 0.9, 0.95, 0.99)}
    names |= {f"words_over_{t}": F.count_if(F.col("word_count") > t) for t in WORD_THRESHOLDS}
    one = base.agg(*[c.cast("double").alias(k) for k, c in names.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in names]))
    copies = duplicate_classes(documents, key, text).agg(F.count("*").cast("double").alias("a"), F.coalesce(F.sum("n_copies"), F.lit(0)).cast("double").alias("b"))
    groups = copies.select(F.explode(F.array(F.struct(F.lit("n_duplicate_groups").alias("measure"), F.col("a").alias("value")),
        F.struct(F.lit("n_documents_in_groups").alias("measure"), F.col("b").alias("value")))).alias("p")).select("p.*")
    return one.select(pairs.alias("p")).select("p.*").unionByName(groups)


def mean_of_valid(rows: DataFrame, value: str, *by: str, invalid: float = -1) -> DataFrame:
    """Mean over values that aren't null or the mark for none; null where there is no valid value."""
    return rows.groupBy(*by).agg(F.avg(F.when(F.col(value) != invalid, F.col(value))).alias("mean_value"),
        F.count(F.when(F.col(value) != invalid, 1)).alias("n_valid"))


def mean_confidence(rows: DataFrame, value: str, *by: str, most: float = 10) -> DataFrame:
    """Mean of the values that are numbers, held between 0 and ``most`` and divided by it; 0 where there is none."""
    v = F.col(value).cast("double")
    mean = F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(0.0))
    return rows.groupBy(*by).agg((F.least(F.lit(float(most)), F.greatest(F.lit(0.0), mean)) / most).alias("mean_confidence"))
