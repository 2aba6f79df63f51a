"""Text of release rows, out of their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.session import materialise, only

CONTENT = "sections array<struct<section_id:string,heading:string,content:string>>, _broken string"


def with_sections(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sections`` of content_json; null where the JSON is cut off or isn't an object with sections."""
    parsed = F.from_json("content_json", CONTENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return rows.withColumn("sections", F.when(parsed["_broken"].isNull(), parsed["sections"]))


def text_of(sections: Column) -> Column:
    """Contents of all sections, one below the other; null without sections."""
    return F.array_join(F.transform(F.filter(sections, lambda s: s["content"].isNotNull()), lambda s: s["content"]), "\n")


def salvaged_sections(content_json: Column) -> Column:
    """Section contents of JSON that is cut off, as far as they go, as an array of strings."""
    raw = F.regexp_extract_all(content_json, F.lit(r'"content"\s*+:\s*+"([^"\\]*+(?:\\.[^"\\]*+)*+)'), F.lit(1))
    return F.transform(raw, lambda x: F.from_json(F.concat(F.lit('{"c":"'), F.regexp_replace(x, r"\\(u[0-9a-fA-F]{0,3})?$", ""), F.lit('"}')), "c string")["c"])


def latest_releases(rows: DataFrame) -> DataFrame:
    """One row a release: of its crawls, one whose JSON is whole if there is any, then the latest (highest id).

    Adds ``text``: all section contents, salvaged where the JSON is cut off. Rows without release_id stand for themselves,
    rows without id don't count. Which crawls stay is decided on ids alone; texts are shuffled only if too many fall away.
    """
    rows = rows.where(F.col("id").isNotNull())
    key = F.coalesce(F.concat(F.lit("r"), "release_id"), F.concat(F.lit("i"), F.col("id").cast("string")))
    crawls = with_sections(rows).select(key.alias("_key"), "id", F.col("sections").isNotNull().alias("_whole"))
    best = materialise(crawls.groupBy("_key").agg(F.max(F.struct("_whole", "id"))["id"].alias("id")).select("id"), "latest")
    rest = materialise(rows.select("id").join(best, "id", "left_anti"), "superseded")
    salvage = F.array_join(F.filter(salvaged_sections(F.col("content_json")), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("sections").isNotNull(), text_of(F.col("sections"))).otherwise(salvage)
    return with_sections(only(rows, "id", best, rest)).withColumn("text", F.nullif(text, F.lit("")))
