"""Content blocks to numbered sections.

A heading block, or a paragraph that looks like a heading of at most 12 words, starts a section; a heading equal to the
current one (but for case) doesn't. Sections without content vanish and take no number. Text before the first heading
stands under "Main Content". Pages without blocks have no sections.

The windows are over one page's blocks; a page is a bounded group, as it was one row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import heading_name, is_heading
from granthika.session import computed_once

MAIN = "Main Content"
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MAX_HEADING_WORDS = 12


def infer_sections(blocks: DataFrame, key: str, prefix: Column | None = None) -> DataFrame:
    """key, section_no (from 1), section_id, heading, content of block rows (key, pos, name, text); ids are ``prefix-Snn``."""
    tagged = F.col("name").isin(*HEADING_TAGS)
    short = F.size(F.split("_name", r"\s+")) <= MAX_HEADING_WORDS
    marked = computed_once(blocks.withColumn("_name", heading_name(F.col("text")))).withColumn("_heading",
        F.when(tagged | ((F.col("name") == "p") & is_heading(F.col("text")) & short), F.col("_name"))).where("_heading is null or _heading <> ''")
    page = Window.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.last("_heading", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(MAIN))
    starts = marked.withColumn("_new", (F.col("_heading").isNotNull() & (F.lower("_heading") != F.lower(before))).cast("int"))
    placed = starts.withColumn("_section", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = placed.groupBy(key, "_section").agg(
        F.coalesce(F.max(F.when(F.col("_new") == 1, F.col("_heading"))), F.lit(MAIN)).alias("heading"),
        F.sort_array(F.collect_list(F.when(F.col("_heading").isNull(), F.struct("pos", "text")))).alias("_texts"),
    )
    filled = grouped.where(F.size("_texts") > 0).withColumn("section_no", F.row_number().over(Window.partitionBy(key).orderBy("_section")))
    number = F.format_string("-S%02d", "section_no")
    return filled.select(key, "section_no", F.concat(F.col(key).cast("string") if prefix is None else prefix, number).alias("section_id"), "heading",
        F.array_join(F.transform("_texts", lambda x: x["text"]), "\n\n").alias("content"))


def has_tables(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.groupBy(key).agg(F.max("is_table").alias("has_tables"))
