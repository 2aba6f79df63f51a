"""Records to documents: JSON fields with fallbacks, metadata union, canonical source types, validation.

Every adapter adds ``errors``, an array of what is wrong with the row; ``split_valid`` divides rows by it, ``require_valid``
stops on the first. Nulls and blanks count as missing; no value is invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.dates import iso_utc, social_instant
from granthika.functions.text import blank_to_null, clean_social, content_hash, entity_names, is_blank, links_of
from granthika.functions.urls import is_http_url
from granthika.schemas import CONTENT_JSON, LANGUAGE_TAG, SOURCE_TYPES
from granthika.session import computed_once

SECTION_SEPARATOR = "\n\n"


def first_filled(*candidates: Column) -> Column:
    """The first candidate that isn't null or blank, as it is."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def parse_object(text: Column, fields: str) -> Column:
    """``text`` as a struct of ``fields`` (which end in ``_broken string``); null if it isn't one whole JSON object."""
    parsed = F.from_json(text, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.when(parsed["_broken"].isNull() & text.rlike(r"^\s*\{"), parsed)


def json_map(text: Column) -> Column:
    """Top-level keys with their values as text; null if it isn't an object."""
    return F.when(F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text)).isNotNull(), F.from_json(text, "map<string,string>"))


def missing_keys(text: Column, required: list[str]) -> Column:
    """Required keys that an object lacks, sorted; all of them if the text is no JSON object."""
    keys = F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text))
    return F.sort_array(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.expr("cast(array() as array<string>)"))))


def merge_metadata(first: Column, second: Column) -> Column:
    """Union of two maps, the second one's values last; null if both are empty."""
    a, b = F.coalesce(first, F.expr("cast(map() as map<string,string>)")), F.coalesce(second, F.expr("cast(map() as map<string,string>)"))
    merged = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.when(F.size(merged) > 0, merged)


def conflicting_keys(first: Column, second: Column) -> Column:
    """Keys of both maps with different values, sorted."""
    both = F.array_intersect(F.coalesce(F.map_keys(first), F.expr("cast(array() as array<string>)")),
        F.coalesce(F.map_keys(second), F.expr("cast(array() as array<string>)")))
    return F.sort_array(F.filter(both, lambda k: ~F.try_element_at(first, k).eqNullSafe(F.try_element_at(second, k))))


def canonical_source_type(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """``social_media`` becomes ``social_media_post``; other values must be canonical, else null. ``aliases`` adds more."""
    names = {"social_media": "social_media_post"} | (aliases or {})
    out = value
    for name, canonical in names.items():
        out = F.when(value == name, canonical).otherwise(out)
    return F.when(out.isin(*SOURCE_TYPES), out)


def errors_of(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in their order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def release_documents(releases: DataFrame) -> DataFrame:
    """Documents of release rows with metadata_json and content_json."""
    content, meta = parse_object(F.col("content_json"), CONTENT_JSON), json_map(F.col("metadata_json"))
    used = [c for c in ("id", "document_id", "url", "title", "published_at", "language", "organization") if c in releases.columns]
    rows = computed_once(releases.select(*used, content.alias("_c"), meta.alias("_m")))
    own = F.from_json(F.col("_c.metadata"), "map<string,string>")
    m = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    sections = F.col("_c.sections")
    out = rows.select(
        "id", "document_id", first_filled(F.col("_c.source_type"), m("source_type")).alias("source_type"),
        F.array_join(F.transform(sections, lambda s: s["content"]), SECTION_SEPARATOR).alias("content"),
        first_filled(F.col("url"), F.col("_c.url"), m("url")).alias("url"), F.coalesce(blank_to_null(F.col("title")), F.col("_c.title")).alias("title"),
        blank_to_null(F.col("organization")).alias("publisher"), m("author").alias("author"),
            F.coalesce(F.nullif("published_at", F.lit("")), m("published_at")).alias("published_at"),
        first_filled(m("retrieved_at"), F.try_element_at(own, F.lit("retrieved_at"))).alias("retrieved_at"),
        first_filled(F.col("language"), F.col("_c.language"), m("language")).alias("language"),
            first_filled(m("content_hash"), F.try_element_at(own, F.lit("content_hash"))).alias("content_hash"),
        F.to_json(merge_metadata(own, F.col("_m"))).alias("metadata_json"), sections.alias("sections"),
        F.col("_c").isNull().alias("_no_content"), F.col("_m").isNull().alias("_no_meta"), F.size(conflicting_keys(own, F.col("_m"))).alias("_conflicts"),
    )
    checks = {
        "content_json": F.col("_no_content"), "metadata_json": F.col("_no_meta"), "metadata_conflict": F.col("_conflicts") > 0,
        "sections": ~F.col("_no_content") & F.coalesce(F.size("sections") <= 0, F.lit(True)),
        "section_content": F.exists("sections", lambda s: is_blank(s["content"]) | is_blank(s["section_id"])), "publisher": F.col("publisher").isNull(),
    } | document_checks()
    return out.withColumn("errors", errors_of(checks)).drop("_no_content", "_no_meta", "_conflicts")


def live_documents(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Documents of nested records of web and social pages; ``content`` is the clean text, there are no sections."""
    s, m = F.col("source"), F.col("metadata")
    extra = F.to_json(F.struct(s["platform"].alias("platform"), s["author_handle"].alias("author_handle"),
        F.col("entities.hashtags").alias("hashtags"), F.col("entities.mentions").alias("mentions"), F.col("entities.urls").alias("urls"),
        m["authority_level"].alias("authority_level"), m["document_type"].alias("document_type")))
    out = records.select(
        "record_no", F.col("doc_id").alias("document_id"), canonical_source_type(s["source_type"], aliases).alias("source_type"),
            s["source_type"].alias("given_source_type"),
        F.col("content.clean_text").alias("content"), s["source_url"].alias("url"), F.col("title"), s["organization"].alias("publisher"),
            s["author_name"].alias("author"),
        F.col("dates.published_at").alias("published_at"), F.col("dates.retrieved_at").alias("retrieved_at"), m["language"].alias("language"),
            m["content_hash"].alias("content_hash"), extra.alias("metadata_json"),
    )
    return out.withColumn("errors", errors_of(document_checks()))


def social_records(posts: DataFrame) -> DataFrame:
    """Nested records of raw posts: id, text, url, lang, created_at, author_handle, author_name, hashtags, mentions (arrays of names) and urls."""
    clean = clean_social(F.col("text"))
    staged = computed_once(posts.withColumn("_clean", clean))
    return staged.select(
        F.concat(F.lit("X_"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("X post by @"), "author_handle").alias("title"),
        F.struct(F.lit("X").alias("platform"), F.lit("social_media_post").alias("source_type"), F.col("url").alias("source_url"),
            F.col("author_name").alias("organization"), "author_handle", "author_name").alias("source"),
        F.struct(iso_utc(social_instant(F.col("created_at"))).alias("published_at")).alias("dates"),
            F.struct(F.col("text").alias("raw_text"), F.col("_clean").alias("clean_text")).alias("content"),
        F.struct(entity_names(F.col("hashtags")).alias("hashtags"), entity_names(F.col("mentions")).alias("mentions"),
            links_of(F.col("urls"), F.col("text")).alias("urls")).alias("entities"),
        F.struct(F.col("lang").alias("language"), content_hash(F.col("_clean")).alias("content_hash"),
            F.lit("social_media_post").alias("document_type")).alias("metadata"),
    )


def release_rows(documents: DataFrame) -> DataFrame:
    """Rows of the releases table of page documents: their facts as ``metadata_json``, and all that isn't metadata as ``content_json``."""
    facts = ("source_type", "url", "organization", "published_at", "language", "release_id", "has_tables")
    told = documents.withColumn("published_at", iso_utc(F.col("published_at")))
    return told.select(
        *[c for c in documents.columns if c not in ("sections", "has_tables", "source_type")],
        F.to_json(F.struct(*facts)).alias("metadata_json"), F.to_json(F.struct("document_id", "title", "source_type", "url", "sections")).alias("content_json"),
    )


def document_checks() -> dict[str, Column]:
    return {
        "document_id": is_blank(F.col("document_id")), "source_type": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
            "content": is_blank(F.col("content")),
        "url": ~is_http_url(F.col("url")), "retrieved_at": is_blank(F.col("retrieved_at")),
            "language": ~F.coalesce(F.col("language").rlike(LANGUAGE_TAG), F.lit(False)),
    }


def chunk_checks() -> dict[str, Column]:
    return {
        "chunk_id": is_blank(F.col("chunk_id")), "content": is_blank(F.col("content")), "chunk_index": F.col("chunk_index") < 0,
            "char_start": F.col("char_start") < 0,
        "char_order": F.col("char_end") < F.col("char_start"), "section_id": F.col("section_id").isNotNull() & is_blank(F.col("section_id")),
    }


def score_is_finite(score: Column) -> Column:
    return F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def require_valid(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without ``errors``; the query fails at the first row that has any."""
    said = F.concat(F.lit("invalid row "), F.col(key).cast("string"), F.lit(": "), F.array_join("errors", ", "))
    return rows.where(F.when(F.size("errors") > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("errors")


def check_columns(rows: DataFrame, required: list[str]) -> DataFrame:
    """``rows``, if it has the required columns."""
    lacking = sorted(set(required) - set(rows.columns))
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return rows
