"""Queries on records: adapters, validation, dates, duplicates, table changes, crawl progress, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions import dates
from granthika.functions.text import blank_to_null
from granthika.functions.urls import release_number
from granthika.operators import analytics, chunking, dedup, html, store
from granthika.operators import documents as adapters
from granthika.plans import sqltext as q
from granthika.plans.corpus_queries import _documents, _pages
from granthika.session import scratch_path, table
from granthika.sources.readers import last_records
from granthika.streaming import ingest

META_KEYS = ["author", "authority_level", "document_type", "language", "release_id", "retrieved_at", "source_type", "topic_tags", "url"]


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pib_releases")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webscraper_output")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_date_progress")


def release_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.release_documents(_releases(spark, sf_dir)).where(~F.array_contains("errors", "content_json") & ~F.array_contains("errors", "sections"))
    return d.select("id", "document_id", "source_type", "url", "title", "publisher", "published_at", "retrieved_at", "language",
        F.size("sections").cast("long").alias("n_sections"), F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def release_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.release_documents(_releases(spark, sf_dir))
    return d.select("id", F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def valid_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = adapters.split_valid(adapters.release_documents(_releases(spark, sf_dir)))
    return valid.orderBy("document_id").select("id", "document_id", "url", "language")


def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.live_documents(_web(spark, sf_dir))
    return d.select("record_no", "document_id", "source_type", "url", "publisher", "author", "language", "retrieved_at",
        F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.array_join("errors", ",").alias("errors"),
                    *[F.get_json_object("metadata_json", f"$.{k}").alias(f"meta_{k}") for k in ("platform", "author_handle", "hashtags", "authority_level")])


def social_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the social platform, taken apart and put together again."""
    w = _web(spark, sf_dir).where("source.platform = 'X'")
    posts = w.select(
        F.regexp_replace("doc_id", "^X_", "").alias("id"), F.col("content.raw_text").alias("text"), F.col("source.source_url").alias("url"),
            F.col("metadata.language").alias("lang"), F.trim("dates.published_at").alias("created_at"),
        F.col("source.author_handle").alias("author_handle"), F.col("source.author_name").alias("author_name"),
            F.transform("entities.hashtags", lambda x: F.concat(F.lit("#"), x)).alias("hashtags"), F.col("entities.mentions").alias("mentions"),
            F.col("entities.urls").alias("urls"),
    )
    r = adapters.social_records(posts)
    return r.select("doc_id", "title", F.col("dates.published_at").alias("published_at"), F.array_join("entities.hashtags", " ").alias("hashtags"),
        F.size("entities.urls").cast("long").alias("n_urls"), F.col("metadata.content_hash").alias("content_hash"))


def release_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release numbers out of the links of index pages (50 rows a page); of each number the last link counts."""
    r = _releases(spark, sf_dir).where("url is not null").select("id", "url", F.coalesce("title", F.lit("")).alias("title"))
    link = F.concat(F.lit("<a href='"), F.col("url"), F.lit("'>"),
        F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</a>"))
    pages = r.select(F.floor(F.col("id") / 50).alias("page"),
        F.struct("id", link.alias("a")).alias("x")).groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    found = html.anchors(pages.select("page", F.array_join(F.transform("xs", lambda x: x["a"]), "\n").alias("html")), "page")
    return html.release_links(found, "page", "https://pib.example/PressReleasePage.aspx?PRID=", "pib.example").select("release_number", "url", "title")


def best_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several fetches of a page the best by share of body text and length, the first that is good enough ending the search."""
    size = F.coalesce(F.length("content.clean_text"), F.lit(0))
    w = _web(spark, sf_dir).where("doc_id is not null").select("doc_id", "record_no",
        F.floor(100 * size / F.length("content.raw_text")).alias("confidence"), size.alias("n_chars"))
    return dedup.best_pass(w, ["doc_id"], "record_no", "confidence", "n_chars", enough=60, least=300).select("doc_id", "record_no",
        F.col("n_chars").cast("long").alias("n_chars"))


def missing_metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lacking = adapters.missing_keys(F.col("metadata_json"), META_KEYS)
    return _releases(spark, sf_dir).select("id", F.array_join(lacking, ",").alias("missing"))


def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.create_map(F.lit("organization"), F.col("organization"), F.lit("language"), F.col("language"), F.lit("crawl_id"), F.col("id").cast("string"))
    meta = adapters.json_map(F.col("metadata_json"))
    merged = adapters.merge_metadata(row, meta)
    both = _releases(spark, sf_dir).select("id", F.size(merged).cast("long").alias("n_keys"),
        F.array_join(adapters.conflicting_keys(row, meta), ",").alias("conflicts"))
    return both


def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = dates.with_release_instant(_releases(spark, sf_dir).select("id", "published_at"), "published_at")
    return dated.select("id", dates.iso_utc(F.col("instant")).alias("instant"))


def social_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).where(F.col("dates.published_at").rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} ")).select("record_no",
        dates.iso_utc(dates.social_instant(F.trim("dates.published_at"))).alias("instant"))


def release_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _releases(spark, sf_dir).select("id", "release_id", "document_id")
    return store.insert_or_ignore(r.limit(0), r, ["release_id", "document_id"], "id")


def new_releases_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one source type against a table that holds the others."""
    r = _releases(spark, sf_dir).select("id", "release_id", "document_id", "authority_level", "language")
    known = r.where("language = 'en'")
    return store.insert_or_ignore(known, r.where("language is distinct from 'en'"), ["release_id", "document_id"], "id").select("id", "release_id")


def published_at_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _releases(spark, sf_dir).select("id", "release_id", "published_at", "metadata_json")
    first = dedup.first_by(r.where("release_id is not null"), ["release_id"], ["id"])
    filled = r.where(blank_to_null(F.col("published_at")).isNotNull() & F.col("release_id").isNotNull())
    repaired = store.fill_missing(first, dedup.last_by(filled, ["release_id"], ["id"]).select("release_id", "published_at"), "release_id", "published_at")
    meta = F.when(F.col("repaired"), store.with_metadata_value(F.col("metadata_json"), "published_at", F.col("published_at"))).otherwise(F.col("metadata_json"))
    return repaired.select("id", "release_id", "published_at", "repaired", F.get_json_object(meta, "$.published_at").alias("meta_published_at"),
        F.get_json_object(meta, "$.authority_level").alias("meta_authority"))


def last_fetch_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _web(spark, sf_dir).where("doc_id is not null").select("doc_id", "record_no", F.col("metadata.content_hash").alias("content_hash"))
    return dedup.last_by(w, ["doc_id"], ["record_no"])


def first_url_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _web(spark, sf_dir).where(F.coalesce(F.col("content.clean_text") != "", F.lit(False)) & F.col("source.source_url").isNotNull())
    return dedup.first_by(w.select(F.col("source.source_url").alias("url"), "record_no", "doc_id"), ["url"], ["record_no"])


def crawl_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _progress(spark, sf_dir).select("crawl_date", "status", "started_at", "completed_at", F.substring("error", 1, 2000).alias("error"))
    return store.latest_state(p, "crawl_date", "started_at")


def retried_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's log after a retry of all days that weren't completed: each finds the releases dated with that day, or none."""
    p = _progress(spark, sf_dir)
    begun = store.started_days(p, F.lit("2027-01-01T00:00:00Z"))
    dated = _releases(spark, sf_dir).where(F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}")).groupBy(F.substring("published_at", 1,
        10).alias("day")).agg(F.count("*").alias("found"), F.countDistinct("release_id").alias("added"))
    outcomes = begun.select("crawl_date", F.date_format(F.to_date("crawl_date", "dd-MM-yyyy"), "yyyy-MM-dd").alias("day")).join(dated, "day",
        "left").withColumn("error", F.lit(None).cast("string"))
    ended = store.ended_days(begun, outcomes, F.lit("2027-01-01T01:00:00Z")).select(*p.columns)
    return store.latest_state(p.unionByName(ended), "crawl_date", "started_at").select("crawl_date", "status", "started_at", "documents_found", "documents_added")


def existing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chunks of every document that a hundred divides."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    chunks = chunking.chunk(d, chunking.ChunkingConfig(60, 80, 0))
    return store.chunks_of(chunks, d.where("document_id % 100 = 0"), 3).select("document_id", "chunk_id", "char_start")


def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each kind of event, as a share of ten between 0 and 1."""
    return analytics.mean_confidence(table(spark, sf_dir, "events"), "value", "event_type").withColumn("mean_confidence", F.round("mean_confidence", 6))


def saved_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows of the releases table, which keeps the first of each release and document."""
    rows = adapters.release_rows(html.page_documents(_pages(spark, sf_dir), "page_id"))
    kept = store.insert_or_ignore(rows.limit(0), rows, ["release_id", "document_id"], "page_id")
    return kept.select("release_id", "document_id", F.array_join(F.array_sort(F.json_object_keys("content_json")), ",").alias("content_keys"),
        F.get_json_object("metadata_json", "$.organization").alias("organization"))


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_days(_progress(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "status")


def resume_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resume_day(_progress(spark, sf_dir)).select(F.col("resume_day").cast("string").alias("resume_day"))


def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_days"), F.sum("documents_found").alias("n_found"),
        F.sum("documents_added").alias("n_added"), F.count("error").alias("n_errors"))


def annotator_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = analytics.mean_of_valid(table(spark, sf_dir, "doc_labels"), "abusive", "annotator_id")
    return m.select("annotator_id", F.round("mean_value", 6).alias("mean_value"), "n_valid")


def last_web_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    publisher = F.coalesce(F.nullif(F.col("source.organization"), F.lit("")), F.col("source.author_name"))
    return last_records(_web(spark, sf_dir).select("record_no", "doc_id", publisher.alias("publisher")), "record_no")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type", "value"), "ts", "event_type", "value")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents; those of one source are replaced by chunks of another size."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "source")
    keep = ("document_id", "chunk_id", "char_start", "char_end", "n_tokens", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))
    target = chunking.chunk(d).select(*keep)
    batch = chunking.chunk(d.where("source = 'pib.example'"), chunking.ChunkingConfig(100, 150, 10)).select(*keep)
    return store.upsert_documents(target, batch, "document_id")


def streamed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release rows that a file stream brings in, in two runs, into a table that keeps the first row of each release."""
    source, at = scratch_path(spark, "incoming"), scratch_path(spark, "streamed")
    r = _releases(spark, sf_dir).select("id", "release_id", "document_id")
    target = store.AppendedTable(spark, f"{at}/table")
    for part in (r.where("language = 'en'"), r.where("language is distinct from 'en'")):
        part.write.mode("append").parquet(source)
        ingest.ingest_new(spark, source, r.schema, target, ["release_id", "document_id"], "id", f"{at}/checkpoint")
    return target.read()


QUERIES = {f.__name__: f for f in (
    retried_days, existing_chunks, mean_confidence, saved_releases, release_documents, release_errors, valid_releases, live_documents, social_records,
        release_links, best_fetches, missing_metadata_keys, merged_metadata, release_dates, social_dates, release_insert_or_ignore, new_releases_only,
    published_at_repair, last_fetch_wins, first_url_wins, crawl_state_latest, missing_days, resume_day, crawl_outcomes, annotator_means,
        last_web_records, event_windows, chunk_upsert, streamed_releases,
)}

_VIS = lambda x: rf"(CASE WHEN regexp_matches({x}, '[^\s\p{{Z}}\x{{85}}]') THEN {x} END)"
_BLANK = lambda x: rf"NOT coalesce(regexp_matches({x}, '[^\s\p{{Z}}\x{{85}}]'), false)"
_TYPES = "('government_document', 'news_article', 'web_page', 'social_media_post', 'report', 'other')"
_TAG = "'^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$'"
_J = lambda c, k: f"json_extract_string({c}, '$.{k}')"
_REL = f"""(SELECT id, document_id, coalesce({_VIS(_J('content_json', 'source_type'))}, {_VIS(_J('m', 'source_type'))}) AS source_type,
    coalesce({_VIS('url')}, {_VIS(_J('content_json', 'url'))}, {_VIS(_J('m', 'url'))}) AS url, coalesce({_VIS('title')}, {_J('content_json', 'title')}) AS title, {_VIS('organization')} AS publisher,
    coalesce(nullif(published_at, ''), {_J('m', 'published_at')}) AS published_at, {_VIS(_J('m', 'retrieved_at'))} AS retrieved_at,
    coalesce({_VIS('language')}, {_VIS(_J('content_json', 'language'))}, {_VIS(_J('m', 'language'))}) AS language, json_extract_string(content_json, '$.sections[*].content') AS c,
    json_extract_string(content_json, '$.sections[*].section_id') AS sid
    FROM (SELECT *, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM pib_releases WHERE json_valid(content_json)))"""
# As _REL, for rows without content too, whose other fields count all the same.
_ALL = _REL.replace("FROM pib_releases WHERE json_valid(content_json))",
    "FROM (SELECT * REPLACE (CASE WHEN json_valid(content_json) THEN content_json END AS content_json) FROM pib_releases))")
_FIRST = lambda src: f"""(SELECT id, release_id, document_id FROM (SELECT *, min(id) OVER (PARTITION BY document_id) AS d FROM (SELECT *, min(id)
    OVER (PARTITION BY release_id) AS r FROM ({src})) WHERE release_id IS NULL OR id = r) WHERE document_id IS NULL OR id = d)"""  # noqa: E731
_FORMATS = ", ".join(
    f"'{f}'" for f in (
        *(f"%d-%m-%Y{t}" for t in (" %H:%M:%S", " %H:%M", " %I:%M:%S %p", " %I:%M %p", "")),
            *(f"%d{s}%m{s}%Y{t}" for s in "/." for t in (" %H:%M:%S", " %H:%M", "")),
        *(f"%d %B %Y{t}" for t in (" %H:%M:%S", " %H:%M", " %I:%M:%S %p", " %I:%M %p", "")), *(f"%d %b %Y{t}" for t in (" %H:%M:%S", " %H:%M", "")),
    )
)
_DAYS = "(SELECT strptime(crawl_date, '%d-%m-%Y')::DATE AS day, status FROM crawl_date_progress)"
_MISSING = f"(SELECT s.day, max(l.status) AS status FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {_DAYS}) s LEFT JOIN {_DAYS} l ON l.day = s.day AND l.status <> 'completed' WHERE s.day NOT IN (SELECT day FROM {_DAYS} WHERE status = 'completed') GROUP BY s.day)"

ORACLE = {
    "mean_confidence": "SELECT event_type, round(least(10, greatest(0, avg(value))) / 10, 6) AS mean_confidence FROM events GROUP BY event_type",
    "retried_days": f"""WITH n AS (SELECT substr(published_at, 1, 10) AS d, count(*) AS f, count(DISTINCT release_id) AS a FROM pib_releases
        WHERE regexp_matches(published_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') GROUP BY 1)
        SELECT strftime(day, '%d-%m-%Y') AS crawl_date, 'completed' AS status, '2027-01-01T00:00:00Z' AS started_at, coalesce(f, 0)::INTEGER AS documents_found, coalesce(a, 0)::INTEGER AS documents_added FROM {_MISSING} LEFT JOIN n ON n.d = day::VARCHAR
        UNION ALL SELECT crawl_date, status, started_at, documents_found, documents_added FROM crawl_date_progress
        WHERE strptime(crawl_date, '%d-%m-%Y')::DATE NOT IN (SELECT day FROM {_MISSING})
        QUALIFY row_number() OVER (PARTITION BY crawl_date ORDER BY started_at DESC NULLS LAST, completed_at DESC NULLS LAST) = 1""",
    "release_errors": f"""WITH r AS (SELECT * FROM {_REL}), e AS (
        SELECT 'publisher' AS error FROM pib_releases WHERE {_BLANK('organization')} UNION ALL SELECT 'document_id' FROM pib_releases WHERE {_BLANK('document_id')}
        UNION ALL SELECT 'content_json' FROM pib_releases WHERE content_json IS NULL OR NOT json_valid(content_json) UNION ALL SELECT 'metadata_json'
        FROM pib_releases WHERE metadata_json IS NULL OR NOT json_valid(metadata_json)
        UNION ALL SELECT 'sections' FROM r WHERE coalesce(len(c), 0) = 0 UNION ALL SELECT 'section_content' FROM r
        WHERE len(list_filter(c, lambda x: {_BLANK('x')})) > 0 OR len(list_filter(sid, lambda x: {_BLANK('x')})) > 0
        UNION ALL SELECT 'content' FROM (SELECT id, {_BLANK("array_to_string(c, chr(10)||chr(10))")} AS b FROM r UNION ALL SELECT id, true
        FROM pib_releases WHERE content_json IS NULL OR NOT json_valid(content_json)) WHERE b
        UNION ALL SELECT 'source_type' FROM {_ALL} WHERE NOT coalesce(source_type IN {_TYPES}, false) UNION ALL SELECT 'url' FROM {_ALL}
        WHERE NOT coalesce(regexp_matches(url, '(?i)^https?://'), false)
        UNION ALL SELECT 'retrieved_at' FROM {_ALL} WHERE {_BLANK('retrieved_at')} UNION ALL SELECT 'language' FROM {_ALL} WHERE NOT coalesce(regexp_matches(language, {_TAG}), false)) SELECT error, count(*) AS n FROM e GROUP BY error""",
    "merged_metadata": f"""WITH r AS (SELECT id, organization, language, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM pib_releases)
        SELECT id, (3 + len(list_filter(coalesce(json_keys(m), []), lambda k: k NOT IN ('organization', 'language', 'crawl_id'))))::BIGINT AS n_keys, array_to_string(list_sort(list_filter(['crawl_id', 'language', 'organization'],
        lambda k: list_contains(json_keys(m), k) AND json_extract_string(m, '$.' || k) IS DISTINCT FROM CASE k WHEN 'language' THEN language WHEN 'organization' THEN organization ELSE id::VARCHAR END)), ',') AS conflicts FROM r""",
    "release_documents": f"SELECT id, document_id, source_type, url, title, publisher, published_at, retrieved_at, language, len(c)::BIGINT AS n_sections, md5(array_to_string(c, chr(10)||chr(10))) AS content_md5 FROM {_REL} WHERE len(c) > 0",
    "valid_releases": f"""SELECT id, document_id, url, language FROM {_REL} WHERE len(c) > 0 AND len(list_filter(c, lambda x: {_BLANK('x')})) = 0
        AND len(list_filter(sid, lambda x: {_BLANK('x')})) = 0 AND publisher IS NOT NULL
        AND NOT ({_BLANK('document_id')}) AND source_type IN {_TYPES} AND regexp_matches(url, '(?i)^https?://') AND retrieved_at IS NOT NULL
        AND regexp_matches(language, {_TAG})""",
    "live_documents": f"""SELECT record_no, doc_id AS document_id,
        CASE WHEN t IN {_TYPES} THEN t END AS source_type, url, publisher, author, language, retrieved_at, md5(content) AS content_md5,
        concat_ws(',', CASE WHEN {_BLANK('doc_id')} THEN 'document_id' END, CASE WHEN NOT coalesce(t IN {_TYPES}, false) THEN 'source_type' END,
        CASE WHEN {_BLANK('content')} THEN 'content' END,
        CASE WHEN NOT coalesce(regexp_matches(url, '(?i)^https?://'), false) THEN 'url' END,
        CASE WHEN {_BLANK('retrieved_at')} THEN 'retrieved_at' END,
        CASE WHEN NOT coalesce(regexp_matches(language, {_TAG}), false) THEN 'language' END) AS errors,
        meta_platform, meta_author_handle, meta_hashtags, meta_authority_level
        FROM (SELECT w.source.platform AS meta_platform, w.source.author_handle AS meta_author_handle, to_json(w.entities.hashtags)::VARCHAR AS meta_hashtags, w.metadata.authority_level AS meta_authority_level, record_no, doc_id, CASE WHEN w.source.source_type = 'social_media' THEN 'social_media_post' ELSE w.source.source_type END AS t, w.source.source_url AS url, w.source.organization AS publisher, w.source.author_name AS author,
        w.metadata.language AS language, w.dates.retrieved_at AS retrieved_at, w.content.clean_text AS content FROM webscraper_output w)""",
    "release_links": r"""SELECT regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1) AS release_number,
        CASE WHEN regexp_matches(url, '^(?i)https?://') THEN url ELSE 'https://pib.example/PressReleasePage.aspx?PRID='
        || regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1) END AS url,
        coalesce(title, '') AS title FROM pib_releases WHERE regexp_matches(url, '(?i)PRID\s*=\s*\d+')
        AND (contains(lower(url), 'pib.example') OR NOT regexp_matches(url, '^(?i)https?://'))
        QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1) ORDER BY id DESC) = 1""",
    "best_fetches": """WITH w AS (SELECT doc_id, record_no, coalesce(length(x.content.clean_text), 0) AS n_chars, floor(100 * coalesce(length(x.content.clean_text), 0) / length(x.content.raw_text)) AS c FROM webscraper_output x WHERE doc_id IS NOT NULL),
        t AS (SELECT *, coalesce(max(coalesce(n_chars >= 300 AND c >= 60, false)::INTEGER)
        OVER (PARTITION BY doc_id ORDER BY record_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM w)
        SELECT doc_id, record_no, n_chars FROM t WHERE stopped = 0 AND n_chars > 0 QUALIFY row_number()
        OVER (PARTITION BY doc_id ORDER BY coalesce(c, 0) + least(n_chars, 500) / 50 DESC, record_no) = 1""",
    "missing_metadata_keys": f"SELECT id, array_to_string(list_sort(list_filter({META_KEYS}, lambda k: NOT list_contains(CASE WHEN json_valid(metadata_json) THEN json_keys(metadata_json) ELSE [] END, k))), ',') AS missing FROM pib_releases",
    "release_dates": rf"""WITH v AS (SELECT id, regexp_replace({q.one_spaced(rf"coalesce(nullif({q.one_spaced(r"regexp_extract(published_at, '(?i)posted\s+on\s*[:-][ \t]*([^\n]*?)\s+by\s+pib\b', 1)")}, ''), published_at)")}, '(?i)(\d)(AM|PM)\b', '\1 \2', 'g') AS v FROM pib_releases),
        p AS (SELECT id, CASE WHEN regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]?[\d:.]*(Z|[+-]\d{{2}}:?\d{{2}})$') THEN try_cast(v AS TIMESTAMPTZ)::TIMESTAMP ELSE
        coalesce(CASE WHEN regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?)?$') THEN try_cast(v AS TIMESTAMP) END, try_strptime(v, [{_FORMATS}]), try_strptime(nullif(regexp_extract(v, '(\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}( \d{{1,2}}:\d{{1,2}}(:\d{{1,2}})?( [AaPp][Mm])?)?)', 1), ''), [{_FORMATS}])) - INTERVAL 330 MINUTE END AS t FROM v)
        SELECT id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS instant FROM p""",
    "social_dates": r"SELECT record_no, strftime(strptime(trim(p, ' ' || chr(10)), '%a %b %d %H:%M:%S %z %Y') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS instant FROM (SELECT record_no, w.dates.published_at AS p FROM webscraper_output w) WHERE regexp_matches(p, '^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} ')",
    "release_insert_or_ignore": f"SELECT id, release_id, document_id FROM {_FIRST('SELECT id, release_id, document_id FROM pib_releases')}",
    "new_releases_only": f"""SELECT id, release_id
        FROM {_FIRST("SELECT id, release_id, document_id FROM pib_releases WHERE language IS DISTINCT FROM 'en' AND release_id NOT IN (SELECT release_id FROM pib_releases WHERE language = 'en' AND release_id IS NOT NULL) AND document_id NOT IN (SELECT document_id FROM pib_releases WHERE language = 'en' AND document_id IS NOT NULL)")}""",
    "published_at_repair": f"""WITH f AS (SELECT id, release_id, published_at, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m
        FROM pib_releases WHERE release_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY id) = 1),
        r AS (SELECT release_id, published_at AS p FROM pib_releases WHERE release_id IS NOT NULL AND {_VIS('published_at')} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY id DESC) = 1)
        SELECT id, f.release_id, CASE WHEN coalesce(published_at, '') = '' THEN coalesce(p, published_at) ELSE published_at END AS published_at, coalesce(published_at, '') = '' AND p IS NOT NULL AS repaired,
        CASE WHEN coalesce(published_at, '') = ''
        AND p IS NOT NULL THEN p ELSE {_J('m', 'published_at')} END AS meta_published_at, {_J('m', 'authority_level')} AS meta_authority FROM f LEFT
        JOIN r ON f.release_id = r.release_id""",
    "last_fetch_wins": "SELECT doc_id, record_no, w.metadata.content_hash AS content_hash FROM webscraper_output w WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY record_no DESC) = 1",
    "first_url_wins": "SELECT w.source.source_url AS url, record_no, doc_id FROM webscraper_output w WHERE w.content.clean_text <> '' AND w.source.source_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY w.source.source_url ORDER BY record_no) = 1",
    "crawl_state_latest": "SELECT crawl_date, status, started_at, completed_at, substr(error, 1, 2000) AS error FROM crawl_date_progress QUALIFY row_number() OVER (PARTITION BY crawl_date ORDER BY started_at DESC NULLS LAST, completed_at DESC NULLS LAST) = 1",
    "missing_days": f"SELECT day::VARCHAR AS day, status FROM {_MISSING}",
    "resume_day": f"SELECT coalesce((SELECT min(day) FROM {_MISSING}), (SELECT max(day) + 1 FROM {_DAYS}))::VARCHAR AS resume_day",
    "crawl_outcomes": "SELECT status, count(*) AS n_days, sum(documents_found)::BIGINT AS n_found, sum(documents_added)::BIGINT AS n_added, count(error) AS n_errors FROM crawl_date_progress GROUP BY status",
    "annotator_means": "SELECT annotator_id, round(avg(abusive) FILTER (abusive <> -1), 6) AS mean_value, count(*) FILTER (abusive <> -1) AS n_valid FROM doc_labels GROUP BY annotator_id",
    "last_web_records": "SELECT record_no, doc_id, coalesce(nullif(w.source.organization, ''), w.source.author_name) AS publisher FROM webscraper_output w ORDER BY record_no DESC LIMIT 5",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "streamed_releases": f"""SELECT id, release_id, document_id
        FROM {_FIRST("SELECT id, release_id, document_id FROM pib_releases WHERE language = 'en'")} UNION ALL SELECT id, release_id, document_id FROM
        {_FIRST("SELECT id, release_id, document_id FROM pib_releases WHERE language IS DISTINCT FROM 'en' AND release_id NOT IN (SELECT release_id FROM pib_releases WHERE language = 'en' AND release_id IS NOT NULL) AND document_id NOT IN (SELECT document_id FROM pib_releases WHERE language = 'en' AND document_id IS NOT NULL)")}""",
}
