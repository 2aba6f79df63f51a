"""Queries on measures and texts of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions import dates, ids, text, urls
from granthika.operators import analytics, chunking, html, sections
from granthika.operators.dedup import first_texts
from granthika.operators.documents import SECTION_SEPARATOR, parse_object
from granthika.plans import sqltext as q
from granthika.schemas import CONTENT_JSON
from granthika.session import computed_once, materialise, spread, table

POINT_NAMESPACE = __import__("uuid").uuid5(__import__("uuid").NAMESPACE_DNS, "granthika")
WHITELIST = ["pib.example", "example", "oshudratimes.example"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.measured(_documents(spark, sf_dir).select("doc_id", "text"))


def corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    stacked = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("character_count",
        "word_count")])).alias("x")).select("x.*")
    d = analytics.distribution(stacked, "v", "measure")
    return d.select("measure", "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("minimum", "median", "p90", "p95", "p99", "maximum")],
        F.round("average", 4).alias("average"))


def word_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.over_thresholds(_measured(spark, sf_dir), "word_count").withColumn("percent", F.round("percent", 4))


def top_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.largest(_measured(spark, sf_dir), "character_count", "doc_id").select("doc_id", "character_count", "word_count")


def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).where(F.col("word_count") < analytics.SHORT_WORDS).select("doc_id", "word_count")


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.exact_duplicates(_documents(spark, sf_dir), "doc_id").select("doc_id", "class_id", "n_copies", "text_hash")


def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every document, and whether one of them occurs twice; of the documents' lines as well, which do repeat."""
    parts = lambda sep: F.filter(F.split("text", sep, -1), lambda x: x != "")
    repeated = analytics.has_repeated_paragraphs(F.col("text"))
    lines = analytics.has_repeated_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    found = _documents(spark, sf_dir).where("text is not null")
    return found.select("doc_id", F.size(parts("\n\n")).cast("long").alias("n_paragraphs"), repeated.alias("repeated"), lines.alias("lines_repeated"))


def table_like_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(analytics.has_table_like_text(F.col("text"))).select("doc_id")


def replacement_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _documents(spark, sf_dir).select(F.lit("documents.text").alias("field"), F.col("text").alias("t"))
    titles = table(spark, sf_dir, "pib_releases").select(F.lit("pib_releases.title").alias("field"), F.col("title").alias("t"))
    n = analytics.replacement_characters(F.col("t"))
    return texts.unionByName(titles).groupBy("field").agg(F.sum(n).cast("long").alias("n_characters"), F.count_if(n > 0).alias("n_rows"))


def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "pib_releases").select("id", parse_object(F.col("content_json"), CONTENT_JSON)["sections"].alias("s")).where("s is not null")
    empty = F.size(F.filter("s", lambda x: text.is_blank(x["content"])))
    return parsed.select("id", F.size("s").cast("long").alias("n_sections"), empty.cast("long").alias("n_empty"))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.report(_documents(spark, sf_dir), "doc_id").withColumn("value", F.round("value", 4))


def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("label"),
        text.script_language(F.col("text")).alias("detected"))
    return found.groupBy("label", "detected").agg(F.count("*").alias("n"))


def clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_block(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(cleaned, "UTF-8")).alias("clean_md5"), F.length(cleaned).cast("long").alias("n_chars"))


def clean_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_web(F.col("content.raw_text"))
    return table(spark, sf_dir, "webscraper_output").select("record_no", F.md5(F.encode(cleaned, "UTF-8")).alias("clean_md5"),
        F.length(cleaned).cast("long").alias("n_chars"))


def clean_social_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "webscraper_output").where(F.col("source.platform") == "X")
    return posts.select("record_no", text.clean_social(F.col("content.raw_text")).alias("clean_text"))


def clean_scanned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_scanned(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(cleaned, "UTF-8")).alias("clean_md5"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("content.raw_text")
    joined = lambda c: F.array_join(c, " ")
    return table(spark, sf_dir, "webscraper_output").where(raw.isNotNull()).select("record_no", joined(text.hashtags(raw)).alias("hashtags"),
        joined(text.mentions(raw)).alias("mentions"), joined(text.urls(raw)).alias("urls"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("source.source_url")
    return table(spark, sf_dir, "webscraper_output").groupBy(urls.host(u).alias("host")).agg(F.count("*").alias("n"),
        F.count_if(urls.on_whitelist(u, WHITELIST)).alias("n_on_list"))


def release_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pib_releases").select("id", urls.release_number(u).alias("release_number"),
        urls.canonical_release_url(u, "https://pib.example/PressReleasePage.aspx?PRID=").alias("canonical_url"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "webscraper_output")
    return web.select("record_no", text.content_hash(F.col("content.clean_text")).alias("content_hash"), ids.web_id(F.col("source.source_url")).alias("web_id"))


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit(":0"))
    return _documents(spark, sf_dir).select("doc_id", ids.uuid5(POINT_NAMESPACE, chunk_id).alias("point_id"))


def important_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "webscraper_output").where("content.raw_text is not null")
    return web.select("record_no", text.important_text(F.col("content.raw_text"), "solar pumps").alias("important_text"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    named = table(spark, sf_dir, "pib_releases").select(F.explode(parse_object(F.col("content_json"), CONTENT_JSON)["sections"]["heading"]).alias("line"))
    lines = own.unionByName(named).where(text.is_heading(F.col("line")))
    return lines.groupBy(text.heading_name(F.col("line")).alias("heading")).agg(F.count("*").alias("n"))


def first_occurrence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(~text.is_blank(F.col("line")))
    kept = first_texts(lines, ["doc_id"], F.lower(text.one_spaced(F.col("line"))), ["line_no"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum("line_no").cast("long").alias("sum_line_no"))


def _span_rows(spark: SparkSession, sf_dir: str, spans) -> DataFrame:
    found = spread(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode(spans(F.col("text"))).alias("span_no", "s"))
    return found.select("doc_id", F.col("span_no").cast("long").alias("span_no"),
        *[F.col(f"s.{c}").cast("long").alias(n) for c, n in (("start", "char_start"), ("end", "char_end"), ("n", "n_words"))])


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(spark, sf_dir, chunking.paragraph_spans)


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(spark, sf_dir, chunking.sentence_spans)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")))
    return chunking.chunk(d).select("document_id", "chunk_id", "chunk_index", "char_start", "char_end", "n_tokens",
        ids.uuid5(POINT_NAMESPACE, F.col("chunk_id")).alias("point_id"), F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def _release_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, content and sections of the releases with text, and their metadata."""
    meta = [c for c in ("title", "organization", "url", "published_at", "language")]
    r = spread(table(spark, sf_dir, "pib_releases").select("id", "content_json", *meta))
    parsed = r.select(F.col("id").alias("document_id"), *meta,
        F.filter(parse_object(F.col("content_json"), CONTENT_JSON)["sections"],
        lambda s: ~text.is_blank(s["content"])).alias("sections")).where(F.size("sections") > 0)
    return computed_once(computed_once(parsed).withColumn("content", F.array_join(F.transform("sections", lambda s: s["content"]), SECTION_SEPARATOR)))


def release_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _release_texts(spark, sf_dir).select("document_id", "content", "sections")
    return chunking.chunk(d, chunking.ChunkingConfig(120, 160, 20)).select("document_id", "chunk_id", "chunk_index", "char_start", "char_end",
        "n_tokens", "section_id", "section_heading")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written out of the releases' sections, with chrome around the article, and what an index says of each."""
    plain = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}

    def element(tag: str, *inner: Column) -> Column:
        told = F.concat(*inner)
        for mark, entity in plain.items():
            told = F.replace(told, F.lit(mark), F.lit(entity))
        return F.coalesce(F.concat(F.lit(f"<{tag}>"), told, F.lit(f"</{tag}>")), F.lit(""))

    body = F.transform("s", lambda x: F.concat(element("h2", x["heading"]), F.replace(element("p", x["content"]), F.lit("\n\n"), F.lit("</p><p>"))))
    head = (element("p", F.col("organization")), element("h1", F.col("title")),
        element("p", F.lit("Posted On: "), F.coalesce("published_at", F.lit("-")), F.lit(" by PIB")), element("p", F.lit("Release ID: "), F.col("release_id")))
    page = F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav><div class='content'>"), *head, F.array_join(body, ""),
        F.lit("</div><footer>All rights reserved</footer></body></html>"))
    own = ("id", "document_id", "release_id", "title", "url", "organization", "published_at")
    parsed = spread(table(spark, sf_dir, "pib_releases").select(*own, "content_json")).select(*own, parse_object(F.col("content_json"), CONTENT_JSON)["sections"].alias("s"))
    rows = computed_once(parsed.where("s is not null and document_id is not null"))
    latest = rows.groupBy("document_id").agg(F.max("id").alias("id")).select("id")
    return rows.join(latest, "id", "left_semi").select(F.col("document_id").alias("page_id"), "release_id", "title", "url", "published_at", page.alias("html"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content blocks of each page: how many, and a hash of them in their order."""
    blocks = html.parse_blocks(_pages(spark, sf_dir), "page_id")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n--\n")
    return blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.md5(F.encode(texts, "UTF-8")).alias("blocks_md5"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = materialise(html.parse_blocks(_pages(spark, sf_dir), "page_id"), "blocks")
    found = sections.infer_sections(blocks, "page_id").join(sections.has_tables(blocks, "page_id"), "page_id")
    return found.select("page_id", "section_no", "has_tables", "section_id", "heading", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a page, by what the page says and else the index."""
    d = html.page_documents(_pages(spark, sf_dir), "page_id")
    return d.select("page_id", "document_id", "release_id", "title", "url", dates.iso_utc(F.col("published_at")).alias("published_at"),
        "organization", "language", "has_tables", F.size("sections").alias("n_sections"))


QUERIES = {f.__name__: f for f in (
    corpus_distribution, word_thresholds, top_largest, short_documents, exact_duplicate_groups, repeated_paragraphs, table_like_text,
        replacement_characters, empty_sections,
    corpus_report, script_language, clean_blocks, clean_web_text, clean_social_text, clean_scanned_text, entity_extract, url_hosts, release_urls,
        content_hashes, point_ids,
    important_text, heading_lines, first_occurrence_lines, paragraph_spans, sentence_spans, document_chunks, release_chunks, html_blocks,
        html_sections, page_documents,
)}

_M = f"(SELECT doc_id, length(coalesce(text,'')) AS character_count, {q.words("coalesce(text,'')")} AS word_count FROM documents)"
_DIST = "count(*) AS n, min(v)::DOUBLE AS minimum, round(quantile_cont(v, 0.5)::DOUBLE, 4) AS median, round(quantile_cont(v, 0.9)::DOUBLE, 4) AS p90, round(quantile_cont(v, 0.95)::DOUBLE, 4) AS p95, round(quantile_cont(v, 0.99)::DOUBLE, 4) AS p99, max(v)::DOUBLE AS maximum, round(avg(v), 4) AS average"
_KNOWN = "|".join(text.HEADINGS)
_CB = q.clean_block("line")
_HEAD = rf"""(regexp_matches(lower(c), '^(?:{_KNOWN})$') OR regexp_matches(lower(c), '^about .*') OR regexp_matches(c, '^(?:\d+[.)]|[IVXLCDM]+[.)])\s+.{{2,100}}$') OR (length(c) <= 100 AND c LIKE '%:'))"""
_DUP = "(SELECT doc_id, sha256(text) AS text_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents WHERE text IS NOT NULL)"
_REPEATED = "len(list_filter(string_split(coalesce(text,''), chr(10)||chr(10)), lambda x: x <> '')) <> len(list_distinct(list_filter(string_split(coalesce(text,''), chr(10)||chr(10)), lambda x: x <> '')))"
_TABLE = "(contains(coalesce(text,''), chr(9)) OR contains(coalesce(text,''), '|') OR contains(lower(coalesce(text,'')), 'table '))"
_NS = POINT_NAMESPACE.hex
_MEASURES = {"n_documents": "count(*)", "n_repeated_paragraphs": f"count(*) FILTER ({_REPEATED})", "n_table_like": f"count(*) FILTER ({_TABLE})",
    "n_replacement_characters": "sum(length(coalesce(text,'')) - length(replace(coalesce(text,''), chr(65533), '')))",
    "n_short": "count(*) FILTER (word_count < 50)"}
for _c in ("character_count", "word_count"):
    _MEASURES |= {f"{_c}_min": f"min({_c})", f"{_c}_mean": f"avg({_c})",
        f"{_c}_max": f"max({_c})"} | {f"{_c}_p{round(p * 100)}": f"quantile_cont({_c}, {p})" for p in (0.5, 0.9, 0.95, 0.99)}
_MEASURES |= {f"words_over_{t}": f"count(*) FILTER (word_count > {t})" for t in analytics.WORD_THRESHOLDS}

_ordered = lambda x: f"array_to_string(list_filter({x}, lambda v, i: list_position({x}, v) = i), ' ')"
_PAGE = """SELECT document_id, list_concat([organization, title, 'Posted On: ' || coalesce(published_at, '-') || ' by PIB', 'Release ID: ' || release_id],
    flatten(list_transform(json_transform(content_json, '{"sections":[{"heading":"VARCHAR","content":"VARCHAR"}]}').sections, lambda x:
    CASE WHEN x.content IS NULL THEN [] ELSE list_concat([x.heading], string_split(x.content, chr(10) || chr(10))) END))) AS texts
    FROM pib_releases WHERE json_valid(content_json) AND document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id DESC) = 1"""
_LOW = f"lower({q.one_spaced('t')})"

# The given posts hold no HTML entities, so this leaves them out.
_POST = r"""regexp_replace(regexp_replace(replace(replace(replace(t, '\r\n', chr(10)), '\n', chr(10)), '\t', ' '), '\r\n?', chr(10), 'g'), '\t', ' ', 'g')"""
_POST = rf"regexp_replace(regexp_replace(regexp_replace({_POST}, '([?!])([A-Za-z0-9])', '\1 \2', 'g'), '[ \f\x0B]+', ' ', 'g'), '[\t\f\v\r \p{{Z}}]*\n[\t\f\v\r \p{{Z}}]*', chr(10), 'g')"
_POST = q.strip(rf"regexp_replace({_POST}, '\n{{3,}}', chr(10) || chr(10), 'g')")

ORACLE = {
    "clean_social_text": f"SELECT record_no, {_POST} AS clean_text FROM (SELECT record_no, w.content.raw_text AS t FROM webscraper_output w WHERE w.source.platform = 'X')",
    "html_blocks": rf"""WITH p AS ({_PAGE}), b AS (SELECT document_id, {q.clean_block('x')} AS t, i
        FROM (SELECT document_id, unnest(texts) AS x, generate_subscripts(texts, 1) AS i FROM p)),
        k AS (SELECT * FROM b WHERE t <> '' AND NOT regexp_matches({_LOW}, '^release\s+id\s*:\s*\d+$|^posted\s+on\s*:\s*.+\s+by\s+pib$')
        AND {_LOW} NOT IN ('government of india', 'press information bureau', 'press information bureau government of india')
        QUALIFY row_number() OVER (PARTITION BY document_id, {_LOW} ORDER BY i) = 1)
        SELECT document_id AS page_id, count(*) AS n_blocks, md5(string_agg(t, chr(10) || '--' || chr(10) ORDER BY i)) AS blocks_md5 FROM k GROUP BY document_id""",
    "corpus_distribution": f"SELECT measure, {_DIST} FROM (SELECT 'character_count' AS measure, character_count AS v FROM {_M} UNION ALL SELECT 'word_count', word_count FROM {_M}) GROUP BY measure",
    "word_thresholds": f"SELECT t::INTEGER AS threshold, count(*) FILTER (word_count > t) AS n_over, round(100.0 * count(*) FILTER (word_count > t) / count(*), 4) AS percent FROM {_M}, (SELECT unnest([500, 750, 1000, 1500, 2000]) AS t) GROUP BY t",
    "top_largest": f"SELECT doc_id, character_count, word_count FROM {_M} ORDER BY character_count DESC, doc_id LIMIT 10",
    "short_documents": f"SELECT doc_id, word_count FROM {_M} WHERE word_count < 50",
    "exact_duplicate_groups": f"SELECT doc_id, class_id, n_copies, text_hash FROM {_DUP} WHERE n_copies > 1",
    "repeated_paragraphs": f"""SELECT doc_id, len(list_filter(string_split(text, chr(10)||chr(10)), lambda x: x <> ''))::BIGINT AS n_paragraphs, {_REPEATED} AS repeated,
        {_REPEATED.replace("chr(10)||chr(10)", "chr(10)")} AS lines_repeated FROM documents WHERE text IS NOT NULL""",
    "table_like_text": f"SELECT doc_id FROM documents WHERE {_TABLE}",
    "replacement_characters": """SELECT field, sum(length(t) - length(replace(t, chr(65533), '')))::BIGINT AS n_characters, count(*) FILTER (contains(t, chr(65533))) AS n_rows
        FROM (SELECT 'documents.text' AS field, coalesce(text,'') AS t FROM documents UNION ALL SELECT 'pib_releases.title', coalesce(title,'')
        FROM pib_releases) GROUP BY field""",
    "empty_sections": rf"""SELECT id, len(c)::BIGINT AS n_sections, len(list_filter(c, lambda x: NOT coalesce(regexp_matches(x, '[^\s\p{{Z}}\x{{85}}]'), false)))::BIGINT AS n_empty
        FROM (SELECT id, json_extract_string(content_json, '$.sections[*].content') AS c FROM pib_releases WHERE json_valid(content_json))""",
    "corpus_report": f"""WITH m AS (SELECT d.text, x.* FROM documents d
        JOIN {_M} x USING (doc_id)), a AS (SELECT {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _MEASURES.items())} FROM m)
        SELECT measure, round(value, 4) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE value)
        UNION ALL SELECT 'n_duplicate_groups', count(DISTINCT class_id)::DOUBLE FROM {_DUP} WHERE n_copies > 1 UNION ALL
        SELECT 'n_documents_in_groups', count(*)::DOUBLE FROM {_DUP} WHERE n_copies > 1""",
    "script_language": r"""SELECT label, CASE WHEN d > 0 AND d > 0.25 * l THEN 'hi' ELSE 'en' END AS detected, count(*) AS n
        FROM (SELECT coalesce(lang, 'none') AS label,
        len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents
        WHERE text IS NOT NULL) GROUP BY ALL""",
    "clean_blocks": f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS n_chars FROM (SELECT doc_id, {q.clean_block('text')} AS c FROM documents)",
    "clean_web_text": f"SELECT record_no, md5(c) AS clean_md5, length(c) AS n_chars FROM (SELECT record_no, {q.one_spaced("regexp_replace(w.content.raw_text, '<[^>]+>', ' ', 'g')")} AS c FROM webscraper_output w)",
    "clean_scanned_text": rf"""SELECT doc_id, md5({q.strip(r"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '(?m)[\t\r\f\v ]+$', '', 'g'), '\n{3,}', chr(10)||chr(10), 'g')")}) AS clean_md5 FROM documents""",
    "entity_extract": rf"""SELECT record_no, {_ordered(r"regexp_extract_all(t, '(^|[^\p{L}\p{N}_])#([\p{L}\p{N}_-]+)', 2)")} AS hashtags,
        {_ordered(r"regexp_extract_all(t, '(^|[^\p{L}\p{N}_])@([\p{L}\p{N}_-]+)', 2)")} AS mentions,
        {_ordered(r"""regexp_extract_all(t, 'https?://[^\s<>\]\["'']+')""")} AS urls FROM (SELECT record_no, w.content.raw_text AS t FROM webscraper_output w) WHERE t IS NOT NULL""",
    "url_hosts": f"SELECT host, count(*) AS n, count(*) FILTER (host IN ('pib.example', 'example', 'oshudratimes.example') OR host LIKE '%.pib.example' OR host LIKE '%.example') AS n_on_list FROM (SELECT {q.host('w.source.source_url')} AS host FROM webscraper_output w) GROUP BY host",
    "release_urls": r"""SELECT id, nullif(regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1), '') AS release_number,
        CASE WHEN nullif(regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1), '') IS NULL THEN url ELSE 'https://pib.example/PressReleasePage.aspx?PRID='
        || regexp_extract(url, '(?i)PRID\s*=\s*(\d+)', 1) END AS canonical_url FROM pib_releases""",
    "content_hashes": f"SELECT record_no, sha256(lower({q.one_spaced('w.content.clean_text')})) AS content_hash, 'WEB_' || substr(sha256(w.source.source_url), 1, 16) AS web_id FROM webscraper_output w",
    "point_ids": f"""SELECT doc_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-'
        || substr('89ab', ((position(substr(h,17,1) IN '0123456789abcdef') - 1) % 4 + 1)::INTEGER, 1) || substr(h,18,3) || '-'
        || substr(h,21,12) AS point_id
        FROM (SELECT doc_id, sha1(unhex('{_NS}') || encode(doc_id || ':0')) AS h FROM documents)""",
    "heading_lines": rf"""SELECT {q.strip(r"regexp_replace(regexp_replace(c, '(?i)^[\dIVXLCDM]+[.)]\s+', ''), ':+$', '')")} AS heading, count(*) AS n
        FROM (SELECT {_CB} AS c FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL
        SELECT unnest(json_extract_string(content_json, '$.sections[*].heading')) FROM pib_releases WHERE json_valid(content_json))) WHERE {_HEAD}
        GROUP BY 1""",
    "first_occurrence_lines": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
        f AS (SELECT doc_id, min(line_no) AS line_no FROM l WHERE regexp_matches(line, '[^\s\p{{Z}}\x{{85}}]') GROUP BY doc_id, lower({q.one_spaced('line')}))
        SELECT doc_id, count(*) AS n_kept, sum(line_no)::BIGINT AS sum_line_no FROM f GROUP BY doc_id""",
    "paragraph_spans": q.spans(rf"(\n{q.SPACE}*\n)", r"\1"),
    "sentence_spans": q.spans(rf"([.!?])({q.SPACE})", r"\2", r"\1"),
}
