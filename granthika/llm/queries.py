"""Queries of the llm operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.urls import host
from granthika.llm import abuse, confusables, language, leakage, packing, releases, sitelines, tokens
from granthika.session import materialise, spread, table


# Problem 1: missing or wrong document language labels

#: Known samples that the network is trained on at most.
MAX_SAMPLES = 5_000


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_no, label and text of both tables; broken JSON gives null text."""
    raw = spread(table(spark, sf_dir, "pib_releases").select("id", "language", "content_json"))
    filed = releases.with_sections(raw).select(
        F.lit("pib_releases").alias("table_name"), F.col("id").alias("row_no"), F.col("language").alias("label"), releases.text_of(F.col("sections")).alias("text")
    )
    pages = spread(table(spark, sf_dir, "webscraper_output").select("record_no", "metadata.language", "content.clean_text")).select(
        F.lit("webscraper_output").alias("table_name"), F.col("record_no").alias("row_no"), F.col("language").alias("label"), F.col("clean_text").alias("text")
    )
    return filed.unionByName(pages)


def _network(spark: SparkSession, sf_dir: str) -> language.BiGru:
    samples = table(spark, sf_dir, "lang_samples").orderBy("sample_id").limit(MAX_SAMPLES).select("sample_text", "language").collect()
    return language.stored_network(spark, [(r.sample_text, r.language) for r in samples])


def _text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.document_languages(language.labelled_sentences(_labelled_texts(spark, sf_dir), _network(spark, sf_dir)))
    return found.withColumn("named", language.named_languages(F.col("label")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = _text_languages(spark, sf_dir).where((F.size("languages") > 0) & (F.col("named") != F.col("languages")))
    return wrong.select("table_name", "row_no", F.explode("languages").alias("lang"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every sentence of every row with its language and confidence."""
    return language.segments(_labelled_texts(spark, sf_dir), _network(spark, sf_dir))


def p1_document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every row, the main one with its pooled probability, and whether the label names them; nulls without text."""
    has = F.size("languages") > 0
    return _text_languages(spark, sf_dir).select(
        "table_name", "row_no", F.array_join("languages", ",").alias("languages"), "main_language", "confidence", F.when(has, F.col("named") == F.col("languages")).alias("label_is_right")
    )


# Problem 3: token budget per source and language


def _budget_releases(rows: DataFrame) -> DataFrame:
    """doc_key, slice and text of releases, one a release."""
    return releases.latest_releases(rows).select(
        F.concat(F.lit("release:"), F.coalesce("release_id", F.col("id").cast("string"))).alias("doc_key"), F.lit("pib_releases").alias("table_name"),
        F.coalesce(host(F.col("url")), F.lower("source")).alias("source"), tokens.language_slice(F.col("language")).alias("language"), tokens.organization_slice(F.col("organization")).alias("organization"), "text",
    )


def _budget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the releases and of the documents."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("doc_key"), F.lit("documents").alias("table_name"),
        F.lower("source").alias("source"), tokens.language_slice(F.col("lang")).alias("language"), tokens.organization_slice(F.col("organization")).alias("organization"), "text",
    )
    return _budget_releases(table(spark, sf_dir, "pib_releases")).unionByName(documents)


def p3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language, organization and their combinations."""
    return tokens.totals(tokens.TokenLedger.fresh(spark).update(_budget_documents(spark, sf_dir)))


def p3_after_new_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals reached in two steps: the first crawls, then deltas to the latest ones by a ledger opened anew."""
    ledger, crawls = tokens.TokenLedger.fresh(spark), table(spark, sf_dir, "pib_releases")
    ledger.update(_budget_releases(crawls.join(crawls.groupBy("release_id").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")))
    return tokens.totals(tokens.TokenLedger(spark, ledger.path).update(_budget_documents(spark, sf_dir)))


def p3_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each slice of the documents table, with and without text."""
    return p3_token_budget(spark, sf_dir).where("table_name = 'documents'").select("level", "source", "language", "organization", "n_documents", "n_with_text")


# Problem 6: filling fixed-capacity containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    items = materialise(tokens.count_tokens(texts, tokens.Tokenizer()), "sizes")
    return packing.pack(items, table(spark, sf_dir, "pack_targets"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document (or piece) for every capacity."""
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(_packed(spark, sf_dir))


# Problem 4: lines repeated across one site's documents


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webscraper_output").select(
        "record_no", "doc_id", sitelines.site(F.col("source.organization"), F.col("source.source_url")).alias("org"), F.col("content.raw_text").alias("raw_text")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.occurrences_of(*sitelines.repeated_lines(_pages(spark, sf_dir)))


def p4_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed lines of each site with their documents."""
    confirmed, _ = sitelines.repeated_lines(_pages(spark, sf_dir))
    return confirmed.select("org", F.col("form").alias("line_form"), "n_docs", "site_docs")


def p4_cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its site's confirmed lines."""
    pages = _pages(spark, sf_dir)
    confirmed, _ = sitelines.repeated_lines(pages)
    return sitelines.without_lines(pages, confirmed).select("record_no", "cleaned_text", "lines_removed")


# Problem 5: visually identical text with different characters


def _visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "pib_releases").select(F.lit("pib_releases").alias("table_name"), F.col("id").alias("row_no"), F.col("title").alias("text"))
    bodies = spread(table(spark, sf_dir, "webscraper_output").select("record_no", "content.clean_text")).select(F.lit("webscraper_output").alias("table_name"), F.col("record_no").alias("row_no"), F.col("clean_text").alias("text"))
    return titles.unionByName(bodies)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_alike_pairs(_visible_texts(spark, sf_dir))


def p5_canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical member of every row that has look-alikes."""
    return confusables.look_alike_members(_visible_texts(spark, sf_dir)).drop("form_id")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and links of each string that has look-alikes, smallest first within its class; the string itself is a hash."""
    c = confusables.look_alike_classes(_visible_texts(spark, sf_dir))
    return c.groupBy("table_name", "canonical_row").agg(F.count("*").alias("n_forms"), F.sum("n_rows").alias("n_rows"), (F.sum("n_links") / 2).cast("long").alias("n_pairs"))


# Problem 7: evaluation texts leaking into training text


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.aligned_words(leakage.build_index(table(spark, sf_dir, "documents")), leakage.item_words(table(spark, sf_dir, "eval_items")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.phrase_matches(_aligned(spark, sf_dir)).select("doc_id", "item_id")


def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of a phrase's words, with small gaps or insertions."""
    return leakage.near_matches(leakage.build_index(table(spark, sf_dir, "documents")), leakage.item_words(table(spark, sf_dir, "eval_items")))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents that hold text of it."""
    found = leakage.phrase_matches(_aligned(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_run").alias("longest_run"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "eval_set")
    return items.join(found, "item_id", "left").select("item_id", "eval_set", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


# Problem 8: abusive, hateful or sexual content


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    encoded = abuse.encode(documents, ("source",))
    return abuse.score(encoded, abuse.stored_model(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "abuse_terms"), encoded))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).where(F.col("p_abusive") > abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity (0 to 3)."""
    return _abuse_scores(spark, sf_dir).drop("source")


def p8_rate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents and mean severity of each source."""
    found = F.col("p_abusive") > abuse.THRESHOLD
    return _abuse_scores(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if(found).alias("n_abusive"), F.avg(found.cast("int")).alias("abusive_rate"), F.avg("expected_severity").alias("mean_severity")
    )


QUERIES = {
    "p3_token_budget": p3_token_budget,
    "p3_after_new_crawl": p3_after_new_crawl,
    "p3_document_counts": p3_document_counts,
    "p6_packing": p6_packing,
    "p6_fill_report": p6_fill_report,
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p1_document_languages": p1_document_languages,
    "p4_found": p4_found,
    "p4_repeated_lines": p4_repeated_lines,
    "p4_cleaned_pages": p4_cleaned_pages,
    "p5_found": p5_found,
    "p5_canonical_texts": p5_canonical_texts,
    "p5_classes": p5_classes,
    "p7_found": p7_found,
    "p7_proximity": p7_proximity,
    "p7_leaked_items": p7_leaked_items,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rate_by_source": p8_rate_by_source,
}
# SQL on the same tables, where SQL can say it. The models, tokenizers and packings are tested on small fixtures instead.

_SITE = r"""regexp_replace(lower(coalesce(w.source.organization, regexp_extract(lower(w.source.source_url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1))), '^www\.', '')"""
_LINES = rf"""(SELECT org, doc_id, record_no, line, lower(regexp_replace(regexp_replace(line, '[\t\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]+', '', 'g'), '\p{{Nd}}+', '0', 'g')) AS form, line_no
    FROM (SELECT {_SITE} AS org, doc_id, record_no, unnest(string_split(w.content.raw_text, chr(10))) AS line, generate_subscripts(string_split(w.content.raw_text, chr(10)), 1) - 1 AS line_no FROM webscraper_output w))"""
_SITES = f"(SELECT {_SITE} AS org, count(DISTINCT doc_id) AS site_docs FROM webscraper_output w GROUP BY 1)"
_CONFIRMED = f"(SELECT org, form, n_docs, site_docs FROM (SELECT org, form, count(DISTINCT doc_id) AS n_docs FROM {_LINES} WHERE form <> '' AND org IS NOT NULL GROUP BY org, form) JOIN {_SITES} USING (org) WHERE n_docs >= 5 AND 5 * n_docs >= site_docs)"


def _sql_text(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _look_sql(x: str) -> str:
    out = f"translate({x}, {_sql_text(confusables._FROM)}, {_sql_text(confusables._TO)})"
    for joined, plain in confusables.JOINED:
        if unicodedata.name(joined).startswith("LATIN SMALL LIGATURE"):
            out = f"replace({out}, '{joined}', '{plain}')"
    return f"nfc_normalize({out})"


_SEEN = f"""(SELECT *, {_look_sql('text')} AS face FROM (SELECT 'pib_releases' AS table_name, id AS row_no, title AS text FROM pib_releases UNION ALL SELECT 'webscraper_output', record_no, w.content.clean_text FROM webscraper_output w) WHERE text IS NOT NULL)"""
_CLASSES = rf"""(SELECT table_name, face, count(DISTINCT text) AS n_forms, count(*) AS n_rows, arg_min(row_no, (octet_length(encode(text)), text, row_no)) AS canonical_row,
    arg_min(text, (octet_length(encode(text)), text, row_no)) AS canonical_text FROM {_SEEN} WHERE regexp_matches(face, '[^\s\p{{Z}}]') GROUP BY table_name, face HAVING count(DISTINCT text) > 1)"""
_CLEAN = r"regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g')"


def _grams(source: str, key: str, text: str) -> str:
    """Every twelve words in a row of each text, as one string, with their place."""
    words = rf"(SELECT {key}, list_filter(list_transform(string_split_regex({text}, '[\s\p{{Z}}\x{{85}}\x1C-\x1F]+'), lambda w: {_CLEAN}), lambda w: w <> '') AS ws FROM {source} WHERE {text} IS NOT NULL)"
    return f"(SELECT {key}, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i : i + 11], ' '))) AS gram, unnest(range(1, len(ws) - 10)) AS {key}_at FROM {words})"


_LEAKS = f"(SELECT DISTINCT doc_id, item_id, doc_id_at - item_id_at AS shift, item_id_at FROM {_grams('documents', 'doc_id', 'text')} JOIN {_grams('eval_items', 'item_id', 'item_text')} USING (gram))"

_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in language.NOTATIONS.items()) + "}"
_NONE = ", ".join(f"'{x}'" for x in language.NO_LANGUAGE)
_LANG = rf"""coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex(lower(coalesce(lang, '')), '[,;+]'),
    lambda x: regexp_replace(trim(x), '[-_].*$', '')), lambda x: x NOT IN ({_NONE})), lambda x: coalesce(map_extract({_KNOWN}, x)[1], x)))), '+'), ''), 'unknown')"""
_ORG = r"lower(regexp_replace(trim(regexp_replace(organization, '[\s\p{Z}]+', ' ', 'g')), '^(?i)www\.', ''))"
for _short, _full in tokens.SHORT_FORMS:
    _ORG = f"regexp_replace({_ORG}, '{_short}', '{_full}', 'g')"
_ORG = f"coalesce(nullif(regexp_replace({_ORG}, '^the ', ''), ''), 'unknown')"
# Windows that follow each other at one shift make one run, which has eleven words more than windows.
_RUNS = f"""(SELECT doc_id, item_id, count(*) + 11 AS run FROM (SELECT *, item_id_at - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_id_at) AS part FROM {_LEAKS}) GROUP BY doc_id, item_id, shift, part)"""

ORACLE: dict[str, str] = {
    "p3_document_counts": f"""SELECT CASE WHEN grouping(s, l, o) = 0 THEN 'cell' WHEN grouping(s) = 0 THEN 'source' WHEN grouping(l) = 0 THEN 'language' WHEN grouping(o) = 0 THEN 'organization' ELSE 'table' END AS level,
        coalesce(s, 'all') AS source, coalesce(l, 'all') AS language, coalesce(o, 'all') AS organization, count(*) AS n_documents, count(text) AS n_with_text
        FROM (SELECT coalesce(lower(source), 'unknown') AS s, {_LANG} AS l, {_ORG} AS o, text FROM documents) GROUP BY GROUPING SETS ((s, l, o), (s), (l), (o), ())""",
    "p4_found": f"SELECT record_no, line_no FROM {_LINES} JOIN {_CONFIRMED} USING (org, form)",
    "p4_repeated_lines": f"SELECT org, form AS line_form, n_docs, site_docs FROM {_CONFIRMED}",
    "p4_cleaned_pages": f"""SELECT record_no, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (hit IS NULL), '') AS cleaned_text, count(hit)::INTEGER AS lines_removed
        FROM (SELECT l.record_no, l.line, l.line_no, c.n_docs AS hit FROM {_LINES} l LEFT JOIN {_CONFIRMED} c ON l.org = c.org AND l.form = c.form) GROUP BY record_no
        UNION ALL SELECT record_no, NULL, NULL FROM webscraper_output w WHERE w.content.raw_text IS NULL""",
    "p5_found": f"SELECT a.table_name, a.row_no AS row_a, b.row_no AS row_b FROM {_SEEN} a JOIN {_SEEN} b ON a.table_name = b.table_name AND a.face = b.face AND a.row_no < b.row_no AND a.text <> b.text",
    "p5_canonical_texts": f"SELECT table_name, row_no, canonical_row, canonical_text, n_forms FROM {_SEEN} JOIN {_CLASSES} USING (table_name, face)",
    "p5_classes": f"""SELECT table_name, canonical_row, n_forms, n_rows, ((n_rows * n_rows - squares) // 2)::BIGINT AS n_pairs FROM {_CLASSES} JOIN
        (SELECT table_name, face, sum(n * n) AS squares FROM (SELECT table_name, face, text, count(*) AS n FROM {_SEEN} GROUP BY ALL) GROUP BY ALL) USING (table_name, face)""",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_LEAKS}",
    "p7_leaked_items": f"""SELECT e.item_id, e.eval_set, coalesce(n, 0) AS n_documents, coalesce(longest, 0) AS longest_run FROM eval_items e LEFT JOIN
        (SELECT item_id, count(DISTINCT doc_id) AS n, max(run) AS longest FROM {_RUNS} GROUP BY item_id) USING (item_id)""",
}
