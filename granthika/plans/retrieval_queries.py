"""Queries on retrieval and evidence. Query sets are all claims, or all vectors whose id 100 divides, against all rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.text import important_text
from granthika.functions.urls import host, on_whitelist
from granthika.operators import chunking, evidence, retrieval
from granthika.plans import sqltext as q
from granthika.plans.corpus_queries import _release_texts
from granthika.session import broadcast_within, materialise, table

#: Hosts whose pages count as evidence.
SITES = ["pib.example", "oshudratimes.example"]
#: Numbers kept free for a document's chunks in the numbering of chunks.
CHUNKS_A_DOCUMENT = 1_000_000


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("language"), "source_type",
        "source", "organization")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claim_queries").select("query_id", F.col("query").alias("text"), "keywords")


def _keyword_text(claims: DataFrame) -> DataFrame:
    return claims.select("query_id", F.array_join("keywords", " ").alias("text"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return retrieval.dense_top(v, queries, 20)


def _sparse(spark: SparkSession, sf_dir: str, language: str | None = None, k: int = 20) -> DataFrame:
    tokens = materialise(retrieval.token_weights(_keyword_text(_claims(spark, sf_dir)), "query_id", "text"), "query-tokens")
    return retrieval.sparse_top(retrieval.filtered(_corpus(spark, sf_dir), language=language), tokens, k)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_by(retrieval.relevance(_corpus(spark, sf_dir), _claims(spark, sf_dir)), "query_id", "item_id", 20).drop("keyword_pos")


def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each claim that are relevant enough to be kept, with the best score."""
    kept = retrieval.relevance(_corpus(spark, sf_dir), _claims(spark, sf_dir), least=2)
    return kept.groupBy("query_id").agg(F.count("*").alias("n_documents"), F.max("score").alias("best_score"))


def filtered_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse and keyword ranks over English documents, fused."""
    english = retrieval.filtered(_corpus(spark, sf_dir), language="en")
    keyword = retrieval.top_by(retrieval.relevance(english, _claims(spark, sf_dir)), "query_id", "item_id", 20)
    return retrieval.fuse([_sparse(spark, sf_dir, "en"), keyword])


def hybrid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five documents of each claim by hashed vectors and shared words."""
    return retrieval.hybrid(_corpus(spark, sf_dir), _claims(spark, sf_dir), "text")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("query_id", retrieval.search_text(F.col("keywords")).alias("search_text"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered evidence of each claim: its five best documents by shared words."""
    best = _sparse(spark, sf_dir, k=5)
    rows = best.join(_corpus(spark, sf_dir), "item_id").select(
        "query_id", F.col("rank").alias("source_number"), "item_id", F.concat(F.col("item_id").cast("string"), F.lit(":0")).alias("chunk_id"),
            F.lit(None).cast("string").alias("title"), F.col("organization").alias("publisher"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("published_at"),
            F.lit(None).cast("string").alias("section_heading"), F.col("text").alias("content"),
    )
    return materialise(rows, "evidence")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broadcast_within(_claims(spark, sf_dir).select("query_id", F.col("text").alias("question")))


def claim_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _evidence(spark, sf_dir).join(_questions(spark, sf_dir), "query_id")
    return evidence.build_context(joined, "query_id", "question").select("query_id", F.md5(F.encode("context", "UTF-8")).alias("context_md5"),
        F.length("context").cast("long").alias("n_chars"))


def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _claims(spark, sf_dir).select("query_id",
        F.array((F.col("query_id") % 3 + 1).cast("int"), F.lit(2), (F.col("query_id") % 3 + 1).cast("int"), F.lit(9)).alias("citations"))
    return evidence.resolve_citations(cited, _evidence(spark, sf_dir), "query_id").select("query_id", "source_number", "citation_position", "chunk_id")


def _chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered evidence of each claim: its five best chunks of the releases, with their title, URL, date and section."""
    d = _release_texts(spark, sf_dir).select("document_id", "title", "url", "published_at", F.col("organization").alias("publisher"),
        F.lit(None).cast("string").alias("author"), "content", "sections")
    chunks = materialise(chunking.chunk(d, chunking.ChunkingConfig(120, 160, 20)).withColumn("item_id",
        F.col("document_id") * CHUNKS_A_DOCUMENT + F.col("chunk_index")), "chunks")
    tokens = retrieval.token_weights(_keyword_text(_claims(spark, sf_dir)), "query_id", "text")
    best = retrieval.sparse_top(chunks, tokens, 5, text="content")
    return materialise(broadcast_within(best.select("query_id", "item_id", F.col("rank").alias("source_number"))).join(chunks, "item_id"), "chunk-evidence")


def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each claim out of chunks of releases."""
    joined = _chunk_evidence(spark, sf_dir).join(_questions(spark, sf_dir), "query_id")
    return evidence.build_context(joined, "query_id", "question").select("query_id", F.md5(F.encode("context", "UTF-8")).alias("context_md5"),
        F.length("context").cast("long").alias("n_chars"))


def quoting(contexts: list[str]) -> list[str]:
    """A completion that needs no model: it quotes the first source's first line and cites all sources that hold it."""
    out = []
    for context in contexts:
        sources = context.split("\n\nSOURCE ")[1:]
        line = sources[0].split("CONTENT:\n", 1)[-1].split("\n")[0] if sources else ""
        cited = [i + 1 for i, s in enumerate(sources) if line in s]
        out.append(json.dumps({"answer": line, "citations": cited, "verdict": "true" if len(cited) > 1 else "unverifiable", "confidence": float(len(cited))}))
    return out


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated answers of an injected completion over each claim's chunks."""
    own = _chunk_evidence(spark, sf_dir)
    prompts = evidence.build_context(own.join(_questions(spark, sf_dir), "query_id"), "query_id", "question")
    raw = evidence.complete(prompts, "query_id", quoting)
    return evidence.validated_answers(_claims(spark, sf_dir).select("query_id").join(raw, "query_id", "left"), own, "query_id")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webscraper_output").select(F.col("record_no").alias("item_id"), F.col("source.source_url").alias("url"),
        F.col("content.clean_text").alias("text"))


def _web_best(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Best pages of each claim from listed hosts."""
    web = _web(spark, sf_dir).where(on_whitelist(F.col("url"), SITES))
    pages = web.select("item_id", "url", (F.length("text") > 0).alias("has_content"))
    candidates = retrieval.relevance(web, _claims(spark, sf_dir)).join(pages, "item_id").withColumnRenamed("item_id", "result_pos")
    return retrieval.web_evidence(candidates, SITES, k)


def web_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web_best(spark, sf_dir).select("query_id", "rank", "url", "score", "keyword_pos", F.col("result_pos").alias("record_no"))


def web_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five web pages of each claim from listed hosts, with the sentences that hold the claim's keywords."""
    named = materialise(_web_best(spark, sf_dir), "web-evidence").join(_keyword_text(_claims(spark, sf_dir)).withColumnRenamed("text", "terms"), "query_id")
    return named.join(_web(spark, sf_dir).select(F.col("item_id").alias("result_pos"), "text"), "result_pos").select(
        "query_id", "rank", "url", host(F.col("url")).alias("host"), "score", important_text(F.col("text"), F.col("terms")).alias("excerpt")
    )


def paired_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's best document and the web's best page of each claim in one JSON object."""
    a = _sparse(spark, sf_dir, k=1).select("query_id", "item_id", F.col("score").cast("long").alias("score"))
    b = _web_best(spark, sf_dir, 1).select("query_id", "url", "score")
    return evidence.paired(a, b, "query_id")


QUERIES = {f.__name__: f for f in (
    dense_topk, sparse_topk, keyword_relevance, relevant_documents, filtered_fusion, hybrid_evidence, search_texts, claim_contexts,
        resolved_citations, chunk_contexts, generated_answers, web_ranking, web_evidence, paired_verdicts,
)}

_TOP = lambda scored, k: f"(SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM {scored} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= {k})"
_WORDS = lambda src, key, text: rf"(SELECT {key}, token, count(*)::DOUBLE AS weight FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '[\s\p{{Z}}]+')) AS token FROM {src}) WHERE token <> '' GROUP BY ALL)"
_QT = _WORDS("(SELECT query_id, array_to_string(keywords, ' ') AS t FROM claim_queries)", "query_id", "t")


def _sparse_sql(where: str = "true", k: int = 20) -> str:
    return _TOP(f"(SELECT query_id, item_id, sum(d.weight * w.weight) AS score FROM {_WORDS(f'(SELECT doc_id AS item_id, text FROM documents WHERE {where})', 'item_id', 'text')} d JOIN {_QT} w USING (token) GROUP BY query_id, item_id)", k)


_KW = "(SELECT query_id, list_filter(list_transform(keywords, lambda k: lower(trim(k))), lambda k: k <> '') AS kw FROM claim_queries)"
_PHRASES = f"""(SELECT query_id, unnest(kw) AS phrase, len(kw) - generate_subscripts(kw, 1) + 1 AS weight, generate_subscripts(kw, 1) - 1 AS keyword_pos FROM {_KW}
    UNION ALL SELECT query_id, kw[i] || ' ' || kw[i + 1], 3, i - 1
    FROM (SELECT query_id, kw, unnest(list_filter(range(1, len(kw)), lambda i: regexp_matches(kw[i], '[{retrieval.WORD}]')
    AND regexp_matches(kw[i + 1], '[{retrieval.WORD}]'))) AS i FROM {_KW} WHERE len(kw) > 1))"""


def _relevance_sql(where: str = "true", source: str = "(SELECT doc_id AS item_id, text, lang FROM documents)") -> str:
    # Words stand between two marks, so a phrase with marks is found only between word ends.
    marked = lambda x: rf"regexp_replace({x}, '([{retrieval.WORD}]+)', '<\1>', 'g')"
    plain = rf"(SELECT item_id, {marked(r"regexp_replace(regexp_replace(lower(text), '[<>]', '=', 'g'), '[\s\p{Z}]+', ' ', 'g')")} AS t FROM {source} WHERE {where})"
    bare = rf"(SELECT query_id, weight, keyword_pos, regexp_replace(regexp_replace(phrase, '[\s\p{{Z}}]+', ' ', 'g'), '^[^{retrieval.WORD}]+|[^{retrieval.WORD}]+$', '', 'g') AS phrase FROM {_PHRASES})"
    each = f"(SELECT phrase, {marked('phrase')} AS m FROM (SELECT DISTINCT phrase FROM {bare}) WHERE phrase <> '')"
    return f"(SELECT query_id, item_id, sum(weight)::BIGINT AS score, min(keyword_pos) AS keyword_pos FROM {each} JOIN {plain} ON contains(t, m) JOIN {bare} USING (phrase) GROUP BY query_id, item_id)"


_LISTED = " OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in SITES)
_PAGES = f"(SELECT record_no AS item_id, w.source.source_url AS url, w.content.clean_text AS text, {q.host('w.source.source_url')} AS host FROM webscraper_output w)"


def _web_once() -> str:
    scored = f"(SELECT * FROM {_relevance_sql(_LISTED, _PAGES)} JOIN {_PAGES} USING (item_id) WHERE length(text) > 0)"
    return f"(SELECT * FROM {scored} QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY keyword_pos, item_id) = 1)"


def _web_sql(k: int = 5) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword_pos, item_id)::INTEGER AS rank FROM {_web_once()} QUALIFY rank <= {k})"


_EV = f"(SELECT s.query_id, s.rank AS source_number, s.item_id, d.organization, d.text FROM {_sparse_sql(k=5)} s JOIN documents d ON d.doc_id = s.item_id)"

ORACLE = {
    "dense_topk": f"SELECT * FROM {_TOP("(SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)", 20)}",
    "sparse_topk": f"SELECT * FROM {_sparse_sql()}",
    "keyword_relevance": f"SELECT * FROM {_TOP(_relevance_sql(), 20)}",
    "filtered_fusion": f"""SELECT * FROM {_TOP(f"(SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM {_sparse_sql("lang = 'en'")} UNION ALL SELECT query_id, item_id, rank FROM {_TOP(_relevance_sql("lang = 'en'"), 20)}) GROUP BY query_id, item_id)", 5)}""",
    "relevant_documents": f"SELECT query_id, count(*) AS n_documents, max(score) AS best_score FROM {_relevance_sql()} WHERE score >= 2 GROUP BY query_id",
    "web_ranking": f"SELECT query_id, rank, url, score, keyword_pos::INTEGER AS keyword_pos, item_id AS record_no FROM {_web_sql()}",
    "paired_verdicts": f"""SELECT query_id, '{{"claim":' || query_id || ',"corpus":{{"item_id":' || a.item_id || ',"score":' || a.score::BIGINT || '}},"live_web":{{"url":' || to_json(b.url)::VARCHAR || ',"score":' || b.score || '}}}}' AS payload
        FROM {_sparse_sql(k=1)} a JOIN (SELECT query_id, arg_min(url, (-score, keyword_pos, item_id)) AS url, max(score) AS score FROM {_web_once()}
        GROUP BY query_id) b USING (query_id)""",
    "search_texts": f"""SELECT query_id, array_to_string(list_transform(CASE WHEN len(list_filter(kw, lambda k: contains(k, ' '))) > 0 THEN list_filter(kw, lambda k: contains(k, ' ')) ELSE kw END, lambda k: '"' || k || '"'), ' OR ') AS search_text FROM {_KW}""",
    "claim_contexts": f"""SELECT query_id, md5(c) AS context_md5, length(c) AS n_chars FROM (SELECT e.query_id, 'USER QUESTION:' || chr(10)
        || any_value(q.query) || chr(10) || chr(10) || 'RETRIEVED SOURCES:' || chr(10) || chr(10) || string_agg(
        'SOURCE ' || source_number || chr(10) || 'Chunk ID: ' || item_id || ':0' || chr(10) || 'Title: Unknown' || chr(10) || 'Publisher: '
        || coalesce(nullif(organization, ''), 'Unknown') || chr(10) || 'Author: Unknown' || chr(10) || 'URL: Unknown' || chr(10) ||
        'Published At: Unknown' || chr(10) || 'Section: Unknown' || chr(10) || chr(10) || 'CONTENT:' || chr(10) || coalesce(text, ''), chr(10)
        || chr(10) ORDER BY source_number) AS c FROM {_EV} e JOIN claim_queries q USING (query_id) GROUP BY e.query_id)""",
    "resolved_citations": f"SELECT query_id, source_number, (CASE WHEN source_number = query_id % 3 + 1 THEN 0 ELSE 1 END)::INTEGER AS citation_position, item_id || ':0' AS chunk_id FROM {_EV} WHERE source_number IN (2, query_id % 3 + 1)",
}
