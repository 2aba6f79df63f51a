"""Ranked retrieval for many claims at once: dense and sparse scores, fusion of ranks, keyword relevance.

Filters come before ranks. Ties go to the smaller id, so ranks are the same on every run. Vectors with a null, zero or
other-sized partner, and texts without shared tokens, don't match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granthika.functions.urls import on_whitelist
from granthika.operators.dedup import first_by
from granthika.session import broadcast_within, computed_once, materialise

#: Query vectors scored in one pass over the corpus; more queries take more passes.
QUERY_BLOCK = 20_000
#: Scores that a task holds at once.
SCORE_CELLS = 3_000_000
#: First words of phrases that are tested inside a row; with more of them every word goes through the join.
MAX_FIRST_WORDS = 20_000
WORD = r"\p{L}\p{M}\p{N}_"
RRF_K = 60


def filtered(rows: DataFrame, source_type: str | None = None, language: str | None = None) -> DataFrame:
    """Equality filters that are given; they reach the scan."""
    for column, value in (("source_type", source_type), ("language", language)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def top_by(scored: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best items of each query with ``rank`` from 1. Spark cuts each partition to k rows a query before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top(corpus: DataFrame, queries: DataFrame, k: int = 20, item: str = "item_id", query: str = "query_id", vector: str = "vector",
    block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top ``k`` of each query over all corpus rows.

    Queries are taken in blocks of at most ``block`` vectors, each block one pass: a task scores its rows against the
    block and keeps k rows a query, so what is shuffled is k rows a query and Arrow batch, not pairs.
    """
    parts = []
    for own in _blocks(queries.where(F.col(vector).isNotNull()), query, block):
        rows = [r for r in own.select(query, vector).orderBy(query).collect() if any(r[1])]
        if rows:
            parts.append(corpus.where(F.col(vector).isNotNull()).select(item,
                vector).mapInPandas(_scorer(corpus.sparkSession, rows, k, item, query, vector), f"{query} long, {item} long, score double"))
    return _best_of(parts, corpus.sparkSession, query, item, k)


def _blocks(queries: DataFrame, query: str, block: int) -> Iterator[DataFrame]:
    """``queries`` in ranges of about ``block`` different ids; one at a time is held by the driver."""
    ids = queries.select(query).where(F.col(query).isNotNull()).distinct()
    n = -(-ids.count() // block)
    cuts = sorted(set(ids.approxQuantile(query, [i / n for i in range(1, n)], 0.0))) if n > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = queries if low is None else queries.where(F.col(query) > low)
        yield own if high is None else own.where(F.col(query) <= high)


def _best_of(parts: list[DataFrame], spark: SparkSession, query: str, item: str, k: int) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"{query} long, {item} long, score double, rank int")
    return top_by(reduce(DataFrame.unionByName, parts), query, item, k)


def _scorer(spark, rows: list, k: int, item: str, query: str, vector: str):
    width = len(rows[0][1])
    kept = [r for r in rows if len(r[1]) == width]
    q = np.array([r[1] for r in kept], np.float64)
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in kept]), q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = shared.value
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == unit.shape[1] and bool(np.any(v)) for v in pdf[vector]]]
            if not len(pdf):
                continue
            v = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            scores = np.round(unit @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
            items, n = pdf[item].to_numpy(), min(k, len(pdf))
            order = np.lexsort((np.broadcast_to(items, scores.shape), -scores), axis=1)[:, :n]
            yield pd.DataFrame({query: np.repeat(ids, n), item: items[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    return run


def token_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, weight: counts of the lower-case words of a text."""
    words = rows.where(F.col(text).isNotNull()).select(key, F.explode(F.split(F.lower(text), r"[\s\p{Z}]+")).alias("token")).where("token <> ''")
    return words.groupBy(key, "token").agg(F.count("*").cast("double").alias("weight"))


def sparse_top(corpus: DataFrame, query_tokens: DataFrame, k: int = 20, text: str = "text", item: str = "item_id", query: str = "query_id",
    block: int = QUERY_BLOCK) -> DataFrame:
    """Top ``k`` by the dot product of word counts and the queries' token weights (query, token, weight).

    A task scores its texts against the broadcast query weights and keeps k rows a query and Arrow batch, so neither words
    nor pairs are shuffled. Queries are taken in blocks of at most ``block``, each block one pass.
    """
    parts = []
    for own in _blocks(query_tokens, query, block):
        rows = own.select(query, "token", "weight").orderBy(query, "token").toPandas()
        if len(rows):
            words = F.split(F.lower(text), r"[\s\p{Z}]+").alias("words")
            parts.append(corpus.where(F.col(text).isNotNull()).select(item,
                words).mapInArrow(_sparse_scorer(corpus.sparkSession, rows, k, item, query), f"{query} long, {item} long, score double"))
    return _best_of(parts, corpus.sparkSession, query, item, k)


def _sparse_scorer(spark, rows: pd.DataFrame, k: int, item: str, query: str):
    queries, own = np.unique(rows[query].to_numpy(), return_inverse=True)
    tokens, column = np.unique(rows["token"].to_numpy(object), return_inverse=True)
    shared = spark.sparkContext.broadcast((queries, tokens, own[np.argsort(column, kind="stable")],
        rows["weight"].to_numpy()[np.argsort(column, kind="stable")], np.append(0, np.cumsum(np.bincount(column)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vocabulary, owner, weight, starts = shared.value
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            step = max(1, SCORE_CELLS // ids.size)
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists = batch.column(1)
                code = pc.index_in(lists.flatten(), value_set=known)
                hit = np.flatnonzero(np.asarray(code.is_valid()))
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[hit]
                # Each different (text, token) once with its count, then with each query that has the token.
                pair, n = np.unique(doc * np.int64(vocabulary.size) + code.to_numpy(zero_copy_only=False)[hit].astype(np.int64), return_counts=True)
                doc, token = pair // vocabulary.size, pair % vocabulary.size
                held = starts[token + 1] - starts[token]
                at = np.repeat(starts[token] - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
                scores = np.bincount(owner[at] * batch.num_rows + np.repeat(doc, held), weights=weight[at] * np.repeat(n, held),
                    minlength=ids.size * batch.num_rows).reshape(ids.size, -1)
                items = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((np.broadcast_to(items, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                q, place = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(items[order[q, place]], pa.int64()),
                    pa.array(best[q, place])], [query, item, "score"])

    return run


def fuse(branches: list[DataFrame], k: int = 5, item: str = "item_id", query: str = "query_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the branches that hold an item."""
    ranks = branches[0].select(query, item, "rank")
    for b in branches[1:]:
        ranks = ranks.unionByName(b.select(query, item, "rank"))
    return top_by(ranks.groupBy(query, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), query, item, k)


def hybrid(corpus: DataFrame, queries: DataFrame, text: str, k: int = 5, prefetch: int = 20, source_type: str | None = None,
    language: str | None = None, embed=None) -> DataFrame:
    """Dense and sparse branch over the filtered corpus (item_id, text), fused; ``embed`` maps texts to vectors."""
    own = filtered(corpus, source_type, language)
    embed = embed or hashed_vectors
    dense = dense_top(embed(own, "item_id", text), embed(queries, "query_id", text), prefetch)
    return fuse([dense, sparse_top(own, token_weights(queries, "query_id", text), prefetch, text)], k)


def hashed_vectors(rows: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """key, vector: each word adds +1 or -1 at a place that its hash names; a deterministic embedding that needs no model."""
    words = F.split(F.lower(text), r"[\s\p{Z}]+")
    places = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h in pdf["h"]:
                h = np.asarray(h, np.int64)
                out.append(np.bincount(np.mod(h, width), weights=np.where((h >> 20) & 1, 1.0, -1.0), minlength=width).astype(np.float32))
            yield pd.DataFrame({key: pdf[key], "vector": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(text).isNotNull()).select(key, places.alias("h")).where(F.size("h") > 0).mapInPandas(add, f"{key} {kind}, vector array<float>")


def keyword_weights(keywords: Column) -> Column:
    """Lower-case keywords with weights n, n-1, ..., 1; blanks left out."""
    kept = F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.transform(kept, lambda k, i: F.struct(k.alias("keyword"), (F.size(kept) - i).alias("weight")))


def search_text(keywords: Column) -> Column:
    """Quoted keywords of several words joined by OR; of single words if there are no others."""
    kept = F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: k != "")
    several = F.filter(kept, lambda k: F.size(F.split(k, " ")) > 1)
    return F.array_join(F.transform(F.when(F.size(several) > 0, several).otherwise(kept), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), " OR ")


def keyword_phrases(queries: DataFrame, query: str = "query_id") -> DataFrame:
    """query, phrase, weight, keyword_pos (from 0, that of the first of a pair): each keyword with its weight, and each pair of neighbouring keywords that have words with 3.

    Phrases are lower case, with single spaces, and without what isn't a letter, mark, digit or underscore at their ends.
    """
    weighted = queries.select(query, keyword_weights(F.col("keywords")).alias("kw"))
    single = weighted.select(query, F.posexplode("kw").alias("keyword_pos", "k")).select(query, F.col("k.keyword").alias("phrase"),
        F.col("k.weight").alias("weight"), "keyword_pos")
    kw = lambda i: F.get("kw", i)["keyword"]
    said = F.filter(F.sequence(F.lit(1), F.size("kw") - 1), lambda i: kw(i - 1).rlike(f"[{WORD}]") & kw(i).rlike(f"[{WORD}]"))
    pairs = F.transform(said, lambda i: F.struct(F.concat(kw(i - 1), F.lit(" "), kw(i)).alias("phrase"), F.lit(3).alias("weight"), (i - 1).alias("keyword_pos")))
    both = single.unionByName(weighted.where(F.size("kw") > 1).select(query, F.explode(pairs).alias("p")).select(query, "p.*"))
    plain = F.regexp_replace(F.regexp_replace("phrase", r"[\s\p{Z}]+", " "), rf"^[^{WORD}]+|[^{WORD}]+$", "")
    return both.withColumn("phrase", plain).where("phrase <> ''")


def held_phrases(corpus: DataFrame, phrases: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """item, phrase: each different phrase that a text holds between word ends, once.

    A text becomes its words, each with what stands behind it up to the next. Where a word begins a phrase, the words from
    there on, as many as the longest phrase has, are joined to the phrases by that word; the text itself leaves the plan
    before. First words are tested inside the row, so other places never become rows.
    """
    own = phrases.select("phrase").distinct().withColumns({"word": F.regexp_extract("phrase", f"[{WORD}]+", 0), "_n": F.regexp_count("phrase", F.lit(f"[{WORD}]+"))})
    firsts = [r[0] for r in own.select("word").distinct().limit(MAX_FIRST_WORDS + 1).collect()]
    longest = own.agg(F.max("_n")).first()[0] or 1
    lower = F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " ")
    plain = computed_once(corpus.where(F.col(text).isNotNull()).select(item, lower.alias("_t")))
    words = computed_once(plain.select(item, *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(n) for n,
        p in (("_w", f"[{WORD}]+"), ("_u", f"[{WORD}]+[^{WORD}]*"))]))
    at = F.transform("_w", lambda w, i: F.struct(w.alias("word"), i.alias("i")))
    if len(firsts) <= MAX_FIRST_WORDS:
        at = F.filter(at, lambda x: x["word"].isin(firsts))
    ahead = F.transform(at, lambda x: F.struct(x["word"].alias("word"), F.array_join(F.slice("_u", x["i"] + 1, longest), "").alias("ahead")))
    places = words.select(item, F.explode(F.array_distinct(ahead)).alias("x")).select(item, "x.word", "x.ahead")
    found = places.join(broadcast_within(own.select("word", "phrase")), "word")
    behind = F.substring("ahead", F.length("phrase") + 1, F.lit(1))
    return found.where(F.startswith("ahead", "phrase") & ~behind.rlike(f"[{WORD}]")).select(item, "phrase").distinct()


def relevance(corpus: DataFrame, queries: DataFrame, text: str = "text", item: str = "item_id", query: str = "query_id", least: int = 1) -> DataFrame:
    """query, item, score, keyword_pos: each keyword of a query that the text holds adds its weight, and each pair of
    neighbouring keywords that stands there as a phrase adds 3; rows below ``least`` fall away. Words are those of any
    script; keyword_pos is that of the first keyword that the text holds.
    """
    phrases = materialise(keyword_phrases(queries, query), "phrases")
    hits = held_phrases(corpus, phrases, text, item).join(broadcast_within(phrases), "phrase")
    return hits.groupBy(query, item).agg(F.sum("weight").cast("long").alias("score"), F.min("keyword_pos").alias("keyword_pos")).where(F.col("score") >= least)


def web_evidence(candidates: DataFrame, domains: list[str], k: int = 5, answered: DataFrame | None = None) -> DataFrame:
    """Best ``k`` web documents of each claim out of candidates (query_id, url, keyword_pos, result_pos, score, has_content).

    Only whitelisted hosts; of repeated URLs the first with content counts; empty content falls away, as do claims that
    ``answered`` (query_id) lists because the corpus has evidence for them. Contents are joined to the few rows left.
    """
    good = candidates.where(on_whitelist(F.col("url"), domains) & F.coalesce("has_content", F.lit(False)))
    if answered is not None:
        good = good.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    once = first_by(good, ["query_id", "url"], ["keyword_pos", "result_pos"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "keyword_pos", "result_pos")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
