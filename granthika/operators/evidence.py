"""Evidence for claims: numbered context, citations, validated answers, paired verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_EVIDENCE = "The available sources do not contain enough information to answer this question."
ANSWER = "answer string, citations array<int>, verdict string, confidence double, _broken string"
FIELDS = (("Chunk ID", "chunk_id"), ("Title", "title"), ("Publisher", "publisher"), ("Author", "author"), ("URL", "url"),
    ("Published At", "published_at"), ("Section", "section_heading"))


def numbered(evidence: DataFrame, claim: str, *order: Column) -> DataFrame:
    """``evidence`` with source_number from 1, by ``order`` within the claim; a claim's evidence is a bounded top list."""
    return evidence.withColumn("source_number", F.row_number().over(Window.partitionBy(claim).orderBy(*order)))


def source_text() -> Column:
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Unknown"))) for name, c in FIELDS]
    return F.concat(F.lit("SOURCE "), F.col("source_number").cast("string"), F.lit("\n"), F.concat_ws("\n", *lines), F.lit("\n\nCONTENT:\n"),
        F.coalesce("content", F.lit("")))


def build_context(evidence: DataFrame, claim: str, question: str) -> DataFrame:
    """One prompt text a claim out of its numbered evidence (source_number, FIELDS, content)."""
    parts = evidence.select(claim, question, F.struct("source_number", source_text().alias("t")).alias("s"))
    texts = parts.groupBy(claim, question).agg(F.sort_array(F.collect_list("s")).alias("s"))
    head = F.concat(F.lit("USER QUESTION:\n"), F.coalesce(F.col(question), F.lit("")))
    return texts.select(claim, F.concat_ws("\n\n", head, F.lit("RETRIEVED SOURCES:"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")).alias("context"))


def resolve_citations(answers: DataFrame, evidence: DataFrame, claim: str) -> DataFrame:
    """Cited numbers (``citations`` of each claim) joined to the evidence: the first mention of each number counts, and
    numbers without evidence fall away. Adds citation_position from 0.
    """
    cited = answers.select(claim, F.posexplode("citations").alias("citation_position", "source_number")).groupBy(claim,
        "source_number").agg(F.min("citation_position").alias("citation_position"))
    return cited.join(evidence, [claim, "source_number"])


def validated_answers(raw: DataFrame, evidence: DataFrame, claim: str, output: str = "raw_output") -> DataFrame:
    """Answers out of a generator's JSON: malformed output gives ``errors``; cited numbers that all lack evidence, or no
    evidence at all, give the no-evidence answer. An answer that cites nothing stands.
    """
    parsed = F.from_json(output, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = raw.select(claim, parsed.alias("a"))
    known = resolve_citations(rows.select(claim, F.col("a.citations").alias("citations")), evidence,
        claim).groupBy(claim).agg(F.sort_array(F.collect_list("source_number")).alias("resolved"))
    any_evidence = evidence.select(claim).distinct().withColumn("_has", F.lit(True))
    joined = rows.join(known, claim, "left").join(any_evidence, claim, "left")
    bad = F.col("a._broken").isNotNull() | F.col("a.answer").isNull() | F.col("a.verdict").isNull() | F.col("a.confidence").isNull()
    none = F.col("_has").isNull() | (F.coalesce(F.size("a.citations") > 0, F.lit(False)) & F.col("resolved").isNull())
    empty = F.expr("cast(array() as array<int>)")
    return joined.select(
        claim, F.when(none, F.lit(NO_EVIDENCE)).otherwise(F.when(~bad, F.col("a.answer"))).alias("answer"),
            F.when(none | bad, empty).otherwise(F.coalesce("resolved", empty)).alias("citations"),
        F.when(none, "Unverifiable").otherwise(F.when(~bad, F.col("a.verdict"))).alias("verdict"),
            F.when(none, 0.0).otherwise(F.when(~bad, F.col("a.confidence"))).alias("confidence"),
        F.when(~none & bad, F.lit("malformed output")).alias("error"),
    )


def complete(prompts: DataFrame, claim: str, completion) -> DataFrame:
    """Runs an injected ``completion(list of prompts) -> list of texts`` on batches of contexts."""

    def run(batches):
        for pdf in batches:
            yield pdf[[claim]].assign(raw_output=completion(pdf["context"].tolist()))

    kind = prompts.schema[claim].dataType.simpleString()
    return prompts.select(claim, "context").mapInPandas(run, f"{claim} {kind}, raw_output string")


def paired(corpus: DataFrame, web: DataFrame, claim: str) -> DataFrame:
    """Both branches' results of each claim as one JSON object."""
    a = corpus.select(claim, F.struct(*[c for c in corpus.columns if c != claim]).alias("corpus"))
    b = web.select(claim, F.struct(*[c for c in web.columns if c != claim]).alias("live_web"))
    return a.join(b, claim).select(claim, F.to_json(F.struct(F.col(claim).alias("claim"), "corpus", "live_web")).alias("payload"))


def display_verdict(verdict: Column) -> Column:
    """true, false or unverifiable."""
    v = F.lower(F.trim(verdict))
    return F.when(v.isin("true", "verified"), "true").when(v == "false", "false").otherwise("unverifiable")
