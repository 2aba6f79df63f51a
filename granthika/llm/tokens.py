"""Token budget per source and language.

Method: a count table keyed by content hash and tokenizer hash holds the tokens of every text that was ever encoded; a
run encodes only texts that the table lacks. A snapshot lists the documents with their content hash and slice. The cube
of totals is kept up to date by signed deltas: documents that left a slice or changed count -1 with their old tokens,
documents that joined count +1 with their new ones; removed documents are those that the new snapshot lacks.

Defined results: null text has no tokens and counts as a document without text; repeated texts are encoded once and
counted for each document; null slice values count as ``unknown``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.llm.language import named_languages
from granthika.session import materialise, only, read_if_there, scratch_path

#: Folder with vocabulary files of public tokenizers; on a cluster it must be on every machine, or the file be sent with
#: ``--files`` and named by its bare name.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: how the byte-level tokenizers cut a text before they join bytes.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Short forms in names of organizations.
SHORT_FORMS = ((r"^min\. ?", "ministry "), (r"^dept+\. ?", "department "), (r"^dir\. ?", "directorate "), (r"^auth\. ?", "authority "), (r"^comm\. ?", "commission "), (r" & ", " and "))
SLICE = ("table_name", "source", "language", "organization")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary file (``.tiktoken``)."""

    path: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken"

    def hash(self) -> str:
        return hashlib.sha256(_file(self.path).read_bytes() + CUT.encode()).hexdigest()[:16]

    def count(self, text: str) -> int:
        return len(_encoding(self.path).encode_ordinary(text))


def _file(path: str) -> Path:
    """The file at ``path``, or the one that ``--files`` has put on this machine under that name."""
    from pyspark import SparkFiles

    return Path(path) if "/" in path else Path(SparkFiles.get(path))


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _file(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``texts`` (key, text) as key, n_tokens; null text has 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.iloc[:, 0], "n_tokens": [tokenizer.count(t) if t else 0 for t in pdf.iloc[:, 1]]})

    key = texts.schema[0]
    return texts.mapInPandas(run, f"key {key.dataType.simpleString()}, n_tokens long").withColumnRenamed("key", key.name)


class TokenLedger:
    """Count table, snapshots and cubes under ``path``; a ledger opened there later, by any process, goes on from the last
    complete version.

    A version counts once it is listed under ``commits``, which is written last; what a broken run left is overwritten by
    the next. Counts that it has added already stay, and their texts aren't encoded again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer | None = None):
        self.spark, self.path, self.tokenizer = spark, path, tokenizer or Tokenizer()

    @classmethod
    def fresh(cls, spark: SparkSession, tokenizer: Tokenizer | None = None) -> TokenLedger:
        return cls(spark, scratch_path(spark, "tokens"), tokenizer)

    @property
    def version(self) -> int:
        """The last complete version, 0 before the first."""
        done = read_if_there(self.spark, f"{self.path}/commits", "version int")
        return (done.agg(F.max("version")).first()[0] or 0) if done is not None else 0

    def counts(self) -> DataFrame | None:
        """content_hash, tokenizer and n_tokens of every text that was encoded."""
        return read_if_there(self.spark, f"{self.path}/counts", "content_hash binary, tokenizer string, n_tokens long")

    def _own_counts(self) -> DataFrame | None:
        known = self.counts()
        return known and known.where(F.col("tokenizer") == self.tokenizer.hash()).select("content_hash", "n_tokens")

    def encode_unseen(self, documents: DataFrame, snapshot: DataFrame) -> DataFrame:
        """Adds the counts of texts that the table lacks under this tokenizer; returns the tokenizer's counts.

        Which document stands for each unseen text is decided on hashes; only its text is read again.
        """
        hashed, known = snapshot.where(F.col("content_hash").isNotNull()), self._own_counts()
        fresh = hashed if known is None else hashed.join(known, "content_hash", "left_anti")
        chosen = materialise(fresh.groupBy("content_hash").agg(F.min("doc_key").alias("doc_key")).select("doc_key").distinct(), "unseen")
        others = materialise(hashed.select("doc_key").distinct().join(chosen, "doc_key", "left_anti"), "seen")
        texts = only(documents.where(F.col("text").isNotNull()).select("doc_key", "text"), "doc_key", chosen, others)
        counted = count_tokens(texts.select(content_hash(F.col("text")).alias("content_hash"), "text"), self.tokenizer).groupBy("content_hash").agg(F.first("n_tokens").alias("n_tokens"))
        if known is not None:
            counted = counted.join(known, "content_hash", "left_anti")
        counted.select("content_hash", F.lit(self.tokenizer.hash()).alias("tokenizer"), "n_tokens").write.mode("append").parquet(f"{self.path}/counts")
        return self._own_counts()

    def update(self, documents: DataFrame) -> DataFrame:
        """Takes ``documents`` (doc_key, the SLICE columns, text) as the new snapshot and returns the new cube."""
        old, new = self.version, self.version + 1
        named = documents.select("doc_key", *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in SLICE], content_hash(F.col("text")).alias("content_hash"))
        named.write.mode("overwrite").parquet(f"{self.path}/snapshot-{new}")
        snapshot = self.spark.read.parquet(f"{self.path}/snapshot-{new}")
        counts = self.encode_unseen(documents, snapshot)
        signed = snapshot.withColumn("sign", F.lit(1))
        if old:
            before = self.spark.read.parquet(f"{self.path}/snapshot-{old}").withColumn("sign", F.lit(-1))
            signed = signed.unionByName(before).groupBy("doc_key", *SLICE, "content_hash").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        deltas = signed.join(counts, "content_hash", "left").groupBy(*SLICE).agg(
            F.sum("sign").alias("n_documents"), F.sum(F.col("sign") * F.col("n_tokens").isNotNull().cast("int")).alias("n_with_text"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).alias("n_tokens")
        )
        if old:
            cells = deltas.unionByName(self.spark.read.parquet(f"{self.path}/cube-{old}"))
            deltas = cells.groupBy(*SLICE).agg(*[F.sum(c).alias(c) for c in ("n_documents", "n_with_text", "n_tokens")]).where("n_documents <> 0")
        deltas.write.mode("overwrite").parquet(f"{self.path}/cube-{new}")
        self.spark.range(1).select(F.lit(new).alias("version")).write.mode("append").parquet(f"{self.path}/commits")
        return self.cube()

    def cube(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cube-{self.version}")


#: Totals by these columns besides the table; bits of grouping_id say which columns a total leaves open.
LEVELS = {"cell": (0, ("source", "language", "organization")), "source": (3, ("source",)), "language": (5, ("language",)), "organization": (6, ("organization",)), "table": (7, ())}


def totals(cube: DataFrame) -> DataFrame:
    """Totals of every table by source, by language, by organization, by all three, and overall.

    ``level`` tells which; columns that a total leaves open are ``all``, which a source may also be called.
    """
    sums = cube.groupingSets([[F.col(c) for c in (SLICE[0], *own)] for _, own in LEVELS.values()], *map(F.col, SLICE)).agg(
        F.grouping_id(*SLICE).alias("_set"), *[F.sum(c).alias(c) for c in ("n_documents", "n_with_text", "n_tokens")]
    )
    level = F.coalesce(*[F.when(F.col("_set") == n, name) for name, (n, _) in LEVELS.items()])
    named = [F.when(F.col(c).isNull(), "all").otherwise(F.col(c)).alias(c) for c in SLICE]
    return sums.select(level.alias("level"), *named, "n_documents", "n_with_text", "n_tokens")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def language_slice(label: Column) -> Column:
    """Codes that a label names, joined by +; null if it names none."""
    return F.nullif(F.array_join(named_languages(label), "+"), F.lit(""))


def organization_slice(name: Column) -> Column:
    """One spelling of an organization: lower case, single spaces, ``and`` for &, common short forms written out, no ``www.``."""
    spelt = F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"[\s\p{Z}]+", " ")), r"^(?i)www\.", ""))
    for short, full in SHORT_FORMS:
        spelt = F.regexp_replace(spelt, short, full)
    return F.nullif(F.regexp_replace(spelt, r"^the ", ""), F.lit(""))
