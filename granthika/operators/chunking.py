"""Documents to chunks of bounded token numbers, with offsets into the original text.

A text of at most ``max_tokens`` is one chunk. A longer one is cut by section (if all sections are found in it, in order)
into paragraphs, too long paragraphs into sentences, too long sentences into groups of ``target_tokens`` tokens; units are
packed until ``target_tokens`` is reached, and each chunk of a section but the first repeats up to ``overlap_tokens``
tokens of the one before.

A tokenizer is a function from a text to the (start, end) of its tokens, by default runs between white space. It sees each
text once; the tokens of a span are those that begin in it. Work and memory are linear in the length of a text.

Defined results: null text has no chunk, empty text one empty chunk; ``content[char_start:char_end]`` is the chunk; null
sections and sections without content are as if they weren't there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.text import word_count

Span = tuple[int, int]
Tokenizer = Callable[[str], list[Span]]
SPANS = "array<struct<start:int,end:int,n:int>>"
CHUNKS = "array<struct<start:int,end:int,n:int,section:int,content:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32())]))
_CHUNK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32()), ("section", pa.int32()), ("content", pa.string())]))
_WORD, _BLANK_LINES, _SENTENCE_END = re.compile(r"\S+"), re.compile(r"\n\s*\n"), re.compile(r"[.!?](?=\s)")


@dataclass(frozen=True)
class ChunkingConfig:
    target_tokens: int = 700
    max_tokens: int = 900
    overlap_tokens: int = 100

    def __post_init__(self):
        if not 0 < self.target_tokens <= self.max_tokens or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("0 < target_tokens <= max_tokens and 0 <= overlap_tokens < max_tokens must hold")


def words(text: str) -> list[Span]:
    """The runs between white space."""
    return [m.span() for m in _WORD.finditer(text)]


class Cutter:
    """One text with its tokens; every span is trimmed of white space."""

    def __init__(self, text: str, tokenizer: Tokenizer = words):
        self.text = text
        self.tokens = [t for t in tokenizer(text) if t[1] > t[0]]
        self.starts = [a for a, _ in self.tokens]

    def count(self, span: Span) -> int:
        return bisect_left(self.starts, span[1]) - bisect_left(self.starts, span[0])

    def _between(self, outer: Span, cuts: Iterator[Span]) -> Iterator[Span]:
        at = outer[0]
        for a, b in [*cuts, (outer[1], outer[1])]:
            while at < a and self.text[at].isspace():
                at += 1
            end = a
            while end > at and self.text[end - 1].isspace():
                end -= 1
            if at < end:
                yield at, end
            at = b

    def paragraphs(self, outer: Span) -> Iterator[Span]:
        return self._between(outer, (m.span() for m in _BLANK_LINES.finditer(self.text, *outer)))

    def sentences(self, outer: Span) -> Iterator[Span]:
        return self._between(outer, ((m.end(), m.end()) for m in _SENTENCE_END.finditer(self.text, *outer)))

    def groups(self, outer: Span, size: int) -> Iterator[Span]:
        own = range(bisect_left(self.starts, outer[0]), bisect_left(self.starts, outer[1]))
        for i in own[::size]:
            yield self.tokens[i][0], self.tokens[min(i + size, own.stop) - 1][1]

    def units(self, outer: Span, config: ChunkingConfig) -> Iterator[Span]:
        for p in self.paragraphs(outer):
            if self.count(p) <= config.max_tokens:
                yield p
                continue
            for s in self.sentences(p):
                yield from [s] if self.count(s) <= config.max_tokens else self.groups(s, config.target_tokens)

    def packed(self, outer: Span, config: ChunkingConfig) -> list[Span]:
        """Neighbouring units joined while the sum fits and the target isn't reached, then widened by the overlap."""
        out: list[Span] = []
        for u in self.units(outer, config):
            if out and self.count((out[-1][0], u[1])) <= config.max_tokens and self.count(out[-1]) < config.target_tokens:
                out[-1] = out[-1][0], u[1]
            else:
                out.append(u)
        for i in range(1, len(out)):
            before, own = out[i - 1], out[i]
            take = min(config.overlap_tokens, self.count(before), config.max_tokens - self.count(own))
            if take > 0:
                wide = self.starts[bisect_left(self.starts, before[1]) - take], own[1]
                out[i] = own if wide == before else wide
        return out

    def placed(self, parts: list[str]) -> list[Span] | None:
        """Where the parts stand in the text, one after the other; None if one isn't found."""
        out, at = [], 0
        for part in parts:
            a = self.text.find(part, at)
            if a < 0:
                return None
            at = a + len(part)
            out.append((a, at))
        return out or None


def _spans(text: Column, cut: Callable[[Cutter, Span], Iterator[Span]]) -> Column:
    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            own = None if t is None else Cutter(t)
            out.append(own and [{"start": a, "end": b, "n": own.count((a, b))} for a, b in cut(own, (0, len(t)))])
        return pa.array(out, _SPAN)

    return run(text)


def paragraph_spans(text: Column) -> Column:
    """start, end and number of words of the paragraphs, which blank lines part; null text gives null."""
    return _spans(text, Cutter.paragraphs)


def sentence_spans(text: Column) -> Column:
    """The same of the sentences, which end in . ! or ? before white space."""
    return _spans(text, Cutter.sentences)


def chunk_spans(text: Column, parts: Column, config: ChunkingConfig, tokenizer: Tokenizer = words) -> Column:
    """Chunks of a text (start, end, n, number of the section from 0 or null, content); ``parts`` are the sections' contents."""

    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array, sections: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), sections.to_pylist()):
            if t is None:
                out.append(None)
                continue
            cutter = Cutter(t, tokenizer)
            if len(cutter.tokens) <= config.max_tokens:
                spans = [(0, len(t), None)]
            elif own and (found := cutter.placed([x or "" for x in own])):
                spans = [(*s, i) for i, outer in enumerate(found) for s in cutter.packed(outer, config)]
            else:
                spans = [(*s, None) for s in cutter.packed((0, len(t)), config)]
            out.append([{"start": a, "end": b, "n": cutter.count((a, b)), "section": i, "content": t[a:b]} for a, b, i in spans])
        return pa.array(out, _CHUNK)

    return run(text, parts)


def chunk(documents: DataFrame, config: ChunkingConfig | None = None, content: str = "content", document_id: str = "document_id",
    tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row a chunk: the document's other columns, chunk_id, chunk_index, content, char_start, char_end, n_tokens and,
    where ``documents`` has ``sections``, section_id and section_heading (else null).

    Without a tokenizer, texts of at most ``max_tokens`` words stay in the JVM.
    """
    config, text = config or ChunkingConfig(), F.col(content)
    sections = F.col("sections") if "sections" in documents.columns else F.expr("cast(null as array<struct<section_id:string,heading:string,content:string>>)")
    kept = [c for c in documents.columns if c not in (content, "sections", "chunk_id", "chunk_index", "char_start", "char_end", "n_tokens",
        "section_id", "section_heading")]
    rows = documents.where(text.isNotNull()).select(*kept, text.alias("_text"), F.filter(sections, lambda s: s["content"].isNotNull()).alias("_sections"))
    rows = rows.withColumn("_n", F.lit(None).cast("int") if tokenizer else word_count(F.col("_text")).cast("int"))
    long = F.when(F.coalesce(F.col("_n") > config.max_tokens, F.lit(True)), F.col("_text"))
    parts = F.when(long.isNotNull(), F.transform("_sections", lambda s: s["content"]))
    cut = rows.withColumn("_cut", chunk_spans(long, parts, config, tokenizer or words))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("_text").alias("end"), F.col("_n").alias("n"),
        F.lit(None).cast("int").alias("section"), F.col("_text").alias("content")))
    each = cut.select(*kept, "_sections", F.posexplode(F.coalesce("_cut", whole)).alias("chunk_index", "_c"))
    own = F.when(F.col("_c.section").isNotNull(), F.get("_sections", F.col("_c.section")))
    return each.select(
        *kept, F.concat(F.col(document_id).cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index",
            F.col("_c.content").alias("content"),
        F.col("_c.start").alias("char_start"), F.col("_c.end").alias("char_end"), F.col("_c.n").alias("n_tokens"),
            own["section_id"].alias("section_id"), own["heading"].alias("section_heading"),
    )
