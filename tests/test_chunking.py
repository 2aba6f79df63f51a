import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthika.operators.chunking import ChunkingConfig, chunk


def literal(text, target, most, repeat):
    """The rule, step by step, on one text."""
    n = lambda a, b: len(text[a:b].split())

    def trim(a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    if n(0, len(text)) <= most:
        return [(0, len(text))]
    units, at = [], 0
    paragraphs = []
    for m in re.finditer(r"\n\s*\n", text):
        paragraphs.append((at, m.start()))
        at = m.end()
    for a, b in [trim(*p) for p in [*paragraphs, (at, len(text))]]:
        if a == b:
            continue
        if n(a, b) <= most:
            units.append((a, b))
            continue
        ends = [a + m.end() for m in re.finditer(r"[.!?](?=\s)", text[a:b])]
        for x, y in [trim(*p) for p in zip([a, *ends], [*ends, b])]:
            if x == y:
                continue
            if n(x, y) <= most:
                units.append((x, y))
                continue
            words = [(x + m.start(), x + m.end()) for m in re.finditer(r"\S+", text[x:y])]
            units += [(g[0][0], g[-1][1]) for g in (words[i : i + target] for i in range(0, len(words), target))]
    packed = []
    for u in units:
        if packed and n(packed[-1][0], u[1]) <= most and n(*packed[-1]) < target:
            packed[-1] = (packed[-1][0], u[1])
        else:
            packed.append(u)
    out = packed[:1]
    for c in packed[1:]:
        words = [out[-1][0] + m.start() for m in re.finditer(r"\S+", text[out[-1][0] : out[-1][1]])]
        take = min(repeat, len(words))
        while take and n(words[-take], c[1]) > most:
            take -= 1
        wide = (words[-take], c[1]) if take else c
        out.append(c if wide == out[-1] else wide)
    return out


def spans(spark, texts, config):
    rows = chunk(spark.createDataFrame(list(enumerate(texts)), "document_id long, content string"), config).orderBy("document_id", "chunk_index").collect()
    got = [[] for _ in texts]
    for r in rows:
        assert r.content == texts[r.document_id][r.char_start : r.char_end]
        assert r.chunk_id == f"{r.document_id}:{r.chunk_index}" and r.n_tokens <= config.max_tokens
        got[r.document_id].append((r.char_start, r.char_end))
    return got


def test_against_the_literal_rule(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull()).select("text").collect()]
    config = ChunkingConfig(40, 60, 8)
    assert spans(spark, texts, config) == [literal(t, 40, 60, 8) for t in texts]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n", min_size=1, max_size=120), min_size=1, max_size=12))
def test_random_texts(spark, texts):
    assert spans(spark, texts, ChunkingConfig(3, 5, 2)) == [literal(t, 3, 5, 2) for t in texts]


def test_sections_and_null(spark):
    kind = "document_id string, content string, sections array<struct<section_id:string,heading:string,content:string>>, chunk_index string"
    s = [("S1", "A", "one two three four."), ("S2", "B", "five six seven.")]
    rows = [("d", "one two three four.\n\nfive six seven.", s, "x"), ("lost", "one two three four five six", [("S1", None, "not there")], None), ("none", None, s, None), ("small", "one", s, None)]
    out = chunk(spark.createDataFrame(rows, kind).drop("chunk_index"), ChunkingConfig(3, 4, 1)).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.content, r.section_id) for r in out] == [
        ("d", "one two three four.", "S1"), ("d", "five six seven.", "S2"), ("lost", "one two three", None), ("lost", "three four five six", None), ("small", "one", None),
    ]


def test_tokenizer_and_long_text(spark):
    import time

    letters = lambda t: [(i, i + 1) for i, c in enumerate(t) if c != " "]
    df = spark.createDataFrame([("a", "abcd efgh ij", 1), ("b", "ab", 2), ("n", None, 3), ("e", "", 4)], "document_id string, content string, n_tokens int")
    got = [(r.chunk_id, r.content, r.n_tokens) for r in chunk(df, ChunkingConfig(4, 5, 1), tokenizer=letters).orderBy("document_id", "chunk_index").collect()]
    assert got == [("a:0", "abcd", 4), ("a:1", "d efgh", 5), ("a:2", "h ij", 3), ("b:0", "ab", 2), ("e:0", "", 0)]
    # Ten times the text takes about ten times the time, not a hundred times.
    took = []
    for n in (2_000, 20_000):
        one = spark.createDataFrame([("x", "Some words stand here, and one more sentence. " * n)], "document_id string, content string")
        chunk(one).count()
        began = time.time()
        assert chunk(one).count() > n / 100
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1
