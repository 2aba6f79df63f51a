from hypothesis import given, settings
from hypothesis import strategies as st

from granthika.llm import packing, tokens

DOC = "doc_key string, table_name string, source string, language string, organization string, text string, n_tokens string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=10), st.integers(1, 60))
def test_fullest_is_the_best_subset(sizes, room):
    counts = {s: sizes.count(s) for s in sizes}
    chosen = packing.fullest(sorted(counts), counts, room)
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums}
    assert sum(s * k for s, k in chosen) == max(x for x in sums if x <= room)
    assert all(sum(k for t, k in chosen if t == s) <= counts[s] for s in counts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_fill_takes_every_item_once(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    bins = list(packing.fill(dict(counts), 50))
    used = {}
    for b in bins:
        assert sum(s * k for s, k in b) <= 50
        for s, k in b:
            used[s] = used.get(s, 0) + k
    assert used == counts


def test_packing(spark):
    items = [(1, 10), (2, 25), (3, 0), (4, None), (5, 7), (6, 3), (7, 3), (8, 20)]
    out = packing.pack(spark.createDataFrame(items, "item_id long, n_tokens long"), spark.createDataFrame([(1, 10, "x"), (2, 30, "y"), (None, 5, "z")], "target_id long, capacity_tokens int, shard string"), 1000).collect()
    for target, cap in ((1, 10), (2, 30)):
        own = [r for r in out if r.target_id == target]
        sums, per_item = {}, {}
        for r in own:
            sums[r.kind, r.shard, r.container_no] = sums.get((r.kind, r.shard, r.container_no), 0) + r.n_tokens
            per_item.setdefault(r.item_id, []).append((r.first_token, r.n_tokens))
        assert max(sums.values()) <= cap
        assert {i: sum(n for _, n in p) for i, p in per_item.items()} == {i: n for i, n in items if n}
        assert all(len(p) == -(-sum(n for _, n in p) // cap) for p in per_item.values())
    assert len({(r.shard, r.container_no) for r in out if r.target_id == 2}) == 3
    empty = packing.pack(spark.createDataFrame([], "item_id long, n_tokens long"), spark.createDataFrame([], "target_id long, capacity_tokens int"))
    assert empty.count() == 0 and packing.fill_report(empty).count() == 0


def cells(cube):
    return {(r.table_name, r.source, r.language, r.organization): (r.n_documents, r.n_with_text, r.n_tokens) for r in cube.collect()}


def test_ledger_follows_changes(spark):
    one = [("a", "t", "s", "en", "o", "hello world", "x"), ("b", "t", "s", None, "o", "hello world", "x"), ("c", "t", "s", "en", "o", None, None), ("d", "t", "s", "en", "o", "bye", None)]
    two = [("a", "t", "s", "en", "o", "hello big world", "x"), ("b", "t", "s", None, "p", "hello world", "x"), ("c", "t", "s", "en", "o", None, None), ("e", "t", "r", "en", "o", "", None)]
    ledger = tokens.TokenLedger.fresh(spark)
    n = ledger.tokenizer.count
    first = cells(ledger.update(spark.createDataFrame(one, DOC)))
    assert first == {("t", "s", "en", "o"): (3, 2, n("hello world") + n("bye")), ("t", "s", "unknown", "o"): (1, 1, n("hello world"))}
    known = ledger.counts().count()
    assert known == 2
    second = cells(ledger.update(spark.createDataFrame(two, DOC)))
    assert second == cells(tokens.TokenLedger.fresh(spark).update(spark.createDataFrame(two, DOC)))
    assert second[("t", "s", "unknown", "p")] == (1, 1, n("hello world")) and ("t", "s", "unknown", "o") not in second
    assert ledger.counts().count() == known + 2
    assert cells(ledger.update(spark.createDataFrame([], DOC))) == {}


def test_totals_and_spellings(spark):
    rows = [("a", "t", "s", "en", "o", "x", None), ("b", "t", "r", "hi", "o", "y", None), ("c", "u", "all", "all", "all", "y", None)]
    t = {tuple(r)[1:5] if r.table_name == "t" else tuple(r)[:5]: r.n_documents for r in tokens.totals(tokens.TokenLedger.fresh(spark).update(spark.createDataFrame(rows, DOC))).collect()}
    assert t[("t", "all", "all", "o")] == 2 and t[("t", "s", "all", "all")] == 1 and t[("t", "all", "all", "all")] == 2
    assert {k[0] for k in t if k[1] == "u"} == {"cell", "source", "language", "organization", "table"}
    names = spark.createDataFrame([("MINISTRY OF SOIL & SEEDS ",), ("Min. of Soil and Seeds",), ("Deptt. of X",), ("www.A.example",), (" ",), (None,)], "x string")
    assert [r[0] for r in names.select(tokens.organization_slice(names.x)).collect()] == ["ministry of soil and seeds"] * 2 + ["department of x", "a.example", None, None]


def test_broken_json_is_salvaged(spark):
    from granthika.llm import releases

    whole = '{"sections": [{"section_id": "s", "content": "one \\"two\\"\\nthree"}, {"content": "four"}]}'
    kind = "id long, release_id string, content_json string, text string"
    rows = [(1, "r", whole, None), (2, "r", whole[:40], None), (3, "q", whole[: whole.index('"}')], None), (4, None, "no json", None), (5, None, None, None), (6, "s", whole, None), (7, "s", whole[: whole.index("}") + 1], None), (None, "z", whole, None)]
    got = {r.id: r.text for r in releases.latest_releases(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 'one "two"\nthree\nfour', 3: 'one "two"\nthree', 4: None, 5: None, 6: 'one "two"\nthree\nfour'}


def test_ledger_in_another_process(spark, tmp_path):
    """A second process goes on from the stored version; a broken update leaves no trace in the cube."""
    import subprocess
    import sys
    from pathlib import Path

    one = [(k, "t", "s", "en", "o", x, None) for k, x in (("a", "hello"), ("b", "hello"), ("c", "gone soon"))]
    two = [("a", "t", "s", "en", "o", "hello there", None), ("b", "t", "s", "en", "o", "hello", None)]
    path = f"{tmp_path}/ledger"
    ledger = tokens.TokenLedger(spark, path)
    ledger.update(spark.createDataFrame(one, DOC))
    spark.createDataFrame([("x",)], "wrong string").write.parquet(f"{path}/snapshot-2")
    code = f"""
from pyspark.sql import SparkSession
from granthika.llm import tokens
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
tokens.TokenLedger(s, {path!r}).update(s.createDataFrame({two!r}, {DOC!r}))
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2], timeout=300)
    assert ledger.version == 2 and cells(ledger.cube()) == cells(tokens.TokenLedger.fresh(spark).update(spark.createDataFrame(two, DOC)))
    assert ledger.counts().count() == 3
