import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from granthika.llm import sitelines
from granthika.llm.queries import _pages

KIND = "record_no long, doc_id string, org string, raw_text string, h string"


def brute(rows):
    docs, lines, places = defaultdict(set), defaultdict(set), []
    for no, doc, org, raw in rows:
        if org is None:
            continue
        docs[org].add(doc)
        for i, line in enumerate((raw or "").split("\n")):
            form = re.sub(r"\d+", "0", re.sub(r"\s+", "", line.lower()))
            if raw is not None and form:
                lines[org, form].add(doc)
                places.append((org, form, no, i))
    good = {k for k, v in lines.items() if len(v - {None}) >= 5 and 5 * len(v - {None}) >= len(docs[k[0]] - {None})}
    return {(no, i) for org, form, no, i in places if (org, form) in good}


def test_given_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rows = [tuple(r) for r in pages.select("record_no", "doc_id", "org", "raw_text").collect()]
    found = sitelines.occurrences_of(*sitelines.repeated_lines(pages))
    assert {tuple(r) for r in found.collect()} == brute(rows) and found.count() == len(brute(rows))


def test_edges(spark):
    rows = [(i, f"d{i}", "a", f"Legal  notice {i}\nunique {chr(97 + i)}\n\n", "x") for i in range(8)]
    rows += [(100, "d0", "a", "LEGAL NOTICE 77", "x"), (101, None, "a", "legal notice 1", None), (102, "z", None, "legal notice 1", None), (103, "y", "a", None, None), (104, "w", "b", "legal notice 1", None)]
    pages = spark.createDataFrame(rows, KIND)
    confirmed, places = sitelines.repeated_lines(pages)
    assert [tuple(r) for r in confirmed.collect()] == [("a", "legalnotice0", 8, 9)]
    assert {tuple(r) for r in sitelines.occurrences_of(confirmed, places).collect()} == {(i, 0) for i in range(8)} | {(100, 0), (101, 0)}
    clean = {r.record_no: (r.cleaned_text, r.lines_removed, r.h) for r in sitelines.without_lines(pages, confirmed).collect()}
    assert clean[0] == ("unique a\n\n", 1, "x") and clean[100][0] == "" and clean[102][0] == "legal notice 1" and clean[103][0] is None and clean[104][1] == 0


def test_empty(spark):
    confirmed, places = sitelines.repeated_lines(spark.createDataFrame([], KIND))
    assert confirmed.count() == 0 and sitelines.occurrences_of(confirmed, places).count() == 0


def test_summary_keeps_every_frequent_line(monkeypatch):
    monkeypatch.setattr(sitelines, "COUNTERS", 4)
    monkeypatch.setattr(sitelines, "PER_LINE", 0)
    pages = [[1, 2, 100 + i, 200 + i, 300 + i] for i in range(200)]
    parts = [pd.concat(sitelines.summarise([pd.DataFrame({"org": "a", "hs": [pd.Series(p).to_numpy() for p in pages[k::4]]})])) for k in range(4)]
    whole = pd.concat(parts)
    bound = whole["err"].sum()
    counts = whole.dropna(subset=["h"]).groupby("h")["n"].sum()
    assert all(counts.get(h, 0) <= 200 <= counts.get(h, 0) + bound for h in (1, 2))


def test_unsure_sites_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(sitelines, "_keep_largest", lambda counts, k: (type(counts)(), max(counts.values())))
    rows = [(i, f"d{i}", "a", f"legal\n{chr(97 + i)}", None) for i in range(8)]
    confirmed, _ = sitelines.repeated_lines(spark.createDataFrame(rows, KIND))
    assert [r.form for r in confirmed.collect()] == ["legal"]
    assert spark.range(1).select(F.lit(1)).first()[0] == 1


def test_pages_of_many_lines_keep_the_guarantee():
    """With 400 lines a page the error stays below a fifth of the pages, and the common line is found."""
    pages = [[1, *range(1000 + 400 * i, 1399 + 400 * i)] for i in range(300)]
    parts = [pd.concat(sitelines.summarise([pd.DataFrame({"org": "a", "hs": [pd.Series(p).to_numpy() for p in pages[k::3]]})])) for k in range(3)]
    whole = pd.concat(parts)
    assert whole["err"].sum() < 60 and whole.loc[whole["h"] == 1, "n"].sum() + whole["err"].sum() >= 300
