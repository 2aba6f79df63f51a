import unicodedata

from granthika.llm import confusables
from granthika.llm.queries import _visible_texts

KIND = "table_name string, row_no long, text string, class_id string"


def plain(t):
    table = {ord(c): (confusables._TO[i] if i < len(confusables._TO) else None) for i, c in enumerate(confusables._FROM)} | {ord(a): b for a, b in confusables.JOINED}
    return unicodedata.normalize("NFC", t.translate(table))


def brute(rows):
    groups, out = {}, set()
    for name, no, text in rows:
        if text is not None and plain(text).strip():
            groups.setdefault((name, plain(text)), []).append((no, text))
    for (name, _), own in groups.items():
        out |= {(name, min(a, b), max(a, b)) for i, (a, s) in enumerate(own) for b, t in own[i + 1 :] if s != t}
    return out


def test_given_texts(spark, sf_dir):
    rows = _visible_texts(spark, sf_dir)
    assert {tuple(r) for r in confusables.look_alike_pairs(rows).collect()} == brute([tuple(r) for r in rows.collect()])


def test_edges(spark):
    texts = ["Café ﬁne", "Café fine", "Саfé fine", "Cafe fine", "café fine", "Ｃａｆé fi​ne", "Café fine 1", "Café fine १", None, "", "​", "Café ﬁne", "co‑op", "co-op"]
    rows = [("t", i, t, "x") for i, t in enumerate(texts)] + [("u", 99, "Café fine", None)]
    got = {tuple(r)[1:] for r in confusables.look_alike_pairs(spark.createDataFrame(rows, KIND)).collect()}
    same = [0, 1, 2, 5, 11]
    assert got == {(a, b) for i, a in enumerate(same) for b in same[i + 1 :] if texts[a] != texts[b]} | {(12, 13)}
    canonical = {r.row_no: r.canonical_row for r in confusables.look_alike_members(spark.createDataFrame(rows, KIND)).collect()}
    assert canonical == dict.fromkeys(same, canonical[0]) | {12: 13, 13: 13}


def test_empty(spark):
    assert confusables.look_alike_pairs(spark.createDataFrame([], KIND)).count() == 0


def test_shapes_by_rule(spark):
    same = [("Fishing Ⅳ", "Fishing IV"), ("𝐁𝐢𝐥𝐥 𝟒", "Bill 4"), ("ﻛﺘﺎﺏ", "كتاب"), ("ﻻ", "لا"), ("ﬓ x", "մն x"), ("Ꮶerala", "Kerala"), ("ĳ", "ij"), ("ｱ", "ア"), ("co‑op", "co-op")]
    other = [("x²", "x2"), ("½", "1/2"), ("①", "1"), ("ß", "ss"), ("é", "e"), ("Ａ", "a"), ("№ 1", "No 1")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*same, *other])], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(confusables.look(df.a) == confusables.look(df.b)).collect()]
    assert got == [True] * len(same) + [False] * len(other)


def test_classes_count_links_without_pairs(spark):
    rows = [("t", i, x, None) for i, x in enumerate(["a-b"] * 5 + ["a‑b"] * 3 + ["a‐b"] + ["solo"])]
    df = spark.createDataFrame(rows, KIND)
    classes = confusables.look_alike_classes(df).collect()
    assert sorted((r.canonical_row, r.n_rows, r.n_links) for r in classes) == [(0, 1, 8), (0, 3, 18), (0, 5, 20)]
    assert confusables.look_alike_pairs(df).count() == 23 == sum(r.n_links for r in classes) / 2
