from granthika.llm import leakage

DOCS, ITEMS = "doc_id long, text string, term string", "item_id long, item_text string, pos string"


def aligned(spark, docs, items, phrase=12):
    words = leakage.item_words(spark.createDataFrame(items, ITEMS))
    return leakage.aligned_words(leakage.build_index(spark.createDataFrame(docs, DOCS), 50), words, phrase)


def brute(docs, items, phrase=12):
    words = lambda t: [w for w in map(leakage.word, (t or "").lower().split()) if w]
    grams = {}
    for i, t, _ in items:
        w = words(t)
        for k in range(len(w) - phrase + 1):
            grams.setdefault(tuple(w[k : k + phrase]), set()).add(i)
    return {(d, i) for d, t, _ in docs for w in [words(t)] for k in range(len(w) - phrase + 1) for i in grams.get(tuple(w[k : k + phrase]), ())}


def test_word():
    assert [leakage.word(w) for w in ("abc", "(a-b),", "—", "'12'", "की।", "́x́")] == ["abc", "a-b", "", "12", "की", "x́"]


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text, "t") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.item_text, "p") for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in leakage.phrase_matches(aligned(spark, docs, items)).collect()} == brute(docs, items)


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(12))
    loud = item.upper().replace(" ", ", *\n")
    docs = [(1, item, "t"), (2, f"x {loud}! y", "t"), (3, item.replace("w5 ", ""), "t"), (4, None, None), (5, "", None), (1, item, "t"), (6, "a " * 30 + item + " a" * 30, None)]
    items = [(7, item, "p"), (8, item, "p"), (9, "too short", None), (10, None, None), (11, "a " * 12, None)]
    a = aligned(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in leakage.phrase_matches(a).collect()} == {(d, i) for d in (1, 2, 6) for i in (7, 8)} | {(6, 11)}
    near = aligned(spark, [(3, "w0 w1 w2 w3 w4 w6 w7 w8 w9 w10 w11 w12 w13", "t")], [(7, " ".join(f"w{i}" for i in range(14)), "p")], 5)
    assert [(r.doc_id, r.n_words) for r in leakage.proximity_matches(near, phrase=12).collect()] == [(3, 13)]


def test_empty(spark):
    assert leakage.phrase_matches(aligned(spark, [], [(1, "a " * 12, None)])).count() == 0
    assert leakage.phrase_matches(aligned(spark, [(1, "a " * 12, None)], [])).count() == 0


def brute_near(docs, items, slop=8, phrase=12):
    words = lambda t: [w for w in map(leakage.word, (t or "").lower().split()) if w]
    out = {}
    for d, t, _ in docs:
        for i, x, _ in items:
            bands = {}
            for p, w in enumerate(words(t)):
                for k, v in enumerate(words(x)):
                    if v == w:
                        for b in ((p - k) // slop, (p - k) // slop - 1):
                            bands.setdefault(b, set()).add(k)
            n = max(map(len, bands.values()), default=0)
            if n >= phrase:
                out[d, i] = max(n, out.get((d, i), 0))
    return out


def test_proximity_of_edited_texts(spark, tmp_path):
    from granthika.llm.queries import p7_proximity

    w = [f"w{i}" for i in range(24)]
    at = lambda i, *new: " ".join([*w[:i], *new, *w[i + 1 :]])
    texts = [at(5), at(5, "x"), at(11, "x"), at(12), " ".join(w[:12]), " ".join(w[:11]), " ".join([*w[:6], "x", "y", *w[6:12]]), " ".join([*w[:10], *["x"] * 30, *w[10:20]]), " ".join(x for i, x in enumerate(w) if i % 2), "z " * 500 + at(7, "x"), None, ""]
    items = [(1, " ".join(w), "p"), (2, at(5, "rare"), "p"), (3, " ".join(["rare1", *w[1:12], "rare2", "w12", "w13"]), "p"), (4, "a b " * 50, "p"), (5, "w1 w2", "p"), (6, None, "p")]
    docs = [(n, t, "t") for n, t in enumerate(texts)] + [(90, "b a " * 9, "t")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/eval_items.parquet")
    expected = brute_near(docs, items)
    assert {(0, 1), (1, 1), (0, 3), (1, 2), (6, 1), (8, 1)} <= expected.keys() and (5, 1) not in expected
    assert {(r.doc_id, r.item_id): r.n_words for r in p7_proximity(spark, str(tmp_path)).collect()} == expected
    words = leakage.item_words(spark.createDataFrame(items, ITEMS))
    index, none = leakage.build_index(spark.createDataFrame(docs, DOCS)), leakage.build_index(spark.createDataFrame([], DOCS))
    # Long texts in pieces, bands held without an array, items in blocks.
    for sizes in ({"piece": 2}, {"dense": 0}, {"item_words": 30}):
        assert {(r.doc_id, r.item_id): r.n_words for r in leakage.near_matches(index, words, **sizes).collect()} == expected
    assert leakage.near_matches(none, words).count() == leakage.near_matches(index, words.limit(0)).count() == 0


def test_index_holds_every_word_and_is_reused(spark, tmp_path):
    docs = [(i, f"One two, two {i}! — x{i % 7}", "t") for i in range(60)] + [(60, None, "t"), (None, "lost", "t")]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    index = leakage.build_index(read(), 40)
    got = sorted((d, p, r.term) for r in index.collect() for d, p in zip(r.docs, r.places))
    assert got == sorted((d, p, w) for d, t, _ in docs if t and d is not None for p, w in enumerate(filter(None, map(leakage.word, t.lower().split()))))
    assert leakage.build_index(read(), 40).inputFiles() == index.inputFiles()
    spark.createDataFrame(docs[:1], DOCS).write.mode("append").parquet(f"{tmp_path}/d")
    assert leakage.build_index(read(), 40).inputFiles() != index.inputFiles()
