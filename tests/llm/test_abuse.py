import numpy as np

from granthika.llm import abuse

CALM = ["The council of Napur approved 12 boats.", "Farmers in Lodur received seeds today.", "The report says work on roads is done.", "Nurses from Tadur visited the clinic in May."]
BAD = ["You are a filthy scumbag and nobody likes you.", "Go back where you came from, you vermin.", "I will break your legs, you pathetic idiot."]


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        own = [CALM[i] for i in rng.integers(0, len(CALM), 3)]
        bad = bool(rng.random() < 0.25)
        if bad:
            own.insert(int(rng.integers(0, 3)), BAD[rng.integers(0, len(BAD))])
        texts.append(" ".join(own)), labels.append(int(bad))
    return texts, labels


def test_tokens():
    assert [abuse.token(w) for w in ("Scum-bag!", "sc.um.bag", "b1tch", "poooorn", "क़मीना", "2,300/-", "...", "dam​n")] == ["scumbag", "scumbag", "bitch", "porn", abuse.token("क़मीना"), "0", "", "damn"]


def fitted(spark, texts, labels, terms=()):
    """(encoded documents, model) of texts with a label each; every third one more is unlabelled."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *texts[::3]])], "doc_id long, text string, p_abusive string")
    votes = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, annotator_id int, abusive int")
    encoded = abuse.encode(docs)
    return encoded, abuse.fit_on(encoded, votes, spark.createDataFrame(list(terms), "term string, severity int"))


def test_held_out_documents(spark):
    texts, labels = made(300)
    noisy = [1 - y if i % 25 == 0 else y for i, y in enumerate(labels)]
    _, model = fitted(spark, texts, noisy, [("scumbag", 2), ("vermin", 3)])
    assert np.all(np.diff(model.thresholds) > 0)
    more, truth = made(200, 1)
    rows = [(i, t, "x") for i, t in enumerate(more)] + [(900, None, "x"), (901, "", "x"), (902, "...", None), (903, f"{CALM[0]} {CALM[1]} {BAD[0]} {CALM[2]}", "y")]
    encoded = abuse.encode(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("source",))
    out = {r.doc_id: r for r in abuse.score(encoded, model).collect()}
    hits = [int(out[i].p_abusive > abuse.THRESHOLD) for i in range(200)]
    assert sum(h == y for h, y in zip(hits, truth)) >= 198
    assert out[900].p_abusive == 0 and out[901].expected_severity == 0 and out[902].worst_sentence is None
    assert out[903].worst_sentence == 2 and out[903].source == "y"
    worse = next(i for i in range(200) if truth[i] and BAD[1] in more[i])
    milder = next(i for i in range(200) if not truth[i])
    assert out[worse].expected_severity > 1 > out[milder].expected_severity


def test_counts_cover_the_whole_corpus(spark):
    texts = ["You are vile. Calm words here.", "Calm words here.", "Calm words here. Calm words here.", "You are vile.", "You are vile. Other words."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    votes = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, annotator_id int, abusive int")
    data = abuse.labelled_sentences(abuse.encode(docs), votes)
    encoder = abuse.Encoder()
    size = np.diff(np.append(data.starts, data.codes.size))
    known = {tuple(data.codes[a : a + n]): (x, u) for a, n, x, u in zip(data.starts, size, data.in_negative, data.unlabelled)}
    assert known == {tuple(encoder.sentence("You are vile.")): (0, 2), tuple(encoder.sentence("Calm words here.")): (1, 1)}
    vile = abuse.pair_codes(np.array(encoder.sentence("You are vile.")))
    calm = abuse.pair_codes(np.array(encoder.sentence("Calm words here.")))
    assert data.pair_counts[vile[1]] == 3 and data.pair_counts[calm[1]] == 4 and data.share == 0.2 and data.sampled == 0.4


def test_kinds_beyond_the_sample(spark):
    """The sample is about a quarter of the labelled documents and lacks many of the kinds; nearly all are found, and nothing else."""
    rng = np.random.default_rng(5)
    words = [a + b + c for a in ("ka", "lo", "mi", "tu", "se", "ro") for b in ("ba", "ne", "du", "pi", "go", "fa") for c in ("l", "n", "s", "r", "k")]
    kinds = [" ".join(rng.choice(words, 6)) + "." for _ in range(240)]
    bad, calm = kinds[:40], kinds[40:]
    truth = rng.random(4_800) < 0.08
    texts = [" ".join([*rng.choice(calm, 3), *([rng.choice(bad)] if y else [])]) for y in truth]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen = np.flatnonzero(rng.random(truth.size) < np.where(truth, 0.5, 0.1))
    votes = spark.createDataFrame([(int(i), 1, int(truth[i])) for i in chosen], "doc_id long, annotator_id int, abusive int")
    encoded = abuse.encode(docs)
    model = abuse.fit_on(encoded, votes, spark.createDataFrame([], "term string, severity int"), 150)
    found = np.zeros(truth.size, bool)
    found[[r.doc_id for r in abuse.score(encoded, model).where(f"p_abusive > {abuse.THRESHOLD}").collect()]] = True
    assert (found & truth).sum() >= 0.95 * truth.sum() and (found & truth).sum() >= 0.98 * found.sum()


def test_model_is_kept(spark, tmp_path, monkeypatch):
    texts, labels = made(60)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, annotator_id int, abusive int").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([("scumbag", 2)], "term string, severity int").write.parquet(f"{tmp_path}/t")
    tables = [spark.read.parquet(f"{tmp_path}/{x}") for x in "dlt"]
    first = abuse.stored_model(*tables, abuse.encode(tables[0]))
    monkeypatch.setattr(abuse, "train", lambda *_: 1 / 0)
    again = abuse.stored_model(*tables, abuse.encode(tables[0]))
    assert np.array_equal(first.weights, again.weights) and np.array_equal(first.thresholds, again.thresholds)


def test_fit_lowers_the_loss_of_grades():
    encoder = abuse.Encoder()
    codes, starts, _ = encoder.texts(["calm words here.", "rude words here.", "vile words here.", "worst words here."])
    grades = np.arange(4)
    model = abuse.fit(codes, starts, grades, grades, np.ones(4), rounds=300)
    raw = model.raw(codes, starts)
    assert np.all(np.diff(raw) > 0) and np.all(np.diff(model.thresholds) > 0)


def test_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b.", "x"), (2, "c d.", "x"), (3, None, "x")], "doc_id long, text string, abusive string")
    votes = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 2, 5), (3, 1, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, annotator_id int, abusive int")
    assert sorted(tuple(r) for r in abuse.labelled_documents(votes).collect()) == [(2, 1), (3, 1), (9, 1)]
    terms = spark.createDataFrame([("scumbag", 2), (None, 1), ("x", None)], "term string, severity int")
    encoded = abuse.encode(docs)
    for labels, words in ((votes, terms), (votes.limit(0), terms), (votes.limit(0), terms.limit(0))):
        assert abuse.score(encoded, abuse.fit_on(encoded, labels, words)).count() == 3
    none = abuse.encode(docs.limit(0))
    assert abuse.score(none, abuse.fit_on(none, votes, terms)).count() == 0
