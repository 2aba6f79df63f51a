import numpy as np
import pytest
from pyspark.sql import functions as F

from granthika.llm import language as L


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return [(r.sample_text, r.language) for r in spark.read.parquet(f"{sf_dir}/lang_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def net(samples):
    return L.train(samples[::2], steps=200)


def test_held_out_sentences(net, samples):
    rest = [(L.digits_to_zero(s), lang) for t, lang in samples[1::2] for s in L.split_sentences(t)]
    p = L.pooled(net, [s for s, _ in rest])
    assert np.mean([L.LANGUAGES[k] == lang for k, (_, lang) in zip(p.argmax(axis=1), rest)]) > 0.97
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = L.BiGru(rng.normal(0, 0.3, (2, 256, 3 * L.HIDDEN)), rng.normal(0, 0.3, (2, L.HIDDEN, 3 * L.HIDDEN)), rng.normal(0, 0.3, (2, L.HIDDEN)), rng.normal(0, 0.3, (2 * L.HIDDEN, 7)), np.zeros(7))
    flat, bounds = L.encode(["abca", "नम"])
    lengths = np.diff(bounds) - 1
    order = np.argsort(-lengths, kind="stable")
    target = rng.integers(0, 7, flat.size)
    loss = lambda: L._gradients(net, flat.astype(int), bounds[:-1][order], lengths[order], target)
    _, grads = loss()
    for param, grad in zip((net.table, net.recurrent, net.bias, net.out), grads):
        for at in [np.unravel_index(i, param.shape) for i in np.argsort(-np.abs(grad).ravel())[:3]]:
            kept = param[at]
            param[at] = kept + 1e-5
            up = loss()[0]
            param[at] = kept - 1e-5
            down = loss()[0]
            param[at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_bytes():
    flat, bounds = L.encode(["aн", "é क", ""])
    assert len(bounds) == 4 and bounds[-1] == flat.size and flat[bounds[1] - 1] == 10


def test_rows(spark, net):
    hindi = "राज्य मंत्री ने कहा कि 57 महिलाओं ने वशीपुर में प्रशिक्षण पूरा कर लिया है।"
    english = "The committee will review the scheme and submit a report within 30 days."
    rows = [("t", 1, f"{english}\n{hindi} {english}", "x"), ("t", 2, None, None), ("t", 3, " \n123", None), ("t", 4, hindi, None), ("t", 5, english * 400, None), ("t", 5, hindi, None)]
    df = spark.createDataFrame(rows, "table_name string, row_no long, text string, label string")
    found = {r.row_no: r for r in L.document_languages(L.labelled_sentences(df, net)).collect()}
    assert found[1].languages == ["en", "hi"] and found[4].languages == ["hi"] and found[1].confidence < 1.0001 and set(found) == {1, 2, 3, 4, 5}
    assert found[2].languages == found[3].languages == [] and found[3].confidence is None and found[2].main_language is None and found[1].label == "x"
    assert L.segments(df.limit(0), net).count() == 0


def test_hot_sentences_by_broadcast(spark, net, monkeypatch):
    english, tamil = "The committee will review the scheme and submit a report.", "இந்த திட்டம் அடுத்த மாதம் தொடங்கும் என்று அமைச்சர் கூறினார்."
    rows = [("t", i, english if i < 1500 else f"{tamil}", "en") for i in range(1510)]
    df = spark.createDataFrame(rows, "table_name string, row_no long, text string, label string")
    found = L.document_languages(L.labelled_sentences(df, net)).groupBy("main_language").count().collect()
    assert sorted(tuple(r) for r in found) == [("en", 1500), ("ta", 10)]


def test_stretches_inside_a_sentence(net):
    english, bengali = "the committee of the state will review the whole scheme", "মন্ত্রক এই প্রকল্পের জন্য টাকা বরাদ্দ করেছে বলে জানা গেছে"
    texts = [english + " " + bengali, bengali, english + " " + bengali + " " + english, "x", english + " মন্ত্রক"]
    flat, bounds = L.encode(texts)
    found, lengths = L.read_positions(net, flat, bounds)
    owner, label, size, sure = L.stretches(flat, bounds, found, lengths)
    got = [[L.LANGUAGES[k] for k in label[owner == i]] for i in range(len(texts))]
    assert got[0] == ["en", "bn"] and got[1] == ["bn"] and got[2] == ["en", "bn", "en"] and len(got[3]) == 1 and got[4] == ["en"]
    assert [int(size[owner == i].sum()) for i in range(len(texts))] == [len(t) for t in texts] and sure[:3].min() > 0.5
    assert abs(size[0] - len(english)) <= 1


def test_long_sentences_are_read_whole(net, samples):
    """A sentence gives the same read alone, among others, or in a small block; no length is a bound."""
    own = " ".join(t.replace("\n", " ") for t, lang in samples if lang == "en")[:30_000]
    short = "The report is here."
    together, alone = L.pooled(net, [own, short]), np.concatenate([L.pooled(net, [own]), L.pooled(net, [short])])
    assert np.allclose(together, alone, atol=1e-5)
    flat, bounds = L.encode([own])
    p, _, _ = L.position_probabilities(net, flat.astype(np.intp), bounds[:-1], np.diff(bounds) - 1)
    assert np.allclose(p.mean(axis=0), together[0], atol=1e-4)


def test_stored_network(spark, samples, monkeypatch):
    few = samples[:40]
    monkeypatch.setattr(L, "train", lambda s: L.BiGru(*[np.full((2, 2), len(s) + i, np.float32) for i in range(5)]))
    first = L.stored_network(spark, few)
    monkeypatch.setattr(L, "train", lambda s: 1 / 0)
    again = L.stored_network(spark, few)
    assert all(np.array_equal(a, b) for a, b in zip(vars(first).values(), vars(again).values()))


def test_labels(spark):
    rows = ["en-IN", "HI", "te; en,EN", "mul", None, " ", "N/A", "Marathi+ur_PK", "fr"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(L.named_languages(F.col("x"))).collect()]
    assert got == [["en"], ["hi"], ["en", "te"], [], [], [], [], ["mr", "ur"], ["fr"]]
