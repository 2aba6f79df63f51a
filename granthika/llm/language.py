"""Missing or wrong document language labels.

Method: a bidirectional gated recurrent network reads the bytes of a text, labels every position with a language, and
the position probabilities are pooled over sentences and documents. It is trained here, in numpy, by backpropagation
through time on the known samples.

Bytes: a character takes one byte, and a shift byte stands before it where its block of 128 code points differs from that
of the previous non-ASCII character of the text; so scripts outside ASCII cost one position a character, not three.
Look-alike characters are mapped to plain ones, and runs of digits to one.

Sentences repeat within and across documents: texts are cut into sentences once, the network reads each distinct sentence
once and whole, however long, and its result is joined back by the sentence's hash. Sentences on very many pages are few,
so they are joined by broadcast, and no task gets all rows of one.

Position labels also part a sentence where its language changes: the best path over its words, with a price for each change.

Defined results: null text, text without letters and broken JSON have no segments and no language, but keep their row;
repeated rows each get theirs; a sentence is labelled as a whole text if its row has none that ends like a sentence.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.llm import confusables
from granthika.session import join_counted, materialise, stored

LANGUAGES = ("en", "hi", "mr", "bn", "ta", "te", "ur")
# Other notations of the languages above.
NOTATIONS = {
    "eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "mar": "mr", "marathi": "mr", "ben": "bn", "bengali": "bn", "bangla": "bn",
    "tam": "ta", "tamil": "ta", "tel": "te", "telugu": "te", "urd": "ur", "urdu": "ur",
} | {x: x for x in LANGUAGES}
NO_LANGUAGE = ("", "mul", "und", "unknown", "n/a", "na", "none", "null", "xx", "zxx", "mis", "-", "?")

HIDDEN = 16
#: To be raised with every change of the network or its training, so that stored weights aren't used on.
VERSION = 1
#: Sentence ends; a shorter piece than so many words is none.
ENDS, MIN_WORDS = ".!?।۔", 3
#: Positions (rows times longest) that are read together; a longer sentence is read alone.
TOGETHER = 512 * 512
#: Price of a change of language inside a sentence; a word's evidence is at most FAINTEST, so a stretch needs three words.
CHANGE, FAINTEST = 5.0, 4.0


# Bytes

_PLAIN = np.arange(0x10000, dtype=np.int64)
for _i, _c in enumerate(confusables._FROM):
    if ord(_c) >= _PLAIN.size:
        continue
    _PLAIN[ord(_c)] = ord(confusables._TO[_i]) if _i < len(confusables._TO) else -1


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, start of each text and the end of the last)."""
    joined = "\n".join(t.replace("\n", " ") for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points < 0x10000, _PLAIN[np.minimum(points, 0xFFFF)], points)
    points = points[points >= 0]
    points[points == 9] = 32
    text_no = np.cumsum(points == 10) - (points == 10)
    wide = np.flatnonzero(points >= 128)
    block = points[wide] >> 7
    block[(block == 12) | (block == 13)] = 12  # the two halves of the Arabic block
    shift = np.ones(wide.size, bool)
    shift[1:] = (block[1:] != block[:-1]) | (text_no[wide][1:] != text_no[wide][:-1])
    size = np.ones(points.size, np.int64)
    size[wide[shift]] = 2
    end = np.cumsum(size)
    out = np.zeros(end[-1] if end.size else 0, np.uint8)
    out[end - 1] = np.where(points < 128, points, 128 + (points & 127))
    out[end[wide[shift]] - 2] = 11 + block[shift] % 21
    stops = end[points == 10]
    return out, np.concatenate([[0], stops])


# The network


@dataclass
class BiGru:
    """One layer in each direction; ``table`` holds the input weights of each byte. Gates: update, reset, candidate."""

    table: np.ndarray  # 2, 256, 3H
    recurrent: np.ndarray  # 2, H, 3H
    bias: np.ndarray  # 2, H: of the candidate's recurrent part
    out: np.ndarray  # 2H, languages
    out_bias: np.ndarray

    def states(self, byte_rows: np.ndarray, active: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """States of all positions (time, row, H); rows are sorted by length, the longest first, ``active`` rows at each time."""
        steps, rows = byte_rows.shape
        h2 = 2 * HIDDEN
        states = np.zeros((steps, rows, HIDDEN), self.table.dtype)
        table, u, b = self.table[side], self.recurrent[side], self.bias[side]
        h = np.zeros((rows, HIDDEN), self.table.dtype)
        for t in range(steps):
            n = active[t]
            x = table[byte_rows[t, :n]]
            h = h[:n]
            a = h @ u
            gates = x[:, :h2] + a[:, :h2]
            np.tanh(gates, out=gates)  # sigmoid(2x) = (1 + tanh x) / 2; the factor 2 is part of the weights
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = a[:, h2:] + b
            q = np.tanh(x[:, h2:] + r * c)
            new = q + z * (h - q)
            if keep is not None:
                keep.append((h, z, r, c, q))
            states[t, :n] = h = new
        return states


def _sorted_rows(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by time and row, the same reversed, active rows by time) of rows that are sorted by length."""
    steps = int(lengths[0])
    t = np.arange(steps)[:, None]
    inside = t < lengths[None, :]
    forward = flat[np.where(inside, starts[None, :] + t, starts[None, :])]
    backward = flat[np.where(inside, starts[None, :] + lengths[None, :] - 1 - t, starts[None, :])]
    return forward, backward, inside.sum(axis=1)


def position_probabilities(net: BiGru, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities of all positions, row and time of each) of rows sorted by length, the longest first."""
    forward, backward, active = _sorted_rows(flat, starts, lengths)
    f, b = net.states(forward, active, 0), net.states(backward, active, 1)
    t = np.arange(forward.shape[0])[:, None]
    inside = t < lengths[None, :]
    time, row = np.nonzero(inside)
    logits = f[time, row] @ net.out[:HIDDEN] + b[lengths[row] - 1 - time, row] @ net.out[HIDDEN:] + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits, row, time


def read_positions(net: BiGru, flat: np.ndarray, bounds: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all positions, length of each text); texts of similar length are read together."""
    flat = flat.astype(np.intp)
    lengths = np.maximum(np.diff(bounds) - 1, 1)  # without the line end
    order = np.argsort(-lengths, kind="stable")
    found = np.zeros((flat.size, len(LANGUAGES)), np.float32)
    i = 0
    while i < order.size:
        own = order[i : i + max(1, min(rows, TOGETHER // int(lengths[order[i]])))]
        i += own.size
        p, row, time = position_probabilities(net, flat, bounds[:-1][own], lengths[own])
        found[bounds[:-1][own][row] + time] = p
    return found, lengths


def pooled(net: BiGru, texts: list[str]) -> np.ndarray:
    """Mean probabilities of each text's positions."""
    flat, bounds = encode(texts)
    found, lengths = read_positions(net, flat, bounds)
    return _means(found, bounds[:-1], lengths)


def _means(found: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Means over spans that don't overlap and rise."""
    edges = np.stack([starts, starts + lengths], axis=1).ravel()
    padded = np.concatenate([found, np.zeros((1, found.shape[1]), found.dtype)])
    return np.add.reduceat(padded.astype(np.float64), edges, axis=0)[::2] / lengths[:, None] if starts.size else np.zeros((0, found.shape[1]))


def stretches(flat: np.ndarray, bounds: np.ndarray, found: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, characters, confidence) of the stretches of all texts, in their order."""
    inside = np.zeros(flat.size, bool)
    begin = np.zeros(flat.size, bool)
    starts = bounds[:-1]
    marks = np.zeros(flat.size + 1, np.int64)
    np.add.at(marks, starts, 1), np.add.at(marks, starts + lengths, -1)
    inside = np.cumsum(marks[:-1]) > 0
    begin[starts] = True
    begin[1:] |= (flat[:-1] == 32) & inside[1:] & inside[:-1]
    word_at = np.flatnonzero(begin)
    word_text = np.searchsorted(starts, word_at, side="right") - 1
    word_size = np.append(word_at[1:], 0) - word_at
    last = np.append(word_text[1:] != word_text[:-1], True)
    word_size[last] = (starts + lengths)[word_text[last]] - word_at[last]
    evidence = np.maximum(np.log(np.maximum(_means(found, word_at, word_size), 1e-9)), -FAINTEST)
    # Best path over the words of each text, all texts at once, the one with most words first.
    n_words = np.bincount(word_text, minlength=starts.size)
    first = np.cumsum(n_words) - n_words
    order = np.argsort(-n_words, kind="stable")
    active = np.searchsorted(-n_words[order], -np.arange(n_words.max(initial=0)), side="left")
    score, back = evidence[first[order]] if starts.size else evidence, []
    for t in range(1, active.size):
        n = active[t]
        best = score[:n].argmax(axis=1)
        change = score[np.arange(n), best] - CHANGE
        back.append(np.where(score[:n] >= change[:, None], np.arange(len(LANGUAGES)), best[:, None]))
        score[:n] = np.maximum(score[:n], change[:, None]) + evidence[first[order[:n]] + t]
    label = np.zeros(word_at.size, np.int64)
    at = score.argmax(axis=1) if starts.size else np.zeros(0, np.int64)
    for t in range(active.size - 1, -1, -1):
        n = active[t]
        label[first[order[:n]] + t] = at[:n]
        if t:
            at[:n] = back[t - 1][np.arange(n), at[:n]]
    new = np.append(True, (label[1:] != label[:-1]) | (word_text[1:] != word_text[:-1])) if label.size else np.zeros(0, bool)
    own = np.flatnonzero(new)
    size = np.add.reduceat(word_size, own) if own.size else word_size
    characters = np.add.reduceat(np.append((flat < 11) | (flat > 31), 0)[: flat.size] * inside, word_at[own]) if own.size else size
    return word_text[own], label[own], characters, _means(found, word_at[own], size)[np.arange(own.size), label[own]]


# Training


def _gradients(net: BiGru, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradient, by backpropagation through time."""
    forward, backward, active = _sorted_rows(flat, starts, lengths)
    kept: tuple[list, list] = ([], [])
    f, b = net.states(forward, active, 0, kept[0]), net.states(backward, active, 1, kept[1])
    steps, rows = forward.shape
    time, row = np.nonzero(np.arange(steps)[:, None] < lengths[None, :])
    back = lengths[row] - 1 - time
    both = np.concatenate([f[time, row], b[back, row]], axis=1)
    logits = both @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    target = targets[starts[row] + time]
    loss = float(-np.log(np.maximum(p[np.arange(row.size), target], 1e-9)).mean())
    p[np.arange(row.size), target] -= 1
    p /= row.size
    d_both = p @ net.out.T
    d_out, d_out_bias = both.T @ p, p.sum(axis=0)
    d_table, d_rec, d_bias = np.zeros_like(net.table), np.zeros_like(net.recurrent), np.zeros_like(net.bias)
    h2 = 2 * HIDDEN
    for side, (bytes_, at) in enumerate(((forward, time), (backward, back))):
        d_state = np.zeros((steps, rows, HIDDEN), net.table.dtype)
        d_state[at, row] = d_both[:, side * HIDDEN : (side + 1) * HIDDEN]
        carry = np.zeros((rows, HIDDEN), net.table.dtype)
        u = net.recurrent[side]
        grads, which = [], []
        for t in range(steps - 1, -1, -1):
            n = active[t]
            h, z, r, c, q = kept[side][t]
            d = d_state[t, :n] + carry[:n]
            d_q = d * (1 - z) * (1 - q * q)
            d_r = d_q * c
            d_a = np.concatenate([d * (h - q) * z * (1 - z) * 2, d_r * r * (1 - r) * 2, d_q * r], axis=1)
            d_x = d_a.copy()
            d_x[:, h2:] = d_q
            grads.append(d_x)
            which.append(bytes_[t, :n])
            d_rec[side] += h.T @ d_a
            d_bias[side] += d_a[:, h2:].sum(axis=0)
            carry[:n] = d * z + d_a @ u.T
        np.add.at(d_table[side], np.concatenate(which), np.concatenate(grads))
    return loss, [d_table, d_rec, d_bias, d_out, d_out_bias]


def train(samples: list[tuple[str, str]], steps: int = 320, rows: int = 48, window: int = 90, seed: int = 7) -> BiGru:
    """Fits the network to (text, language) samples: windows over sentences of one or two languages, in changing case."""
    rng = np.random.default_rng(seed)
    by_language: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for text, language in samples:
        if text and language in by_language:
            # Hindi in Latin letters is a kind of its own when samples are drawn, else it would be rare.
            by_language.setdefault(language + "-latin", []) if text.isascii() and language != "en" else None
            by_language[language + "-latin" if text.isascii() and language != "en" else language] += [digits_to_zero(s) for s in split_sentences(text)]
    kinds = [k for k, v in by_language.items() if v]
    scale = 0.3
    net = BiGru(
        (rng.normal(0, scale, (2, 256, 3 * HIDDEN))).astype(np.float32), rng.normal(0, 1 / np.sqrt(HIDDEN), (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        np.zeros((2, HIDDEN), np.float32), rng.normal(0, scale, (2 * HIDDEN, len(LANGUAGES))).astype(np.float32), np.zeros(len(LANGUAGES), np.float32),
    )
    if not kinds:
        return net
    params = [net.table, net.recurrent, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        texts, targets = [], []
        for _ in range(rows):
            parts, labels = [], []
            for _ in range(1 if rng.random() < 0.75 else 2):
                kind = kinds[rng.integers(len(kinds))]
                s = by_language[kind][rng.integers(len(by_language[kind]))]
                cut = int(rng.integers(0, max(1, len(s) - window))) if rng.random() < 0.4 else 0
                dice = rng.random()
                s = s[cut : cut + window] if dice > 0.24 else s[cut : cut + window].upper() if dice < 0.12 else s[cut : cut + window].lower()
                if rng.random() < 0.2:
                    s = s.rstrip(ENDS)
                parts.append(s), labels.append(LANGUAGES.index(kind[:2]))
            texts.append(parts), targets.append(labels)
        whole = [" ".join(p) for p in texts]
        flat, bounds = encode(whole)
        first, first_bounds = encode([p[0] for p in texts])
        lengths = np.maximum(np.diff(bounds) - 1, 1)
        own = np.zeros(flat.size, np.int64)
        for i, labels in enumerate(targets):
            split = bounds[i] + (first_bounds[i + 1] - first_bounds[i] - 1 if len(labels) > 1 else lengths[i] + 1)
            own[bounds[i] : split] = labels[0]
            own[split : bounds[i + 1]] = labels[-1]
        order = np.argsort(-lengths, kind="stable")
        _, grads = _gradients(net, flat.astype(np.intp), bounds[:-1][order], lengths[order], own)
        rate = 0.012 * min(1.0, 2.2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, (m, v) in zip(params, grads, moments):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def stored_network(spark: SparkSession, samples: list[tuple[str, str]]) -> BiGru:
    """The network of these samples; it is trained once, and its weights are kept in the shared folder."""

    def made() -> DataFrame:
        kept = io.BytesIO()
        np.savez(kept, *vars(train(samples)).values())
        return spark.createDataFrame([(bytearray(kept.getvalue()),)], "weights binary")

    mark = hashlib.sha256(repr((VERSION, samples)).encode()).hexdigest()[:32]
    with np.load(io.BytesIO(bytes(stored(spark, "network", mark, made).first().weights))) as kept:
        return BiGru(*[kept[f"arr_{i}"] for i in range(5)])


# Sentences

_CUT = re.compile(rf"(?<=[{ENDS}])\s+|[\n\r]+")
_DIGITS = re.compile(r"\d+")


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _CUT.split(text)) if s]


def digits_to_zero(text: str) -> str:
    return _DIGITS.sub("0", text)


def sentence_rows(rows: DataFrame) -> DataFrame:
    """table_name, row_no, label, seg_no, sentence (digits as 0), key, n_chars and ``whole`` (ends like a sentence) of ``rows``
    (table_name, row_no, label, text), written once; a row without any sentence has one line with nulls.
    """
    cut = F.split(F.regexp_replace("text", r"\p{Nd}+", "0"), rf"(?<=[{ENDS}])[\s\p{{Z}}]+|[\n\r]+")
    worded = F.filter(F.transform(cut, lambda s, i: F.struct(i.alias("seg_no"), s.alias("sentence"))), lambda x: x["sentence"].rlike(r"\p{L}"))
    parts = rows.select("table_name", "row_no", "label", F.explode_outer(worded).alias("x")).select("table_name", "row_no", "label", "x.*")
    return materialise(parts.withColumns({
        "n_chars": F.length("sentence"),
        "whole": F.col("sentence").rlike(rf"[{ENDS}][\"'”’)\]]*[\s\p{{Z}}]*$") & (F.size(F.split(F.trim("sentence"), r"[\s\p{Z}]+")) >= MIN_WORDS),
        "key": F.when(F.col("sentence").isNotNull(), F.xxhash64("sentence")),
    }), "sentences")


def classify(sentences: DataFrame, net: BiGru, inside: bool = False) -> DataFrame:
    """key, n (occurrences), language, confidence, p (probabilities) and, if asked for, parts of each distinct sentence."""
    shared = sentences.sparkSession.sparkContext.broadcast(net)
    names = np.array(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, bounds = encode(pdf["sentence"].tolist())
            found, lengths = read_positions(shared.value, flat, bounds)
            p = _means(found, bounds[:-1], lengths)
            owner, label, size, sure = stretches(flat, bounds, found, lengths) if inside else [np.zeros(0, np.int64)] * 4
            own = [{"n_chars": c, "language": x, "confidence": f} for c, x, f in zip(size.tolist(), names[label].tolist(), sure.tolist())]
            cuts = np.searchsorted(owner, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"key": pdf["key"], "n": pdf["n"], "language": names[p.argmax(axis=1)], "confidence": p.max(axis=1), "p": list(p.astype(np.float32)), "parts": [own[a:b] for a, b in zip(cuts[:-1], cuts[1:])]})

    distinct = sentences.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("sentence").alias("sentence"), F.count("*").alias("n"))
    return distinct.mapInPandas(run, "key long, n long, language string, confidence double, p array<float>, parts array<struct<n_chars:int,language:string,confidence:double>>")


def labelled_sentences(rows: DataFrame, net: BiGru, inside: bool = False) -> DataFrame:
    """Every sentence of every row with what ``classify`` says of it; rows without sentences keep their line of nulls."""
    sentences = sentence_rows(rows)
    found = materialise(classify(sentences, net, inside), "labels")
    return join_counted(sentences.drop("sentence"), found, "key", "n", "left")


def segments(rows: DataFrame, net: BiGru) -> DataFrame:
    """table_name, row_no, seg_no, part_no, n_chars, language, confidence: the stretches of every sentence in one language."""
    each = labelled_sentences(rows, net, True).select("table_name", "row_no", "seg_no", F.posexplode("parts").alias("part_no", "x"))
    return each.select("table_name", "row_no", "seg_no", "part_no", "x.*")


def document_languages(sentences: DataFrame) -> DataFrame:
    """table_name, row_no, label, languages (sorted, of whole sentences), main language and its pooled probability, of
    ``labelled_sentences``; rows without sentences have an empty array and nulls.
    """
    mean = [F.sum(F.get("p", F.lit(i)) * F.col("n_chars")).alias(f"_{x}") for i, x in enumerate(LANGUAGES)]
    grouped = sentences.groupBy("table_name", "row_no").agg(
        F.first("label").alias("label"), F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("language")))).alias("_whole"), F.sort_array(F.collect_set("language")).alias("_any"), F.sum("n_chars").alias("_n"), *mean
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"_{x}").alias("score"), F.lit(x).alias("language")) for x in LANGUAGES]))
    return grouped.select(
        "table_name", "row_no", "label", F.when(F.size("_whole") > 0, F.col("_whole")).otherwise(F.col("_any")).alias("languages"),
        F.when(F.col("_n").isNotNull(), best["language"]).alias("main_language"), (best["score"] / F.col("_n")).alias("confidence"),
    )


def named_languages(label: Column) -> Column:
    """Sorted codes that a label names; unknown names stay as they are, placeholders name none."""
    known = F.create_map(*[F.lit(x) for pair in NOTATIONS.items() for x in pair])
    names = F.transform(F.split(F.lower(F.coalesce(label, F.lit(""))), "[,;+]"), lambda x: F.regexp_replace(F.trim(x), r"[-_].*$", ""))
    real = F.filter(names, lambda x: ~x.isin(*NO_LANGUAGE))
    return F.sort_array(F.array_distinct(F.transform(real, lambda x: F.coalesce(F.try_element_at(known, x), x))))
