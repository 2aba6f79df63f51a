"""Abusive, hateful or sexual content.

Method: cumulative-link ordinal regression on sparse text features (hashed words and word pairs of one sentence), with one
weight vector shared by the ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k), k = 1..3. The output of a document is
that of its worst sentence: the expected severity (sum of the P) and P(grade >= 1).

Labels are on documents, so the abusive sentence of a positive document is found while fitting: the sentence with the
highest score takes the label, all sentences of negative documents take grade 0, and positive documents in which no
sentence scores stop counting (label noise). Sentences with a listed term take its severity as their grade; for others it
is known only that the grade is at least 1, and the likelihood is that of the open interval.

Texts are encoded once: the sentences of every document as feature codes are stored, and both the fit and the scores read
them. How often a labelled sentence, or a word pair of one, occurs is counted over all documents. The weights are fitted
to distinct sentences, which come to the driver as codes: all those of a bounded sample of labelled documents
(``max_labelled``, by hash of the id), and from every positive document beyond it those that can stand for its label. Counts are
brought to the sample's size, so that no side outweighs the other as the corpus grows. The model is stored, and every query
scores every sentence of every document with it.

Defined results: null and empty texts score 0; repeated documents score alike; labels other than 0 and 1, and documents
whose annotators are evenly split, aren't used; without any positive label the fit rests on the listed terms alone.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.session import broadcast_within, fingerprint, materialise, spread, stored

#: Labelled documents that the fit uses at most.
MAX_LABELLED = 9_000
#: A sentence can stand for a positive document if it is so many times as frequent there as elsewhere.
MIN_LIFT = 8.0
#: Weights of a pair's harmless uses in the whole corpus, and of a sentence's unlabelled ones, both in counts of the sample.
COMMON = 5.5
USUAL = 2.7
GRADES = 3
BITS = 19
SIZE = 1 << BITS
#: A document counts as abusive from this P(grade >= 1) of its worst sentence on.
THRESHOLD = 0.4
#: To be raised with every change of the codes or the fit, so that stored ones aren't used on.
VERSION = 4
SENTENCES = "codes array<int>, starts array<int>, hashes array<long>"

_START, _END, _NAME, _NUMBER, _NONE = 1, 2, 3, 4, 5
_SENTENCE = re.compile(r"(?<=[.!?।۔])\s+|[\n\r]+")
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_SPACED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z@$][ .\-]{1,3}){2,}[A-Za-z@$](?![A-Za-z])")
_REPEAT = re.compile(r"(.)\1{2,}")
_REMEMBERED = 400_000


def token(piece: str) -> str:
    """Lower case without punctuation and accents on Latin letters, with letter-like digits and drawn-out letters undone."""
    w = unicodedata.normalize("NFKD", piece).lower()
    core = w.strip("".join(c for c in set(w) if unicodedata.category(c)[0] in "PSC" and c not in "@$"))
    if not any(c.isalpha() for c in core):
        return "0" if any(c.isdigit() for c in core) else ""
    if core.isascii() and not core.isalpha():
        core = core.translate(_LEET)
    core = "".join(c for c in core if unicodedata.category(c)[0] in "LN" or unicodedata.category(c)[0] == "M" and not "̀" <= c <= "ͯ")
    return _REPEAT.sub(r"\1", core)


class _Codes(dict):
    """Piece to feature code; inside a sentence, capitalised Latin pieces are names."""

    def __init__(self, names: bool):
        super().__init__()
        self.names = names

    def __missing__(self, piece: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        w = token(piece)
        if not w:
            code = _NONE
        elif w == "0":
            code = _NUMBER
        elif self.names and piece[:1].isupper() and not (len(piece) > 1 and piece.isupper()):
            code = _NAME
        else:
            code = 8 + zlib.crc32(w.encode()) % (SIZE - 8)
        self[piece] = code
        return code


class Encoder:
    """Texts to feature codes of their sentences; one per task."""

    def __init__(self):
        self.first, self.inner = _Codes(False), _Codes(True)

    def sentence(self, s: str) -> list[int]:
        if _SPACED.search(s):
            s = _SPACED.sub(lambda m: re.sub(r"[ .\-]", "", m[0]), s)
        pieces = (s.lower() if s.isupper() else s).split()
        return [_START, self.first[pieces[0]], *map(self.inner.__getitem__, pieces[1:]), _END] if pieces else []

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of all sentences in a row, start of each sentence, text of each sentence)."""
        codes: list[int] = []
        starts, owner = [], []
        for i, text in enumerate(texts):
            for s in _SENTENCE.split(text) if text else ():
                own = self.sentence(s)
                if max(own, default=0) > _NONE or _NAME in own:  # a sentence without words is none
                    starts.append(len(codes))
                    owner.append(i)
                    codes += own
        flat, begin = np.array(codes, np.int64), np.array(starts, np.int64)
        keep = np.ones(flat.size, bool)
        keep[1:] = (flat[1:] != flat[:-1]) | (flat[1:] != _NAME)  # a name of several words counts as one
        return flat[keep], begin - np.append(0, np.cumsum(~keep))[begin], np.array(owner, np.int64)


def pair_codes(codes: np.ndarray) -> np.ndarray:
    """Feature of each word with the next one."""
    after = np.append(codes[1:], 0)
    return (codes * 1_000_003 + after * 7_919 + 17) % SIZE


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, SIZE
    thresholds: np.ndarray  # GRADES, increasing

    def raw(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """w.x of each sentence; x has 1/sqrt(words) at each of its features."""
        each = self.weights[codes] + self.weights[pair_codes(codes)]
        lengths = np.diff(np.append(starts, codes.size))
        return np.add.reduceat(each, starts) / np.sqrt(lengths)

    def at_least(self, raw: np.ndarray) -> np.ndarray:
        """P(grade >= k), one row per k."""
        return 1 / (1 + np.exp(-(raw[None, :] - self.thresholds[:, None])))


def fit(codes: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, rounds: int = 120, l2: float = 2e-6, begin: OrdinalModel | None = None) -> OrdinalModel:
    """Weighted maximum likelihood by Adam; a sentence's grade lies in [low, high]."""
    lengths = np.diff(np.append(starts, codes.size))
    scale = np.repeat(1 / np.sqrt(lengths), lengths)
    pairs = pair_codes(codes)
    w = begin.weights.astype(np.float64) if begin else np.zeros(SIZE)
    t = begin.thresholds.copy() if begin else np.array([2.0, 3.0, 4.0])
    gaps = np.concatenate([t[:1], np.log(np.diff(t))])
    m, v, mt, vt = np.zeros(SIZE), np.zeros(SIZE), np.zeros(GRADES), np.zeros(GRADES)
    total = weight.sum()
    for step in range(1, rounds + 1):
        t = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
        s = np.add.reduceat((w[codes] + w[pairs]) * scale, starts)
        p = np.vstack([np.ones_like(s), 1 / (1 + np.exp(-np.clip(s[None, :] - t[:, None], -30, 30))), np.zeros_like(s)])
        at = np.arange(s.size)
        lower, upper = p[low, at], p[high + 1, at]
        mass = np.maximum(lower - upper, 1e-9)
        up = weight * (1 - lower - upper) / total
        slope = p * (1 - p)
        gt = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            gt[k - 1] = np.sum(weight * ((high + 1 == k) * slope[k] - (low == k) * slope[k]) / mass) / total
        gw = np.bincount(codes, weights=np.repeat(up, lengths) * scale, minlength=SIZE) + np.bincount(pairs, weights=np.repeat(up, lengths) * scale, minlength=SIZE) - l2 * w
        gg = np.concatenate([[gt.sum()], [gt[i:].sum() * np.exp(gaps[i]) for i in range(1, GRADES)]])
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gg, 0.99 * vt + 0.01 * gg * gg
        rate = 0.2 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w += rate * m / (np.sqrt(v) + 1e-7)
        gaps += 0.2 * rate * mt / (np.sqrt(vt) + 1e-7)
    return OrdinalModel(w.astype(np.float32), np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))]))


def encode(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, and the sentences of each document: codes of all in a row, start and hash of each.

    Written once for the documents' files. Null and empty texts have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for pdf in batches:
            codes, starts, owner = encoder.texts(pdf.pop("text").tolist())
            small, ends = codes.astype(np.int32), np.append(starts, codes.size)
            hashes = np.array([xxhash.xxh3_64_intdigest(small[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], np.uint64).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(len(pdf) + 1))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            yield pdf.assign(codes=[small[ends[a] : ends[b]] for a, b in spans], starts=[(starts[a:b] - ends[a]).astype(np.int32) for a, b in spans], hashes=[hashes[a:b] for a, b in spans])

    own = documents.select("doc_id", *keep, "text")
    kinds = ", ".join(f"{c} {t}" for c, t in own.dtypes[:-1])
    return stored(documents.sparkSession, "abuse-sentences", fingerprint(documents, keep, VERSION), lambda: spread(own).mapInPandas(run, f"{kinds}, {SENTENCES}"))


@dataclass
class Labelled:
    """Distinct sentences of the labelled sample and the telling ones of all other positive documents, with counts over all documents."""

    codes: np.ndarray  # of all sentences in a row
    starts: np.ndarray
    in_negative: np.ndarray  # documents of the sample labelled 0 that hold the sentence
    unlabelled: np.ndarray  # documents without a label that hold it, of the whole corpus
    telling: np.ndarray  # whether it is so frequent in documents labelled 1 that it can stand for them
    pos_number: np.ndarray  # sentences of the documents labelled 1 (beyond the sample the telling ones), and the document of each
    pos_owner: np.ndarray
    pair_counts: np.ndarray  # sentences of the whole corpus that hold a pair, for the pairs of positive sentences
    pos_pair_counts: np.ndarray  # those of all documents labelled 1
    share: float  # of documents labelled 1 among all
    labelled: float  # of labelled documents among all
    sampled: float  # of the sample's documents among all


def _common_pairs(data: Labelled) -> tuple[np.ndarray, np.ndarray]:
    """(neighbouring words of positive sentences, how much more often they stand in the corpus than the labels explain).

    A labelled document stands for 1 / ``labelled`` documents. What goes beyond that is harmless use, and counts as such.
    """
    last = np.append(data.starts[1:], data.codes.size) - 1
    number = np.repeat(np.arange(data.starts.size), np.diff(np.append(data.starts, data.codes.size)))
    at = np.flatnonzero(np.isin(number, data.pos_number) & ~np.isin(np.arange(data.codes.size), last))
    if not at.size:
        return np.zeros((0, 2), np.int64), np.zeros(0)
    kept, first = np.unique(pair_codes(data.codes)[at], return_index=True)
    excess = np.maximum(data.pair_counts[kept] - data.pos_pair_counts[kept] / data.labelled, 0)
    words = at[first][excess > 0]
    return np.stack([data.codes[words], data.codes[np.minimum(words + 1, data.codes.size - 1)]], axis=1), excess[excess > 0]


def train(data: Labelled, terms: list[tuple[str, int]], passes: int = 8) -> OrdinalModel:
    """Fits the model to labelled sentences and to the listed terms with their severities.

    Sentences of negative documents have grade 0. In a positive document the sentence with the highest score has the
    label; only sentences that are much more frequent there than in the whole corpus can.
    """
    encoder, n = Encoder(), data.starts.size
    tcodes, tstarts, towner = encoder.texts([t for t, _ in terms])
    severity = np.array([g for _, g in terms], np.int64)[towner]
    common, excess = _common_pairs(data)
    codes = np.concatenate([data.codes, tcodes, common.ravel()]).astype(np.int64)
    starts = np.concatenate([data.starts, tstarts + data.codes.size, data.codes.size + tcodes.size + 2 * np.arange(excess.size)]).astype(np.int64)
    if not starts.size:
        return OrdinalModel(np.zeros(SIZE, np.float32), np.array([2.0, 3.0, 4.0]))
    lengths = np.diff(np.append(starts, codes.size))
    pairs = pair_codes(codes)
    term_rows, common_rows = n + np.arange(tstarts.size), n + tstarts.size + np.arange(excess.size)

    # The grade of a sentence is that of the listed terms in it.
    grade = np.zeros(starts.size, np.int64)
    listed = {tuple(encoder.sentence(t)[1:-1]): g for t, g in terms}
    for j in np.unique(data.pos_number):
        words = codes[starts[j] + 1 : starts[j] + lengths[j] - 1].tolist()
        for size in {len(k) for k in listed}:
            for i in range(len(words) - size + 1):
                grade[j] = max(grade[j], listed.get(tuple(words[i : i + size]), 0))

    # First guess: the three most telling word pairs, by smoothed odds of positive documents against the whole corpus.
    telling = np.zeros(starts.size, bool)
    telling[:n] = data.telling
    odds = np.log((data.pos_pair_counts + 0.3 * data.share) / (data.share * data.pair_counts + 0.3))[pairs]
    rank = np.lexsort((-odds, np.repeat(np.arange(starts.size), lengths)))
    top = [odds[rank][np.minimum(starts + i, starts + lengths - 1)] for i in range(3)]
    score = np.where(telling, sum(top) / 3 + (grade > 0), -np.inf)
    # Sentences that many documents hold without a label are harmless as a rule; they count a little. All counts of the corpus
    # are brought down to the sample, so that its positive documents weigh as much beside them in a corpus of any size.
    negative, usual = np.zeros(starts.size), np.zeros(starts.size)
    negative[:n], usual[:n] = data.in_negative, np.where(data.telling, 0.0, data.unlabelled * data.sampled)
    excess, part = excess * data.sampled, data.sampled / data.labelled
    floor, model = -np.inf, None
    for _ in range(passes):
        chosen = np.zeros(starts.size)
        if data.pos_number.size:
            order = np.lexsort((score[data.pos_number], data.pos_owner))
            last = np.append(np.flatnonzero(np.diff(data.pos_owner[order])), order.size - 1)
            picked = data.pos_number[order][last]
            np.add.at(chosen, picked[score[picked] > floor], 1)
        weak = negative + USUAL * usual
        neg, pos = np.flatnonzero(weak > 0), np.flatnonzero(chosen)
        rows = np.concatenate([neg, pos, term_rows, common_rows])
        none = np.zeros(common_rows.size, np.int64)
        low = np.concatenate([np.zeros(neg.size, np.int64), np.maximum(grade[pos], 1), severity, none])
        high = np.concatenate([np.zeros(neg.size, np.int64), np.where(grade[pos] > 0, grade[pos], GRADES), severity, none])
        own = chosen[pos] * part
        weight = np.concatenate([np.sqrt(weak[neg]), 2.0 * np.minimum(own, np.sqrt(own)), np.full(term_rows.size, 0.3), COMMON * np.sqrt(excess)])
        at = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]).astype(np.int64)
        flat = codes[np.repeat(starts[rows] - at, lengths[rows]) + np.arange(lengths[rows].sum())]
        model = fit(flat, at, low, high, weight, begin=model, rounds=100 if model is None else 40)
        score = np.where(telling, model.raw(codes, starts), -np.inf)
        floor = model.thresholds[0] - 1.0
    return model


def clear_labels(labels: DataFrame) -> DataFrame:
    """doc_id and abusive (0/1) of every labelled document, by majority of valid, distinct labels."""
    votes = labels.where(F.col("abusive").isin(0, 1) & F.col("doc_id").isNotNull()).distinct().groupBy("doc_id").agg(F.avg("abusive").alias("share"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("abusive"))


def labelled_documents(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``clear_labels`` of at most ``max_labelled`` documents."""
    return clear_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def labelled_sentences(encoded: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Labelled:
    """What the fit needs: sentences of the labelled sample and the telling ones of all positive documents, with counts over all of ``encoded``."""
    sample = materialise(labelled_documents(labels, max_labelled), "labelled-sample")
    known = clear_labels(labels).join(F.broadcast(sample.select("doc_id", F.lit(True).alias("sampled"))), "doc_id", "left")
    known = materialise(known.withColumn("sampled", F.coalesce("sampled", F.lit(False))), "labelled")
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("codes")))
    each = F.transform(F.arrays_zip("hashes", "starts", ends.alias("ends")), lambda x: F.struct(x["hashes"].alias("h"), F.slice("codes", x["starts"] + 1, x["ends"] - x["starts"]).alias("codes")))
    own = encoded.join(broadcast_within(known), "doc_id").dropDuplicates(["doc_id"]).where(F.size("hashes") > 0)
    rows = materialise(own.select("doc_id", "abusive", "sampled", F.explode(F.array_distinct(each)).alias("x")).select("doc_id", "abusive", "sampled", "x.*"), "labelled-sentences")
    positive = rows.where("abusive = 1")
    n_docs, n_positive = max(1, encoded.count()), positive.select("doc_id").distinct().count()
    share = max(1, n_positive) / n_docs

    forms = rows.where("sampled or abusive = 1").groupBy("h").agg(
        F.first("codes").alias("codes"), F.count_if(F.col("sampled") & (F.col("abusive") == 0)).alias("n_neg"), F.count_if(F.col("abusive") == 1).alias("n_pos"), F.bool_or("sampled").alias("in_sample")
    )
    forms = materialise(forms, "labelled-forms")
    wanted = broadcast_within(forms.select("h"))
    held, n_own = (hashes.join(wanted, "h", "left_semi").groupBy("h").agg(F.count("*").alias(n)) for hashes, n in ((encoded.select(F.explode(F.array_distinct("hashes")).alias("h")), "n"), (rows.select("h"), "n_own")))
    telling = (F.col("n_pos") > 0) & (F.col("n_pos") > MIN_LIFT * share * (F.col("n") - F.col("n_pos")))
    told = forms.join(held, "h").join(n_own, "h").select("h", "codes", "n_neg", "in_sample", (F.col("n") - F.col("n_own")).alias("unlabelled"), telling.alias("telling"))
    told = materialise(told.where("in_sample or telling"), "telling-sentences")

    found = told.orderBy("h").toArrow().combine_chunks()
    hashes, n_neg, unlabelled, telling = (found[c].to_numpy() for c in ("h", "n_neg", "unlabelled", "telling"))
    sizes, codes = pc.list_value_length(found["codes"]).to_numpy().astype(np.int64), pc.list_flatten(found["codes"]).to_numpy().astype(np.int64)
    places = positive.join(broadcast_within(told.select("h", "telling")), "h").where("sampled or telling").select("doc_id", "h").orderBy("doc_id", "h").toArrow()
    number = np.searchsorted(hashes, places["h"].to_numpy())
    in_positive = np.repeat(np.isin(np.arange(hashes.size), number), sizes)
    pairs = np.unique(pair_codes(codes)[in_positive]) if codes.size else codes
    labelled, sampled = (max(1, x.count()) / n_docs for x in (known, sample))
    return Labelled(
        codes, np.cumsum(sizes) - sizes, n_neg.astype(float), np.maximum(unlabelled, 0).astype(float), telling.astype(bool), number, places["doc_id"].to_numpy(),
        pair_frequencies(encoded, pairs), pair_frequencies(positive, pairs), share, labelled, sampled,
    )


def pair_frequencies(encoded: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted pair stands in the sentences of ``encoded``, by its code; tasks add up before they send."""
    shared = encoded.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy().astype(np.int64)
            if codes.size:
                total += np.bincount(pair_codes(codes), minlength=SIZE)
        own = shared.value[total[shared.value] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["pair", "n"])

    out = np.zeros(SIZE)
    if wanted.size:
        found = encoded.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
        out[found["pair"].to_numpy(np.int64)] = found["n"]
    return out


def fit_on(encoded: DataFrame, labels: DataFrame, terms: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """The model of a labelled sample; ``terms`` has term and severity."""
    listed = terms.where(F.col("term").isNotNull() & F.col("severity").between(1, GRADES)).select("term", "severity").distinct().orderBy("term", "severity").collect()
    return train(labelled_sentences(encoded, labels, max_labelled), [(r.term, r.severity) for r in listed])


def stored_model(documents: DataFrame, labels: DataFrame, terms: DataFrame, encoded: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """``fit_on``, once for the files of the three tables."""
    spark = documents.sparkSession

    def made() -> DataFrame:
        m = fit_on(encoded, labels, terms, max_labelled)
        return spark.createDataFrame([(bytearray(m.weights.tobytes()), m.thresholds.tolist())], "weights binary, thresholds array<double>")

    mark = fingerprint(labels, fingerprint(terms), fingerprint(documents), max_labelled, VERSION)
    row = stored(spark, "abuse-model", mark, made).first()
    return OrdinalModel(np.frombuffer(bytes(row.weights), np.float32), np.array(row.thresholds))


def score(encoded: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, what ``encode`` kept, expected_severity (0 to 3), p_abusive and the number of the worst sentence (null without any)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [(c, t) for c, t in encoded.dtypes if c not in ("codes", "starts", "hashes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            codes, starts = (batch.column(batch.num_columns - 2 + i) for i in range(2))
            n_codes, n_sentences = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (codes, starts))
            begin = np.cumsum(n_sentences) - n_sentences
            worst, raw = np.full(batch.num_rows, -1, np.int64), np.full(batch.num_rows, -np.inf)
            if n_sentences.sum():
                at = starts.flatten().to_numpy().astype(np.int64) + np.repeat(np.cumsum(n_codes) - n_codes, n_sentences)
                raws = m.raw(codes.flatten().to_numpy().astype(np.int64), at)
                has = np.flatnonzero(n_sentences)
                raw[has] = np.maximum.reduceat(raws, begin[has])
                best = np.flatnonzero(raws == np.repeat(raw, n_sentences))[::-1]
                owner = np.repeat(np.arange(batch.num_rows), n_sentences)
                worst[owner[best]] = best - begin[owner[best]]
            p = m.at_least(raw)
            told = [pa.array(p.sum(axis=0)), pa.array(p[0]), pa.array(worst, pa.int32(), mask=worst < 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *told], [*[c for c, _ in kept], "expected_severity", "p_abusive", "worst_sentence"])

    kinds = ", ".join(f"{c} {t}" for c, t in kept)
    return encoded.select(*[c for c, _ in kept], "codes", "starts").mapInArrow(run, f"{kinds}, expected_severity double, p_abusive double, worst_sentence int")
