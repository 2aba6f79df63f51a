"""Evaluation texts leaking into training text.

Method: a positional inverted index of the whole training text (term, with its documents and positions) is built once,
stored and reused by any set of test items. Each window of ``phrase`` consecutive words of an item is looked up by its
rarest term; the position in the document less the position in the item gives an offset. At each (item, document, offset)
the item's words are looked for at their offset-adjusted positions by a join on document, term and position; runs of
consecutive words are phrase matches. Words that agree at nearby offsets are proximity matches; as an edit can take away
any one word, these are looked for at all offsets.

Words: pieces between white space of any kind, lower case, without punctuation and marks at both ends; pieces without a
letter or digit are none.

The index is cut into segments of about a million words, within which a term has one row with parallel arrays of documents
and positions; so no term's list is ever one row, however frequent it is, and building it shuffles nothing.

Defined results: null and empty texts have no words and match nothing; items shorter than the phrase match nothing;
repeated documents and items each match under their own id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.session import broadcast_within, fingerprint, materialise, measured, spread, stored

PHRASE = 12
#: Words of a segment of the index, about.
SEGMENT = 1_000_000
#: Remembered pieces in a task; the memory is emptied when it is full.
REMEMBERED = 400_000
#: Item words that proximity takes up in one pass over the index; more items take more passes.
ITEM_WORDS = 200_000
#: Bytes of the candidates' documents up to which other documents' postings are left out before the shuffle.
MAX_DOCUMENT_BYTES = 16 << 20
#: Pieces in which a long text is aligned for proximity, in steps of the slop (8,192 words with a slop of 8).
PIECE = 1024
#: Bands (times items) that are held as an array even if few of them are met.
DENSE = 1_000_000
INDEX = "term string, docs array<long>, places array<int>"


def word(piece: str) -> str:
    """``piece`` (lower case) without what isn't letter, digit or combining mark at its ends; empty if it has no letter or digit."""
    if piece.isalnum():
        return piece
    inner = [i for i, ch in enumerate(piece) if unicodedata.category(ch)[0] in "LNM"]
    if not any(unicodedata.category(piece[i])[0] in "LN" for i in inner):
        return ""
    first = next(i for i in inner if unicodedata.category(piece[i])[0] != "M")
    return piece[first : inner[-1] + 1]


class _Codes(dict):
    """Piece to term number, -1 for no word; ``terms`` has the words by their number."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}
        self.terms: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = -1
        if w := word(piece):
            code = self.number.setdefault(w, len(self.terms))
            if code == len(self.terms):
                self.terms.append(w)
        self[piece] = code
        return code


def _segment(docs: list[int], texts: list[np.ndarray], terms: list[str]) -> pa.RecordBatch:
    """One row a term; ``texts`` has the term numbers of each document."""
    sizes = np.array([t.size for t in texts])
    codes = np.concatenate(texts)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    first = np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1]))
    offsets = pa.array(np.append(first, codes.size), pa.int32())
    place = np.arange(codes.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (np.repeat(np.array(docs, np.int64), sizes), place.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([terms[c] for c in sorted_codes[first].tolist()], pa.string()), *lists], ["term", "docs", "places"])


def _indexer(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, texts, held = _Codes(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.fromiter(map(seen.__getitem__, text.lower().split()), np.int64)
                codes = codes[codes >= 0]
                if codes.size:
                    docs.append(doc), texts.append(codes)
                    held += codes.size
                if held >= segment:
                    yield _segment(docs, texts, seen.terms)
                    docs, texts, held = [], [], 0
                    seen = _Codes() if len(seen) > REMEMBERED else seen
        if held:
            yield _segment(docs, texts, seen.terms)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, terms, places = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i, w in enumerate(filter(None, map(word, (text or "").lower().split()))):
                items.append(item), terms.append(w), places.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.string()), pa.array(places, pa.int32())], ["item_id", "term", "pos"])


def item_words(items: DataFrame) -> DataFrame:
    """item_id, term, pos of items with item_id and item_text."""
    return materialise(items.select("item_id", "item_text").mapInArrow(_item_words, "item_id long, term string, pos int"), "item-words")


def build_index(documents: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The stored index (term, docs, places) of all words of ``documents`` (doc_id, text), written once for their files."""
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return stored(documents.sparkSession, "postings", fingerprint(documents, segment, 1), lambda: spread(texts).mapInArrow(_indexer(segment), INDEX))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, pos and the columns of ``terms`` (term, ...) of every posting of these terms."""
    held = index.join(broadcast_within(terms), "term")
    own = [c for c in terms.columns if c != "term"]
    return held.select("term", *own, F.explode(F.arrays_zip("docs", "places")).alias("p")).select(F.col("p.docs").alias("doc_id"), F.col("p.places").alias("pos"), "term", *own)


def aligned_words(index: DataFrame, words: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, item_id, shift, ipos: words of an item that a document holds at the same shift as one of its anchors.

    Every run of ``phrase`` words that document and item share lies on such a shift.
    """
    terms = materialise(words.select("term").distinct(), "terms")
    rarity = index.join(broadcast_within(terms), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("n"))
    known = words.join(rarity, "term", "left").fillna(0, ["n"])
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, phrase - 1)
    windows = known.select("item_id", F.count("*").over(ahead).alias("size"), F.min("n").over(ahead).alias("least"), F.min(F.struct("n", "term", "pos")).over(ahead).alias("rarest"))
    anchors = materialise(windows.where((F.col("size") == phrase) & (F.col("least") > 0)).select("item_id", F.col("rarest.term").alias("term"), F.col("rarest.pos").alias("ipos")).distinct(), "anchors")
    shifts = materialise(postings(index, anchors).select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).distinct(), "shifts")
    wanted = shifts.join(broadcast_within(words.withColumnRenamed("pos", "ipos")), "item_id").withColumn("pos", F.col("ipos") + F.col("shift")).where("pos >= 0")
    own, documents = postings(index, terms), shifts.select("doc_id").distinct()
    if measured(documents) <= MAX_DOCUMENT_BYTES:
        own = own.join(F.broadcast(documents), "doc_id", "left_semi")
    # A document that occurs twice has its postings twice.
    return wanted.join(own, ["doc_id", "term", "pos"], "left_semi").select("doc_id", "item_id", "shift", "ipos")


def phrase_matches(aligned: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, item_id and the longest run of consecutive item words, of at least ``phrase``."""
    along = Window.partitionBy("doc_id", "item_id", "shift").orderBy("ipos")
    runs = aligned.withColumn("run", F.col("ipos") - F.dense_rank().over(along)).groupBy("doc_id", "item_id", "shift", "run").agg((F.max("ipos") - F.min("ipos") + 1).alias("n_words"))
    return runs.where(F.col("n_words") >= phrase).groupBy("doc_id", "item_id").agg(F.max("n_words").cast("long").alias("longest_run"))


def _near(starts: np.ndarray, items: np.ndarray, places: np.ndarray, slop: int, phrase: int, piece: int, dense: int):
    """Arrow batches (id, item words of the document as position << 32 | term) to doc_id, item_id, n_words.

    Term i stands at ``places`` starts[i] to starts[i + 1] of ``items``. Every pair of a document word and an equal item
    word sets the bit of its item position at its item and band of shifts.
    """
    number, own = np.unique(items, return_inverse=True)
    widest = int(places.max(initial=0)) + 1
    held, before = np.diff(starts), -(-widest // slop) + 1
    block, bit = places // 64, np.uint64(1) << (places % 64).astype(np.uint64)
    blocks = -(-widest // 64)

    def matches(at: np.ndarray, ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers and word counts of the matching bands; ``first`` is the first half band of the piece."""
        n = held[ids]
        pair = np.repeat(starts[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        half = (np.repeat(at, n) - places[pair]) // slop - first + before
        width = int(half.max(initial=0)) + 2
        key = own[pair] * width + half
        # A pair lies in the band that begins in its half and in the one before.
        if number.size * width <= max(dense, 8 * key.size):
            bits = np.zeros((blocks, number.size * width), np.uint64)
            np.bitwise_or.at(bits, (block[pair], key), bit[pair])
            bits[:, :-1] |= bits[:, 1:].copy()
            bands = None
        else:
            bands, to = np.unique(np.concatenate([key, key - 1]), return_inverse=True)
            bits = np.zeros((blocks, bands.size), np.uint64)
            np.bitwise_or.at(bits, (np.tile(block[pair], 2), to), np.tile(bit[pair], 2))
        words = np.bitwise_count(bits).sum(axis=0, dtype=np.int64)
        good = np.flatnonzero(words >= phrase)
        return (good if bands is None else bands[good]) // width, words[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = piece * slop
        for batch in batches:
            docs, found, counts = [], [], []
            for doc, held_words in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = held_words.values.to_numpy()
                at, ids = packed >> 32, packed & 0xFFFFFFFF
                best = np.zeros(number.size, np.int64)
                # Long texts go piece by piece; pieces overlap, so every band lies in one as a whole.
                for begin in range(0, int(at[-1]) + 1, span):
                    a, b = np.searchsorted(at, [begin, begin + span + widest + 2 * slop])
                    if a < b:
                        np.maximum.at(best, *matches(at[a:b], ids[a:b], begin // slop))
                hit = np.flatnonzero(best)
                docs.append(np.full(hit.size, doc, np.int64))
                found.append(number[hit])
                counts.append(best[hit])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (docs, found, counts)], ["doc_id", "item_id", "n_words"])

    return run


def near_matches(index: DataFrame, words: DataFrame, slop: int = 8, phrase: int = PHRASE, piece: int = PIECE, dense: int = DENSE, item_words: int = ITEM_WORDS) -> DataFrame:
    """``proximity_matches`` of all words of all items with all documents of the index.

    There are no anchors that an edit could take away: the postings of all item words come together by document. Items are
    taken in blocks of about ``item_words`` words, each one pass over the index.
    """
    spark = index.sparkSession
    n = max(1, -(-words.count() // item_words))
    cuts = sorted(set(words.approxQuantile("item_id", [i / n for i in range(1, n)], 0.0))) if n > 1 else []
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        block = words if low is None else words.where(F.col("item_id") > low)
        rows = (block if high is None else block.where(F.col("item_id") <= high)).sort("term", "item_id", "pos").toPandas()
        terms, starts = np.unique(rows["term"].to_numpy(object), return_index=True)
        coded = spark.createDataFrame(list(zip(terms.tolist(), range(terms.size))), "term string, code long")
        packed = F.sort_array(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("code"))))
        run = _near(np.append(starts, len(rows)), rows["item_id"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64), slop, phrase, piece, dense)
        parts.append(postings(index, coded).groupBy("doc_id").agg(packed.alias("words")).mapInArrow(run, "doc_id long, item_id long, n_words long"))
    return reduce(DataFrame.unionByName, parts)


def proximity_matches(aligned: DataFrame, slop: int = 8, phrase: int = PHRASE) -> DataFrame:
    """doc_id, item_id, n_words: at least ``phrase`` different item words at shifts that lie within ``slop`` of each other.

    Shifts are taken in overlapping bands of twice ``slop``, so a match within ``slop`` lies in one band as a whole.
    """
    band = F.floor(F.col("shift") / slop)
    banded = aligned.withColumn("band", F.explode(F.array(band, band - 1)))
    return (
        banded.groupBy("doc_id", "item_id", "band").agg(F.countDistinct("ipos").alias("n"))
        .where(F.col("n") >= phrase).groupBy("doc_id", "item_id").agg(F.max("n").alias("n_words"))
    )
