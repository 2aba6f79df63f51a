"""Visually identical text with different characters.

Method: characters are mapped to the plain ones they look like; the mapped values are grouped in SQL under Spark's
accent-sensitive Unicode collation, which also makes combining and precomposed accents equal; each class gets a
deterministic canonical member, and it is joined back to the rows. Pairs of rows are those with one canonical member:
its different strings are paired first, and their rows after that.

The collation calls some values equal that look different (digits of different scripts), so an exact check of the mapped,
normalised text splits such classes again.

Defined results: null text, and text without a visible character, belongs to no class; exact copies share a class but
form no pair; rows without a number are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from granthika.session import materialise

# Letters of other scripts that look like Latin ones.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυϲϳ", "ABEZHIKMNOPTYXayivopucj")
ARMENIAN = ("ՕՍՏԼօոսհցյ", "OUSLonuhgj")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB")
# Kinds of hyphen, invisible characters.
HYPHENS = "‐‑‒−﹣"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
# What the character tables call other shapes of the same letters, and where they keep joined letters.
SHAPES = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
LIGATURES = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB17), (0xFEF5, 0xFEFC))


def _shapes() -> tuple[dict[str, str], dict[str, str]]:
    """(characters that are another shape of one, joined letters with the single ones), by the Unicode character tables.

    Full-width and half-width forms, mathematical letters, contextual Arabic forms, Roman numerals, ligatures.
    """
    one, several = {}, {}
    for code in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)):
        kind, *parts = unicodedata.decomposition(chr(code)).split() or [""]
        ligature = kind in ("<compat>", "<isolated>", "<final>") and any(a <= code <= b for a, b in LIGATURES)
        if kind in SHAPES or ligature:
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and not plain.isspace():
                one[chr(code)] = plain
            elif ligature:
                several[chr(code)] = plain
    return one, several


_ONE, _SEVERAL = _shapes()
JOINED = tuple(_SEVERAL.items())
_ALIKE = dict(zip(*(a + b + c + d for a, b, c, d in zip(CYRILLIC, GREEK, ARMENIAN, CHEROKEE))))
_SPACES = "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")
_PAIRS = {**_ONE, **_ALIKE}
_FROM = "".join(_PAIRS) + _SPACES + HYPHENS + INVISIBLE
_TO = "".join(_PAIRS.values()) + " " * len(_SPACES) + "-" * len(HYPHENS)


def look(text: Column) -> Column:
    """``text`` with each character replaced by the plain one it looks like, and invisible ones removed."""
    plain = F.translate(text, _FROM, _TO)
    parted = plain
    for joined, letters in JOINED:
        parted = F.replace(parted, F.lit(joined), F.lit(letters))
    other = F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), parted).otherwise(plain)
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(text)


@F.pandas_udf(LongType())
def _exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit hash of the composed form; compared only within one collation class."""
    import xxhash

    for s in batches:
        yield s.map(lambda x: xxhash.xxh3_64_intdigest(unicodedata.normalize("NFC", x)) - (1 << 63), na_action="ignore").astype("Int64")


def look_alike_members(rows: DataFrame) -> DataFrame:
    """table_name, row_no, form_id (hash of the string), canonical_row, canonical_text and n_forms of every row in a class of
    several strings, of ``rows`` (table_name, row_no, text).

    The canonical member is the one with the fewest unusual characters (shortest UTF-8, then smallest string, then row).
    """
    spark = rows.sparkSession
    visible = rows.where(F.col("text").rlike(rf"[^\s\p{{Z}}{INVISIBLE}]") & F.col("row_no").isNotNull())
    visible.select("table_name", "row_no", "text", look(F.col("text")).alias("seen")).createOrReplaceTempView("granthika_seen")
    classes = spark.sql(
        """SELECT table_name, seen COLLATE UNICODE AS face, min(row_no) AS class_id FROM granthika_seen
           GROUP BY table_name, seen COLLATE UNICODE HAVING min(xxhash64(text)) <> max(xxhash64(text))"""
    )
    classes.createOrReplaceTempView("granthika_faces")
    members = spark.sql(
        """SELECT s.table_name, s.row_no, s.text, s.seen, c.class_id, xxhash64(s.text) AS form_id
           FROM granthika_seen s JOIN granthika_faces c ON s.table_name = c.table_name AND s.seen COLLATE UNICODE = c.face"""
    )
    m = materialise(members.withColumn("exact", _exact("seen")).drop("seen"), "faces")
    own = ["table_name", "class_id", "exact"]
    best = m.groupBy(*own).agg(F.min(F.struct(F.octet_length("text").alias("bytes"), "text", "row_no")).alias("best"), F.countDistinct("form_id").alias("n_forms"))
    chosen = best.where("n_forms > 1").select(*own, "n_forms", F.col("best.row_no").alias("canonical_row"), F.col("best.text").alias("canonical_text"))
    return m.drop("text").join(chosen, own).drop("class_id", "exact")


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """table_name, row_a < row_b of rows that look the same but differ in their characters."""
    members = materialise(look_alike_members(rows).select("table_name", "canonical_row", "form_id", "row_no"), "members")
    own = ["table_name", "canonical_row"]
    forms = members.groupBy(*own).agg(F.sort_array(F.collect_set("form_id")).alias("f"))
    links = forms.select(*own, F.posexplode("f").alias("i", "form_a"), "f").select(*own, "form_a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("form_b"))
    a, b = (members.withColumnsRenamed({"row_no": f"row_{x}", "form_id": f"form_{x}"}) for x in "ab")
    each = links.join(a, [*own, "form_a"]).join(b, [*own, "form_b"])
    return each.select("table_name", F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"))


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """table_name, canonical_row, form_id, n_rows and n_links (pairs of its rows with rows of other strings) of every string in a class."""
    members = materialise(look_alike_members(rows).select("table_name", "canonical_row", "form_id"), "members")
    own = ["table_name", "canonical_row"]
    forms = members.groupBy(*own, "form_id").agg(F.count("*").alias("n_rows"))
    whole = forms.groupBy(*own).agg(F.sum("n_rows").alias("_all"))
    return forms.join(whole, own).select(*own, "form_id", "n_rows", (F.col("n_rows") * (F.col("_all") - F.col("n_rows"))).alias("n_links"))
