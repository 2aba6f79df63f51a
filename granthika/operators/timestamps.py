"""Date texts of many forms and zones, brought to one UTC instant.

A value is a raw string with the zone that its source implies and the order that the source uses for all-numeric dates.
Values repeat, so they are reduced to a dictionary of distinct (raw, zone, order) triples; each triple is parsed once,
kept in a Parquet table that later runs extend, and joined back to the rows.

Defined results: null, blank, relative, incomplete and non-existing dates, and zoneless local times that a clock change
skips or repeats, have a null instant. Repeated rows each get their instant. Columns of the input other than the three
keys pass through; ``instant`` and ``instant_utc`` are replaced if the input has them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in English and Hindi (without nukta), in calendar order.
MONTHS = (
    ("january", "jan", "जनवरी"),
    ("february", "feb", "फरवरी"),
    ("march", "mar", "मार्च"),
    ("april", "apr", "अप्रैल"),
    ("may", "may", "मई"),
    ("june", "jun", "जून"),
    ("july", "jul", "जुलाई"),
    ("august", "aug", "अगस्त"),
    ("september", "sep", "सितंबर", "sept", "सितम्बर"),
    ("october", "oct", "अक्टूबर", "अक्तूबर"),
    ("november", "nov", "नवंबर", "नवम्बर"),
    ("december", "dec", "दिसंबर", "दिसम्बर"),
)
# Minutes east of UTC of abbreviations that hold for every source, and of those the zone database lacks.
ANY_ZONE = {"Z": 0, "UTC": 0, "GMT": 0, "IST": 330}
OF_ZONE = {("Asia/Kathmandu", "NPT"): 345, ("Asia/Dubai", "GST"): 240}

# Ends in \z: in Java, $ also matches before a final line feed.
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"
PARSED = "raw string, zone string, date_order string, micros long"

_MONTH_NO = {name: i for i, names in enumerate(MONTHS, 1) for name in names}
_NAME = "|".join(sorted(_MONTH_NO, key=len, reverse=True))
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[ap]\.?m\b\.?)?(?:\s*(?:hrs|hours))?"
_ZONE = r"(?P<zone>[A-Za-z]{1,5}(?![A-Za-z]))?\s*(?P<off>[+-]\d{2}(?::?\d{2})?)?"
_TAIL = rf"(?:(?:\s*T\s*|,?\s+at\s+|,?\s+){_TIME}\s*{_ZONE})?"
_FORMS = [
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"(?P<y>\d{{4}})([-/.])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}}){_TAIL}",
        rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_TAIL}",
        rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<mon>{_NAME})\.?,?[\s-]+(?P<y>\d{{4}}|\d{{2}}){_TAIL}",
        rf"(?P<mon>{_NAME})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}",
        rf"(?P<mon>{_NAME})\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}\s*{_ZONE}\s+(?P<y>\d{{4}})",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:\.(?P<f>\d{{1,9}}))?\s*{_ZONE})?",
    )
]
_FRAME = re.compile(r"^(?:(?:posted|published|updated|last updated)(?:\s+on)?\s*:?\s*)?(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(.*?)(?:\s+by\s+.*)?$", re.IGNORECASE | re.DOTALL)
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _plain(raw: str) -> str:
    """ASCII digits, no nukta, no format characters, single spaces."""
    kept = []
    for ch in unicodedata.normalize("NFD", raw):
        if ch == "़" or unicodedata.category(ch) == "Cf":
            continue
        kept.append(str(unicodedata.digit(ch)) if ch.isdigit() and unicodedata.category(ch) == "Nd" else ch)
    return " ".join("".join(kept).split())


@lru_cache(maxsize=4096)
def _abbreviations(zone: str, year: int) -> dict[str, int]:
    """Abbreviation to minutes east of UTC, as the zone used them in that year."""
    tz, out = ZoneInfo(zone), {}
    for month in range(1, 13):
        t = datetime(year, month, 1, 12, tzinfo=tz)
        out[t.tzname()] = int(t.utcoffset().total_seconds()) // 60
    return out


def _micros(t: datetime) -> int:
    return (t - _ZERO) // timedelta(microseconds=1)


def parse_instant(raw: str | None, zone: str, date_order: str) -> int | None:
    """Microseconds since 1970 UTC of a date text, or None if it doesn't fix one instant."""
    if raw is None:
        return None
    text = _FRAME.match(_plain(raw)).group(1).strip()
    if text.isdigit() and len(text) in _EPOCH:
        return int(text) * _EPOCH[len(text)]
    for form in _FORMS:
        if m := form.fullmatch(text):
            try:
                return _resolve(m.groupdict(), zone, date_order)
            except (ValueError, OverflowError):
                return None
    return None


def _resolve(g: dict, zone: str, date_order: str) -> int | None:
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("mon"):
        month, day = _MONTH_NO[g["mon"].lower()], int(g["d"])
    elif g.get("a"):
        # Dots stand only in day-first notations, whatever order a site uses with slashes.
        day, month = (int(g["b"]), int(g["a"])) if date_order == "mdy" and g["sep"] != "." else (int(g["a"]), int(g["b"]))
    else:
        month, day = int(g["m"]), int(g["d"])
    hour, half = int(g["h"] or 0), (g.get("ap") or "").lower()[:1]
    if half:
        if hour > 12 and half == "a" or hour == 0 and half == "p":
            return None
        hour = hour % 12 + 12 * (half == "p") if hour <= 12 else hour
    t = datetime(year, month, day, hour, int(g["mi"] or 0), int(g["s"] or 0), int(((g["f"] or "") + "000000")[:6]))
    if g["off"]:
        digits = g["off"][1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
        if g["zone"] and g["zone"].upper() not in ("GMT", "UTC"):
            return None
        return _micros((t - timedelta(minutes=minutes if g["off"][0] == "+" else -minutes)).replace(tzinfo=timezone.utc))
    if g["zone"]:
        name = g["zone"].upper()
        minutes = ANY_ZONE.get(name, OF_ZONE.get((zone, name), _abbreviations(zone, year).get(name)))
        return None if minutes is None else _micros((t - timedelta(minutes=minutes)).replace(tzinfo=timezone.utc))
    first, second = (t.replace(tzinfo=ZoneInfo(zone), fold=fold) for fold in (0, 1))
    return _micros(first) if first.utcoffset() == second.utcoffset() else None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [parse_instant(*x) for x in zip(pdf["raw"], pdf["zone"], pdf["date_order"])]
        yield pdf.assign(micros=pd.array(found, dtype="Int64"))


class InstantDictionary:
    """Distinct (raw, zone, date_order) triples with their instants, in a Parquet table at ``path`` that grows by run."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(PARSED).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def extend(self, values: DataFrame) -> DataFrame:
        """Parses the triples of ``values`` that the dictionary lacks, appends them and returns the dictionary."""
        fresh = values.where(F.col("raw").isNotNull()).select("raw", "zone", "date_order").distinct()
        known = self.read()
        if known is not None:
            fresh = fresh.join(known, ["raw", "zone", "date_order"], "left_anti")
        fresh.mapInPandas(_parse_batches, PARSED).write.mode("append").parquet(self.path)
        return self.read()


def normalise(values: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """``values`` (with raw, zone, date_order) plus ``instant`` (timestamp) and ``instant_utc`` (text), null if undecidable."""
    return _joined(values, dictionary, "left")


def resolve_only(values: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """As ``normalise``, without the rows that are undecidable; those never enter the join."""
    return _joined(values, dictionary, "inner")


def _joined(values: DataFrame, dictionary: InstantDictionary, how: str) -> DataFrame:
    parsed = dictionary.extend(values).where("micros is not null").withColumnRenamed("micros", "_granthika_micros")
    instant = F.timestamp_micros("_granthika_micros")
    return values.join(parsed, ["raw", "zone", "date_order"], how).withColumns({"instant": instant, "instant_utc": utc_text(instant)}).drop("_granthika_micros")


def utc_text(instant: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``; the session's time zone is UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_canonical(raw: Column) -> Column:
    return F.coalesce(raw.rlike(CANONICAL), F.lit(False))
