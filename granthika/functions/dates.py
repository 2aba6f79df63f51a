"""Date expressions in the notations of releases and social posts, with Spark's own parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.text import one_spaced

ZONE = "+05:30"
# Shapes of a release's date: numeric with - / or . between, and with a month's name; an optional time of day.
_CLOCK = r"(?: (\d{1,2}:\d{1,2}(?::\d{1,2})?)( [AaPp][Mm])?)?"
_NUMERIC = rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_CLOCK}"
_NAMED = rf"(\d{{1,2}}) (\p{{L}}+) (\d{{4}}){_CLOCK}"


def posted_on(text: Column) -> Column:
    """What stands on the line after the first ``Posted On:`` (or ``Posted On -``), up to ``by PIB`` if that follows; null without it."""
    line = F.regexp_extract(text, r"(?i)\bposted\s+on\s*[:-][ \t]*([^\n]*)", 1)
    return F.nullif(one_spaced(F.get(F.split(line, r"(?i)\s+by\s+pib\b"), F.lit(0))), F.lit(""))


_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def with_release_instant(rows: DataFrame, source: str, name: str = "instant") -> DataFrame:
    """``rows`` with the instant of a release's date text; without an offset it is that of India. Null if no notation fits.

    ISO 8601 comes first, then the notations with numbers and with names, then an all-numeric date inside the text. The
    steps are columns of their own, as one expression of all would be too large for compiled code.
    """
    spaced = rows.withColumn("_value", F.regexp_replace(one_spaced(F.coalesce(posted_on(F.col(source)), F.col(source))), r"(?i)(\d)(AM|PM)\b", "$1 $2"))
    parts = spaced.withColumns({f"_iso{i}": F.regexp_extract("_value", _ISO, i) for i in range(1, 5)} | {"_inside": F.regexp_extract("_value", _NUMERIC, 0)})
    clock = F.concat(F.coalesce(F.nullif("_iso2", F.lit("")), F.lit("00:00")), F.coalesce(F.nullif("_iso3", F.lit("")), F.lit(":00")))
    offset = F.regexp_replace(F.coalesce(F.nullif("_iso4", F.lit("")), F.lit(ZONE)), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(F.col("_iso1") != "", F.concat("_iso1", F.lit("T"), clock, offset).try_cast("timestamp"))
    tried = parts.withColumns({"_a": iso, "_b": _numeric(F.col("_value")), "_c": _named(F.col("_value")), "_d": _numeric(F.col("_inside"))})
    return tried.withColumn(name, F.coalesce("_a", "_b", "_c", "_d")).select(*rows.columns, name)


def _read(text: Column, shape: str, date: Column, n: int, months: tuple[str, ...], half_day: Column) -> Column:
    """Instant of ``date`` and the clock in groups n and n + 1 of ``shape``; half days only where ``half_day`` holds."""
    clock, mark = F.regexp_extract(text, shape, n), F.upper(F.regexp_extract(text, shape, n + 1))
    seconds = F.when(clock == "", "0:0:0").when(clock.rlike(r":\d+:"), clock).otherwise(F.concat(clock, F.lit(":0")))
    whole = F.concat(date, F.lit(" "), seconds, mark, F.lit(" " + ZONE))
    plain = [F.when(mark == "", F.try_to_timestamp(whole, F.lit(f"d-{m}-yyyy H:m:s XXX"))) for m in months]
    halved = F.when((mark != "") & half_day, F.try_to_timestamp(whole, F.lit(f"d-{months[0]}-yyyy h:m:s a XXX")))
    return F.when(text.rlike(shape), F.coalesce(*plain, halved))


def _numeric(text: Column) -> Column:
    """d-m-yyyy; half days (AM, PM) only with hyphens."""
    shape = f"^{_NUMERIC}$"
    date = F.concat_ws("-", *[F.regexp_extract(text, shape, g) for g in (1, 3, 4)])
    return _read(text, shape, date, 5, ("M",), F.regexp_extract(text, shape, 2) == "-")


def _named(text: Column) -> Column:
    """Day, month's name, year; half days only with the whole name."""
    shape = f"^{_NAMED}$"
    date = F.concat_ws("-", *[F.regexp_extract(text, shape, g) for g in (1, 2, 3)])
    return _read(text, shape, date, 4, ("MMMM", "MMM"), F.lit(True))


def social_instant(text: Column) -> Column:
    """Instant of ``Wed Oct 10 20:19:24 +0000 2018``."""
    return F.try_to_timestamp(F.substring(text, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


def iso_utc(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")
