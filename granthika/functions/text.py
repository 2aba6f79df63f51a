"""Text expressions. Null stays null unless said otherwise; white space is that of Unicode, not of ASCII alone."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\p{Z}\x{85}\x1C-\x1F]"
# Names of sections that stand as a paragraph of their own.
HEADINGS = (
    "background", "introduction", "overview", "key details?", "highlights?", "key highlights?", "details?", "objectives?", "purpose", "aims?",
    "benefits?", "features?", "eligibility", "implementation", "implementation details?", "financial implications?", "funding", "timeline",
    "important points?", "key points?", "decisions?", "key decisions?", "announcements?", "key announcements?", "additional information",
    "way forward", "conclusion", "about .*",
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null and for white space alone."""
    return ~F.coalesce(text.rlike(r"[^\s\p{Z}\x{85}]"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def one_spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


# Marks that an extraction leaves, and characters that nobody sees.
MARKS, UNSEEN = r"\[\s*/?\s*(?i:table|image)\s*\]", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"
_ALONG = r"[ \t\f\x0B\xA0]"


def clean_block(text: Column) -> Column:
    """Extraction marks and invisible characters removed, horizontal space single, at most one blank line.

    Space around line ends goes with them, so the run of line ends that is left is a run of blank lines.
    """
    seen = F.regexp_replace(text, rf"{MARKS}|{UNSEEN}", "")
    lines = F.regexp_replace(seen, rf"{_ALONG}*(?:\r\n?|\n){_ALONG}*", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, rf"{_ALONG}+", " "), r"\n{3,}", "\n\n"))


def clean_web(text: Column) -> Column:
    """Tags to spaces, white space single."""
    return one_spaced(F.regexp_replace(text, r"<[^>]+>", " "))


def clean_scanned(text: Column) -> Column:
    """Control characters removed, lines without trailing space, blank runs of one line."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, r"(?m)[^\S\n]+$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def unescape_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numeric entities; Spark has no built-in for them."""
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


def clean_social(text: Column, unescape: bool = True) -> Column:
    """Entities and literal escapes decoded, a space after ? and !, single spaces in lines, at most one blank line."""
    out = unescape_html(text) if unescape else text
    for escaped, plain in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", " ")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    out = F.replace(F.regexp_replace(out, r"\r\n?", "\n"), F.lit("\t"), F.lit(" "))
    out = F.regexp_replace(out, r"([?!])(?=[A-Za-z0-9])", "$1 ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \f\x0B]+", " "), rf"(?:[^\S\n]|\p{{Z}})*\n(?:[^\S\n]|\p{{Z}})*", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}\x{85}\x1C-\x1F]+")).cast("long")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a substring; 0 for an empty one."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n.cast("int")).otherwise(0)


def script_language(text: Column) -> Column:
    """``hi`` if there are Devanagari letters, more than a quarter of the Latin ones; else ``en``."""
    devanagari = F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((devanagari > 0) & (devanagari > 0.25 * latin), "hi").otherwise("en")


def is_heading(text: Column) -> Column:
    """A known section name, a numbered line of up to 100 characters, or a line of up to 100 characters that ends in a colon."""
    t = clean_block(text)
    shape = rf"^(?i:{'|'.join(HEADINGS)})$|^(?i:about ).*|^(?:\d+[.)]|[IVXLCDM]+[.)])\s+.{{2,100}}$|^[\s\S]{{0,99}}:$"
    return F.coalesce(t.rlike(shape), F.lit(False))


def heading_name(text: Column) -> Column:
    """Without the number in front and the colon behind."""
    return strip(F.regexp_replace(F.regexp_replace(clean_block(text), r"(?i)^[\dIVXLCDM]+[.)]\s+", ""), ":+$", ""))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with single spaces."""
    return F.sha2(F.lower(one_spaced(text)), 256)


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_-]+)"), F.lit(1)))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])@([\p{L}\p{N}_-]+)"), F.lit(1)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\]\[\"']+"), F.lit(0)))


def entities(text: Column) -> Column:
    """hashtags, mentions and urls (each once, in order of first appearance) of a text."""
    links = F.transform(urls(text), lambda u: F.struct(u.alias("url"), u.alias("expanded_url")))
    return F.struct(hashtags(text).alias("hashtags"), mentions(text).alias("mentions"), links.alias("urls"))


def entity_names(items: Column) -> Column:
    """Names without leading # and @, blanks left out."""
    return F.filter(F.transform(items, lambda x: F.ltrim(x, F.lit("#@"))), lambda x: F.length(x) > 0)


def named_entities(items: Column, keys: tuple[str, ...]) -> Column:
    """Names of items that are maps: the first of ``keys`` with a text in it, without leading # and @; items without any are left out."""
    name = lambda m: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys])
    return entity_names(F.filter(F.transform(items, name), lambda x: x.isNotNull()))


def links_of(given: Column, text: Column) -> Column:
    """Links that a record names, then those in its text without trailing marks; each URL once. Both are arrays of {url, expanded_url}."""
    none = F.expr("cast(array() as array<struct<url:string,expanded_url:string>>)")
    own = F.filter(F.coalesce(given, none), lambda x: F.length(x["url"]) > 0)
    seen = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>'\"\])]+"), F.lit(0)),
        lambda u: F.struct(F.regexp_replace(u, "[.,!?;:]+$", "").alias("url"), F.lit(None).cast("string").alias("expanded_url")))
    every = F.concat(own, seen)
    names = F.transform(every, lambda x: x["url"])
    return F.filter(every, lambda x, i: F.array_position(names, x["url"]) == i + 1)


def publisher_line(text: Column, title: Column) -> Column:
    """The last line before the title that names neither the publisher's portal nor the release itself; null without one."""
    at = F.call_function("locate", title, text)
    lines = F.filter(F.transform(F.split(F.substring(text, F.lit(1), at - 1), "\n"), one_spaced), lambda x: x != "")
    # Lines that stand above every release.
    ignored = ("government of india", "press information bureau", "press information bureau government of india", "home", "press releases",
        "all press release", "all releases")
    own = F.filter(lines, lambda x: ~F.lower(x).isin(*ignored) & ~F.lower(x).contains("posted on:") & ~F.lower(x).rlike(r"^release\s+id\s*:?\s*\d+$"))
    return F.when(at > 1, F.try_element_at(own, F.lit(-1)))


def important_text(text: Column, keyword: str | Column, max_characters: int = 2000, min_characters: int = 35) -> Column:
    """Sentences that hold the keyword's words most often, in order of the text, as many as fit.

    ``keyword`` is a text, or a column of texts; without words in it, sentences go by position. Sentences are taken by
    falling count, then position; one that doesn't fit is passed over, and later ones may still fit.
    """
    keyword = F.lit(keyword) if isinstance(keyword, str) else keyword
    terms = F.regexp_extract_all(F.lower(F.coalesce(keyword, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_-]+"), F.lit(0))
    marked = F.regexp_replace(clean_web(text), r"\[\.\.\.\]|(?<=[.!?])\s+", "\u0001")
    sentences = F.transform(F.split(marked, "\u0001"), lambda s, i: F.struct(i.alias("at"), strip(s).alias("s")))
    long_enough = F.filter(sentences, lambda x: F.length(x["s"]) >= min_characters)

    def score(x: Column) -> Column:
        return F.aggregate(terms, F.lit(0), lambda n, t: n + occurrences(F.lower(x["s"]), t))

    ranked = F.array_sort(F.transform(long_enough, lambda x: F.struct((-score(x)).alias("order"), x["at"].alias("at"), x["s"].alias("s"))))
    empty = F.expr("cast(array() as array<struct<at:int,s:string>>)")
    taken = F.aggregate(
        ranked,
        F.struct(F.lit(0).alias("used"), empty.alias("kept")),
        lambda acc, x: F.when(acc["used"] + F.length(x["s"]) > max_characters, acc).otherwise(
            F.struct((acc["used"] + F.length(x["s"])).alias("used"), F.array_append(acc["kept"], F.struct(x["at"].alias("at"), x["s"].alias("s"))).alias("kept"))
        ),
    )
    return F.array_join(F.transform(F.array_sort(taken["kept"]), lambda x: x["s"]), " ")
