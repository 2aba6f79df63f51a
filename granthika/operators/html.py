"""HTML pages to content blocks, links and documents.

The standard parser only tells which elements a piece of text stands in. All that follows is Spark: page chrome falls away,
the article is chosen, and cells, rows, items and blocks are put together by grouping on the numbers of their elements.

Defined results: null and empty pages give no rows; unclosed paragraphs end where a new block begins; an end tag without
its start is ignored; pages with a null key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.dates import posted_on, with_release_instant
from granthika.functions.text import blank_to_null, clean_block, one_spaced, publisher_line, script_language
from granthika.functions.urls import release_number
from granthika.operators.dedup import first_texts, last_by
from granthika.operators.sections import MAIN, has_tables, infer_sections
from granthika.session import computed_once, materialise

# Tags of content blocks, tags that are dropped, and marks of page chrome in ids and classes.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table", "blockquote")
DROPPED_TAGS = ("script", "style", "noscript", "iframe", "svg", "canvas", "template", "nav", "footer", "aside")
CHROME = (
    "navbar", "nav-bar", "navigation", "menu", "footer", "cookie", "advert", "advertisement", "social", "share", "sidebar", "breadcrumb",
    "recommend", "related", "popup", "modal", "skip", "accessibility",
)
VOID = ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")
#: Elements that can be the article, the better kind first, and the least text that an article has.
CONTAINERS, LEAST_TEXT = {"article": 3, "main": 2, "div": 1, "section": 1}, 300
# What an article of a release says somewhere, and its publisher if it names none.
MARKERS, PUBLISHER = ("posted on", "release id"), "Press Information Bureau"
PATH = "array<struct<no:int,tag:string,marks:string,nth:int>>"


class _Texts(HTMLParser):
    """Texts of a page, each with the open elements around it: (number, tag, id and class, number among its like)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[int, str, str, int]] = []
        self.likes: list[dict[str, int]] = [{}]
        self.found: list[tuple[str, list]] = []
        self.number = 0

    def _close(self, depth: int) -> None:
        del self.open[depth:], self.likes[depth + 1 :]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in BLOCK_TAGS and self.open and self.open[-1][1] == "p":
            self._close(len(self.open) - 1)
        self.number += 1
        nth = self.likes[-1][tag] = self.likes[-1].get(tag, 0) + 1
        given = dict(attrs)
        self.open.append((self.number, tag, f"{given.get('id') or ''} {given.get('class') or ''}".lower(), nth))
        self.likes.append({})

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][1] == tag), None)
        if depth is not None:
            self._close(depth)

    def handle_data(self, data):
        if data.strip():
            self.found.append((data.strip(), list(self.open)))


def texts_in_place(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, text and path of each text of each page, the outermost element first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, texts, paths = [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                parser = _Texts()
                parser.feed(page)
                parser.close()
                owner += [i] * len(parser.found)
                texts += [t for t, _ in parser.found]
                paths += [p for _, p in parser.found]
            first = np.flatnonzero(np.append(True, np.diff(owner) != 0)) if owner else np.zeros(0, int)
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            no, tag, marks, nth = zip(*(n for p in paths for n in p)) if any(paths) else ((),) * 4
            nodes = pa.StructArray.from_arrays([pa.array(no, pa.int32()), pa.array(tag, pa.string()), pa.array(marks, pa.string()), pa.array(nth, pa.int32())], ["no", "tag", "marks", "nth"])
            path = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in paths])), pa.int32()), nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(place, pa.int32()), pa.array(texts, pa.string()), path], [key, "pos", "text", "path"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.where(F.col(key).isNotNull() & F.col(html).isNotNull()).select(key, html).mapInArrow(run, f"{key} {kind}, pos int, text string, path {PATH}")


def is_chrome(node: Column) -> Column:
    return node["tag"].isin(*DROPPED_TAGS) | node["marks"].rlike("|".join(CHROME))


def articles(texts: DataFrame, key: str, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """key, article: of the elements that hold every marker and enough text, the best kind, of those the innermost; pages without one have no row."""
    nodes = F.filter(F.transform("path", lambda n, i: F.struct(i.alias("depth"), n["no"].alias("no"), n["tag"].alias("tag"))), lambda n: n["tag"].isin(*CONTAINERS))
    said = [F.lower(one_spaced(F.col("text"))).contains(m).alias(f"_m{i}") for i, m in enumerate(markers)]
    each = texts.select(key, F.length("text").alias("_n"), *said, F.explode(nodes).alias("n"))
    whole = each.groupBy(key, "n").agg((F.sum("_n") + F.count("*")).alias("size"), *[F.max(f"_m{i}").alias(f"_m{i}") for i in range(len(markers))])
    kind = F.coalesce(*[F.when(F.col("n.tag") == t, score) for t, score in CONTAINERS.items()])
    good = whole.where((F.col("size") > LEAST_TEXT) & F.array_min(F.array(F.lit(True), *[F.col(f"_m{i}") for i in range(len(markers))])))
    return good.groupBy(key).agg(F.max(F.struct(kind.alias("kind"), F.col("n.depth").alias("depth"), (-F.col("n.no")).alias("no"),
        F.col("n.no").alias("own")))["own"].alias("article"))


def article_texts(pages: DataFrame, key: str, html: str = "html", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """key, pos, text and path below the article of each text in it; of a page without article, all that isn't chrome.

    The rows of a page lie in one partition, so what is grouped by page and element later isn't shuffled again.
    """
    texts = materialise(texts_in_place(pages, key, html).where(~F.exists("path", is_chrome)), "page-texts")
    chosen = texts.join(articles(texts, key, markers), key, "left").repartition(key)
    within = F.filter("path", lambda n: n["no"] > F.col("article"))
    inside = F.col("article").isNull() | F.exists("path", lambda n: n["no"] == F.col("article"))
    return chosen.where(inside).select(key, "pos", "text", F.when(F.col("article").isNull(), F.col("path")).otherwise(within).alias("path"))


def blocks_of(texts: DataFrame, key: str) -> DataFrame:
    """key, pos, name, text, is_table: the outermost content blocks.

    A table's text belongs to its innermost cell, and cells to their innermost row: cells are parted by bars, rows by line
    ends. A list's items are its own, without lists inside them.
    """
    after = lambda path, no: F.filter(path, lambda n: n["no"] > no)
    last = lambda path, *tags: F.try_element_at(F.filter(path, lambda n: n["tag"].isin(*tags)), F.lit(-1))
    block = F.get(F.filter("path", lambda n: n["tag"].isin(*BLOCK_TAGS)), F.lit(0))
    placed = computed_once(texts.select(key, "pos", "text", "path", block.alias("b")).where("b is not null")).withColumn("below", after("path", F.col("b.no")))
    item = F.get(F.filter("below", lambda n: n["tag"] == "li"), F.lit(0))
    told = computed_once(placed.select(
        key, "pos", "text", F.col("b.no").alias("no"), F.col("b.tag").alias("name"), last("below", "tr")["no"].alias("tr"),
            last("below", "td", "th")["no"].alias("td"), item.alias("li"),
        F.exists("below", lambda n: n["tag"].isin("ul", "ol") & (n["no"] > item["no"])).alias("deeper"),
    ))
    table, listed = F.col("name") == "table", F.col("name").isin("ul", "ol")
    own = told.where(~table & ~listed | table & F.col("td").isNotNull() | listed & F.col("li").isNotNull() & ~F.coalesce("deeper", F.lit(False)))
    parts = own.withColumns({"row": F.when(table, F.coalesce("tr", F.lit(0))).when(listed, F.col("li.no")).otherwise(0),
        "cell": F.when(table, F.col("td")).otherwise(0), "nth": F.when(listed, F.col("li.nth"))})
    joined = lambda order, text, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_v")))),
        lambda x: x["_v"]), sep)
    cells = parts.groupBy(key, "no", "name", "row", "nth", "cell").agg(joined("pos", "text", " ").alias("_t"))
    even = cells.withColumn("_t", F.when(table | listed, one_spaced(F.col("_t"))).otherwise(F.col("_t"))).where("_t <> ''")
    rows = even.groupBy(key, "no", "name", "row", "nth").agg(joined("cell", "_t", " | ").alias("_t"))
    mark = F.when(F.col("name") == "ol", F.concat(F.col("nth").cast("string"), F.lit(". "))).when(F.col("name") == "ul", F.lit("• ")).otherwise(F.lit(""))
    blocks = rows.withColumn("_t", F.concat(mark, "_t")).groupBy(key, "no", "name").agg(joined("row", "_t", "\n").alias("text"))
    return blocks.select(key, F.col("no").alias("pos"), "name", "text", table.alias("is_table"))


def parse_blocks(pages: DataFrame, key: str, html: str = "html", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """key, pos, name, text, is_table: one row a cleaned block, without page metadata.

    Of equal texts of a page (but for case and white space) the first stays.
    """
    return _cleaned(article_texts(pages, key, html, markers), key)


def _cleaned(texts: DataFrame, key: str) -> DataFrame:
    cleaned = computed_once(blocks_of(texts, key).withColumn("text", clean_block(F.col("text")))).where("text <> ''")
    told = computed_once(cleaned.withColumn("_low", F.lower(one_spaced(F.col("text"))))).where(~is_page_metadata(F.col("_low")))
    return first_texts(told, [key], F.col("_low"), ["pos"]).drop("_low")


def is_page_metadata(low: Column) -> Column:
    """Lines, in lower case with single spaces, that name the release or its publisher, and say nothing else."""
    named = low.isin("government of india", "press information bureau", "press information bureau government of india")
    return named | low.rlike(r"^release\s+id\s*:\s*\d+$|^posted\s+on\s*:\s*.+\s+by\s+pib$")


def titles(blocks: DataFrame, key: str) -> DataFrame:
    """key, title: the first h1, else h2, else h3, that isn't a publisher's or a metadata line; pages without one have no row."""
    good = F.col("name").isin("h1", "h2", "h3") & ~F.lower("text").contains("press information bureau") & ~F.col("text").rlike(r"(?i)^(?:release\s+id|posted\s+on)\s*:?")
    return blocks.where(good).groupBy(key).agg(F.min(F.struct("name", "pos", "text"))["text"].alias("title"))


def page_documents(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One document a page of ``pages`` (key, html, url, and what the index page said: release_id, title, published_at).

    What the page says comes first: its release id, title, date and publisher; then what the index said. Pages without
    sections have their whole text as one; pages without text fall away. ``published_at`` is an instant, null if neither
    date can be read.
    """
    texts = materialise(article_texts(pages, key, html), "article-texts")
    blocks = materialise(_cleaned(texts, key), "page-blocks")
    order = F.sort_array(F.collect_list(F.struct("pos", "text")))
    whole = texts.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n").alias("_text"))
    numbered = infer_sections(blocks, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section_no", "heading", "content"))).alias("_sections"))
    joined = pages.drop(html).join(whole, key)
    for found in (numbered, titles(blocks, key).withColumnRenamed("title", "_title"), has_tables(blocks, key)):
        joined = joined.join(found, key, "left")
    number = F.coalesce(F.nullif(F.regexp_extract("_text", r"(?i)release\s+id\s*:\s*(\d+)", 1), F.lit("")), F.col("release_id").cast("string"))
    said = computed_once(joined.withColumns({"_id": number, "_title": F.coalesce("_title", "title"), "_posted": posted_on(F.col("_text"))}))
    dated = with_release_instant(with_release_instant(said, "_posted", "_on_page"), "published_at", "_on_index")
    lone = F.array(F.struct(F.lit(1).alias("section_no"), F.lit(MAIN).alias("heading"), clean_block(F.col("_text")).alias("content")))
    document = F.concat(F.lit("PIB-"), F.col("_id"))
    section = lambda s: F.struct(F.concat(document, F.format_string("-S%02d", s["section_no"])).alias("section_id"), s["heading"].alias("heading"),
        s["content"].alias("content"))
    return dated.select(
        key, document.alias("document_id"), F.col("_id").alias("release_id"), F.lit("web_page").alias("source_type"), "url", F.col("_title").alias("title"),
        F.coalesce("_on_page", "_on_index").alias("published_at"),
            F.coalesce(blank_to_null(publisher_line(F.col("_text"), F.col("_title"))), F.lit(PUBLISHER)).alias("organization"),
        script_language(F.col("_text")).alias("language"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"),
        F.transform(F.coalesce("_sections", lone), section).alias("sections"),
    )


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, href, onclick and text of each link of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                links = _Links()
                links.feed(h or "")
                links.close()
                rows += [(k, i, *x) for i, x in enumerate(links.found)]
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "onclick", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, href string, onclick string, text string")


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            values = dict(attrs)
            self.found.append([values.get("href"), values.get("onclick"), ""])
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag != "a"

    def handle_data(self, data):
        if self.open:
            self.found[-1][2] += data


def release_links(links: DataFrame, page: str, template: str, host_text: str = "") -> DataFrame:
    """release_number, url and title of the releases that links lead to; of each number the last link counts.

    The number comes from the address, else from the script; the URL is the address if it is a whole one, else ``template``
    with the number. Only URLs that contain ``host_text`` stay.
    """
    number = F.coalesce(release_number(F.col("href")), release_number(F.col("onclick")))
    url = F.when(F.col("href").rlike("(?i)^https?://") & release_number(F.col("href")).isNotNull(), F.col("href")).otherwise(F.concat(F.lit(template), number))
    good = links.select(page, "pos", F.col("text").alias("title"), number.alias("release_number"),
        url.alias("url")).where(F.col("release_number").isNotNull() & F.contains(F.lower("url"), F.lit(host_text.lower())))
    return last_by(good, ["release_number"], [page, "pos"]).select("release_number", "url", "title")
