"""Lines repeated across one site's documents.

Method: every task keeps a Misra-Gries summary of line hashes per site; the summaries add up to one summary per site
whose error is known. Every line that can reach the site's threshold is a candidate. A second pass counts the candidates
exactly (distinct documents per full line), and the confirmed lines go to the tasks as broadcast sets that clean the pages.

The error of a summary is at most the site's lines over its counters, so a task gives a site counters in proportion to
the mean lines of its pages, and the error stays at a tenth of its pages. Where pages were fetched so often that this
still reaches the threshold, the site loses the guarantee; all its lines are then counted exactly.

Defined results: null text has no lines and stays null; blank lines never count and are kept; null document ids aren't
counted as documents, but their lines are cleaned; pages without organization and host belong to no site and stay as
they are; repeated rows each give their occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.urls import host
from granthika.session import broadcast_within, materialise

#: A line counts as repeated from so many documents and from this share of the site's documents.
MIN_DOCS, MIN_SHARE = 5, 5
#: Counters a summary keeps for one site at least, and for each line of its mean page.
COUNTERS, PER_LINE = 256, 2 * MIN_SHARE
SUMMARY = "org string, h long, n long, err long"


def site(organization: Column, url: Column) -> Column:
    """Lower-case organization less a leading ``www.``; where null, the host of the URL."""
    return F.coalesce(F.regexp_replace(F.lower(organization), r"^www\.", ""), host(url))


def line_forms(text: Column) -> Column:
    """Array with the form of each line under which lines are compared: lower case, digit runs as 0, no white space."""
    even = F.regexp_replace(F.regexp_replace(text, r"[\t\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+", ""), r"\p{Nd}+", "0")
    return F.split(F.lower(even), "\n", -1)


def _keep_largest(counts: Counter, k: int) -> tuple[Counter, int]:
    """Misra-Gries reduction to ``k`` counters: the (k+1)-th largest count is taken off all."""
    if len(counts) <= k:
        return counts, 0
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return Counter({h: n - cut for h, n in counts.items() if n > cut}), cut


def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's summary per site of its rows (org, hs: hashes of the page's distinct lines)."""
    counters: dict[str, Counter] = {}
    errors, pages, lines = Counter(), Counter(), Counter()
    room = lambda org: max(COUNTERS, -(-PER_LINE * lines[org] // pages[org]))
    for pdf in batches:
        for org, lists in pdf.groupby("org", sort=False)["hs"]:
            hashes, n = np.unique(np.concatenate(lists.to_numpy()), return_counts=True)
            pages[org] += len(lists)
            lines[org] += int(n.sum())
            own = counters.setdefault(org, Counter())
            own.update(dict(zip(hashes.tolist(), n.tolist())))
            if len(own) > 8 * room(org):
                counters[org], cut = _keep_largest(own, room(org))
                errors[org] += cut
    for org, own in counters.items():
        own, cut = _keep_largest(own, room(org))
        size = len(own)
        yield pd.DataFrame(
            {"org": org, "h": pd.array([*own, None], dtype="Int64"), "n": [*own.values(), 0], "err": [0] * size + [errors[org] + cut]}
        )


def repeated_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed, occurrences) of ``pages`` with record_no, doc_id, org and raw_text.

    confirmed: org, form, n_docs, site_docs. occurrences: org, form, record_no, line_no, doc_id of candidates, of which
    the confirmed ones are a part.
    """
    named = pages.where(F.col("org").isNotNull())
    sites = named.groupBy("org").agg(F.countDistinct("doc_id").alias("site_docs")).where(F.col("site_docs") >= MIN_DOCS)
    sites = materialise(sites.withColumn("need", F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("site_docs") / MIN_SHARE))), "sites")
    few = broadcast_within(sites)

    text = named.where(F.col("raw_text").isNotNull()).join(few.select("org"), "org", "left_semi")
    forms = text.select("org", "record_no", "doc_id", line_forms(F.col("raw_text")).alias("forms"))
    hashes = forms.select("org", F.transform(F.filter(F.array_distinct("forms"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("hs"))
    partial = hashes.where(F.size("hs") > 0).mapInPandas(summarise, SUMMARY)
    merged = materialise(partial.groupBy("org", "h").agg(F.sum("n").alias("n"), F.sum("err").alias("err")), "summary")
    bounds = merged.where(F.col("h").isNull()).select("org", F.col("err").alias("bound")).join(few, "org").select("org", "bound", "need")
    candidates = merged.where(F.col("h").isNotNull()).join(broadcast_within(bounds), "org").where(F.col("n") + F.col("bound") >= F.col("need"))

    lines = forms.select("org", "record_no", "doc_id", F.posexplode("forms").alias("line_no", "form")).where(F.col("form") != "").withColumn("h", F.xxhash64("form"))
    chosen = lines.join(broadcast_within(candidates.select("org", "h")), ["org", "h"], "left_semi")
    unsure = bounds.where(F.col("bound") >= F.col("need")).select("org")
    if not unsure.isEmpty():
        whole = broadcast_within(unsure)
        chosen = chosen.join(whole, "org", "left_anti").unionByName(lines.join(whole, "org", "left_semi"))
    occurrences = materialise(chosen.drop("h"), "lines")
    confirmed = (
        occurrences.groupBy("org", "form").agg(F.countDistinct("doc_id").alias("n_docs"))
        .join(few, "org").where(F.col("n_docs") >= F.col("need"))
        .select("org", "form", "n_docs", "site_docs")
    )
    return materialise(confirmed, "confirmed"), occurrences


def occurrences_of(confirmed: DataFrame, occurrences: DataFrame) -> DataFrame:
    """record_no and line_no (from 0) of every occurrence of a confirmed line."""
    return occurrences.join(broadcast_within(confirmed.select("org", "form")), ["org", "form"], "left_semi").select("record_no", F.col("line_no").cast("long").alias("line_no"))


def without_lines(pages: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``pages`` with ``cleaned_text`` and ``lines_removed``; a site's confirmed lines are few (at most MIN_SHARE times its mean lines a page)."""
    sets = confirmed.groupBy("org").agg(F.collect_set("form").alias("_granthika_set"))
    joined = pages.join(broadcast_within(sets), "org", "left")
    split = joined.withColumns({"_granthika_lines": F.split("raw_text", "\n", -1), "_granthika_forms": line_forms(F.col("raw_text"))})
    # The lines of a page that are in the set are found by hash; only these few are then compared with each line.
    found = split.withColumn("_granthika_found", F.array_intersect("_granthika_forms", "_granthika_set"))
    keep = F.filter("_granthika_lines", lambda _, i: ~F.array_contains(F.col("_granthika_found"), F.get(F.col("_granthika_forms"), i)))
    kept = found.withColumn("_granthika_kept", F.when(F.col("_granthika_set").isNull(), F.col("_granthika_lines")).otherwise(keep))
    out = kept.withColumns({"cleaned_text": F.array_join("_granthika_kept", "\n"), "lines_removed": F.size("_granthika_lines") - F.size("_granthika_kept")})
    return out.drop("_granthika_lines", "_granthika_forms", "_granthika_kept", "_granthika_set", "_granthika_found")
