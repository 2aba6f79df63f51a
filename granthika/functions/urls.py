"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def is_http_url(url: Column) -> Column:
    """True for http or https with a host; null and malformed input give false."""
    return F.coalesce(url.rlike(r"(?i)^https?://") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def on_whitelist(url: Column, domains: list[str]) -> Column:
    """True if the host is one of ``domains`` or a subdomain of one."""
    h = host(url)
    hits = [(h == d) | h.endswith("." + d) for d in (x.lower() for x in domains)]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def canonical_release_url(url: Column, template: str) -> Column:
    """``template`` with the release number of ``url`` (PRID=n) put in; other URLs pass unchanged."""
    prid = release_number(url)
    return F.when(prid.isNotNull(), F.concat(F.lit(template), prid)).otherwise(url)


def release_number(text: Column) -> Column:
    """Digits after ``PRID=`` in any case; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?i)PRID\s*=\s*(\d+)", 1), F.lit(""))
