"""Identifiers as pure expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version 5 UUID of a name, as text; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    dash = F.lit("-")
    return F.concat(F.substring(digest, 1, 8), dash, F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), dash, variant,
        F.substring(digest, 18, 3), dash, F.substring(digest, 21, 12))


def web_id(url: Column) -> Column:
    """``WEB_`` and 16 digits of the URL's SHA-256."""
    return F.concat(F.lit("WEB_"), F.substring(F.sha2(url, 256), 1, 16))
