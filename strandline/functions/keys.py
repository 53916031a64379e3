"""Keys and hashes of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*parts: str) -> Column:
    """SHA-256 of the natural key; each part is written with its length, so ("ab", "c") and ("a", "bc") differ."""
    written = [F.concat(F.octet_length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")) for p in parts]
    return F.sha2(F.concat(*written), 256)


def attrs_hash(*columns: str) -> Column:
    """Hash of the payload; nulls count as a value of their own."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def event_id(*columns: str, length: int = 16) -> Column:
    """A short stable id of an event from its fields."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, length)
