"""Row hashes that decide a split; equal on every partitioning and every engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_digest(key: Sequence[Column], seed: int) -> Column:
    """md5 hex of the key columns and the seed; nulls count as empty text."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def percent_bucket(digest: Column) -> Column:
    """0..99 from the first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
