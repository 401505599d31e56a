"""Seeded hashes that order and draw the same way on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed, parts) -> Column:
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    columns = [F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", seed_col.cast("string"), *[c.cast("string") for c in columns]), 256)


def stable_hash(seed, *parts) -> Column:
    """First 16 hex digits of sha256("seed|part|..."); ordering the text orders the number."""
    return F.substring(_digest(seed, parts), 1, 16)


def hash_uniform(seed, *parts) -> Column:
    """A double strictly inside (0, 1) made from 52 hash bits."""
    head = F.conv(F.substring(_digest(seed, parts), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(2**52))


def hex_prefix(hex_text: Column, digits: int) -> Column:
    """Leading hex digits as an integer: a bucket that never runs against the hash order."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("int")
