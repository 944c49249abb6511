"""Seeded, engine-independent hashes.

All seeded operators (missingness injection, splits, folds, subsamples) use
md5 of a ``|``-joined text, which gives the same value in Spark and in any SQL
engine with ``md5``.  The assignment of a row therefore depends only on its
key, never on partitioning or on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _text(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """First 8 hex digits of md5 as a non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 8), 16, 10).cast("bigint")


def hash60(*parts) -> Column:
    """First 15 hex digits of md5 as a non-negative bigint (60 bits)."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 15), 16, 10).cast("bigint")


def unit_hash(*parts) -> Column:
    """Uniform number in [0, 1) from the seeded key."""
    return hash32(*parts) / F.lit(TWO_32)


def sql_hash32(*parts: str) -> str:
    """SQL text of :func:`hash32` for DuckDB-style engines (oracle side)."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_unit_hash(*parts: str) -> str:
    return f"({sql_hash32(*parts)} / 4294967296.0)"
