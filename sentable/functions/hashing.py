"""Deterministic randomness.

``u(seed, tag, key)`` is the first 52 bits of md5("seed:tag:key") divided by
2**52: a uniform number in [0, 1) that is exact in a double, identical in any
engine with md5, and independent of partitioning or task retries.  Spark's
``rand(seed)``, ``sample`` and ``randomSplit`` depend on partition layout and
are never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def hash_hex(seed, tag, key) -> Column:
    """md5 hex of "seed:tag:key" (32 lowercase hex characters)."""
    return F.md5(F.concat_ws(":", _lit(seed), _lit(tag), _lit(key).cast("string")))


def hex_to_u(hexcol: Column) -> Column:
    return F.conv(F.substring(hexcol, 1, 13), 16, 10).cast("long").cast("double") / F.lit(TWO_52)


def uniform(seed, tag, key) -> Column:
    """u(seed, tag, key) in [0, 1)."""
    return hex_to_u(hash_hex(seed, tag, key))


def row_key(df_cols_formatted: list[Column]) -> Column:
    """Key of a row without a unique declared key: md5 of its formatted cells."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("\u0000")) for c in df_cols_formatted]))
