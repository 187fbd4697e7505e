"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentable.functions.fmt import quoted

MAX_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the size of a row: the bytes of its texts, of nested values as JSON, and 16 a column."""
    texts = [F.col(quoted(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [F.to_json(F.struct(quoted(f.name))) for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in [*texts, *nested]), F.lit(16 * len(df.columns)))


def small_side(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The check is an explicit bounded scan (``limit(max_rows + 1)``); above the
    bounds the side is left to a shuffle join, which AQE may still convert or
    split at run time."""
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= max_rows and (r["b"] or 0) <= max_bytes else df
