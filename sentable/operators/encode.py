"""Label encoders as tables (AGG-6, WIN-1, JN-2, JN-3, FLT-6).

An encoder is a DataFrame (column, value, id): the sorted distinct text of
each column numbered 0..n-1 (code-point order, as Python sorts str).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import formatted, quoted
from sentable.operators.domain import long_form
from sentable.operators.index import rank_within
from sentable.operators.joins import small_side
from sentable.operators.prep import to_numeric



def dense_ids(vals: DataFrame, group: str = "column", value: str = "value", out: str = "id") -> DataFrame:
    """WIN-1: number the distinct ``value`` of each ``group`` 0..n-1 in order
    (exact rank over order-preserving sampled buckets; see ``rank_within``)."""
    return rank_within(vals, [group], value, out)


def fit_labels(df: DataFrame, cols: list[str], fill: str = "?") -> DataFrame:
    """AGG-6: classes per column = sorted distinct ``str`` values (fit on ``all``)."""
    from sentable.sources.io import materialize
    f = formatted(df, cols, fill, upcast=False)
    # read several times, by the ranking and by each column's lookup: written once
    values = materialize(long_form(df, cols, f).distinct(), "label-values")
    return materialize(dense_ids(values), "labels")


def _per_column(enc: DataFrame, c: str, max_rows: int) -> DataFrame:
    e = enc.filter(F.col("column") == c).select(F.col("value").alias("_v"), F.col("id").alias("_id"))
    return small_side(e, max_rows)


def encode_labels(df: DataFrame, enc: DataFrame, cols: list[str], policy: str = "error",
                  fill: str = "?", max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """JN-2: value → id by a left join per column.  An unseen value raises
    (policy 'error'), drops the row ('drop') or becomes null ('null')."""
    f = formatted(df, cols, fill, upcast=False)
    out = df.select(*[f[c].alias(c) if c in cols else F.col(quoted(c)) for c in df.columns])
    for c in cols:
        e = _per_column(enc, c, max_broadcast_rows)
        out = out.join(e, out[c] == e["_v"], "left")
        if policy == "error":
            mapped = F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.col(c)))) \
                      .otherwise(F.col("_id"))
        else:
            mapped = F.col("_id")
        out = out.withColumn(c, mapped.cast("long")).drop("_v", "_id")
        if policy == "drop":
            out = out.filter(F.col(c).isNotNull())
    return out


def decode_labels(df: DataFrame, enc: DataFrame, cols: list[str], max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """JN-3: coerce to number, drop unparsable, keep ids in 0..n-1 (1.0 counts
    as 1, 1.5 does not), map id → value.  One inner join per column does the
    range filter (FLT-6) and the mapping together."""
    out = df
    for c in cols:
        e = _per_column(enc, c, max_broadcast_rows).withColumn("_idd", F.col("_id").cast("double"))
        out = out.withColumn(c, to_numeric(F.col(c)))
        out = out.join(e, out[c] == e["_idd"], "inner").withColumn(c, F.col("_v")).drop("_v", "_id", "_idd")
    return out
