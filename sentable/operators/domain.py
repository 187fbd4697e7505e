"""Domains of categorical columns and the domain check of parsed rows
(AGG-3, JN-1, AGG-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import formatted
from sentable.operators.joins import small_side


def long_form(df: DataFrame, cols: list[str], values: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` to (column, value) rows in one pass (no union of scans)."""
    values = values or {c: F.col(c) for c in cols}
    keep = keep or []
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), values[c].alias("value"))
                                               for c in cols])))


def domains(real: DataFrame, cols: list[str], fill: str | None = "?") -> DataFrame:
    """AGG-3: distinct stripped text per column; a null is ``fill`` (the
    reference's re-read without fill turns it into 'nan': pass fill='nan')."""
    f = formatted(real, cols, null_text=fill if fill is not None else "nan", upcast=False)
    return long_form(real, cols, f).distinct()


def domain_flags(parsed: DataFrame, dom: DataFrame, cols: list[str], max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Add ``_in_<col>`` flags: the parsed value occurs in the column's domain.

    Each per-column domain is a left join on (value); the domain side is
    broadcast only after its row count is checked, else a shuffle join."""
    from sentable.sources.io import materialize
    out = parsed
    dom = materialize(dom, "domains", ["column"])   # small: computed once, read per column
    for c in cols:
        d = dom.filter(F.col("column") == c).select(F.col("value").alias(f"_dv_{c}")).distinct()
        d = small_side(d, max_broadcast_rows).withColumn(f"_in_{c}", F.lit(True))
        out = out.join(d, out[c] == d[f"_dv_{c}"], "left").drop(f"_dv_{c}") \
                 .withColumn(f"_in_{c}", F.coalesce(F.col(f"_in_{c}"), F.lit(False)))
    return out


def in_domain(parsed: DataFrame, dom: DataFrame, cols: list[str], max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """JN-1: keep rows whose values occur in the real table, column by column
    (left-semi joins; the small per-column domain is broadcast when checked small)."""
    from sentable.sources.io import materialize
    out = parsed
    dom = materialize(dom, "domains", ["column"])   # small: computed once, read per column
    for c in cols:
        d = dom.filter(F.col("column") == c).select(F.col("value").alias(f"_dv_{c}")).distinct()
        d = small_side(d, max_broadcast_rows)
        out = out.join(d, out[c] == d[f"_dv_{c}"], "left_semi")
    return out


def parse_report(flags: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-5: one pass of conditional sums → (step, stage, n) rows:
    lines, problem lines, parsed, then survivors after each domain check."""
    ok = F.col("_complete")
    aggs = [F.count(F.lit(1)).alias("s0"),
            F.sum(F.when(~ok, 1).otherwise(0)).alias("s1"),
            F.sum(F.when(ok, 1).otherwise(0)).alias("s2")]
    cond = ok
    for i, c in enumerate(cols):
        cond = cond & F.col(f"_in_{c}")
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).alias(f"s{3 + i}"))
    names = ["lines", "problem_lines", "parsed"] + [f"in_domain:{c}" for c in cols]
    a = flags.agg(*aggs)
    return a.select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("stage"),
                                                F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("long").alias("n"))
                                       for i, n in enumerate(names)])))
