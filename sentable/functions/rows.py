"""Row-level helpers that keep expensive projections where they are.

Catalyst pushes a Filter on a computed column down through every Project
(inlining the expression, even below an Exchange that spreads the input).
Dropping rows through a generator instead — ``inline(when(cond,
array(struct(row))))`` emits the row or nothing — keeps the computation in
place and evaluated once; the Generate node also stops inferred
``isnotnull`` join filters from being pushed into the projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import quoted


def keep_if(df: DataFrame, cond: Column | str) -> DataFrame:
    c = F.col(cond) if isinstance(cond, str) else cond
    return df.select(F.inline(F.when(c, F.array(F.struct(*[F.col(quoted(x)).alias(x) for x in df.columns])))))


def barrier(df: DataFrame) -> DataFrame:
    """Same rows; computed columns above stay computed once."""
    return df.select(F.inline(F.array(F.struct(*[F.col(quoted(x)).alias(x) for x in df.columns]))))
