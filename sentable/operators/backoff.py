"""GEN-9 by interpolated back-off: every level that knows a context has its say.

Without context, P(unseen value) is g = (n1 + 1) / (rows + 2), the share of values met once (all unseen values are
one symbol, as in the plain loss), and P(value) = (1 - g) (n + 1) / (rows + kinds).  From there P goes through the
levels from the shortest context to the longest one: P = (max(n - D, 0) + D * kinds * P of the level below) / total, with
the count n of the value in this context, and the total and the number of kinds of values there.  D is
n1 / (n1 + 2 n2) of the column's level, from the entries counted once and twice: near 1 where values hardly
repeat, so that a level which knows little passes nearly all on.  What the discount takes from seen values goes to the level below, so probabilities sum to 1 at each level.
A context that training does not have leaves P as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.operators import experts as X
from sentable.operators.joins import small_side

LEVELS = 3
NO_ONES = 0.5           # the discount of a level without entries counted once


def discounts(counts: DataFrame) -> DataFrame:
    """(col, level, d): a row a column and level; of level 0 the unseen values' share."""
    n1, n2 = (F.count_if(F.col("n") == k) for k in (1, 2))
    return counts.groupBy("col", "level").agg(F.when(F.col("level") == 0, (n1 + 1) / (F.sum("n") + 2.0)).when(n1 == 0, F.lit(NO_ONES)).otherwise(n1 / (n1 + 2 * n2)).alias("d"))


def probabilities(model: X.ExpertModel, cells: DataFrame, oid: int = 0) -> DataFrame:
    """``cells`` (col, value, c0, c1, c2, ...) with ``p``."""
    from sentable.sources.io import materialize
    counts = materialize(model.counts.filter((F.col("order_id") == oid) & (F.col("level") < LEVELS)), "backoff-counts")
    groups = counts.groupBy("col", "level", "ctx").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    d = discounts(counts)
    for L in range(LEVELS):
        cells = cells.join(F.broadcast(d.filter(F.col("level") == L).select("col", F.col("d").alias(f"d{L}"))), "col", "left")
        g = groups.filter(F.col("level") == L).select("col", F.col("ctx").alias(f"c{L}"), F.col("t").alias(f"t{L}"), F.col("k").alias(f"k{L}"))
        n = counts.filter(F.col("level") == L).select("col", F.col("ctx").alias(f"c{L}"), "value", F.col("n").alias(f"n{L}"))
        cells = cells.join(F.broadcast(g) if L == 0 else small_side(g, 100_000), ["col", f"c{L}"], "left")
        cells = cells.join(n, ["col", f"c{L}", "value"], "left")
    p = F.when(F.col("t0").isNull(), F.lit(1.0)).when(F.col("n0").isNull(), F.col("d0")).otherwise(
        (1.0 - F.col("d0")) * (F.col("n0") + 1) / (F.col("t0") + F.col("k0")))
    for L in range(1, LEVELS):
        seen = F.greatest(F.coalesce(f"n{L}", F.lit(0)) - F.col(f"d{L}"), F.lit(0.0))
        p = F.when(F.col(f"t{L}").isNotNull(), (seen + F.col(f"d{L}") * F.col(f"k{L}") * p) / F.col(f"t{L}")).otherwise(p)
    return cells.withColumn("p", p).drop(*[f"{x}{L}" for x in "tknd" for L in range(LEVELS)])


def cells_of(model: X.ExpertModel, df: DataFrame, oid: int = 0) -> DataFrame:
    """(col, value, c0, c1, c2, w): equal cells are one row, counted."""
    o = model.orders[oid]
    text = {c: X.cell_text(df, c) for c in o}
    items = [F.struct(F.lit(c).alias("col"), text[c].alias("value"),
                      *[(X._ctx(model, o, j, L, text) if L <= min(j, 2) else F.lit(X.NO_LEVEL)).alias(f"c{L}") for L in range(LEVELS)])
             for j, c in enumerate(o)]
    return df.select(F.inline(F.array(*items))).groupBy("col", "value", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("w"))


def evaluate(model: X.ExpertModel, val: DataFrame, oid: int = 0) -> DataFrame:
    """(column, loss): the mean of -ln P by column, and over the columns ('__mean__')."""
    cells = probabilities(model, cells_of(model, val, oid), oid)
    per = cells.groupBy("col").agg((F.sum(-F.log("p") * F.col("w")) / F.sum("w")).alias("loss"))
    every = per.agg(F.avg("loss").alias("loss")).select(F.lit("__mean__").alias("col"), "loss")
    return per.unionByName(every).select(F.col("col").alias("column"), F.round("loss", 6).alias("loss"))
