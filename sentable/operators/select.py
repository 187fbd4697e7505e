"""GEN-10: early-stopped candidate selection by validation loss."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.operators import experts as X


FINEST = 1_000


def coarser(m: X.ExpertModel, bins: int) -> X.ExpertModel:
    """The model with fewer bins, which divide those of ``m``: its contexts' bins are merged and their counts added."""
    if m.bins % bins:
        raise ValueError(f"{bins} bins are not made of {m.bins}")
    step = m.bins // bins
    merged = lambda t: F.when(t == "-1", t).otherwise(F.floor(t.try_cast("long") / step).cast("string"))
    ctx = F.when(F.col("level") == 0, F.col("ctx"))
    for oid, o in enumerate(m.orders):
        for j, c in enumerate(o):
            here = (F.col("order_id") == oid) & (F.col("col") == c)
            if j and o[j - 1] in m.numeric:
                ctx = ctx.when(here & (F.col("level") == 1), merged(F.col("ctx")))
            if j >= 2:
                first, last = F.substring_index("ctx", X.SEP, 1), F.substring_index("ctx", X.SEP, -1)
                parts = [merged(first) if o[0] in m.numeric else first, merged(last) if o[j - 1] in m.numeric else last]
                ctx = ctx.when(here & (F.col("level") == 2), F.concat(parts[0], F.lit(X.SEP), parts[1]))
            for d, g in enumerate(o[j + 1:]):
                if g in m.numeric:
                    ctx = ctx.when(here & (F.col("level") == X.NEXT_LEVEL + d), merged(F.col("ctx")))
    counts = m.counts.withColumn("ctx", ctx.otherwise(F.col("ctx"))).groupBy(*X.GROUP, "value").agg(F.sum("n").alias("n"))
    return X.ExpertModel(m.cols, m.orders, m.numeric, bins, counts, m.cond, dict(m.meta))


def select_best(train: DataFrame, val: DataFrame, cols: list[str], cond: str | None, candidates: list[int],
                patience: int = 2, key: str = "row_key") -> DataFrame:
    """Evaluate a model per candidate bin count (in order); stop
    after ``patience`` evaluations without improvement; report every
    evaluated candidate with the chosen one flagged.  Only the mean loss of
    each candidate reaches the driver.

    The training rows are scanned once: bins of equal width are nested in those of any multiple of
    their number, so the tables fitted with the candidates' least common multiple add up to each
    candidate's.  Where that would be over ``FINEST`` bins, each candidate is fitted by itself."""
    from sentable.sources.io import materialize
    # every candidate reads both inputs: derive them once
    train, val = materialize(train, "select-train"), materialize(val, "select-val")
    rows, best, bad = [], None, 0
    edges = X.numeric_edges(train, cols)
    finest = math.lcm(*candidates)
    fine = None
    if finest <= FINEST:
        fine = X.fit(train, cols, cond=cond, bins=finest, edges=edges)
        fine.counts = materialize(fine.counts, "select-counts")
    for i, b in enumerate(candidates):
        m = coarser(fine, b) if fine else X.fit(train, cols, cond=cond, bins=b, edges=edges)
        loss = X.evaluate(m, val, key).filter(F.col("column") == "__mean__").first()["loss"]
        rows.append((i, b, float(loss)))
        if best is None or loss < best[2]:
            best, bad = rows[-1], 0
        else:
            bad += 1
            if bad >= patience:
                break
    spark = train.sparkSession
    return spark.createDataFrame([(i, b, l, (i == best[0])) for i, b, l in rows],
                                 "step long, bins long, loss double, selected boolean")
