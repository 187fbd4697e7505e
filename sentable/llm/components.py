"""Connected components of an edge table, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import cut

JUMPS = 2      # pointer doublings a round: chains of 2**JUMPS nodes collapse in one


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Each round every node points to its smallest neighbour if that is smaller, pointers
    are doubled, and edges are redrawn between what they point to, until none is left.
    Joins are left to the planner, which can split a hub's rows."""
    first = edges = _drawn(edges)
    steps = []
    while not edges.isEmpty():
        step = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "pointers")
        far = step
        for _ in range(JUMPS):
            far = _moved(far, far.toDF("node", "next"), "to")
        steps.append(cut(far, "pointers"))
        edges = _drawn(_moved(_moved(edges, steps[-1].toDF("node", "next"), "a"), steps[-1].toDF("node", "next"), "b"))
    roots = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for step in steps:
        roots = _moved(roots, step.toDF("node", "next"), "root")
    return cut(roots, "roots")


def _drawn(edges: DataFrame) -> DataFrame:
    return cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")


def _moved(df: DataFrame, step: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by what ``step`` (node, next) points it to."""
    step = step.toDF("_at", "_next")
    return (df.join(step, F.col(col) == F.col("_at"), "left").withColumn(col, F.coalesce("_next", col)).drop("_at", "_next"))
