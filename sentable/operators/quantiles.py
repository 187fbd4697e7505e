"""Mergeable quantile sketches of numeric columns, equi-depth edges and inverse-CDF draws.

A sketch is a table of nodes (col, lo, hi, n): the least and the greatest value and the number of rows
of a cell.  The range of a column is cut into ``WAYS`` cells; a cell with more than 1 / ``accuracy``
of the rows is cut again, up to ``LEVELS`` times, unless all its values are equal.  Each pass is one
map-side combined count over the rows in cells that are cut, so an outlier that leaves all
others in one cell costs a pass and no accuracy.  Nodes of one sketch are disjoint and their
counts exact: the rank of a node's least value is known exactly, and ranks between are off by
less than the node's count, at most 1 / accuracy of the rows unless the node is one value (or its
values agree in their first LEVELS * 8 bits within the range).

Counts add, so sketches of parts of a table merge by a union of nodes; then the rank error is that of
both parts together.  Missing and infinite values are not in a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentable.functions.fmt import is_numeric_type, quoted

WAYS_BITS, LEVELS = 8, 6
ACCURACY = 512


def numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if is_numeric_type(df.schema[c].dataType)]


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, x): every finite number of the numeric columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(quoted(c)).cast("double").alias("x")) for c in cols])
    return df.select(F.inline(cells)).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))


def sketch(df: DataFrame, cols: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(col, lo, hi, n) of the numeric columns of ``df``, written to the checkpoint folder."""
    from sentable.sources.io import materialize
    cols = numeric_columns(df, cols or df.columns)
    spark = df.sparkSession
    empty = spark.createDataFrame([], "col string, lo double, hi double, n long")
    if not cols:
        return empty
    rows = _long(df, cols)
    span = {r["col"]: r for r in rows.groupBy("col").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                                         F.count(F.lit(1)).alias("n")).collect()}      # a row a column
    if not span:
        return empty
    pick = lambda f, kind: F.create_map(*[F.lit(y) for c, r in span.items() for y in (c, f(r))])[F.col("col")].cast(kind)
    lo, hi, limit = pick(lambda r: r["lo"], "double"), pick(lambda r: r["hi"], "double"), pick(lambda r: r["n"] // accuracy, "long")
    at = F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    cell = lambda level: F.least(F.floor(at * float(1 << WAYS_BITS * level)),
                                 F.lit((1 << WAYS_BITS * level) - 1)).cast("long")
    nodes, heavy = [], None
    for level in range(1, LEVELS + 1):
        inside = rows if heavy is None else rows.withColumn("parent", cell(level - 1)).join(
            F.broadcast(heavy), ["col", "parent"], "left_semi")       # at most accuracy cells a column
        found = materialize(inside.groupBy("col", cell(level).alias("cell")).agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")), "quantile-cells")
        cut_again = (F.col("n") > limit) & (F.col("lo") < F.col("hi")) & F.lit(level < LEVELS)
        nodes.append(found.where(~cut_again).select("col", "lo", "hi", "n"))
        heavy = found.where(cut_again).select("col", F.col("cell").alias("parent"))
        if heavy.isEmpty():
            break
    out = nodes[0]
    for d in nodes[1:]:
        out = out.unionByName(d)
    return materialize(out, "quantile-nodes")


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("col", "lo", "hi").agg(F.sum("n").alias("n"))


def ranked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``before``, the rows below, and ``total``.  A column's nodes are bounded by the accuracy."""
    w = Window.partitionBy("col").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.select("*", (F.sum("n").over(w) - F.col("n")).alias("before"),
                        F.sum("n").over(Window.partitionBy("col")).alias("total"))


def edge_table(nodes: DataFrame, bins: int) -> DataFrame:
    """(col, b, edge, rank, total): the least value of the first node with at least b / bins of the
    rows below it, for b from 1; ``rank`` rows are below it, exactly.  Bins that a frequent value fills give no edge twice."""
    r = ranked(nodes).select("col", "lo", "before", "total", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("b"))
    r = r.where(F.col("before") * bins >= F.col("b") * F.col("total"))
    first = r.groupBy("col", "b").agg(F.min(F.struct("lo", "before", "total")).alias("f"))
    return first.groupBy("col", F.col("f.lo").alias("edge"), F.col("f.before").alias("rank"), F.col("f.total").alias("total")) \
                .agg(F.min("b").cast("long").alias("b")).select("col", "b", "edge", "rank", "total")


def edges(nodes: DataFrame, bins: int) -> dict[str, list[float]]:
    """Ascending inner edges of every column: fewer than ``bins`` numbers each."""
    out = {r["col"]: [] for r in nodes.select("col").distinct().collect()}
    for r in edge_table(nodes, bins).orderBy("col", "edge").collect():
        out[r["col"]].append(r["edge"])
    return out


def bin_of(x: Column, inner: list[float]) -> Column:
    """The number of edges that are not above ``x``, as text; -1 for missing numbers."""
    x = x.cast("double")
    b = F.when(x.isNull() | F.isnan(x), F.lit("-1"))
    for k, e in enumerate(inner):
        b = b.when(x < F.lit(e), F.lit(str(k)))
    return b.otherwise(F.lit(str(len(inner))))


def bin_nodes(nodes: DataFrame, inner: dict[str, list[float]]) -> DataFrame:
    """(col, bin, rows, size, block, node): each bin's nodes in order, with the rows up to each one's end,
    under every block of ``size`` rows that they meet.  Blocks hold as many rows as a node does on average, so a
    row of the bin meets fewer than two nodes in its block."""
    cuts = F.create_map(*[F.lit(y) for c, e in inner.items() for y in (c, ",".join(map(repr, e)))])[F.col("col")]
    b = F.size(F.filter(F.transform(F.split(cuts, ","), lambda e: e.try_cast("double")), lambda e: e <= F.col("lo")))
    n = nodes.select("col", "lo", "hi", "n", b.cast("string").alias("bin"))
    whole = Window.partitionBy("col", "bin")
    n = n.select("*", F.sum("n").over(whole.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                 F.sum("n").over(whole).alias("rows"), F.ceil(F.avg("n").over(whole)).cast("long").alias("size"))
    first, last = F.floor((F.col("upto") - F.col("n")) / F.col("size")), F.floor((F.col("upto") - 1) / F.col("size"))
    return n.select("col", "bin", "rows", "size", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"),
                    F.struct("upto", "lo", "hi", "n").alias("node"))


def draw_inside(r: Column, node: Column, integral: bool) -> Column:
    """The value of row ``r`` of a bin, which is one of ``node``'s: a place in it by linear interpolation."""
    t = (r - node["upto"] + node["n"]) / node["n"]
    if integral:
        return node["lo"] + F.floor((node["hi"] - node["lo"] + 1.0) * t)
    return node["lo"] + (node["hi"] - node["lo"]) * t
