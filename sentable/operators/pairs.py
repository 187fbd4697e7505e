"""Pair models: order-free count tables of all column pairs, and what is drawn from them.

Each cell becomes a symbol: a category's text, or a number's equi-depth bin (``quantiles``).  One scan counts
the symbols of every pair of columns.  From these tables alone come

- the mutual information of all pairs and the maximum spanning tree over it, which gives every
  column the parent that says most about it, wherever it stands in the table (GEN-1, GEN-3);
- rows drawn along the tree, or each in its own order of columns (GEN-5);
- missing cells filled from all given cells of their row at once (GEN-8).

A drawn bin becomes a number by the inverse CDF inside it, or by a walk over its next-token table
(``walk``), so numbers need not be those of the training rows.  Tables add up, so models of parts of a
table with the same edges merge.  A column pair's table has at most as many rows as there are pairs of symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import INTEGRAL, is_missing, quoted
from sentable.functions.hashing import hash_hex, uniform
from sentable.operators import experts as X
from sentable.operators import quantiles as Q
from sentable.operators.joins import small_side

SMOOTH = 0.5            # added to each count of a pair in the log-linear combination
BROADCAST = 200_000


@dataclass
class PairModel:
    cols: list[str]
    edges: dict[str, list[float]]      # inner edges of the numeric columns
    integral: set[str]                 # numeric columns of whole numbers
    nodes: DataFrame                   # the numeric columns' sketches
    singles: DataFrame                 # col, s, n
    pairs: DataFrame                   # a, b, sa, sb, n for columns a before b

    def oriented(self) -> DataFrame:
        """(col, given, value, ctx, n): each pair table in both directions."""
        p = self.pairs
        return p.select(F.col("a").alias("col"), F.col("b").alias("given"), F.col("sa").alias("value"), F.col("sb").alias("ctx"), "n") \
            .unionByName(p.select(F.col("b").alias("col"), F.col("a").alias("given"), F.col("sb").alias("value"), F.col("sa").alias("ctx"), "n"))


def symbol(df: DataFrame, c: str, inner: dict[str, list[float]]) -> Column:
    return Q.bin_of(F.col(quoted(c)), inner[c]) if c in inner else X.cell_text(df, c)


def fit(df: DataFrame, cols: list[str] | None = None, bins: int = 20, accuracy: int = Q.ACCURACY,
        nodes: DataFrame | None = None, inner: dict[str, list[float]] | None = None) -> PairModel:
    """GEN-1: sketches first, then one scan for the tables of all pairs of columns.

    A model with the same bins for later rows takes the first one's ``nodes`` and ``inner`` edges."""
    from sentable.sources.io import materialize
    cols = cols or df.columns
    numeric = Q.numeric_columns(df, cols)
    nodes = Q.sketch(df, numeric, accuracy) if nodes is None else nodes
    inner = {c: [] for c in numeric} | Q.edges(nodes, bins) if inner is None else inner
    s = df.select(*[symbol(df, c, inner).alias(f"s{k}") for k, c in enumerate(cols)])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{a}").alias("sa"), F.col(f"s{b}").alias("sb"))
             for a in range(len(cols)) for b in range(a + 1, len(cols))]
    # a lone column is paired with nothing: its symbols stand in the table of column -1
    items += [F.struct(F.lit(-1).alias("a"), F.lit(b).alias("b"), F.lit("").alias("sa"), F.col(f"s{b}").alias("sb"))
              for b in range(len(cols))]
    counts = s.select(F.inline(F.array(*items))).groupBy("a", "b", "sa", "sb").agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in cols]), F.col(c) + 1)
    counts = materialize(counts, "pair-counts")
    pairs = counts.where("a >= 0").select(name("a").alias("a"), name("b").alias("b"), "sa", "sb", "n")
    singles = counts.where("a < 0").select(name("b").alias("col"), F.col("sb").alias("s"), "n")
    whole = {c for c in numeric if isinstance(df.schema[c].dataType, INTEGRAL)}
    return PairModel(list(cols), inner, whole, nodes, singles, pairs)


def merge(m: PairModel, other: PairModel) -> PairModel:
    """GEN-11: the model of both models' rows."""
    if m.cols != other.cols or m.edges != other.edges:
        raise ValueError("models must share columns and edges")
    add = lambda x, y, keys: x.unionByName(y).groupBy(*keys).agg(F.sum("n").alias("n"))
    return PairModel(m.cols, m.edges, m.integral, Q.merge_sketches(m.nodes, other.nodes),
                     add(m.singles, other.singles, ["col", "s"]), add(m.pairs, other.pairs, ["a", "b", "sa", "sb"]))


# ------------------------------------------------------------------ the tree
def mutual_information(m: PairModel) -> DataFrame:
    """(a, b, mi) of every pair of columns, in nats."""
    side = lambda c: small_side(m.singles, BROADCAST).select(F.col("col").alias(c), F.col("s").alias("s" + c),
                                                            F.col("n").alias("n" + c))
    p = m.pairs.join(side("a"), ["a", "sa"]).join(side("b"), ["b", "sb"])
    rows = m.singles.where(F.col("col") == m.cols[0]).agg(F.sum("n")).first()[0] or 0        # one number
    n = F.lit(float(max(rows, 1)))
    term = F.col("n") / n * F.log(F.col("n") * n / (F.col("na").cast("double") * F.col("nb")))
    return p.groupBy("a", "b").agg(F.round(F.sum(term), 9).alias("mi"))


def tree(m: PairModel, root: str | None = None, mi: DataFrame | None = None) -> list[tuple[str, str | None]]:
    """(column, parent) in the order of drawing: the maximum spanning tree from ``root`` (the last column).
    Ties go to the parent, then to the column, that comes first in the table.  The driver sees a number a pair of columns."""
    weight = {}
    for r in (mi if mi is not None else mutual_information(m)).collect():
        weight[r["a"], r["b"]] = weight[r["b"], r["a"]] = r["mi"]
    place = {c: k for k, c in enumerate(m.cols)}
    out: list[tuple[str, str | None]] = [(root or m.cols[-1], None)]
    while len(out) < len(m.cols):
        inside = [c for c, _ in out]
        edge = min(((-weight.get((p, c), 0.0), place[p], place[c]) for p in inside for c in m.cols if c not in inside))
        out.append((m.cols[edge[2]], m.cols[edge[1]]))
    return out


def tree_counts(m: PairModel, parents: list[tuple[str, str | None]]) -> DataFrame:
    """(col, level, ctx, value, n) of the tree's experts: level 1 given the parent's symbol, level 0 given nothing."""
    edges = m.nodes.sparkSession.createDataFrame([(c, p) for c, p in parents if p], "col string, given string")
    own = m.oriented().join(F.broadcast(edges), ["col", "given"]).select(
        "col", F.lit(1).cast("long").alias("level"), "ctx", "value", "n")
    return own.unionByName(m.singles.select("col", F.lit(0).cast("long").alias("level"), F.lit("").alias("ctx"),
                                            F.col("s").alias("value"), "n"))


def draw_symbols(m: PairModel, keys: DataFrame, seed, parents: list[tuple[str, str | None]], key: str = "sid",
                 temperature: float = 1.0, given: dict[str, Column] | None = None) -> DataFrame:
    """Each key's symbols, drawn along the tree; ``given`` fixes those of some columns."""
    from sentable.sources.io import materialize
    given = given or {}
    counts = tree_counts(m, parents).withColumn("order_id", F.lit(0).cast("long"))
    order = [c for c, _ in parents]
    tables = X.draw_tables(X.ExpertModel(m.cols, [order], {}, 1, counts), temperature)
    x = keys.select(key, *[v.alias(c) for c, v in given.items()])
    for j, (c, p) in enumerate(parents):
        if c in given:
            continue
        ctx = {0: F.lit("")} | ({1: F.col(quoted(p))} if p else {})
        x = X.draw_column(x, tables, 0, c, ctx, uniform(seed, F.lit(f"tree:{c}"), F.col(key)), c)
        if (j + 1) % 8 == 0 and j + 1 < len(parents):
            x = materialize(x, "tree-part")
    return x.select(key, *[quoted(c) for c in m.cols])


def numbers(m: PairModel, x: DataFrame, seed, key: str = "sid", cols: list[str] | None = None) -> DataFrame:
    """Bins of the numeric columns become numbers by the inverse CDF; -1 becomes null.

    A bin may hold thousands of nodes, so a row looks up only those of the block that its rank is in."""
    wanted = [c for c in (cols or m.cols) if c in m.edges]
    if not wanted:
        return x
    names = x.columns
    nodes = _written(Q.bin_nodes(m.nodes, m.edges), "quantile-bins")
    for c in wanted:
        own = nodes.where(F.col("col") == c).select(F.col("bin").alias("_b"), F.col("rows").alias("_rows"), F.col("size").alias("_size"),
                                                    F.col("block").alias("_k"), F.col("node").alias("_node"))
        sizes = small_side(own.select("_b", "_rows", "_size").distinct(), BROADCAST)
        x = x.select("*", F.col(quoted(c)).alias("_b"), uniform(seed, F.lit(f"inside:{c}"), F.col(key)).alias("_u")).join(sizes, "_b", "left")
        x = x.withColumn("_r", F.floor(F.col("_u") * F.col("_rows")).cast("long"))
        x = x.withColumn("_k", F.floor(F.col("_r") / F.col("_size")).cast("long"))
        x = x.join(small_side(own.select("_b", "_k", "_node"), BROADCAST), ["_b", "_k"], "left")
        upto, r = F.col("_node.upto"), F.col("_r")
        x = x.where(F.col("_node").isNull() | ((upto - F.col("_node.n") <= r) & (r < upto)))
        x = x.select(*[(Q.draw_inside(r, F.col("_node"), c in m.integral) if d == c else F.col(quoted(d))).alias(d) for d in names])
    return x


def sample(m: PairModel, keys: DataFrame, seed, root: str | None = None, key: str = "sid", temperature: float = 1.0,
           parents: list[tuple[str, str | None]] | None = None) -> DataFrame:
    """GEN-3: one new row a key along the tree, numbers drawn inside their bins."""
    parents = parents or tree(m, root)
    return numbers(m, draw_symbols(m, keys, seed, parents, key, temperature), seed, key)


def _written(df: DataFrame, what: str) -> DataFrame:
    from sentable.sources.io import materialize
    return materialize(df, what)


# ------------------------------------------------------------ any order of columns
def row_orders(keys: DataFrame, cols: list[str], seed, key: str = "sid", first: str | None = None) -> Column:
    """GEN-5: each row's own order of columns, by a hash; ``first`` (if any) stands in front."""
    rest = [c for c in cols if c != first]
    items = F.array(*[F.struct(hash_hex(seed, F.lit(f"order:{c}"), F.col(key)).alias("h"), F.lit(c).alias("c")) for c in rest])
    order = F.transform(F.array_sort(items), lambda x: x["c"])
    return F.concat(F.array(F.lit(first)), order) if first else order


def sample_any_order(m: PairModel, keys: DataFrame, seed, key: str = "sid", first: str | None = None,
                     temperature: float = 1.0, orders: Column | None = None) -> DataFrame:
    """GEN-5: new rows whose columns are drawn in an order of the row's own, each given the one drawn before it.

    One plan walks all orders: step k draws every row's k-th column, whichever it is, from the pair tables
    of all columns.  So the plan grows with the columns and not with the orders.  Returns the row's
    order as well (comma-joined, column ``order``)."""
    from sentable.sources.io import materialize
    counts = m.oriented().select(F.concat_ws(X.SEP, "col", "given").alias("col"), F.lit(1).cast("long").alias("level"),
                                 "ctx", "value", "n")
    counts = counts.unionByName(m.singles.select(F.concat_ws(X.SEP, F.col("col"), F.lit("")).alias("col"), F.lit(1).cast("long").alias("level"),
                                                 F.lit("").alias("ctx"), F.col("s").alias("value"), "n"))
    t = entry_table(counts, temperature)
    x = keys.select(key, (orders if orders is not None else row_orders(keys, m.cols, seed, key, first)).alias("_o"))
    x = x.select("*", F.lit("").alias("_s"), F.create_map().cast("map<string,string>").alias("_v"))
    for k in range(len(m.cols)):
        c, p = F.get("_o", k), F.get("_o", k - 1) if k else F.lit("")
        x = x.withColumn("_c", c).withColumn("_u", uniform(seed, F.concat(F.lit("any:"), F.col("_c")), F.col(key)))
        x = draw_entry(x, t, F.concat_ws(X.SEP, F.col("_c"), p), F.col("_s"), F.col("_u"), "_s")
        x = x.withColumn("_v", F.map_concat("_v", F.create_map("_c", "_s"))).drop("_c", "_u")
        if (k + 1) % 8 == 0 and k + 1 < len(m.cols):
            x = materialize(x, "order-part")
    x = x.select(key, F.array_join("_o", ",").alias("order"), *[F.element_at("_v", F.lit(c)).alias(c) for c in m.cols])
    return numbers(m, x, seed, key)


def entry_table(counts: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(col, ctx, block, lo, hi, val, total, size): an entry under each block of weights that its interval
    meets.  Blocks are as wide as an entry is on average, so a probe meets fewer than two."""
    from sentable.operators.dist import block_size, intervals
    w = X.weighted(counts.withColumn("order_id", F.lit(0).cast("long")), temperature).select("col", "ctx", "value", "n")
    iv = intervals(w, ["col", "ctx"])
    e = iv.withColumn("size", block_size()).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("lo") / F.col("size")).cast("long"), F.floor((F.col("hi") - 1) / F.col("size")).cast("long"))))
    return _written(e.select("col", "ctx", "block", "lo", "hi", F.col("value").alias("val"), "total", "size"), "pair-entries")


def draw_entry(x: DataFrame, t: DataFrame, col: Column, ctx: Column, u: Column, out: str) -> DataFrame:
    """The value drawn from the table of (col, ctx), which every row must find there."""
    groups = small_side(t.select(F.col("col").alias("_tc"), F.col("ctx").alias("_tx"), "total", "size").distinct(), BROADCAST)
    e = small_side(t.select(F.col("col").alias("_tc"), F.col("ctx").alias("_tx"), "block", "lo", "hi", "val"), BROADCAST)
    base = [c for c in x.columns if c != out]
    x = x.select("*", col.alias("_tc"), ctx.alias("_tx"), u.alias("_tu")).join(groups, ["_tc", "_tx"])
    x = x.withColumn("_tr", F.floor(F.col("_tu") * F.col("total")).cast("long"))
    x = x.withColumn("block", F.floor(F.col("_tr") / F.col("size")).cast("long")).drop("total", "size")
    x = x.join(e, ["_tc", "_tx", "block"]).where((F.col("lo") <= F.col("_tr")) & (F.col("_tr") < F.col("hi")))
    return x.select(*base, F.col("val").alias(out))


# ------------------------------------------------------------ imputation
def candidates(m: PairModel, df: DataFrame, key: str = "row_key") -> DataFrame:
    """(key, col, value, score): of each missing cell the values that training rows have with some given cell of
    the row, and for a row without any given cell all values of the column.

    The score is log-linear in all given cells g: ln n(v) + sum over g of ln P(g | v), with
    P(g | v) = (n(v, g) + SMOOTH) / (n(v) + SMOOTH * symbols of g's column).  Given cells and pair
    tables meet in a join on (column, given column, its symbol), and what a value gets from each is summed
    by (row, column, value); so a cell's candidates are spread over tasks."""
    kinds = m.singles.groupBy("col").agg(F.count(F.lit(1)).alias("k"))
    known = {r["col"]: r["k"] for r in kinds.collect()}                        # a number a column
    given = [F.struct(F.lit(c).alias("c"), F.when(~is_missing(df, c), symbol(df, c, m.edges)).alias("s")) for c in m.cols]
    cells = F.array(*given)
    x = df.select(F.col(quoted(key)).alias("_key"), F.filter(cells, lambda v: v["s"].isNotNull()).alias("g"),
                  F.transform(F.filter(cells, lambda v: v["s"].isNull()), lambda v: v["c"]).alias("lost"))
    x = _written(x.where(F.size("lost") > 0), "impute-cells")
    lost = x.select("_key", "g", F.explode("lost").alias("col"))
    met = lost.select("_key", "col", F.explode("g").alias("v")).select("_key", "col", F.col("v.c").alias("given"), F.col("v.s").alias("ctx"))
    pairs = small_side(_written(m.oriented(), "oriented-pairs"), BROADCAST)
    lift = F.sum(F.log((F.col("n") + SMOOTH) / SMOOTH))
    seen = met.join(pairs, ["col", "given", "ctx"]).groupBy("_key", "col", "value").agg(lift.alias("lift"))
    # what a value's score is without any pair: the same for all rows with the same given columns
    pattern = F.array_join(F.transform("g", lambda v: v["c"]), X.SEP)
    shape = lost.select("_key", "col", pattern.alias("pattern"))
    patterns = _written(shape.select("col", "pattern").distinct(), "impute-patterns")       # as many as missing patterns
    k = F.create_map(*[F.lit(y) for c, n in known.items() for y in (c, float(n))])
    names = F.filter(F.split("pattern", X.SEP), lambda c: c != "")
    floor_ = F.aggregate(names, F.log("n"), lambda acc, c: acc - F.log(F.col("n") + F.lit(SMOOTH) * k[c]) + F.lit(SMOOTH_LOG))
    base = patterns.join(m.singles.withColumnRenamed("s", "value"), "col").select("col", "pattern", "value", floor_.alias("base"))
    base = small_side(_written(base, "impute-base"), BROADCAST)
    scored = seen.join(shape, ["_key", "col"]).join(base, ["col", "pattern", "value"]).select(
        "_key", "col", "value", (F.col("base") + F.col("lift")).alias("score"))
    # cells that no pair table says anything about
    rest = shape.join(seen.select("_key", "col").distinct(), ["_key", "col"], "left_anti").join(base, ["col", "pattern"])
    return scored.unionByName(rest.select("_key", "col", "value", F.col("base").alias("score"))).withColumnRenamed("_key", key)


SMOOTH_LOG = -0.6931471805599453     # ln SMOOTH


def impute(m: PairModel, df: DataFrame, seed, key: str = "row_key", temperature: float = 1.0) -> DataFrame:
    """GEN-8: every missing cell from all given cells of its row (``candidates``).

    Temperature 0 takes the best candidate; else a candidate is drawn with a probability in proportion to
    exp(score / temperature), as the one whose score plus Gumbel noise of its own is the largest: a plain
    maximum by cell, whatever the number of candidates.  Missing numbers get a value inside the drawn
    bin; the mark of a missing value is no candidate.  A column without any value in training stays null."""
    from sentable.functions.fmt import format_value
    noise = F.lit(0.0) if temperature == 0 else -F.log(-F.log(
        (F.floor(uniform(seed, F.concat_ws(":", F.lit("fill"), F.col("col"), F.col("value")), F.col(key)) * 4503599627370496.0) + 0.5)
        / 4503599627370496.0)) * temperature
    missing = F.when(F.col("col").isin(list(m.edges)), F.lit("-1")).otherwise(F.lit(X.FILL_TEXT))
    c = candidates(m, df, key).where(F.col("value") != missing)
    best = c.groupBy(key, "col").agg(F.max_by("value", F.struct(F.round(F.col("score") + noise, 9).alias("s"), F.col("value"))).alias("v"))
    filled = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("_f"))
    drawn = numbers(m, filled.select(key, *[F.element_at("_f", F.lit(c)).alias(c) for c in m.cols]), seed, key)
    drawn = drawn.select(key, *[F.col(quoted(c)).alias(f"_d_{c}") for c in m.cols])
    own = {c: F.when(~is_missing(df, c), F.col(quoted(c)).cast("double") if c in m.edges else
                     format_value(F.col(quoted(c)), df.schema[c].dataType, None)) for c in m.cols}
    return df.join(drawn, key, "left").select(key, *[F.coalesce(own[c], F.col(quoted(f"_d_{c}"))).alias(c) for c in m.cols])
