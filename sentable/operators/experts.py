"""Per-column conditional value models ("experts") — GEN-1 … GEN-14, re-aimed.

The reference fits one language-model head per column and samples rows
column by column.  Here each column's expert is a count table:

    counts(order_id, col, level, ctx, value, n)

for a generation order c1..cm (c1 = anchor).  Contexts of column cj:
level 0 = nothing, level 1 = the previous column, level 2 = (anchor,
previous); level 3 + d = the column d + 1 places later, used only to complete a
row whose previous cell is missing but a later one is given.  Numeric context values are
binned on edges frozen at fit time;
drawn values are always real training strings.  Sampling walks the order and
draws each column with an interval join (see ``dist.draw``) at the highest
level whose context exists, backing off to lower levels otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentable.functions.fmt import format_value, is_missing, is_numeric_type, quoted
from sentable.functions.hashing import uniform
from sentable.operators.dist import block_size, intervals
from sentable.operators.joins import MAX_BYTES, small_side

SEP = "\u0001"          # joins anchor and previous context values
NAN_TEXT = "nan"        # text of a missing number (Plain-mode rows)
FILL_TEXT = "?"         # text of a missing category (after fill_na)
NO_LEVEL = "\u0002"     # the context of a level that a column does not have
WEIGHT_TOTAL = float(2 ** 48)    # bound of a group's total weight in tempered draws
GROUP = ["order_id", "col", "level", "ctx"]
SALTS = 64              # parts of a group that are joined apart
NEXT_LEVEL = 3          # level 3 + d: context = the column d + 1 places later in order (used to complete rows)


@dataclass
class ExpertModel:
    cols: list[str]
    orders: list[list[str]]
    numeric: dict[str, tuple[float, float]]
    bins: int
    counts: DataFrame
    cond: str | None = None
    meta: dict = field(default_factory=dict)
    # of a fit: its counts, and the same for the (order_id, col, level)s alone that a condition picks
    lazy: tuple[DataFrame, Callable[[Callable[[int, str, int], bool]], DataFrame]] | None = None

    def attrs(self) -> dict:
        return {"cols": self.cols, "orders": self.orders, "bins": self.bins, "cond": self.cond,
                "numeric": {k: list(v) for k, v in self.numeric.items()}, **self.meta}


# ------------------------------------------------------------------ values
def cell_text(df: DataFrame, c: str) -> Column:
    """A cell as model text: numbers print like Python, a missing number is
    'nan', a missing category is '?'."""
    dt = df.schema[c].dataType
    return format_value(F.col(quoted(c)), dt, NAN_TEXT if is_numeric_type(dt) else FILL_TEXT)


def ctx_value(model_numeric: dict, bins: int, c: str, text: Column) -> Column:
    """Context value of column ``c`` given its text: the bin for numbers
    (-1 if missing or unparsable), else the text itself."""
    if c not in model_numeric:
        return text
    lo, hi = model_numeric[c]
    x = text.try_cast("double")
    if hi == lo or lo is None:
        b = F.lit(0)
    else:
        b = F.greatest(F.lit(0), F.least(F.floor((x - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * F.lit(bins)),
                                         F.lit(bins - 1)))
    return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(b).cast("long").cast("string")


def _ctx(model, order, j, level, get: dict[str, Column]) -> Column:
    """The context of the j-th column at a level, from the texts of the others."""
    return _given(order, j, level, {c: ctx_value(model.numeric, model.bins, c, v) for c, v in get.items()})


def _given(order, j, level, value: dict[str, Column]) -> Column:
    """The same from their context values."""
    if level == 0:
        return F.lit("")
    if level >= NEXT_LEVEL:
        return value[order[j + 1 + level - NEXT_LEVEL]]
    prev = value[order[j - 1]]
    return prev if level == 1 else F.concat(value[order[0]], F.lit(SEP), prev)


# --------------------------------------------------------------------- fit
def numeric_edges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """One aggregate pass for (min, max) of every numeric column."""
    num = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    if not num:
        return {}
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in num],
               *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in num]).first()
    return {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in num}


def fit(df: DataFrame, cols: list[str] | None = None, cond: str | None = None, bins: int = 20,
        order: str = "schema", k: int = 4, seed=42, edges: dict | None = None,
        pairs: list[tuple[str, str]] | None = None) -> ExpertModel:
    """GEN-1: one expert per column for each generation order.

    ``order='schema'`` fits the table order; ``'conditional'`` puts ``cond``
    first; ``'random'`` fits K orders with ``cond`` first and the rest in
    hash order (SMP-4).  ``cond`` defaults to the last column.  ``pairs`` asks for
    the table of a column given a later one besides those of its next column
    (see ``needed_pairs``).  One scan: every row emits its (col, level, ctx,
    value) items through ``inline`` and a partially aggregated count folds
    them, so hot values collapse before the shuffle."""
    from sentable.operators.starts import generation_orders
    cols = cols or df.columns
    cond = cond or cols[-1]
    pairs = set(pairs or ())
    if order == "schema":
        orders = [list(cols)]
    elif order == "conditional":
        orders = [[cond] + [c for c in cols if c != cond]]
    else:
        orders = generation_orders(cols, cond, seed, k)
    model = ExpertModel(list(cols), orders, edges if edges is not None else numeric_edges(df, cols), bins, None, cond)
    tables = context_tables(orders, pairs)
    place = {c: i for i, c in enumerate(cols)}
    # texts and context values are worked out once a row, and a table that several orders share is counted once
    x = df.select(*[cell_text(df, c).alias(f"t{i}") for i, c in enumerate(cols)])
    x = x.select(*[f"t{i}" for i in range(len(cols))],
                 *[ctx_value(model.numeric, bins, c, F.col(f"t{i}")).alias(f"x{i}") for i, c in enumerate(cols)])

    def count(wanted: Callable[[int, str, int], bool]) -> DataFrame:
        kept = {(c, given): picked for (c, given), where in tables.items()
                if (picked := [(oid, level) for oid, level in where if wanted(oid, c, level)])}
        if not kept:
            return model.counts.limit(0)
        items = [F.struct(F.lit(i).alias("_i"), F.concat_ws(SEP, *[F.col(f"x{place[g]}") for g in given]).alias("ctx"),
                          F.col(f"t{place[c]}").alias("value")) for i, (c, given) in enumerate(kept)]
        places = F.array(*[F.array(*[F.struct(F.lit(oid).cast("long").alias("order_id"), F.lit(c).alias("col"),
                                              F.lit(level).cast("long").alias("level")) for oid, level in where])
                           for (c, _), where in kept.items()])
        counted = x.select(F.inline(F.array(*items))).groupBy("_i", "ctx", "value").agg(F.count(F.lit(1)).alias("n"))
        return counted.select("ctx", "value", "n", F.inline(F.get(places, F.col("_i")))).select(*GROUP, "value", "n")

    model.counts = count(lambda *_: True)
    model.lazy = (model.counts, count)
    return model


def context_tables(orders: list[list[str]], pairs=()) -> dict[tuple[str, tuple[str, ...]], list[tuple[int, int]]]:
    """The different tables of a fit, (column, columns of its context), and the (order, level)s that each one serves."""
    out: dict = {}
    for oid, o in enumerate(orders):
        for j, c in enumerate(o):
            given = {0: (), 1: (o[j - 1],), 2: (o[0], o[j - 1])}
            for level in range(0, min(j, 2) + 1):
                out.setdefault((c, given[level]), []).append((oid, level))
            for d, g in enumerate(o[j + 1:]):
                if d == 0 or (c, g) in pairs:
                    out.setdefault((c, (g,)), []).append((oid, NEXT_LEVEL + d))
    return out


def needed_pairs(df: DataFrame, cols: list[str]) -> list[tuple[str, str]]:
    """(missing column, nearest later given one) of the missing patterns that
    occur in ``df``: the pair tables that completing its rows can use."""
    bits = F.concat(*[F.when(is_missing(df, c), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    out = set()
    for r in df.select(bits.alias("p")).groupBy("p").agg(F.count(F.lit(1))).collect():      # one row a pattern
        for j, c in enumerate(cols):
            if r["p"][j] == "0" and "1" in r["p"][j:]:
                out.add((c, cols[r["p"].index("1", j)]))
    return sorted(out)


def merge(a: ExpertModel, b: ExpertModel) -> ExpertModel:
    """GEN-11: continue a fit with new rows — counts add (edges are frozen)."""
    if a.orders != b.orders or a.numeric != b.numeric or a.bins != b.bins:
        raise ValueError("models must share orders, bins and bin edges")
    counts = a.counts.unionByName(b.counts).groupBy(*GROUP, "value").agg(F.sum("n").cast("long").alias("n"))
    return ExpertModel(a.cols, a.orders, a.numeric, a.bins, counts, a.cond, dict(a.meta))


# ------------------------------------------------------------- draw tables
def weighted(counts: DataFrame, temperature: float) -> DataFrame:
    """GEN-6: sharpen by p**(1/t), as integer weights (t=1 keeps counts,
    t=0 keeps only the most frequent value, smallest text on ties).

    Weights are relative to the group's largest count and as fine as a total of
    ``WEIGHT_TOTAL`` allows, so they depend on the ratios of counts and not on
    the table's size."""
    if temperature == 1:
        return counts
    if temperature == 0:
        top = counts.groupBy(*GROUP).agg(F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b")))
                                         .alias("value"))
        return counts.join(top, [*GROUP, "value"], "left_semi")
    # a group may hold every value of a column, so it is joined in SALTS parts
    counts = counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    part = counts.groupBy(*GROUP, "_salt").agg(F.max("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*GROUP)
    top = part.select(*GROUP, "_salt", F.max("_n").over(whole).alias("_top"), F.sum("_m").over(whole).alias("_e"))
    share = F.pow(F.col("n") / F.col("_top"), F.lit(1.0 / temperature))
    w = F.greatest(F.lit(1), F.round(share * F.floor(F.lit(WEIGHT_TOTAL) / F.col("_e")))).cast("long")
    return counts.join(top, [*GROUP, "_salt"]).withColumn("n", w).drop("_top", "_e", "_salt")


@dataclass
class DrawTables:
    groups: DataFrame     # GROUP + _t (total), _blk
    entries: DataFrame    # GROUP + _k, lo, hi, _val   (Parquet, partitioned by col)
    broadcast_groups: dict[str, bool]
    broadcast_entries: dict[str, bool]
    level0: dict = field(default_factory=dict)   # (order_id, col) -> (total, blk)
    place: dict = field(default_factory=dict)    # (order_id, col, level) -> the (order_id, level) that stands for it


def draw_tables(model: ExpertModel, temperature: float = 1.0, max_broadcast_rows: int = 100_000,
                completion: bool = True, drawn: list[str] | None = None) -> DrawTables:
    """Interval tables for the draw, written once as Parquet to the shared
    checkpoint folder (a reliable lineage cut).  Entries are partitioned by
    column, so each column's draw reads only its own directory.  Whether a
    column's side is broadcast is decided from exact per-column row counts and
    bytes (one small aggregate); larger sides use a shuffle join.

    Orders that draw a column given the same columns share the table of the first of them.  Without
    ``completion``, tables given a later column are left out: only completing a row looks there.
    ``drawn`` names the columns that are drawn, if not all are.  What is left out is not counted either, as far as the
    model's counts are still those of a fit; they are written once, for the weights and the sizes of groups read them."""
    from sentable.sources.io import materialize
    drawn = model.cols if drawn is None else drawn
    place = {}
    if len(model.orders) > 1:
        for (c, _), where in context_tables(model.orders).items():
            where = [w for w in where if completion or w[1] < NEXT_LEVEL]
            place.update({(oid, c, level): where[0] for oid, level in where})

    def wanted(oid, c, level):
        return c in drawn and (completion or level < NEXT_LEVEL) and place.get((oid, c, level), (oid, level)) == (oid, level)
    if model.lazy and model.lazy[0] is model.counts:
        counts = model.lazy[1](wanted)
    else:
        counts = model.counts if completion else model.counts.filter(F.col("level") < NEXT_LEVEL)
        if set(drawn) != set(model.cols):
            counts = counts.filter(F.col("col").isin(list(drawn)))
        twice = [F.struct(F.lit(oid).cast("long").alias("order_id"), F.lit(c).alias("col"), F.lit(level).cast("long").alias("level"))
                 for (oid, c, level), first in place.items() if (oid, level) != first]
        if twice:
            counts = counts.filter(~F.struct("order_id", "col", "level").isin(*twice))
    counts = materialize(counts, "counts")
    # one table holds the entries under their blocks and, with each, its group's total and block size
    iv = intervals(weighted(counts, temperature), GROUP).withColumn("_blk", block_size())
    first = F.floor(F.col("lo") / F.col("_blk")).cast("long")
    iv = iv.withColumn("_k", F.explode(F.sequence(first, F.floor((F.col("hi") - 1) / F.col("_blk")).cast("long"))))
    iv = materialize(iv.select(*GROUP, "_k", "lo", "hi", F.col("value").alias("_val"), F.col("total").alias("_t"), "_blk"),
                     "entries", ["col"])
    groups = materialize(iv.groupBy(*GROUP).agg(F.max("_t").alias("_t"), F.max("_blk").alias("_blk")), "groups", ["col"])
    entries = iv.drop("_t", "_blk")
    size = F.octet_length("_val") + F.octet_length("ctx") + 64
    ne = {r["col"]: (r["n"], r["b"]) for r in entries.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()}
    # one row per (order, column): group counts and the level-0 group, whose
    # total and block size become literals instead of a join
    per = groups.groupBy("order_id", "col").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("ctx") + 64).alias("_b"),
        F.max(F.when(F.col("level") == 0, F.col("_t"))).alias("_t0"),
        F.max(F.when(F.col("level") == 0, F.col("_blk"))).alias("_b0")).collect()
    ng: dict[str, tuple[int, int]] = {}
    lvl0 = {}
    for r in per:
        n, b = ng.get(r["col"], (0, 0))
        ng[r["col"]] = (n + r["_n"], b + r["_b"])
        if r["_t0"] is not None:
            lvl0[(r["order_id"], r["col"])] = (r["_t0"], r["_b0"])
    fits = lambda sizes, c: all(x <= most for x, most in zip(sizes.get(c, (0, 0)), (max_broadcast_rows, MAX_BYTES)))
    return DrawTables(groups, entries, {c: fits(ng, c) for c in model.cols}, {c: fits(ne, c) for c in model.cols}, lvl0, place)


def _side(df: DataFrame, b: bool) -> DataFrame:
    return F.broadcast(df) if b else df


def draw_column(x: DataFrame, tables: DrawTables, oid: int, col: str, ctx_by_level: dict[int, Column],
                u: Column, out: str, ctx_of: tuple[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Draw ``col`` for every row of ``x`` at the highest level whose context
    was seen in training (back-off: one left lookup per level on the small
    group table), then one block join for the interval.  Few DataFrame
    operations per column keep plan analysis cheap on long chains.  ``ctx_of`` names a further
    column, a function of the drawn text, which is worked out in the table of entries and not for each row."""
    levels = sorted(ctx_by_level, reverse=True)
    at = {L: tables.place.get((oid, col, L), (oid, L)) for L in levels}
    base = x.columns
    x = x.select("*", u.alias("_u"), *[ctx_by_level[L].alias(f"_c{L}") for L in levels])
    g = tables.groups.filter(F.col("col") == col)
    for L in levels:
        if L == 0:
            t0, b0 = tables.level0.get((at[L][0], col), (None, None))
            x = x.withColumns({"_t0": F.lit(t0).cast("long"), "_b0": F.lit(b0).cast("long")})
            continue
        gl = g.filter((F.col("order_id") == at[L][0]) & (F.col("level") == at[L][1])).select(
            F.col("ctx").alias(f"_c{L}"), F.col("_t").alias(f"_t{L}"), F.col("_blk").alias(f"_b{L}"))
        x = x.join(_side(gl, tables.broadcast_groups[col]), f"_c{L}", "left")

    def pick(value, kind):
        e = F.lit(None).cast(kind)
        for L in sorted(levels):          # lowest first, so higher levels win
            e = F.when(F.col(f"_t{L}").isNotNull(), value(L)).otherwise(e)
        return e
    t, blk = (pick(lambda L, p=p: F.col(f"{p}{L}"), "long") for p in ("_t", "_b"))
    r = F.floor(F.col("_u") * t).cast("long")
    # what all rows share (one order, or one level with its one context) is a filter of the entries and no key.  The block
    # comes first: a sort by it rarely has to compare the other keys, which few values share
    oids = sorted({o for o, _ in at.values()})
    keys = {"_k": F.floor(r / blk).cast("long")}
    if levels != [0]:
        keys |= {"_ctx": pick(lambda L: F.col(f"_c{L}"), "string"), "_lvl": pick(lambda L: F.lit(at[L][1]), "long")}
    if len(oids) > 1:
        keys["_oid"] = pick(lambda L: F.lit(at[L][0]), "long")
    x = x.select(*base, r.alias("_r"), *[v.alias(k) for k, v in keys.items()])
    e = tables.entries.filter(F.col("col") == col)
    if len(oids) == 1:
        e = e.filter(F.col("order_id") == oids[0])
    if levels == [0]:
        e = e.filter(F.col("level") == at[0][1])
    if len({at[L] for L in levels}) < len(tables.place):
        e = e.filter(F.struct("order_id", "level").isin(*[F.struct(F.lit(o).cast("long").alias("order_id"), F.lit(L).cast("long").alias("level"))
                                                          for o, L in sorted(set(at.values()))]))
    names = {"_k": "_k", "_ctx": "ctx", "_lvl": "level", "_oid": "order_id"}
    e = e.select(*[F.col(names[k]).alias(k) for k in keys], "lo", "hi", "_val",
                 *([ctx_of[1](F.col("_val")).alias(ctx_of[0])] if ctx_of else []))
    m = x.join(_side(e, tables.broadcast_entries[col]), list(keys), "left")
    m = m.filter(F.col("lo").isNull() | ((F.col("lo") <= F.col("_r")) & (F.col("_r") < F.col("hi"))))
    return m.select(*base, F.col("_val").alias(out), *([ctx_of[0]] if ctx_of else []))


def sample(model: ExpertModel, keys: DataFrame, seed, key: str = "sid", temperature: float = 1.0,
           given: dict[str, Column] | None = None, order_of: Column | None = None, attempt: int = 0,
           tables: DrawTables | None = None, checkpoint_every: int = 8) -> DataFrame:
    """GEN-3/4/5/6: complete rows for every key.

    ``given`` fixes some columns (a start value or prompt fields); the others
    are drawn in the model's order.  With several orders (random mode),
    ``order_of`` picks each row's order id and one sub-plan per order is
    unioned.  Lineage is cut with a reliable checkpoint every few columns."""
    given = given or {}
    tables = tables or draw_tables(model, temperature, completion=False, drawn=[c for c in model.cols if c not in given])
    if order_of is not None and len(model.orders) > 1:
        # every order's sub-plan filters the same keys: derive them once
        from sentable.sources.io import materialize
        keys = materialize(keys.withColumn("_order", order_of), "sample-keys")
        order_of = F.col("_order")
    parts = []
    for oid, o in enumerate(model.orders):
        x = keys if order_of is None or len(model.orders) == 1 else keys.filter(order_of == oid)
        bin_of = {c: (f"_x{k}", lambda v, c=c: ctx_value(model.numeric, model.bins, c, v)) for k, c in enumerate(o) if c in model.numeric}
        for c, v in given.items():
            x = x.withColumn(c, v)
            if c in bin_of:
                x = x.withColumn(bin_of[c][0], bin_of[c][1](F.col(quoted(c))))
        for j, c in enumerate(o):
            if c in given:
                continue
            value = {cc: F.col(quoted(bin_of[cc][0] if cc in bin_of else cc)) for cc in o[:j]}
            levels = {L: _given(o, j, L, value) for L in range(0, min(j, 2) + 1)}
            u = uniform(seed, F.lit(f"draw:{attempt}:{oid}:{c}"), F.col(key))
            x = draw_column(x, tables, oid, c, levels, u, c, bin_of.get(c))
            if checkpoint_every and (j + 1) % checkpoint_every == 0 and j + 1 < len(o):
                from sentable.sources.io import materialize
                x = materialize(x, "sample-part")
        parts.append(x.select(*[cc for cc in keys.columns if cc != "_order"], *model.cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_n(model: ExpertModel, n: int, seed, temperature: float = 1.0, **kw) -> DataFrame:
    """SMP-1: ``n`` new rows, however many the model was fitted on."""
    keys = model.counts.sparkSession.range(n).select(F.col("id").cast("string").alias("sid"))
    return sample(model, keys, seed, temperature=temperature, **kw)


def sampled_lines(df: DataFrame, model: ExpertModel, key: str = "sid", order_id: Column | None = None) -> DataFrame:
    """GEN-14: the generated text — one sentence per column in generation
    order; every column appears exactly once by construction."""
    def line(o):
        return F.concat(*[F.concat(F.lit(c + " is "), F.col(c), F.lit("<EOC>")) for c in o])
    if len(model.orders) == 1 or order_id is None:
        txt = line(model.orders[0])
    else:
        txt = F.element_at(F.array(*[line(o) for o in model.orders]), order_id.cast("int") + 1)
    return df.select(key, txt.alias("line"))


# ------------------------------------------------------------------ evaluate
def evaluate(model: ExpertModel, val: DataFrame, key: str = "row_key", oid: int = 0) -> DataFrame:
    """GEN-9 / AGG-7: validation loss.  For each row and column, -ln of the
    add-one smoothed probability of the true value under the highest-level
    context seen in training (else level 0); mean per column, then the mean
    over columns (row '__mean__').  V = level-0 distinct values + 1.

    Equal cells are counted before any join, so a frequent value or context is
    one row of it however many rows have it."""
    from sentable.sources.io import materialize
    o = model.orders[oid]
    text = val.select(*[cell_text(val, c).alias(f"t{j}") for j, c in enumerate(o)])
    text = text.select("*", *[ctx_value(model.numeric, model.bins, c, F.col(f"t{j}")).alias(f"x{j}") for j, c in enumerate(o)])
    value = {c: F.col(f"x{j}") for j, c in enumerate(o)}
    items = []
    for j, c in enumerate(o):
        items.append(F.struct(F.lit(c).alias("col"), F.col(f"t{j}").alias("value"),
                              *[(_given(o, j, L, value) if L <= min(j, 2) else F.lit(NO_LEVEL)).alias(f"c{L}")
                                for L in range(3)]))
    cells = text.select(F.inline(F.array(*items))).groupBy("col", "value", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("w"))
    # only levels that an evaluation reads; the totals are read for every level, the counts once more
    cnt = materialize(model.counts.filter((F.col("order_id") == oid) & (F.col("level") < NEXT_LEVEL)), "eval-counts")
    tot = materialize(cnt.groupBy("col", "level", "ctx").agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k")), "eval-totals")
    vocab = tot.filter(F.col("level") == 0).select("col", (F.col("k") + 1).alias("V"))
    for L in range(3):
        t = tot.filter(F.col("level") == L).select("col", F.col("ctx").alias(f"c{L}"), F.col("tot").alias(f"t{L}"))
        # level 0 has one row per column; deeper levels (a few bins or values a context)
        # are broadcast after a check of rows and bytes, else left to AQE's skew handling
        cells = cells.join(F.broadcast(t) if L == 0 else small_side(t, 100_000), ["col", f"c{L}"], "left")
    lvl = F.when(F.col("t2").isNotNull(), 2).when(F.col("t1").isNotNull(), 1).otherwise(0).cast("long")
    cells = cells.withColumn("level", lvl) \
        .withColumn("ctx", F.when(F.col("level") == 2, F.col("c2")).when(F.col("level") == 1, F.col("c1")).otherwise(F.lit(""))) \
        .withColumn("tot", F.coalesce(F.when(F.col("level") == 2, F.col("t2")).when(F.col("level") == 1, F.col("t1"))
                                      .otherwise(F.col("t0")), F.lit(0)))
    cells = cells.join(cnt.drop("order_id"), ["col", "level", "ctx", "value"], "left").join(F.broadcast(vocab), "col")
    nll = -F.log((F.coalesce(F.col("n"), F.lit(0)) + 1) / (F.col("tot") + F.col("V")))
    per = cells.groupBy("col").agg((F.sum(nll * F.col("w")) / F.sum("w")).alias("loss"))
    allm = per.agg(F.avg("loss").alias("loss")).select(F.lit("__mean__").alias("col"), "loss")
    return per.unionByName(allm).select(F.col("col").alias("column"), F.round("loss", 6).alias("loss"))


# --------------------------------------------------------------- save/load
def save(model: ExpertModel, path: str) -> None:
    """SNK-6: counts as Parquet + attributes as one JSON line."""
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    spark = model.counts.sparkSession
    spark.createDataFrame([(json.dumps(model.attrs()),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(f"{path}/attributes")


def load(spark, path: str) -> ExpertModel:
    a = json.loads(spark.read.text(f"{path}/attributes").first()[0])
    counts = spark.read.parquet(f"{path}/counts")
    num = {k: (v[0], v[1]) for k, v in a.pop("numeric").items()}
    cols, orders, bins, cond = a.pop("cols"), a.pop("orders"), a.pop("bins"), a.pop("cond")
    return ExpertModel(cols, orders, num, bins, counts, cond, a)



# ---------------------------------------------------------- completion
def complete_rows(model: ExpertModel, x: DataFrame, fixed: dict[str, Column], seed, key: str,
                  attempt: int = 0, tables: DrawTables | None = None, temperature: float = 1.0) -> DataFrame:
    """Fill the null cells of ``fixed`` (text per column) in the model's order;
    given cells are kept and serve as context for later columns.  Every row
    is drawn (a broadcast lookup) and the given value wins, so the plan stays
    one linear chain."""
    tables = tables or draw_tables(model, temperature)
    o = model.orders[0]
    x = x.select(key, *[fixed[c].alias(f"_g_{c}") for c in model.cols])
    for j, c in enumerate(o):
        get = {cc: F.col(cc) for cc in o[:j]}
        levels = {L: _ctx(model, o, j, L, get) for L in range(0, min(j, 2) + 1)}
        # without a given cell just before it, condition on the nearest later cell that is
        # given: levels above 2 win in the draw, and a null context or an unfitted pair is passed over
        free = F.col(quoted(f"_g_{o[j - 1]}")).isNull() if j else F.lit(True)
        for d, g in enumerate(o[j + 1:]):
            cell = F.col(quoted(f"_g_{g}"))
            levels[NEXT_LEVEL + d] = F.when(free & cell.isNotNull(), _ctx(model, o, j, NEXT_LEVEL + d, {g: cell}))
            free = free & cell.isNull()
        u = uniform(seed, F.lit(f"draw:{attempt}:0:{c}"), F.col(key))
        x = draw_column(x, tables, 0, c, levels, u, "_d")
        x = x.withColumn(c, F.coalesce(F.col(quoted(f"_g_{c}")), F.col("_d"))).drop("_d")
    return x.select(key, *model.cols)


def sample_from_prompts(model: ExpertModel, prompts: DataFrame, seed, key: str = "sid", text: str = "text",
                        temperature: float = 1.0) -> DataFrame:
    """GEN-7: "Sex is female, Age is 26" → a completed row.  The prompt is
    parsed leniently; placeholder and None mean "to be generated"."""
    from sentable.functions.parse import PLACEHOLDER, lenient_fields
    f = lenient_fields(F.col(text), model.cols)
    fixed = {c: F.when(v != F.lit(PLACEHOLDER), v) for c, v in f.items()}
    return complete_rows(model, prompts, fixed, seed, key, temperature=temperature)


@dataclass
class ImputeResult:
    rows: DataFrame
    dropped: int
    attempts: int


def impute(model: ExpertModel, df: DataFrame, seed, key: str = "row_key", max_retries: int = 15,
           temperature: float = 1.0) -> ImputeResult:
    """GEN-8: fill every null conditioned on the row's known values.

    Numeric columns come back as doubles; a cell that is still not a number
    (e.g. 'nan' drawn from training nulls) makes the row incomplete and it is
    retried with the attempt number in the hash tag, re-drawing only the
    missing cells.  Each attempt works on the remaining rows only (written
    to the checkpoint folder); rows still incomplete after ``max_retries``
    are dropped and counted, as the source warns and drops them.  A row that
    misses a cell of a column without any value to draw is dropped at once."""
    from sentable.operators.prep import same_columns, to_numeric
    from sentable.sources.io import materialize
    same_columns(df.drop(key), model.cols)
    num = [c for c in model.cols if c in model.numeric]
    # A missing number ('nan', from training nulls) is never a useful draw:
    # without it, a context that only ever saw nulls backs off to a lower
    # level instead of failing every retry.
    real_values = model.counts.filter(~(F.col("col").isin(num) & (F.col("value") == NAN_TEXT))) if num else model.counts
    tables = draw_tables(ExpertModel(model.cols, model.orders, model.numeric, model.bins, real_values, model.cond),
                         temperature)
    fixed = {c: format_value(F.col(c), df.schema[c].dataType, None) for c in model.cols}
    complete0 = F.lit(True)
    for c in model.cols:
        complete0 = complete0 & ~is_missing(df, c)
        fixed[c] = F.when(~is_missing(df, c), fixed[c])
    # complete rows pass through (numbers as doubles); only the others are drawn
    done = [df.filter(complete0).select(key, *[F.col(c).cast("double").alias(c) if c in num else fixed[c].alias(c)
                                                for c in model.cols])]
    cur = df.filter(~complete0).select(key, *[fixed[c].alias(c) for c in model.cols])
    hopeless = F.lit(False)
    for c in model.cols:
        if (0, c) not in tables.level0:
            hopeless = hopeless | F.col(quoted(c)).isNull()
    lost = cur.filter(hopeless).count()
    cur = cur.filter(~hopeless)
    attempts = 0
    for attempt in range(max_retries if not cur.isEmpty() else 0):
        attempts += 1
        x = complete_rows(model, cur, {c: F.col(c) for c in model.cols}, seed, key, attempt, tables)
        typed = x.select(key, *[to_numeric(F.col(c)).alias(c) if c in num else F.col(c) for c in model.cols])
        typed = materialize(typed, f"impute-{attempt}")
        ok = F.lit(True)
        for c in model.cols:
            ok = ok & F.col(c).isNotNull() & (~F.isnan(F.col(c)) if c in num else F.lit(True))
        done.append(typed.filter(ok))
        cur = typed.filter(~ok).select(key, *[F.when(~F.isnan(F.col(c)), format_value(F.col(c), typed.schema[c].dataType, None))
                                              .alias(c) if c in num else F.col(c) for c in model.cols])
        if cur.isEmpty():
            break
    dropped = lost + (cur.count() if attempts else 0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return ImputeResult(out, dropped, attempts)
