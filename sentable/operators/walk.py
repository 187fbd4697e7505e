"""Values drawn token by token from a column's head (GEN-2).

A head counts which token follows which, by column, context (a drawn symbol, or nothing) and place in the value:
(col, ctx, pos, shape, token) -> next, where the shape is what stood before of signs (or, in numbers, of
all but digits).  A walk starts before the first token and draws the next one until it
draws the end.  Each transition occurs in training, and so does each one's place, so that
a walk is never longer than the longest value, always ends, and has the signs of some value in their order;
but the values that walks put together need not occur.  All columns of all rows take a step together: a row's walk is spread like any other row's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import quoted
from sentable.functions.hashing import uniform
from sentable.operators.experts import cell_text
from sentable.operators.pairs import PairModel, draw_entry, entry_table, symbol
from sentable.operators.prep import to_numeric
from sentable.operators.tokens import pieces

START, END = "", ""      # no piece is empty
WORDS, DIGITS = "^([A-Za-z]+|[0-9])?$", "^[0-9]?$"      # pieces that leave the shape as it is


def fit_heads(cells: DataFrame, free: str = WORDS) -> DataFrame:
    """(col, ctx, pos, shape, token, next, n) of ``cells`` (col, ctx, value).  Equal cells are counted before
    they are cut into pieces."""
    c = cells.groupBy("col", "ctx", "value").agg(F.count(F.lit(1)).alias("n"))
    p = F.concat(F.array(F.lit(START)), pieces(F.col("value")), F.array(F.lit(END)))
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(
        (i - 1).alias("pos"), F.array_join(F.filter(F.slice("p", F.lit(1), i), lambda t: ~t.rlike(free)), "").alias("shape"),
        F.get("p", i - 1).alias("token"), F.get("p", i).alias("next")))
    return (c.select("col", "ctx", "n", p.alias("p")).select("col", "ctx", "n", F.explode(steps).alias("t"))
            .groupBy("col", "ctx", "t.pos", "t.shape", "t.token", "t.next").agg(F.sum("n").alias("n"))
            .withColumn("pos", F.col("pos").cast("long")))


def _state(ctx: Column, pos: Column | int, shape: Column, token: Column) -> Column:
    return F.concat_ws("\u0001", ctx, (pos if isinstance(pos, Column) else F.lit(pos)).cast("string"), shape, token)


def walk(heads: DataFrame, starts: DataFrame, seed, key: str = "sid", free: str = WORDS) -> DataFrame:
    """(key, col, value) for ``starts`` (key, col, ctx); a context without a head gives no row."""
    from sentable.sources.io import materialize
    heads = materialize(heads, "heads")
    longest = heads.agg(F.max("pos")).first()[0]
    if longest is None:
        return starts.select(key, "col", F.lit(None).cast("string").alias("value")).limit(0)
    t = entry_table(heads.select("col", F.lit(0).cast("long").alias("level"),
                                 _state(F.col("ctx"), F.col("pos"), F.col("shape"), F.col("token")).alias("ctx"), F.col("next").alias("value"), "n"))
    x = starts.select(key, "col", F.col("ctx").alias("_x"), F.lit(START).alias("_t"), F.lit("").alias("_h"),
                      F.lit("").alias("value"))
    done = []
    for pos in range(longest + 1):
        u = uniform(seed, F.concat_ws(":", F.lit("walk"), F.col("col"), F.lit(str(pos))), F.col(key))
        x = draw_entry(x, t, F.col("col"), _state(F.col("_x"), pos, F.col("_h"), F.col("_t")), u, "_t")
        x = x.withColumn("value", F.concat("value", "_t")).withColumn(
            "_h", F.when(F.col("_t").rlike(free), F.col("_h")).otherwise(F.concat("_h", "_t")))
        x = materialize(x, "walk")
        done.append(x.where(F.col("_t") == END).select(key, "col", "value"))
        x = x.where(F.col("_t") != END)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def number_cells(df: DataFrame, m: PairModel) -> DataFrame:
    """(col, ctx, value): each number of the numeric columns as text, with its bin."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), symbol(df, c, m.edges).alias("ctx"), cell_text(df, c).alias("value"))
                      for c in m.cols if c in m.edges])
    return df.select(F.inline(cells)).where(F.col("ctx") != "-1")


def numbers_by_walk(m: PairModel, heads: DataFrame, x: DataFrame, seed, key: str = "sid") -> DataFrame:
    """Bins of the numeric columns become numbers that the heads spell, given the bin; -1 becomes null."""
    numeric = [c for c in m.cols if c in m.edges]
    if not numeric:
        return x
    starts = x.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(quoted(c)).alias("ctx")) for c in numeric])))
    spelt = walk(heads, starts.where(F.col("ctx") != "-1"), seed, key, DIGITS)
    wide = spelt.groupBy(key).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_w_{c}") for c in numeric])
    out = x.join(wide, key, "left")
    return out.select(*[to_numeric(F.col(quoted(f"_w_{c}"))).alias(c) if c in numeric else F.col(quoted(c)) for c in x.columns])
