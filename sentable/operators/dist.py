"""Distributions, weighted intervals and the interval draw (AGG-1/2, WIN-3,
JN-4, JN-5).

A distribution is a table of (group..., value, n).  ``intervals`` turns it
into integer half-open ranges [lo, hi) of total weight ``total`` per group;
a draw with integer r in [0, total) picks the value whose range holds r.
Integers only, so any engine draws the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentable.functions.fmt import format_value
from sentable.operators.joins import small_side

SUB_DIGITS = 2


def value_distribution(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    """AGG-1: relative frequency of the non-null values of ``col`` (as text)."""
    v = format_value(F.col(col), df.schema[col].dataType)
    counts = df.select(v.alias(out)).filter(F.col(out).isNotNull()).groupBy(out).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]       # one number: a literal, so no join
    return counts.withColumn("total", F.lit(total).cast("long")).withColumn("p", F.col("n") / F.col("total"))


def integer_weights(dist: DataFrame, weight: str = "n") -> DataFrame:
    """Positive weights only; fractional ones (relative frequencies) are scaled
    to integers with a total of about 2**48, which keeps their ratios."""
    d = dist.filter(F.col(weight) > 0)
    if isinstance(d.schema[weight].dataType, T.IntegralType):
        return d
    total = d.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    return d.withColumn(weight, F.greatest(F.lit(1), F.round(F.col(weight).cast("double") * (2.0 ** 48 / (total or 1.0))))
                        .cast("long"))


def draw_from_one(probes: DataFrame, dist: DataFrame, u: str = "_u", value: str = "value", weight: str = "n",
                  out: str = "value") -> DataFrame:
    """JN-4 for one distribution: total and block size are literals (one small
    aggregate), so the only join is the equi-join on the block."""
    iv = intervals(integer_weights(dist, weight).select(F.lit("").alias("_g"), value, weight), ["_g"], value, weight)
    r = iv.agg(F.max("total").alias("t"), F.count(F.lit(1)).alias("e")).first()
    if not r["e"]:
        raise ValueError("an empty distribution")
    blk = max(1, -(-r["t"] // r["e"]))
    entries = iv.select(F.explode(F.sequence(F.floor(F.col("lo") / blk).cast("long"),
                                             F.floor((F.col("hi") - 1) / blk).cast("long"))).alias("_k"),
                        "lo", "hi", F.col(value).alias("_val"))
    p = probes.withColumn("_r", F.floor(F.col(u) * F.lit(r["t"])).cast("long"))
    p = p.withColumn("_k", F.floor(F.col("_r") / blk).cast("long"))
    m = p.join(entries, "_k").filter((F.col("lo") <= F.col("_r")) & (F.col("_r") < F.col("hi")))
    return m.drop("_k", "_r", "lo", "hi").withColumnRenamed("_val", out)


def intervals(counts: DataFrame, group: list[str], value: str = "value", weight: str = "n") -> DataFrame:
    """WIN-3: running weights per group ordered by (md5(value)[:2], n desc, value).

    The order only has to be fixed, so it starts with a hash prefix of the
    value: ranges are built per (group, prefix) and shifted by the running
    size of earlier prefixes, computed on the small (group, prefix) table.
    A group with millions of values is thus spread over 256 window partitions
    instead of landing in one task.  ``entries`` is the group's number of values, so that what
    follows needs no join on the group."""
    c = counts.withColumn("_sb", F.substring(F.md5(F.col(value).cast("string")), 1, SUB_DIGITS))
    sub = c.groupBy(*group, "_sb").agg(F.sum(weight).alias("_sw"), F.count(F.lit(1)).alias("_se"))
    w_sub = Window.partitionBy(*group).orderBy("_sb").rowsBetween(Window.unboundedPreceding, 0)
    sub = sub.select(*group, "_sb", (F.sum("_sw").over(w_sub) - F.col("_sw")).alias("_off"),
                     F.sum("_sw").over(Window.partitionBy(*group)).alias("total"),
                     F.sum("_se").over(Window.partitionBy(*group)).alias("entries"))
    w_in = Window.partitionBy("_sb", *group).orderBy(F.col(weight).desc(), F.col(value)) \
                 .rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_run", F.sum(weight).over(w_in))
    out = c.join(sub, ["_sb", *group])
    return out.select(*counts.columns,
                      (F.col("_off") + F.col("_run") - F.col(weight)).cast("long").alias("lo"),
                      (F.col("_off") + F.col("_run")).cast("long").alias("hi"),
                      F.col("total").cast("long").alias("total"), F.col("entries").cast("long").alias("entries"))


def block_size() -> Column:
    """The width of a group's blocks: as much weight as an entry has on average."""
    return F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("entries"))).cast("long")


def draw(probes: DataFrame, table: DataFrame, group: list[str], u: str = "_u", value: str = "value",
         out: str = "value", max_broadcast_rows: int = 2_000_000, keep_r: bool = False) -> DataFrame:
    """JN-4: weighted pick.  ``probes`` carry the group keys and a uniform
    ``u``; ``table`` is the output of ``intervals``.  Rows whose group is
    absent from the table get no match (callers left-join for back-off).

    Range join without a nested loop: each group is cut into blocks of
    ceil(total / entries) weight; entries are listed under every block they
    overlap and a probe looks up the single block holding r, then keeps the
    entry with lo <= r < hi.  Expected matches per probe stay below two."""
    groups = table.groupBy(*group).agg(F.max("total").alias("_t"), F.max(block_size()).alias("_blk"))
    entries = (table.withColumn("_blk", block_size())
               .withColumn("_k", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_blk")).cast("long"),
                                                      F.floor((F.col("hi") - 1) / F.col("_blk")).cast("long"))))
               .select(*group, "_k", "lo", "hi", F.col(value).alias("_val")))
    groups = small_side(groups, max_broadcast_rows)
    entries = small_side(entries, max_broadcast_rows)
    p = probes.join(groups, group, "inner")
    p = p.withColumn("_r", F.floor(F.col(u) * F.col("_t")).cast("long")) \
         .withColumn("_k", F.floor(F.col("_r") / F.col("_blk")).cast("long"))
    m = p.join(entries, [*group, "_k"], "inner").filter((F.col("lo") <= F.col("_r")) & (F.col("_r") < F.col("hi")))
    drop = ["_t", "_blk", "_k", "lo", "hi"] + ([] if keep_r else ["_r"])
    return m.drop(*drop).withColumnRenamed("_val", out)


def pick_by_index(probes: DataFrame, indexed: DataFrame, n_col: Column | int, u: str = "_u", idx: str = "idx",
                  value: str = "value", out: str = "value") -> DataFrame:
    """JN-5: uniform pick from a long list: equi-join on floor(u * n) = exact
    row index, so the list is never gathered anywhere."""
    p = probes.withColumn("_pos", F.floor(F.col(u) * (n_col if isinstance(n_col, Column) else F.lit(n_col))).cast("long"))
    lst = indexed.select(F.col(idx).alias("_pos"), F.col(value).alias(out))
    return p.join(lst, "_pos").drop("_pos")
