"""Exact, reproducible global row index without a global sort.

Order = (md5 order hash, row values).  Rows are first grouped on
(hash, all columns) with a map-side partial count, so identical copies (which
are interchangeable) collapse before the shuffle however hot they are.  The
distinct rows are then numbered inside hash buckets (first ``digits`` hex
characters, uniform by construction), bucket sizes are turned into offsets on
a table of at most 16**digits rows (the only broadcast, so its size is bounded
by the parameter, not by the data; it is written once to the checkpoint folder), and copies are expanded back.  A group of
more than ``chunk`` copies is expanded in chunks spread over tasks, so no task
emits an unbounded share of the rows.

SQL equivalent: ``row_number() OVER (ORDER BY hash, key) - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_exact_index(df: DataFrame, order_hash: Column, idx: str = "idx", digits: int = 4,
                     chunk: int = 1 << 20, with_count: str | None = None) -> DataFrame:
    from sentable.sources.io import materialize
    cols = df.columns
    bucket = F.conv(F.substring(F.col("_h"), 1, digits), 16, 10).cast("int")
    g = (df.withColumn("_h", order_hash)
           .groupBy("_h", *cols).agg(F.count(F.lit(1)).alias("_m"))
           .withColumn("_b", bucket))
    within = Window.partitionBy("_b").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_s", F.sum("_m").over(within) - F.col("_m"))
    # Bucket sizes straight from the input (only the hash inputs are read; the
    # partial aggregate leaves at most 16**digits rows per task).
    offs = df.select(order_hash.alias("_h")).select(bucket.alias("_b")).groupBy("_b") \
             .agg(F.count(F.lit(1)).alias("_bm"))
    # <= 16**digits rows: one small task, then broadcast.
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offs = materialize(offs.select("_b", "_bm", (F.sum("_bm").over(w_all) - F.col("_bm")).alias("_o")), "index-offsets")
    size = offs.agg(F.sum("_bm").alias("n"), F.max("_bm").alias("most")).first()
    g = g.join(F.broadcast(offs.select("_b", "_o")), "_b").withColumn("_start", F.col("_o") + F.col("_s"))
    out = (g.filter(F.col("_m") <= chunk) if (size["most"] or 0) > chunk else g) \
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    if (size["most"] or 0) > chunk:         # no group is larger than its bucket: else no rows are expanded apart
        big = (g.filter(F.col("_m") > chunk)
                 .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / chunk).cast("long"))))
                 .repartition("_h", "_c")
                 .withColumn("_j", F.explode(F.sequence(F.col("_c") * chunk,
                                                        F.least((F.col("_c") + 1) * chunk, F.col("_m")) - 1))))
        out = out.unionByName(big.drop("_c"))
    extra = [F.lit(size["n"]).cast("long").alias(with_count)] if with_count else []
    return out.select(*cols, (F.col("_start") + F.col("_j")).cast("long").alias(idx), *extra)


def rank_within(df: DataFrame, group: list[str], key: str, out: str = "rank", sample: int = 4096,
                buckets: int = 64, per_bucket: int = 1 << 20) -> DataFrame:
    """Exact 0-based rank of the distinct string ``key`` inside each group,
    in string (code-point) order, without sending a group to one task.

    Order-preserving buckets come from a hash-chosen sample of each group's
    keys (at most ~``sample`` per group reach the driver, whose size is thus
    bounded by groups x sample); each row finds its bucket among the boundaries
    (``buckets``, and more so that a bucket holds about ``per_bucket`` rows, up to the
    sample), rows are ranked inside (group, bucket), and bucket sizes become
    offsets on a table of at most sample+1 rows per group.  Ranks are exact whatever the boundaries are; only balance
    depends on the sample."""
    spark = df.sparkSession
    sizes = {tuple(r[g] for g in group): r["_n"] for r in df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).collect()}
    u = F.conv(F.substring(F.md5(F.col(key)), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    rate = F.lit(1.0)
    if sizes:
        rates = spark.createDataFrame([(*k, min(1.0, sample / max(n, 1))) for k, n in sizes.items()],
                                      [*group, "_rate"])
        picked = df.join(F.broadcast(rates), group).filter(u < F.col("_rate"))
    else:
        picked = df.limit(0)
    bounds = {}
    for r in picked.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_s")).collect():
        s, k = r["_s"], tuple(r[g] for g in group)
        step = max(1, len(s) // max(buckets, sizes[k] // per_bucket))
        bounds[k] = s[step::step]
    bt = spark.createDataFrame([(*k, v) for k, v in bounds.items()] or [tuple([None] * len(group)) + ([],)],
                               df.select(*group).schema.add("_bounds", T.ArrayType(T.StringType())))
    x = df.join(F.broadcast(bt), group, "left").withColumn(
        "_bk", F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<string>")), lambda b: b <= F.col(key))))
    cnt = x.groupBy(*group, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0)
    offs = cnt.select(*group, "_bk", (F.sum("_c").over(w) - F.col("_c")).alias("_o"))
    r = F.row_number().over(Window.partitionBy(*group, "_bk").orderBy(key))
    return (x.withColumn("_r", r).join(offs, [*group, "_bk"])
             .select(*df.columns, (F.col("_o") + F.col("_r") - 1).cast("long").alias(out)))
