"""Seeded shuffle, exact splits, epoch batches, row lookup (SRT-1, SPL-1,
SRT-2, JN-7, AGG-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sentable.functions.hashing import hash_hex
from sentable.operators.index import rank_within, with_exact_index


def shuffle_index(df: DataFrame, seed, key: Column, tag: str = "shuffle", idx: str = "idx",
                  with_count: str | None = None) -> DataFrame:
    """SRT-1: seeded permutation with a fresh index 0..n-1 (order = md5(seed:tag:key))."""
    return with_exact_index(df, hash_hex(seed, tag, key), idx, with_count=with_count)


def split(df: DataFrame, seed, key: Column, train_frac: float = 0.75, val_frac: float = 0.075,
          out: str = "split", idx: str = "idx") -> DataFrame:
    """SPL-1: train = first int(tf*n) of the shuffled rows, val = next
    int(vf*n), test = the rest.  Sizes are exact (unlike randomSplit)."""
    x = shuffle_index(df, seed, key, idx=idx, with_count="_n")
    n1 = F.floor(F.lit(float(train_frac)) * F.col("_n"))
    n2 = F.floor(F.lit(float(val_frac)) * F.col("_n"))
    lab = F.when(F.col(idx) < n1, "train").when(F.col(idx) < n1 + n2, "val").otherwise("test")
    return x.withColumn(out, lab).drop("_n")


def split_shapes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """AGG-4: rows × columns per split."""
    ncols = len([c for c in df.columns if c not in (split_col, "idx")])
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(ncols).cast("long"))


def epoch_batches(df: DataFrame, seed, key: Column, epoch: int, batch_size: int, drop_last: bool = False,
                  shuffle: bool = True) -> DataFrame:
    """SRT-2: training rows reshuffled per epoch and cut into batches of
    ``batch_size``; the short last batch is dropped if asked.  Evaluation
    (``shuffle=False``) keeps the table's order, that of its (unique) key:
    numbers by value, texts by code points."""
    if shuffle:
        x = shuffle_index(df, seed, key, tag=f"epoch:{epoch}", idx="idx", with_count="_n")
    else:
        x = df.select("*", key.alias("_key"))
        if not isinstance(x.schema["_key"].dataType, StringType):
            # fixed width: 20 digits before the point and 12 after it
            moved = F.col("_key").cast("decimal(32,12)") + F.lit("1" + "0" * 20).cast("decimal(33,12)")
            x = x.withColumn("_key", F.lpad(moved.cast("string"), 34, "0"))
        x = rank_within(x.withColumn("_g", F.lit(0)), ["_g"], "_key", "idx").drop("_g", "_key")
        x = x.withColumn("_n", F.lit(df.count()))
    x = x.withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("long"))
    if drop_last:
        x = x.filter(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return x.withColumn("epoch", F.lit(epoch).cast("long")).drop("_n")


def rows_by_index(indexed: DataFrame, positions: list[int], idx: str = "idx") -> DataFrame:
    """JN-7: fetch rows by position with a left-semi join on the (user-sized)
    key list, broadcast."""
    keys = indexed.sparkSession.createDataFrame([(int(p),) for p in positions], f"{idx} long")
    return indexed.join(F.broadcast(keys), idx, "left_semi")
