"""Rows laid out by their exact index, so that a few of them cost a few files (JN-7).

``write_layout`` deals an indexed table into blocks of consecutive positions, a folder and file each, with
rows in order inside.  ``rows_at`` turns the positions asked for into blocks: Spark then lists and opens these
folders alone, and in them reads the row groups whose least and greatest index admit a position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
IN_LIST = 1_000          # so many positions become a filter; more are joined


def write_layout(indexed: DataFrame, path: str, idx: str = "idx", block_rows: int = BLOCK_ROWS) -> None:
    block = F.floor(F.col(idx) / block_rows).cast("long")
    (indexed.withColumn("block", block).repartition("block").sortWithinPartitions("block", idx)
     .write.mode("errorifexists").partitionBy("block").parquet(path))


def rows_at(spark: SparkSession, path: str, positions: list[int] | DataFrame, idx: str = "idx",
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows at ``positions``, a list or a table with the column ``idx``; positions without a row give none."""
    rows = spark.read.parquet(path)
    if isinstance(positions, DataFrame) or len(positions) > IN_LIST:
        keys = positions.select(idx) if isinstance(positions, DataFrame) else spark.createDataFrame(
            [(int(p),) for p in positions], f"{idx} long")
        keys = keys.distinct().withColumn("block", F.floor(F.col(idx) / block_rows).cast("long"))
        # the join names the blocks, which prunes folders at run time
        return rows.join(keys, ["block", idx], "left_semi").drop("block")
    wanted = sorted({int(p) for p in positions})
    return rows.where(F.col("block").isin(sorted({p // block_rows for p in wanted})) & F.col(idx).isin(wanted)).drop("block")
