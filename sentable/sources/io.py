"""Sources and sinks (SRC-1/2/4/6, SNK-1/3/4/5).

A snapshot is a folder of its own, ``<base>/<name>/version=<v>/split=<s>/``, and an entry in the table's
log of versions (``versions``) that makes it the latest.  Reading a split is a partition
filter, so Spark prunes the other directories; ``all`` is the read without
a split filter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentable.session import ensure_checkpoint_dir
from sentable.sources import versions

# Cell texts pandas' read_csv turns into missing values.
NA_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# Values keep their spaces, quotes and line ends through a CSV snapshot.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True,
       "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


ROWS_PER_TASK = 250_000


def spread(df: DataFrame, min_tasks: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer tasks than the cluster has cores (a
    small or single-row-group file) with a round-robin repartition.  With
    ``rows_per_task`` (which counts the rows, for Parquet from the files' footers) a task gets about that many at
    most; a split is otherwise as large as its bytes allow, which is millions of narrow rows."""
    try:
        sc = df.sparkSession.sparkContext
        want = min_tasks or sc.defaultParallelism
        if rows_per_task:
            want = max(want, -(-df.count() // rows_per_task))
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as it is
        return df
    return df.repartition(want) if n < want else df


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sentable-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a reliable lineage cut (survives executor loss) that, unlike an RDD
    checkpoint, keeps column pruning and partition/filter pushdown."""
    path = scratch_path(df.sparkSession, what)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """A written scratch table goes when the driver's session ends; until then lazy
    results may still read it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def version_name(creation_time: str) -> str:
    """The dated folder name: whitespace runs become dots; ':' (not allowed in
    HDFS/S3 paths) becomes '-'."""
    return ".".join(creation_time.split()).replace(":", "-")


def write_snapshot(df: DataFrame, base: str, name: str, creation_time: str, split_col: str = "split",
                   fmt: str = "parquet") -> None:
    """SNK-1: the split table under a dated version (must not exist), which is
    the latest one as soon as it is whole.  Nothing that a reader may hold is overwritten."""
    root, version = f"{base.rstrip('/')}/{name}", version_name(creation_time)
    w = df.write.format(fmt).partitionBy(split_col)
    (w.options(**CSV) if fmt == "csv" else w).mode("errorifexists").save(f"{root}/version={version}")
    versions.publish(df.sparkSession, root, version)


def read_split(spark: SparkSession, base: str, name: str, split: str | None = "train", version: str = "latest",
               schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-1: one split (or all with ``split=None``) of one version.  ``latest`` is resolved here, once:
    the table that is returned stays that version's when others are published."""
    root = f"{base.rstrip('/')}/{name}"
    if version == "latest":
        version = versions.latest(spark, root)
        if version is None:
            raise FileNotFoundError(f"{root} has no published version")
    r = spark.read.format(fmt)
    if schema is not None and fmt == "csv":
        r = r.schema(schema)
    if fmt == "csv":
        r = r.options(**CSV).option("inferSchema", schema is None)
    df = r.load(f"{root}/version={version}")
    if split is not None:
        df = df.filter(F.col("split") == split)
    if fmt == "csv":
        df = na_markers_to_null(df)
    return df


def resolve_version(run_config: dict) -> str:
    """SRC-2: the snapshot a run was trained on (its recorded creation time)."""
    return version_name(run_config["creation_time"])


def na_markers_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """CSV cells such as 'NA' or 'null' are missing, as in pandas; '?' stays."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[F.when(F.col(c).isin(NA_MARKERS), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def write_raw_samples(lines: DataFrame, path: str, mode: str = "append", col: str = "line") -> None:
    """SNK-3: one generated row per line; 'append' (batches) or 'overwrite'."""
    lines.select(F.col(col).alias("value")).write.mode(mode).text(path)


def read_raw_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: one row per line, the newline itself removed."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_clean(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """SNK-4: write parsed rows; nothing is written when no row survived."""
    rows = materialize(df, "clean")      # the parse runs once, whether or not a row survives
    if rows.isEmpty():
        return False
    w = rows.write.mode("overwrite").format(fmt)
    (w.options(**CSV) if fmt == "csv" else w).save(path)
    return True


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-5: (run, step, metric, value) rows appended to a metrics table."""
    metrics.write.mode("append").parquet(path)
