"""Queries: snapshot and raw-text round trips, recipe (SRC-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.functions.hashing import uniform
from sentable.operators.parsing import parse_strict
from sentable.operators.prep import check_roles, fill_na, recode, rename_all
from sentable.operators.split import split
from sentable.plans.fixtures import FIXTURES, load, sql_load, sql_u, table
from sentable.plans.q_prep import SEED, sql_split
from sentable.plans.registry import query
from sentable.plans.sqlparse import strict_select
from sentable.plans.workloads import noisy_lines, sql_noisy_lines
from sentable.sources.io import read_raw_samples, read_split, resolve_version, scratch_path, write_raw_samples, \
    write_snapshot

B = FIXTURES["B"]
CREATED = "2026-01-05 10:00:00.000001"
SCHEMA_B = "row_key string, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double, idx bigint"


def _snapshot(spark, sf, fmt):
    base = scratch_path(spark, "snap")
    write_snapshot(split(load(spark, sf, "B"), SEED, F.col("row_key")), base, "orders", CREATED, fmt=fmt)
    return base


_SPLIT_B = sql_split(sql_load("B"))


@query("snapshot_roundtrip", f"SELECT row_key, {', '.join(B.cols)}, idx, split FROM ({_SPLIT_B})")
def _snapshot_roundtrip(spark, sf):
    base = _snapshot(spark, sf, "parquet")
    return read_split(spark, base, "orders", split=None).select("row_key", *B.cols, "idx", "split")


@query("read_split", f"SELECT row_key, {', '.join(B.cols)}, idx FROM ({_SPLIT_B}) WHERE split = 'train'")
def _read_split(spark, sf):
    """CSV snapshot with header, read back with an explicit schema; one split."""
    from pyspark.sql.types import StructType
    base = _snapshot(spark, sf, "csv")
    schema = StructType.fromDDL(SCHEMA_B)
    return read_split(spark, base, "orders", "train", schema=schema, fmt="csv").select("row_key", *B.cols, "idx")


_MARKS = f"CASE WHEN {sql_u(11, chr(39) + 'mark' + chr(39), 'row_key')} < 0.3 THEN NULL ELSE c_mktsegment END"


@query("read_split_markers", f"SELECT row_key, c_nationkey, c_acctbal, {_MARKS} AS c_mktsegment FROM ({sql_load('C')})")
def _read_split_markers(spark, sf):
    """SRC-1: cells that read NA, null or nothing are missing."""
    from pyspark.sql.types import StructType
    u = uniform(11, "mark", F.col("row_key"))
    df = load(spark, sf, "C").withColumn("c_mktsegment", F.when(u < 0.1, F.lit("NA")).when(u < 0.2, F.lit("null"))
                                         .when(u < 0.3, F.lit("")).otherwise(F.col("c_mktsegment")))
    base = scratch_path(spark, "snap")
    write_snapshot(df.withColumn("split", F.lit("train")), base, "customer", CREATED, fmt="csv")
    schema = StructType.fromDDL("row_key string, c_nationkey bigint, c_acctbal double, c_mktsegment string")
    return read_split(spark, base, "customer", "train", schema=schema, fmt="csv").select(
        "row_key", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("read_version", f"SELECT row_key, {', '.join(B.cols)}, idx FROM ({_SPLIT_B}) WHERE split = 'val'")
def _read_version(spark, sf):
    base = _snapshot(spark, sf, "parquet")
    v = resolve_version({"creation_time": CREATED})
    return read_split(spark, base, "orders", "val", version=v).select("row_key", *B.cols, "idx")


@query("snapshot_versions", f"SELECT 'first' AS reader, split, count(*)::BIGINT AS n FROM ({_SPLIT_B}) GROUP BY split UNION ALL "
                            f"SELECT 'second', split, count(*)::BIGINT FROM ({_SPLIT_B}) WHERE o_orderstatus = 'F' GROUP BY split")
def _snapshot_versions(spark, sf):
    """SNK-1 / SRC-2: a reader of the latest version keeps it while the next one is written and published."""
    rows = split(load(spark, sf, "B"), SEED, F.col("row_key"))
    base = scratch_path(spark, "snap")
    write_snapshot(rows, base, "orders", CREATED)
    first = read_split(spark, base, "orders", split=None)
    write_snapshot(rows.where("o_orderstatus = 'F'"), base, "orders", "2026-01-06 10:00:00")
    second = read_split(spark, base, "orders", split=None)
    count = lambda df, name: df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reader"), "split", "n")
    return count(first, "first").unionByName(count(second, "second"))


RECIPE_COLS = ["key", "name", "brand", "kind", "size", "price"]


@query("recipe_part",
       "SELECT key, flag, kind, size, price, idx, split FROM (" + sql_split(
           "SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_partkey AS key, "
           "CASE WHEN p_brand IS NOT DISTINCT FROM 'Brand#13' THEN 'positive' ELSE 'negative' END AS flag, "
           "coalesce(p_type, '?') AS kind, p_size AS size, p_retailprice AS price FROM part") + ")")
def _recipe_part(spark, sf):
    """SRC-4 + recipe: external table → positional rename → recode → fill →
    role check → seeded shuffle and exact split."""
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    df = rename_all(df, RECIPE_COLS)
    df = recode(df, "brand", "Brand#13", "positive", "negative").withColumnRenamed("brand", "flag")
    df = fill_na(df.select("key", "flag", "kind", "size", "price"))
    check_roles(["flag", "kind", "size", "price"], ["kind"], ["size", "price"], ["flag"])
    return split(df, SEED, F.col("key").cast("string")).select("key", "flag", "kind", "size", "price", "idx", "split")


@query("raw_roundtrip", "SELECT * EXCLUDE (row_key) FROM (" + strict_select(sql_noisy_lines("B", sql_load("B")), B.cols, ["row_key"]) + ")")
def _raw_roundtrip(spark, sf):
    """SNK-3 + SRC-6: lines appended in two batches, read back, parsed."""
    path = scratch_path(spark, "raw")
    lines = noisy_lines(load(spark, sf, "B"), "B")
    half = uniform(11, "batch", F.col("row_key")) < 0.5
    write_raw_samples(lines.filter(half), path, mode="append")
    write_raw_samples(lines.filter(~half), path, mode="append")
    return parse_strict(read_raw_samples(spark, path), B.cols)


@query("stream_parse", "SELECT * EXCLUDE (row_key) FROM ("
       + __import__("sentable.plans.q_text", fromlist=["x"])._sql_in_domain(
           strict_select(__import__("sentable.plans.q_text", fromlist=["x"])._CLEAN_B, B.cols, ["row_key"]), "B", B.ords)
       + ")")
def _stream_parse(spark, sf):
    """STR-1: lines arrive as two appended batches; the stream parses and
    validates them (stream-static semi-joins) into a Parquet sink."""
    from sentable.streaming.parse_stream import run_available
    src = scratch_path(spark, "stream-src")
    real = load(spark, sf, "B")
    lines = noisy_lines(real, "B")
    half = uniform(11, "batch", F.col("row_key")) < 0.5
    write_raw_samples(lines.filter(half), src, mode="append")
    write_raw_samples(lines.filter(~half), src, mode="append")
    return run_available(spark, src, real, B.cols, B.ords, scratch_path(spark, "stream-sink"),
                         scratch_path(spark, "stream-ckpt"))
