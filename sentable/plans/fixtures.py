"""Fixture tables read from the driver's parquet files.

Each fixture is a source table, a row key, and a declared column contract
(ords = categorical, nums = numeric, labs = targets).  ``nulls=True``
injects nulls where u(7, 'null:<col>', key) < 0.1, identically in both engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentable.functions.fmt import py_double_str
from sentable.functions.hashing import uniform


@dataclass(frozen=True)
class Fixture:
    table: str
    key: str | None                 # declared unique key, or None → md5 of the row
    cols: list[str]
    ords: list[str]
    nums: list[str]
    labs: list[str]
    task: str
    kinds: dict[str, str] = field(default_factory=dict)   # int | double | string
    key_parts: list[tuple[str, str]] = field(default_factory=list)


FIXTURES: dict[str, Fixture] = {
    "A": Fixture("part", "p_partkey", ["p_brand", "p_size", "p_retailprice", "p_type"],
                 ["p_brand"], ["p_size", "p_retailprice"], ["p_type"], "classification",
                 {"p_brand": "string", "p_size": "int", "p_retailprice": "double", "p_type": "string"}),
    "B": Fixture("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
                 ["o_orderstatus", "o_orderpriority"], ["o_custkey"], ["o_totalprice"], "regression",
                 {"o_custkey": "int", "o_orderstatus": "string", "o_orderpriority": "string", "o_totalprice": "double"}),
    "C": Fixture("customer", "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"],
                 ["c_nationkey"], ["c_acctbal"], ["c_mktsegment"], "classification",
                 {"c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}),
    "D": Fixture("lineitem", None, ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"],
                 ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"], "regression",
                 {"l_quantity": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                  "l_linestatus": "string", "l_extendedprice": "double"},
                 [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                  ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                  ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "ts")]),
    "E": Fixture("events", "event_id", ["event_type", "value", "user_id"],
                 ["event_type"], ["user_id"], ["value"], "regression",
                 {"event_type": "string", "value": "double", "user_id": "int"}),
}

NULL_SEED = 7
NULL_RATE = 0.1


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _needed(fx: Fixture) -> list[str]:
    keys = [fx.key] if fx.key else [c for c, _ in fx.key_parts]
    return list(dict.fromkeys(keys + fx.cols))


def _key_expr(fx: Fixture):
    if fx.key:
        return F.col(fx.key).cast("string")
    parts = []
    for c, k in fx.key_parts:
        parts.append(py_double_str(F.col(c)) if k == "double" else F.col(c).cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def load(spark: SparkSession, sf_dir: str, alias: str, nulls: bool = False, key: bool = True) -> DataFrame:
    """Fixture rows: ``row_key`` (string) then the contract's columns."""
    from sentable.sources.io import ROWS_PER_TASK, spread
    fx = FIXTURES[alias]
    src = spread(table(spark, sf_dir, fx.table, _needed(fx)), rows_per_task=ROWS_PER_TASK)
    df = src.select((_key_expr(fx).alias("row_key")), *fx.cols)
    if nulls:
        df = df.select("row_key", *[F.when(uniform(NULL_SEED, F.lit("null:" + c), F.col("row_key")) < NULL_RATE,
                                           F.lit(None)).otherwise(F.col(c)).alias(c) for c in fx.cols])
    return df if key else df.drop("row_key")


# ---------------------------------------------------------------- SQL side
def sql_hex(seed, tag_sql: str, key_sql: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {tag_sql}, CAST({key_sql} AS VARCHAR)))"


def sql_hex_to_u(hex_sql: str) -> str:
    return f"(CAST(('0x' || substr({hex_sql}, 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_u(seed, tag_sql: str, key_sql: str) -> str:
    return sql_hex_to_u(sql_hex(seed, tag_sql, key_sql))


def sql_fmt(col: str, kind: str, null_text: str | None = None, as_double: bool = False) -> str:
    if kind == "double" or (as_double and kind == "int"):
        e = f"CAST(CAST({col} AS DOUBLE) AS VARCHAR)"
    elif kind == "bool":
        e = f"(CASE WHEN {col} THEN 'True' WHEN NOT {col} THEN 'False' END)"
    elif kind == "string":
        e = f"trim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    else:
        e = f"CAST({col} AS VARCHAR)"
    return f"coalesce({e}, '{null_text}')" if null_text is not None else e


def sql_key(fx: Fixture) -> str:
    if fx.key:
        return f"CAST({fx.key} AS VARCHAR)"
    return "md5(concat_ws('|', " + ", ".join(sql_fmt(c, k) for c, k in fx.key_parts) + "))"


def sql_load(alias: str, nulls: bool = False) -> str:
    """SELECT producing row_key + contract columns (a subquery body)."""
    fx = FIXTURES[alias]
    base = f"SELECT {sql_key(fx)} AS row_key, {', '.join(fx.cols)} FROM {fx.table}"
    if not nulls:
        return base
    sel = ", ".join(f"CASE WHEN {sql_u(NULL_SEED, repr('null:' + c), 'row_key')} < {NULL_RATE} THEN NULL ELSE {c} END AS {c}"
                    for c in fx.cols)
    return f"SELECT row_key, {sel} FROM ({base})"


def upcast(alias: str) -> bool:
    kinds = [FIXTURES[alias].kinds[c] for c in FIXTURES[alias].cols]
    return all(k in ("int", "double") for k in kinds) and "double" in kinds
