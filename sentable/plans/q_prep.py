"""Queries: projections, fills, contract, encoders, shuffle and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.functions.hashing import uniform
from sentable.operators.encode import decode_labels, encode_labels, fit_labels
from sentable.operators.parsing import parse_lenient, parse_samples
from sentable.operators.prep import (coerce_numeric, column_contract, fill_na, fill_na_all, missing_profile, recode,
                                     rename_all, tail_columns, typed_output)
from sentable.operators.split import epoch_batches, rows_by_index, shuffle_index, split, split_shapes
from sentable.plans.fixtures import FIXTURES, load, sql_fmt, sql_hex, sql_load, sql_u, table
from sentable.plans.q_text import _CLEAN_B, _sql_in_domain
from sentable.plans.registry import query
from sentable.plans.sqlparse import lenient_select, strict_select
from sentable.plans.workloads import lenient_text, noisy_lines, sql_lenient_text

A, B, C = FIXTURES["A"], FIXTURES["B"], FIXTURES["C"]
SEED = 42
PART_NAMES = ["key", "name", "brand", "kind", "size", "price"]
NUMBER_SQL = r"'\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*'"


def sql_to_numeric(v: str) -> str:
    return f"(CASE WHEN regexp_full_match(CAST({v} AS VARCHAR), {NUMBER_SQL}) THEN TRY_CAST(trim(CAST({v} AS VARCHAR)) AS DOUBLE) END)"


def sql_indexed(src: str, seed, tag: str, key: str = "row_key", idx: str = "idx") -> str:
    return (f"SELECT *, (row_number() OVER (ORDER BY {sql_hex(seed, repr(tag), key)}, {key}) - 1)::BIGINT AS {idx}, "
            f"count(*) OVER ()::BIGINT AS _n FROM ({src})")


def sql_split(src: str, seed=SEED, tf=0.75, vf=0.075) -> str:
    n1, n2 = f"floor({tf}::DOUBLE * _n)", f"floor({vf}::DOUBLE * _n)"
    return (f"SELECT * EXCLUDE (_n), CASE WHEN idx < {n1} THEN 'train' WHEN idx < {n1} + {n2} THEN 'val' "
            f"ELSE 'test' END AS split FROM ({sql_indexed(src, seed, 'shuffle')})")


@query("rename_all", f"SELECT {', '.join(f'{a} AS {b}' for a, b in zip(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], PART_NAMES))} FROM part")
def _rename_all(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return rename_all(df, PART_NAMES)


@query("recode", f"SELECT row_key, CASE WHEN p_brand IS NOT DISTINCT FROM 'Brand#13' THEN 'positive' ELSE 'negative' END AS p_brand "
                 f"FROM ({sql_load('A', nulls=True)})")
def _recode(spark, sf):
    return recode(load(spark, sf, "A", nulls=True), "p_brand", "Brand#13", "positive", "negative").select("row_key", "p_brand")


@query("tail_columns", "SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _tail_columns(spark, sf):
    return tail_columns(table(spark, sf, "lineitem"), 3)


def _sql_contract():
    src = sql_load("C", nulls=True)
    role = {**{c: "ords" for c in C.ords}, **{c: "nums" for c in C.nums}, **{c: "labs" for c in C.labs}}
    stype = {"int": "int", "double": "double", "string": "string"}
    parts = []
    for i, c in enumerate(C.cols):
        k = C.kinds[c]
        parts.append(f"SELECT '{c}' AS column, {i}::BIGINT AS position, '{role[c]}' AS role, '{stype[k]}' AS type, "
                     f"{'true' if k != 'string' else 'false'} AS is_numeric, (count(*) - count({c}))::BIGINT AS nulls, "
                     f"count(DISTINCT {sql_fmt(c, k)})::BIGINT AS n_distinct FROM ({src})")
    return " UNION ALL ".join(parts)


@query("column_contract", _sql_contract())
def _column_contract(spark, sf):
    df = load(spark, sf, "C", nulls=True, key=False)
    return column_contract(df, C.ords, C.nums, C.labs).withColumnRenamed("distinct", "n_distinct")


@query("fill_na", f"SELECT row_key, c_nationkey, c_acctbal, coalesce(c_mktsegment, '?') AS c_mktsegment "
                  f"FROM ({sql_load('C', nulls=True)})")
def _fill_na(spark, sf):
    return fill_na(load(spark, sf, "C", nulls=True))


@query("fill_na_all", f"SELECT row_key, {sql_fmt('c_nationkey', 'int', '?')} AS c_nationkey, "
                      f"{sql_fmt('c_acctbal', 'double', '?')} AS c_acctbal, coalesce(c_mktsegment, '?') AS c_mktsegment "
                      f"FROM ({sql_load('C', nulls=True)})")
def _fill_na_all(spark, sf):
    return fill_na_all(load(spark, sf, "C", nulls=True), "?", C.cols)


@query("missing_profile", f"SELECT row_key, ({' + '.join(f'(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in C.cols)})::BIGINT AS n_missing, "
                          f"({' AND '.join(f'{c} IS NOT NULL' for c in C.cols)}) AS is_complete FROM ({sql_load('C', nulls=True)})")
def _missing_profile(spark, sf):
    return missing_profile(load(spark, sf, "C", nulls=True), C.cols, keep=["row_key"])


_LEN_C = lenient_select(sql_lenient_text("C", sql_load("C", nulls=True)), C.cols, ["row_key"])


@query("coerce_numeric", f"SELECT row_key, {sql_to_numeric('c_nationkey')} AS c_nationkey, "
                         f"{sql_to_numeric('c_acctbal')} AS c_acctbal, c_mktsegment FROM ({_LEN_C})")
def _coerce_numeric(spark, sf):
    parsed = parse_lenient(lenient_text(load(spark, sf, "C", nulls=True), "C"), C.cols)
    return coerce_numeric(parsed, ["c_nationkey", "c_acctbal"])


@query("typed_samples", f"SELECT row_key, TRY_CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_orderpriority, "
                        f"TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM "
                        f"({_sql_in_domain(strict_select(_CLEAN_B, B.cols, ['row_key']), 'B', B.ords)})")
def _typed_samples(spark, sf):
    real = load(spark, sf, "B")
    parsed = parse_samples(noisy_lines(real, "B"), real, B.cols, B.ords)
    return typed_output(parsed, {"o_custkey": "bigint", "o_totalprice": "double"})


ENC_COLS = A.ords + A.labs   # classification: ords + labs are encoded


def _sql_fit_labels(alias, cols):
    fx = FIXTURES[alias]
    d = " UNION ".join(f"SELECT '{c}' AS column, {sql_fmt(c, fx.kinds[c], '?')} AS value FROM {fx.table}" for c in cols)
    return f'SELECT "column", value, (row_number() OVER (PARTITION BY "column" ORDER BY value) - 1)::BIGINT AS id FROM ({d})'


_FIT_A = _sql_fit_labels("A", ENC_COLS)


@query("fit_labels", _FIT_A)
def _fit_labels(spark, sf):
    return fit_labels(load(spark, sf, "A", key=False), ENC_COLS)


def _sql_encoded_a():
    j = " ".join(f"JOIN (SELECT value AS v_{c}, id AS id_{c} FROM enc WHERE \"column\" = '{c}') ON {c} = v_{c}" for c in ENC_COLS)
    return (f"WITH enc AS ({_FIT_A}) SELECT row_key, id_p_brand AS p_brand, p_size, p_retailprice, id_p_type AS p_type "
            f"FROM ({sql_load('A')}) {j}")


@query("encode_labels", _sql_encoded_a())
def _encode_labels(spark, sf):
    df = load(spark, sf, "A")
    return encode_labels(df, fit_labels(df.drop("row_key"), ENC_COLS), ENC_COLS)


def _damage_ids(df):
    u = uniform(11, "decode", F.col("row_key"))
    t = F.col("p_type").cast("string")
    bad = (F.when(u < 0.1, F.concat(t, F.lit(".5"))).when(u < 0.2, F.concat(t, F.lit(".0")))
           .when(u < 0.3, (F.col("p_type") + 1000).cast("string")).when(u < 0.35, F.lit("x")).otherwise(t))
    return df.select("row_key", F.col("p_brand").cast("string").alias("p_brand"), "p_size", "p_retailprice", bad.alias("p_type"))


def _sql_decoded():
    u = sql_u(11, "'decode'", "row_key")
    dmg = (f"SELECT row_key, CAST(p_brand AS VARCHAR) AS p_brand, p_size, p_retailprice, CASE WHEN {u} < 0.1 THEN p_type || '.5' "
           f"WHEN {u} < 0.2 THEN p_type || '.0' WHEN {u} < 0.3 THEN CAST(p_type + 1000 AS VARCHAR) WHEN {u} < 0.35 THEN 'x' "
           f"ELSE CAST(p_type AS VARCHAR) END AS p_type FROM ({_sql_encoded_a()})")
    j = " ".join(f"JOIN (SELECT value AS v_{c}, CAST(id AS DOUBLE) AS id_{c} FROM enc WHERE \"column\" = '{c}') "
                 f"ON {sql_to_numeric(c)} = id_{c}" for c in ENC_COLS)
    return f"WITH enc AS ({_FIT_A}) SELECT row_key, v_p_brand AS p_brand, p_size, p_retailprice, v_p_type AS p_type FROM ({dmg}) {j}"


@query("decode_labels", _sql_decoded())
def _decode_labels(spark, sf):
    df = load(spark, sf, "A")
    enc = fit_labels(df.drop("row_key"), ENC_COLS)
    return decode_labels(_damage_ids(encode_labels(df, enc, ENC_COLS)), enc, ENC_COLS)


@query("shuffle_index", f"SELECT * EXCLUDE (_n) FROM ({sql_indexed(sql_load('B'), SEED, 'shuffle')})")
def _shuffle_index(spark, sf):
    df = load(spark, sf, "B")
    return shuffle_index(df, SEED, F.col("row_key"))


@query("split", f"SELECT row_key, idx, split FROM ({sql_split(sql_load('B'))})")
def _split(spark, sf):
    return split(load(spark, sf, "B"), SEED, F.col("row_key")).select("row_key", "idx", "split")


@query("split_shapes", f"SELECT split, count(*)::BIGINT AS n_rows, {len(B.cols) + 1}::BIGINT AS n_cols "
                       f"FROM ({sql_split(sql_load('B'))}) GROUP BY split")
def _split_shapes(spark, sf):
    return split_shapes(split(load(spark, sf, "B"), SEED, F.col("row_key")))


@query("epoch_batches", f"SELECT row_key, idx, (idx // 64)::BIGINT AS batch_id, 3::BIGINT AS epoch FROM "
                        f"({sql_indexed(sql_load('C'), SEED, 'epoch:3')}) WHERE idx // 64 < _n // 64")
def _epoch_batches(spark, sf):
    return epoch_batches(load(spark, sf, "C").select("row_key"), SEED, F.col("row_key"), 3, 64, drop_last=True)


@query("eval_batches", "SELECT c_custkey, idx, (idx // 64)::BIGINT AS batch_id, 0::BIGINT AS epoch FROM (SELECT c_custkey, "
                       "(row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS idx FROM customer)")
def _eval_batches(spark, sf):
    """SRT-2: evaluation batches, in the table's order, the short last one kept."""
    return epoch_batches(table(spark, sf, "customer", ["c_custkey"]), SEED, F.col("c_custkey"), 0, 64, shuffle=False)


_TRAIN_A = f"SELECT * FROM ({sql_split(sql_load('A'))}) WHERE split = 'train'"


def _sql_unseen(how: str) -> str:
    ids = " ".join(f"LEFT JOIN (SELECT {c} AS v_{c}, (row_number() OVER (ORDER BY {c}) - 1)::BIGINT AS id_{c} FROM "
                   f"(SELECT DISTINCT {c} FROM ({_TRAIN_A}))) ON {c} = v_{c}" for c in ENC_COLS)
    keep = " AND ".join(f"id_{c} IS NOT NULL" for c in ENC_COLS)
    return (f"SELECT row_key, id_p_brand AS p_brand, p_size, p_retailprice, id_p_type AS p_type FROM ({sql_load('A')}) {ids}"
            + (f" WHERE {keep}" if how == "drop" else ""))


def _encode_unseen(spark, sf, how):
    """JN-2 with labels of the training split only: the whole table has others."""
    df = load(spark, sf, "A")
    train = split(df, SEED, F.col("row_key")).filter("split = 'train'").select(*A.cols)
    return encode_labels(df, fit_labels(train, ENC_COLS), ENC_COLS, policy=how)


for _how in ("drop", "null"):
    query(f"encode_unseen_{_how}", _sql_unseen(_how))(lambda spark, sf, how=_how: _encode_unseen(spark, sf, how))


POSITIONS = [0, 1, 7, 100, 1000, 5000, 14999, 10 ** 9]


@query("rows_by_index", f"SELECT * EXCLUDE (_n) FROM ({sql_indexed(sql_load('B'), SEED, 'shuffle')}) "
                        f"WHERE idx IN ({', '.join(map(str, POSITIONS))})")
def _rows_by_index(spark, sf):
    return rows_by_index(shuffle_index(load(spark, sf, "B"), SEED, F.col("row_key")), POSITIONS)


@query("rows_by_layout", f"SELECT * EXCLUDE (_n) FROM ({sql_indexed(sql_load('B'), SEED, 'shuffle')}) "
                         f"WHERE idx IN ({', '.join(map(str, POSITIONS))})")
def _rows_by_layout(spark, sf):
    """JN-7 on a kept index: the table is indexed and laid out once, a fetch opens the blocks it needs."""
    from sentable.sources.io import scratch_path
    from sentable.sources.layout import rows_at, write_layout
    path = scratch_path(spark, "layout")
    write_layout(shuffle_index(load(spark, sf, "B"), SEED, F.col("row_key")), path, block_rows=1_000)
    return rows_at(spark, path, POSITIONS, block_rows=1_000)
