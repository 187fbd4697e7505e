"""Queries: distributions, intervals, start prompts, orders, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.functions.text import BOS, impute_prompt, permuted_sentences, row_sentences
from sentable.operators.dist import intervals, value_distribution
from sentable.operators.split import shuffle_index
from sentable.operators.starts import (continuous_list, order_of_rows, start_categorical, start_continuous,
                                       start_prompts, start_random)
from sentable.plans.fixtures import FIXTURES, load, sql_fmt, sql_hex, sql_load, sql_u, upcast
from sentable.plans.q_prep import SEED, sql_indexed
from sentable.plans.registry import query

B, C = FIXTURES["B"], FIXTURES["C"]


def _sql_vdist(alias, col):
    fx = FIXTURES[alias]
    v = sql_fmt(col, fx.kinds[col])
    return (f"SELECT value, n, total, n::DOUBLE / total::DOUBLE AS p FROM "
            f"(SELECT {v} AS value, count(*)::BIGINT AS n FROM {fx.table} WHERE {col} IS NOT NULL GROUP BY 1), "
            f"(SELECT count({col})::BIGINT AS total FROM {fx.table})")


@query("value_distribution", _sql_vdist("B", "o_orderpriority"))
def _value_distribution(spark, sf):
    return value_distribution(load(spark, sf, "B"), "o_orderpriority")


_LIST_C = f"SELECT row_key, value, idx, _n AS n_list FROM ({sql_indexed(f'SELECT row_key, c_acctbal AS value FROM ({sql_load(chr(67), nulls=True)})', SEED, 'list')})"


@query("continuous_distribution", _LIST_C)
def _continuous_distribution(spark, sf):
    return continuous_list(load(spark, sf, "C", nulls=True), "c_acctbal", SEED, "row_key")


def sql_intervals(counts_sql: str, group: list[str], value: str = "value", weight: str = "n") -> str:
    g = ", ".join(group)
    order = f"substr(md5(CAST({value} AS VARCHAR)), 1, 2), {weight} DESC, {value}"
    run = f"sum({weight}) OVER (PARTITION BY {g} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (f"SELECT *, ({run} - {weight})::BIGINT AS lo, ({run})::BIGINT AS hi, "
            f"(sum({weight}) OVER (PARTITION BY {g}))::BIGINT AS total FROM ({counts_sql})")


_CW_COUNTS = "SELECT o_orderstatus AS ctx, o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2"


@query("cumulative_weights", sql_intervals(_CW_COUNTS, ["ctx"]))
def _cumulative_weights(spark, sf):
    df = load(spark, sf, "B")
    counts = df.groupBy(F.col("o_orderstatus").alias("ctx"), F.col("o_orderpriority").alias("value")) \
               .agg(F.count(F.lit(1)).alias("n"))
    return intervals(counts, ["ctx"])


def sql_draw(probe_sql: str, iv_sql: str, on: str, u: str = "_u", sel: str = "p.*, iv.value") -> str:
    r = f"floor(p.{u} * iv.total)"
    return f"SELECT {sel} FROM ({probe_sql}) p JOIN ({iv_sql}) iv ON {on} AND iv.lo <= {r} AND {r} < iv.hi"


_PRI_COUNTS = "SELECT 'o_orderpriority' AS _col, o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 2"
_PROBE_B = f"SELECT row_key AS sid, {sql_u(SEED, chr(39) + 'start' + chr(39), 'row_key')} AS _u FROM ({sql_load('B')})"


@query("start_categorical", sql_draw(_PROBE_B, sql_intervals(_PRI_COUNTS, ["_col"]), "true",
                                     sel="p.sid, 'o_orderpriority is ' || iv.value AS prompt"))
def _start_categorical(spark, sf):
    df = load(spark, sf, "B")
    dist = df.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return start_categorical(df.select(F.col("row_key").alias("sid")), dist, "o_orderpriority", SEED)


def _sql_cont(list_sql: str, probe_sql: str, col: str) -> str:
    return (f"SELECT p.sid, '{col} is ' || CASE WHEN l.value IS NULL OR isnan(l.value) THEN 'nan' "
            f"ELSE printf('%.5f', l.value) END AS prompt FROM ({probe_sql}) p, (SELECT max(n_list) AS nl FROM ({list_sql})) m "
            f"JOIN ({list_sql}) l ON l.idx = floor(p._u * m.nl)")


_PROBE_C = f"SELECT row_key AS sid, {sql_u(SEED, chr(39) + 'start' + chr(39), 'row_key')} AS _u FROM ({sql_load('C')})"


@query("start_continuous", _sql_cont(_LIST_C, _PROBE_C, "c_acctbal"))
def _start_continuous(spark, sf):
    lst = continuous_list(load(spark, sf, "C", nulls=True), "c_acctbal", SEED, "row_key")
    return start_continuous(load(spark, sf, "C").select(F.col("row_key").alias("sid")), lst, "c_acctbal", SEED)


_C_NAMES = "[" + ", ".join(f"'{c}'" for c in C.cols) + "]"


@query("start_random", f"SELECT sid, {_C_NAMES}[CAST(floor(_u * {len(C.cols)}) AS INTEGER) + 1] || ' is ' AS prompt "
                       f"FROM ({_PROBE_C})")
def _start_random(spark, sf):
    return start_random(load(spark, sf, "C").select(F.col("row_key").alias("sid")), C.cols, SEED)


_LIST_B = (f"SELECT row_key, value, idx, _n AS n_list FROM "
           f"({sql_indexed(f'SELECT row_key, o_totalprice AS value FROM ({sql_load(chr(66))})', SEED, 'list')})")


@query("start_prompts", _sql_cont(_LIST_B, _PROBE_B, "o_totalprice"))
def _start_prompts(spark, sf):
    """TXT-9 with nothing given: the fitted default, i.e. the conditional
    column (first label, a float → continuous list) and its distribution."""
    df = load(spark, sf, "B")
    default = ("o_totalprice", ("continuous", continuous_list(df, "o_totalprice", SEED, "row_key")))
    return start_prompts(df.select(F.col("row_key").alias("sid")), B.cols, SEED, default=default)


def _sql_orders(cols, cond, seed, k=4):
    rest = [c for c in cols if c != cond]
    vals = ", ".join(f"('{c}')" for c in rest)
    outs = []
    for i in range(k):
        outs.append(f"(SELECT '{cond},' || string_agg(c, ',' ORDER BY md5('{seed}:order:{i}:' || c)) FROM (VALUES {vals}) t(c))")
    return "[" + ", ".join(outs) + "]"


@query("generation_order", f"SELECT row_key AS sid, ((idx // 100) % 4)::BIGINT AS order_id, "
                           f"{_sql_orders(B.cols, 'o_totalprice', SEED)}[((idx // 100) % 4) + 1] AS \"order\" "
                           f"FROM ({sql_indexed(sql_load('B'), SEED, 'shuffle')})")
def _generation_order(spark, sf):
    """SMP-4: random-order sampling — the conditional column first, rows of
    batch b (100 rows) use order b mod 4."""
    idx = shuffle_index(load(spark, sf, "B"), SEED, F.col("row_key")).withColumnRenamed("row_key", "sid")
    return order_of_rows(idx, B.cols, "o_totalprice", SEED, 100)


def _sql_cells(alias, src, body):
    fx = FIXTURES[alias]
    return " UNION ALL ".join(body(i, c, fx.kinds[c]) for i, c in enumerate(fx.cols))


def _sql_permuted():
    src = sql_load("C", nulls=True)
    cells = _sql_cells("C", src, lambda i, c, k: (
        f"SELECT row_key, {sql_hex(SEED, chr(39) + 'perm:' + chr(39) + ' || row_key', repr(c))} AS h, {i} AS i, "
        f"'{c} is ' || {sql_fmt(c, k, 'None')} || '<EOC>' AS s FROM ({src})"))
    return (f"SELECT row_key, string_agg(s, '' ORDER BY h) AS text, string_agg(CAST(i AS VARCHAR), ',' ORDER BY h) AS perm "
            f"FROM ({cells}) GROUP BY row_key")


@query("permuted_row_text", _sql_permuted())
def _permuted_row_text(spark, sf):
    df = load(spark, sf, "C", nulls=True)
    text, perm = permuted_sentences(df, SEED, F.col("row_key"), C.cols)
    return df.select("row_key", text.alias("text"), perm.alias("perm"))


def _sql_impute_prompt():
    src = sql_load("C", nulls=True)
    cells = _sql_cells("C", src, lambda i, c, k: (
        f"SELECT row_key, '{c}' AS c, {sql_hex(SEED, chr(39) + 'partial:' + chr(39) + ' || row_key', repr(c))} AS h, "
        f"{sql_hex(SEED, chr(39) + 'missing:' + chr(39) + ' || row_key', repr(c))} AS hm, "
        f"CASE WHEN {c} IS NOT NULL THEN '{c} is ' || {sql_fmt(c, k)} END AS s FROM ({src})"))
    agg = (f"SELECT row_key, coalesce(string_agg(s, ', ' ORDER BY h), '') AS enc, "
           f"arg_min(c, hm) FILTER (WHERE s IS NULL) AS miss FROM ({cells}) GROUP BY row_key")
    return (f"SELECT row_key, CASE WHEN length(enc) > 0 THEN enc || ', ' ELSE '' END || "
            f"CASE WHEN miss IS NOT NULL THEN miss || ' is' ELSE '' END AS prompt FROM ({agg})")


@query("impute_prompt", _sql_impute_prompt())
def _impute_prompt(spark, sf):
    df = load(spark, sf, "C", nulls=True)
    return df.select("row_key", impute_prompt(df, C.cols, SEED, F.col("row_key")).alias("prompt"))


def _sql_growing():
    fx = B
    up = upcast("B")
    sents = [f"'{c} is ' || {sql_fmt(c, fx.kinds[c], 'nan', up)} || '<EOC>'" for c in fx.cols]
    parts = []
    for i, c in enumerate(fx.cols):
        pre = "concat(" + ", ".join(["'<BOS>'"] + sents[:i]) + ")"
        parts.append(f"SELECT row_key, {i + 1}::BIGINT AS pos, '{c}' AS target, {pre} AS prompt FROM ({sql_load('B')})")
    return " UNION ALL ".join(parts)


@query("growing_prefix", _sql_growing())
def _growing_prefix(spark, sf):
    """WIN-5: the prompt before column i holds all sentences before it."""
    df = load(spark, sf, "B")
    s = row_sentences(df, B.cols)
    x = df.select("row_key", s.alias("_s"), F.posexplode(F.array(*[F.lit(c) for c in B.cols])).alias("_p", "target"))
    return x.select("row_key", (F.col("_p") + 1).cast("long").alias("pos"), "target",
                    F.concat(F.lit(BOS), F.array_join(F.slice("_s", 1, F.col("_p")), "")).alias("prompt"))
