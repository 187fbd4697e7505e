"""Queries: formatting, row text and parsing (TXT-*, PRJ-8, AGG-3, JN-1, AGG-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.functions.fmt import formatted
from sentable.functions.text import clean_text, fix_question_mark, row_sentences, row_text, strip_bos
from sentable.operators.domain import domains, parse_report
from sentable.operators.parsing import parse_flags, parse_lenient, parse_samples, parse_strict
from sentable.plans.fixtures import FIXTURES, load, sql_fmt, sql_load
from sentable.plans.registry import query
from sentable.plans.sqlparse import clean_sql, flags_select, lenient_select, strict_select
from sentable.plans.workloads import lenient_text, noisy_lines, spoiled_lines, sql_lenient_text, sql_noisy_lines, \
    sql_sentences, sql_spoiled_lines

D, B, A, C = FIXTURES["D"], FIXTURES["B"], FIXTURES["A"], FIXTURES["C"]


def _stringify(spark, sf):
    df = load(spark, sf, "D")
    f = formatted(df, D.cols, upcast=False)
    return df.select("row_key", *[f[c].alias(c) for c in D.cols])


query("stringify", f"SELECT row_key, {', '.join(sql_fmt(c, D.kinds[c]) + ' AS ' + c for c in D.cols)} "
                   f"FROM ({sql_load('D')})")(_stringify)


@query("row_sentences", f"SELECT row_key, {sql_sentences('B', '|')} AS sentences FROM ({sql_load('B')})")
def _row_sentences(spark, sf):
    df = load(spark, sf, "B")
    return df.select("row_key", F.array_join(row_sentences(df, B.cols), "|").alias("sentences"))


@query("row_text", f"SELECT row_key, '<BOS>' || {sql_sentences('A')} AS text FROM ({sql_load('A')})")
def _row_text(spark, sf):
    df = load(spark, sf, "A")
    return df.select("row_key", row_text(df, A.cols).alias("text"))


@query("row_text_lineitem", f"SELECT row_key, '<BOS>' || {sql_sentences('D')} AS text FROM ({sql_load('D')})")
def _row_text_lineitem(spark, sf):
    df = load(spark, sf, "D")
    return df.select("row_key", row_text(df, D.cols).alias("text"))


@query("row_text_subset",
       f"SELECT row_key, '<BOS>' || concat('p_size is ' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || '<EOC>', "
       f"'p_retailprice is ' || CAST(p_retailprice AS VARCHAR) || '<EOC>') AS text FROM ({sql_load('A')})")
def _row_text_subset(spark, sf):
    """PRJ-4: serialise only chosen columns; (p_size, p_retailprice) is all
    numeric with a float, so ints print as 1.0 (the upcast rule)."""
    df = load(spark, sf, "A").select("row_key", "p_size", "p_retailprice")
    return df.select("row_key", row_text(df, ["p_size", "p_retailprice"]).alias("text"))


_NOISY_B = sql_noisy_lines("B", sql_load("B"))


@query("clean_text", f"SELECT row_key, {clean_sql('line')} AS line FROM ({sql_spoiled_lines(_NOISY_B)})")
def _clean_text(spark, sf):
    """TXT-10/11/12 on lines that hold every mark they remove or repair."""
    lines = spoiled_lines(noisy_lines(load(spark, sf, "B"), "B"))
    return lines.select("row_key", strip_bos(fix_question_mark(clean_text(F.col("line")))).alias("line"))


@query("parse_strict", strict_select(_NOISY_B, B.cols, ["row_key"]))
def _parse_strict(spark, sf):
    return parse_strict(noisy_lines(load(spark, sf, "B"), "B"), B.cols)


@query("parse_terminated", strict_select(_NOISY_B, B.cols, ["row_key"], terminated=True, keep_failed=True))
def _parse_terminated(spark, sf):
    return parse_strict(noisy_lines(load(spark, sf, "B"), "B"), B.cols, terminated=True, keep_failed=True)


@query("parse_lenient", lenient_select(sql_lenient_text("C", sql_load("C", nulls=True)), C.cols, ["row_key"]))
def _parse_lenient(spark, sf):
    return parse_lenient(lenient_text(load(spark, sf, "C", nulls=True), "C"), C.cols)


def _sql_domains(alias, cols, fill="?"):
    fx = FIXTURES[alias]
    return " UNION ".join(f"SELECT '{c}' AS column, {sql_fmt(c, fx.kinds[c], fill)} AS value FROM {fx.table}"
                          for c in cols)


@query("domains", _sql_domains("B", B.ords))
def _domains(spark, sf):
    return domains(load(spark, sf, "B"), B.ords)


_CLEAN_B = f"SELECT row_key, {clean_sql('line')} AS line FROM ({_NOISY_B})"


def _sql_in_domain(src, alias, cols):
    conds = " AND ".join(f"{c} IN (SELECT value FROM ({_sql_domains(alias, [c])}))" for c in cols)
    return f"SELECT * FROM ({src}) WHERE {conds}"


@query("domain_filter", _sql_in_domain(strict_select(_NOISY_B, B.cols, ["row_key"]), "B", B.ords))
def _domain_filter(spark, sf):
    """JN-1 alone: strict parse of the raw lines (no clean-up), then the
    per-column semi-joins against the real table's domains."""
    real = load(spark, sf, "B")
    return parse_samples(noisy_lines(real, "B"), real, B.cols, B.ords, clean=False)


def _sql_report(src, alias, cols):
    fl = flags_select(src, FIXTURES[alias].cols, ["row_key"])
    ins = [f"(coalesce({c} IN (SELECT value FROM ({_sql_domains(alias, [c])})), false))" for c in cols]
    sums = ["count(*) AS s0", "sum(CASE WHEN NOT _complete THEN 1 ELSE 0 END) AS s1",
            "sum(CASE WHEN _complete THEN 1 ELSE 0 END) AS s2"]
    cond = "_complete"
    for i, e in enumerate(ins):
        cond += f" AND {e}"
        sums.append(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS s{3 + i}")
    names = ["lines", "problem_lines", "parsed"] + [f"in_domain:{c}" for c in cols]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS step, '{n}' AS stage, coalesce(s{i}, 0)::BIGINT AS n FROM a"
                              for i, n in enumerate(names))
    return f"WITH a AS (SELECT {', '.join(sums)} FROM ({fl})) {rows}"


@query("parse_report", _sql_report(_CLEAN_B, "B", B.ords))
def _parse_report(spark, sf):
    real = load(spark, sf, "B")
    return parse_report(parse_flags(noisy_lines(real, "B"), real, B.cols, B.ords), B.ords)


@query("parse_samples", _sql_in_domain(strict_select(_CLEAN_B, B.cols, ["row_key"]), "B", B.ords))
def _parse_samples(spark, sf):
    """TXT-16 + SNK-4 on damaged text of ``orders``: clean, strict parse,
    domain check, then the clean table is written as CSV with a header
    (nothing is written if no row survived) and read back."""
    from sentable.sources.io import CSV, scratch_path, write_clean
    real = load(spark, sf, "B")
    out = parse_samples(noisy_lines(real, "B"), real, B.cols, B.ords)
    path = scratch_path(spark, "clean")
    if not write_clean(out, path):
        return out.limit(0)
    schema = ", ".join(f"{c} string" for c in out.columns)
    return spark.read.schema(schema).options(**CSV).csv(path)      # as it was written
