"""Text workloads derived by Spark from the fixture tables.

Generated text in the reference comes from a model; here it is rendered from
real rows with deterministic damage, so every parse query reads whole tables
and its work grows with them.  Damage by u(11, 'noise', key):
  [0, .1)   last <EOC> cut (unterminated last sentence)
  [.1, .2)  leading <BOS> left in place
  [.2, .3)  lower-cased (values leave the domain)
  [.3, .35) doubled space after "is" (four words)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.hashing import uniform
from sentable.functions.text import row_text, IS
from sentable.functions.fmt import formatted
from sentable.plans.fixtures import FIXTURES, sql_fmt, sql_u, upcast

NOISE_SEED = 11


def noisy_lines(df: DataFrame, alias: str) -> DataFrame:
    fx = FIXTURES[alias]
    staged = df.select("row_key", row_text(df, fx.cols, bos=False, null_text="nan", upcast=upcast(alias)).alias("_b"),
                       uniform(NOISE_SEED, "noise", F.col("row_key")).alias("_u"))
    base, u = F.col("_b"), F.col("_u")
    line = (F.when(u < 0.1, base.substr(F.lit(1), F.length(base) - 5))
            .when(u < 0.2, F.concat(F.lit("<BOS>"), base))
            .when(u < 0.3, F.lower(base))
            .when(u < 0.35, F.replace(base, F.lit(" is "), F.lit(" is  ")))
            .otherwise(base))
    return staged.select("row_key", line.alias("line"))


def sql_sentences(alias: str, sep: str = "") -> str:
    fx = FIXTURES[alias]
    up = upcast(alias)
    parts = [f"'{c} is ' || {sql_fmt(c, fx.kinds[c], 'nan', up)} || '<EOC>'" for c in fx.cols]
    return "concat(" + ", ".join(parts) + ")" if not sep else "concat_ws('" + sep + "', " + ", ".join(parts) + ")"


def sql_noisy_lines(alias: str, src: str) -> str:
    base = sql_sentences(alias)
    u = sql_u(NOISE_SEED, "'noise'", "row_key")
    return (f"SELECT row_key, CASE WHEN u < 0.1 THEN substr(b, 1, length(b) - 5) "
            f"WHEN u < 0.2 THEN '<BOS>' || b WHEN u < 0.3 THEN lower(b) "
            f"WHEN u < 0.35 THEN replace(b, ' is ', ' is  ') ELSE b END AS line "
            f"FROM (SELECT row_key, {base} AS b, {u} AS u FROM ({src}))")


def spoiled_lines(df: DataFrame) -> DataFrame:
    """Marks of a decoder in ``line``: an end-of-text token, line ends, a joined question mark."""
    u, line = uniform(NOISE_SEED, "spoil", F.col("row_key")), F.col("line")
    return df.withColumn("line", F.when(u < 0.2, F.concat(line, F.lit("<|endoftext|>")))
                         .when(u < 0.4, F.replace(line, F.lit(" is "), F.lit("\nis\r ")))
                         .when(u < 0.6, F.replace(line, F.lit(" is "), F.lit(" is?"))).otherwise(line))


def sql_spoiled_lines(src: str) -> str:
    u = sql_u(NOISE_SEED, "'spoil'", "row_key")
    return (f"SELECT row_key, CASE WHEN u < 0.2 THEN line || '<|endoftext|>' "
            f"WHEN u < 0.4 THEN replace(line, ' is ', chr(10) || 'is' || chr(13) || ' ') "
            f"WHEN u < 0.6 THEN replace(line, ' is ', ' is?') ELSE line END AS line FROM (SELECT *, {u} AS u FROM ({src}))")


def lenient_text(df: DataFrame, alias: str) -> DataFrame:
    """Comma format: non-null cells as "c is v"; a null cell reads "c is None"
    on half of the rows (u(11,'none',key) < .5) and is left out otherwise."""
    fx = FIXTURES[alias]
    f = formatted(df, fx.cols, None, upcast=False)
    none = uniform(NOISE_SEED, "none", F.col("row_key")) < 0.5
    items = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + IS), f[c]))
                      .when(none, F.lit(c + IS + "None")) for c in fx.cols])
    return df.select("row_key", F.array_join(items, ", ").alias("text"))


def sql_lenient_text(alias: str, src: str) -> str:
    fx = FIXTURES[alias]
    none = f"({sql_u(NOISE_SEED, chr(39) + 'none' + chr(39), 'row_key')} < 0.5)"
    items = [f"CASE WHEN {c} IS NOT NULL THEN '{c} is ' || {sql_fmt(c, fx.kinds[c])} "
             f"WHEN {none} THEN '{c} is None' END" for c in fx.cols]
    return f"SELECT row_key, concat_ws(', ', {', '.join(items)}) AS text FROM ({src})"
