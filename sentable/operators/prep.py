"""Projections, recodes, casts, fills and the column contract (§2.2, §2.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentable.functions.fmt import FRACTIONAL, INTEGRAL, WHITESPACE, format_value, formatted, is_missing, quoted
from sentable.operators.domain import long_form

# Fixed value: what pandas' to_numeric(errors='coerce') accepts as a number.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_RE = r"^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"


def rename_all(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ-1: positional rename of every column."""
    if len(cols) != len(df.columns):
        raise ValueError(f"{len(cols)} names for {len(df.columns)} columns")
    return df.toDF(*cols)


def recode(df: DataFrame, col: str, value, yes, no) -> DataFrame:
    """PRJ-2: x == value → yes, else (null included) → no."""
    return df.withColumn(col, F.when(F.col(col).eqNullSafe(F.lit(value)), F.lit(yes)).otherwise(F.lit(no)))


def tail_columns(df: DataFrame, k: int = 3) -> DataFrame:
    """PRJ-3: keep the last k columns (the tiny debug mode)."""
    return df.select(*[quoted(c) for c in df.columns[-k:]])


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric by type; booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL + FRACTIONAL + (T.DecimalType,))]


def check_roles(cols: list[str], ords: list[str], nums: list[str], labs: list[str]) -> None:
    roles = ords + nums + labs
    if set(roles) != set(cols) or len(roles) != len(cols):
        raise ValueError("roles must be a disjoint exact cover of the columns")


def column_contract(df: DataFrame, ords: list[str], nums: list[str], labs: list[str]) -> DataFrame:
    """PRJ-5: one row per column (role, type, is_numeric, nulls, distinct);
    raises if the roles are not a disjoint exact cover of the columns.

    One scan: cells are unpivoted to (column, value), counted per distinct
    value with a map-side partial aggregate (so a hot value collapses early),
    then folded per column."""
    cols = df.columns
    check_roles(cols, ords, nums, labs)
    role = {**{c: "ords" for c in ords}, **{c: "nums" for c in nums}, **{c: "labs" for c in labs}}
    f = formatted(df, cols, None, upcast=False)
    lf = long_form(df, cols, f)
    per_value = lf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    stats = per_value.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).cast("long").alias("nulls"),
        F.count("value").cast("long").alias("distinct"))
    numeric = set(numeric_columns(df))
    meta = df.sparkSession.createDataFrame(
        [(c, i, role[c], df.schema[c].dataType.simpleString(), c in numeric) for i, c in enumerate(cols)],
        "column string, position int, role string, type string, is_numeric boolean")
    return meta.join(stats, "column", "left").select(
        "column", F.col("position").cast("long").alias("position"), "role", "type", "is_numeric",
        F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"),
        F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))


def same_columns(df: DataFrame, cols: list[str]) -> None:
    """SET-2 on schemas: the fitted and incoming column sets must match."""
    if set(df.columns) != set(cols):
        raise ValueError("the column names do not match the fitted columns")


def fill_na(df: DataFrame, fill: str = "?") -> DataFrame:
    """FLT-1: fill every column that is not numeric; one of another type
    (boolean, date, ...) that has nulls becomes text, as in ``fill_na_all``."""
    return fill_na_all(df, fill, [c for c in df.columns if c not in set(numeric_columns(df))])


def fill_na_all(df: DataFrame, fill: str = "?", cols: list[str] | None = None) -> DataFrame:
    """FLT-2: fill every column (or ``cols``); a column of another type than
    text that has missing cells becomes text.

    Which columns change type depends on the data, so one aggregate pass
    counts missing cells per column first (a single-row result)."""
    cols = cols or df.columns
    typed = [c for c in cols if not isinstance(df.schema[c].dataType, T.StringType)]
    counts = dict(zip(typed, df.agg(*[F.count_if(is_missing(df, c)) for c in typed]).first())) if typed else {}
    out = []
    for c in df.columns:
        col, dt = F.col(quoted(c)), df.schema[c].dataType
        if c not in cols:
            out.append(col)
        elif isinstance(dt, T.StringType):
            out.append(F.coalesce(col, F.lit(fill)).alias(c))
        elif counts[c]:
            out.append(F.when(is_missing(df, c), F.lit(fill)).otherwise(format_value(col, dt)).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def to_numeric(c: Column) -> Column:
    """PRJ-9: pandas-style coerce: a number (or a text of infinity) → double,
    anything else → null.  The guard matters: Spark alone would accept '1d' or '1f'."""
    s = c.cast("string")
    return (F.when(s.rlike(NUMBER_RE), F.btrim(s, F.lit(WHITESPACE)).try_cast("double"))
            .when(s.rlike(INFINITY_RE), F.when(s.rlike(r"^\s*-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[to_numeric(F.col(quoted(c))).alias(c) if c in cols else F.col(quoted(c)) for c in df.columns])


def missing_profile(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """FLT-7: missing cells (null or NaN) per row and an is-complete flag."""
    n = sum((is_missing(df, c).cast("long") for c in cols), F.lit(0).cast("long"))
    return df.select(*(keep or []), n.alias("n_missing"), (n == 0).alias("is_complete"))


def typed_output(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """PRJ-12: parsed text columns back to the real table's types (try_cast)."""
    return df.select(*[F.col(quoted(c)).try_cast(types[c]).alias(c) if c in types else F.col(quoted(c)) for c in df.columns])
