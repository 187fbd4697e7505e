"""TXT-0: cell → text the way Python's ``str(x).strip()`` prints it.

Spark prints doubles through Java (``1.0E7``, ``1.0E-4``); Python switches to
exponent form only below 1e-4 or from 1e16 up (``1e+16``, ``1e-05``) and
otherwise prints positional digits.  Both produce the shortest round-trip
digits, so only the layout needs rewriting, which is done with string
expressions (no UDF).  Java 17 sometimes prints one digit more than the
shortest; those cases are repaired by a round-trip test.  Known limits (Java
17 only, magnitudes no table here reaches): for |x| >= 1e16 about 0.5% of
values may differ from Python in the last digit (two shortest candidates
round-trip and Python takes the nearer), and 5e-324 prints as ``4.9e-324``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters Python's str.strip() removes for ASCII text.
WHITESPACE = " \t\n\x0b\x0c\r"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, INTEGRAL + FRACTIONAL + (T.DecimalType,))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` (a one-element
    ``transform``), so a big expression is not copied into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _exponent_form(s: Column) -> Column:
    """Java ``d.dddE±n`` → Python layout (only reached for rare magnitudes)."""
    def body(p):
        digits, e, sign = p["d"], p["e"], p["sign"]
        nd = F.length(digits)
        sci = F.concat(sign, F.substring(digits, 1, 1),
                       F.when(nd > 1, F.concat(F.lit("."), F.substring(digits, 2, 1 << 20))).otherwise(F.lit("")),
                       F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string")))
                        .otherwise(F.abs(e).cast("string")))
        big = F.when(nd <= e + 1, F.concat(sign, F.rpad(digits, e + 1, "0"), F.lit(".0"))) \
               .otherwise(F.concat(sign, F.substring(digits, 1, e + 1), F.lit("."), F.substring(digits, e + 2, 1 << 20)))
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.when((e >= 16) | (e < -4), sci).when(e >= 0, big).otherwise(small)

    def parts(t):
        mant = F.substring_index(t, "E", 1)
        d = F.regexp_replace(F.regexp_replace(mant, r"[-.]", ""), r"0+$", "")
        return F.named_struct(F.lit("d"), F.when(d == "", F.lit("0")).otherwise(d),
                              F.lit("e"), F.substring_index(t, "E", -1).cast("int"),
                              F.lit("sign"), F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")))
    return let(let(s, parts), body)


def _shortest_java(x: Column) -> Column:
    """Java 17 sometimes prints 17 significant digits where 15 or 16 already
    round-trip (seen for |x| >= 1e16).  Python prints the shortest: try the
    15- and 16-digit renderings and keep the first that parses back to x."""
    def body(t):
        sig = F.length(F.regexp_replace(F.regexp_replace(F.substring_index(t, "E", 1), r"[-.]", ""), r"0+$", ""))
        c15 = F.replace(F.replace(F.format_string("%.14e", x), F.lit("e+"), F.lit("E")), F.lit("e"), F.lit("E"))
        c16 = F.replace(F.replace(F.format_string("%.15e", x), F.lit("e+"), F.lit("E")), F.lit("e"), F.lit("E"))
        c17 = F.replace(F.replace(F.format_string("%.16e", x), F.lit("e+"), F.lit("E")), F.lit("e"), F.lit("E"))
        return (F.when((sig >= 17) & (c15.try_cast("double") == x), c15)
                .when((sig >= 17) & (c16.try_cast("double") == x), c16)
                .when((sig >= 18) & (c17.try_cast("double") == x), c17)
                .otherwise(t))
    return let(x.cast("string"), body)


def py_double_str(x: Column) -> Column:
    """Python ``str(float)``.  Java and Python agree on the digits and, for
    1e-3 <= |x| < 1e7, on the layout too: that common case is a plain cast
    (code-generated); only other magnitudes go through the rewrite."""
    ax = F.abs(x)
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when((x == 0) | ((ax >= 1e-3) & (ax < 1e7)), x.cast("string"))
            .otherwise(_exponent_form(_shortest_java(x))))


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def is_missing(df: DataFrame, name: str) -> Column:
    """The one rule for missing cells: null, or NaN in a fractional column."""
    c = F.col(quoted(name))
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def format_value(c: Column, dtype, null_text: str | None = None, as_double: bool = False) -> Column:
    """Text of one cell; ``null_text`` replaces nulls (None keeps them null)."""
    if isinstance(dtype, FRACTIONAL) or (as_double and isinstance(dtype, INTEGRAL)):
        out = py_double_str(c.cast("double"))
    elif isinstance(dtype, INTEGRAL) or isinstance(dtype, T.DecimalType):
        out = c.cast("string")
    elif isinstance(dtype, T.BooleanType):
        out = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, T.StringType):
        out = F.btrim(c, F.lit(WHITESPACE))
    else:
        out = F.btrim(c.cast("string"), F.lit(WHITESPACE))
    if null_text is not None:
        out = F.coalesce(out, F.lit(null_text))
    return out


def all_numeric_upcast(df: DataFrame, cols: list[str]) -> bool:
    """A pandas row of an all-numeric frame with a float column is float:
    its ints print as ``1.0``.  Mixed rows keep ``1``."""
    types = [df.schema[c].dataType for c in cols]
    return all(isinstance(t, INTEGRAL + FRACTIONAL) for t in types) and \
        any(isinstance(t, FRACTIONAL) for t in types)


def formatted(df: DataFrame, cols: list[str] | None = None, null_text: str | None = None,
              upcast: bool | None = None) -> dict[str, Column]:
    cols = cols or df.columns
    up = all_numeric_upcast(df, cols) if upcast is None else upcast
    return {c: format_value(F.col(quoted(c)), df.schema[c].dataType, null_text, as_double=up) for c in cols}


def stringify(df: DataFrame, cols: list[str] | None = None, null_text: str | None = None) -> DataFrame:
    """PRJ-8: Python ``str()`` per cell of ``cols`` (others untouched)."""
    f = formatted(df, cols, null_text, upcast=False)
    return df.select(*[f[c].alias(c) if c in f else F.col(quoted(c)) for c in df.columns])
