"""Text → row (TXT-13/14/15) as one projection of higher-order functions.

Strict rules (one generated row per line, newline already removed):
split on <EOC>, split each piece on single spaces, keep pieces of exactly
three words whose first word is a known column; the first such piece per
column wins; the middle word is not checked.  ``terminated`` drops the text
after the last <EOC>.  Lenient rules: split on ",", strip, split on " is ",
the second part is the value, a missing column becomes "placeholder" and the
text "None" becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.text import EOC
from sentable.functions.fmt import WHITESPACE, quoted

# Fixed value: marker for a column the lenient parser did not find.
PLACEHOLDER = "placeholder"


def _named_with_value(c: str):
    return lambda w: (w[0] == F.lit(c)) & (F.size(w) >= 2)


def sentence_pattern(c: str, terminated: bool = False, value_spaces: bool = False) -> str:
    """Regex for the first well-formed sentence of column ``c``: it starts the
    line or follows an <EOC>, is exactly "c w2 w3" with single spaces (words
    may be empty, none crosses an <EOC>) and ends at the next <EOC> (or, unless
    ``terminated``, at the end of the line).  Group 2 is the value.  Because
    "<EOC>" cannot overlap itself, these boundaries are exactly those of
    splitting on <EOC>."""
    # possessive runs of one-character steps: matched in a loop, so their length is not bounded by the stack
    word = r"((?:(?!<EOC>)[^ ])*+)"
    value = r"((?s:(?!<EOC>).)*+)" if value_spaces else word
    end = r"(?=<EOC>)" if terminated else r"(?=<EOC>|\z)"
    return r"(?:^|<EOC>)\Q" + c.replace("\\E", r"\E\\E\Q") + r"\E " + word + " " + value + end


def strict_field(line: Column, c: str, terminated: bool = False, value_spaces: bool = False) -> Column:
    """The value of the first well-formed sentence of ``c``, or null.  A name
    with a space can never be the first of three words, so it is never found;
    ``value_spaces`` takes names and values with spaces."""
    if " " in c and not value_spaces:
        return F.lit(None).cast("string")
    pattern = F.lit(sentence_pattern(c, terminated, value_spaces))
    if value_spaces:
        return F.get(F.regexp_extract_all(line, pattern, 2), 0)
    # the search ends with the first sentence (three words, so what follows its last space is the value)
    return F.substring_index(F.regexp_substr(line, pattern), " ", -1)


def with_strict_fields(df: DataFrame, line: str, cols: list[str], keep: list[str], terminated: bool = False,
                       value_spaces: bool = False) -> DataFrame:
    """keep + parsed columns + ``_complete``.  One code-generated regex
    search per column (first match wins; malformed sentences never match)."""
    f = df.select(*keep, *[strict_field(F.col(line), c, terminated, value_spaces).alias(c) for c in cols])
    return f.select("*", complete({c: F.col(quoted(c)) for c in cols}).alias("_complete"))


def _lenient_parts(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), lambda f: F.split(F.btrim(f, F.lit(WHITESPACE)), " is ", -1))


def _lenient_value(parts: Column, c: str, none_to_null: bool) -> Column:
    # A bare "c" (no " is ") has no value and does not claim the column.
    v = F.coalesce(F.get(F.get(F.filter(parts, _named_with_value(c)), 0), 1), F.lit(PLACEHOLDER))
    return F.nullif(v, F.lit("None")) if none_to_null else v


def with_lenient_fields(df: DataFrame, text: str, cols: list[str], keep: list[str], none_to_null: bool = True) -> DataFrame:
    v = df.select(*keep, _lenient_parts(F.col(text)).alias("_ft"))
    return v.select(*keep, *[_lenient_value(F.col("_ft"), c, none_to_null).alias(c) for c in cols])


def complete(fields: dict[str, Column]) -> Column:
    """FLT-4: all columns were found."""
    out = F.lit(True)
    for v in fields.values():
        out = out & v.isNotNull()
    return out


def lenient_fields(text: Column, cols: list[str], none_to_null: bool = True) -> dict[str, Column]:
    return {c: _lenient_value(_lenient_parts(text), c, none_to_null) for c in cols}
