"""Row ↔ text expressions (TXT-1 … TXT-12).  All built-in functions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import formatted, is_missing
from sentable.functions.hashing import hash_hex

# The special tokens and sentence layout of the text format.
BOS = "<BOS>"
EOC = "<EOC>"
IS = " is "
ENDOFTEXT = "<|endoftext|>"


def sentence(name: str, value: Column, end: str = EOC) -> Column:
    return F.concat(F.lit(name), F.lit(IS), value, F.lit(end))


def row_sentences(df: DataFrame, cols: list[str] | None = None, null_text: str | None = "nan",
                  upcast: bool | None = None) -> Column:
    """TXT-1: array of "<col> is <val><EOC>" in schema (or given) order."""
    cols = cols or [c for c in df.columns]
    f = formatted(df, cols, null_text, upcast)
    return F.array(*[sentence(c, f[c]) for c in cols])


def row_text(df: DataFrame, cols: list[str] | None = None, bos: bool = True,
             null_text: str | None = "nan", upcast: bool | None = None) -> Column:
    """TXT-2: <BOS> + all sentences joined with no separator."""
    body = F.array_join(row_sentences(df, cols, null_text, upcast), "")
    return F.concat(F.lit(BOS), body) if bos else body


def permuted_sentences(df: DataFrame, seed, key: Column, cols: list[str] | None = None,
                       null_text: str | None = "None", tag: str = "perm") -> tuple[Column, Column]:
    """SMP-2 / TXT-3: per-row random column order.

    Each column gets the sort key md5(seed:tag:key:col); the permutation is the
    column indexes in that order.  Returns (text, permutation as "i,j,k").
    Permuted rows never upcast ints.
    """
    cols = cols or df.columns
    f = formatted(df, cols, null_text, upcast=False)
    items = F.array(*[F.struct(hash_hex(seed, F.concat_ws(":", F.lit(tag), key.cast("string")), F.lit(c)).alias("h"),
                               F.lit(i).alias("i"), sentence(c, f[c]).alias("s"))
                      for i, c in enumerate(cols)])
    srt = F.array_sort(items)
    text = F.array_join(F.transform(srt, lambda x: x["s"]), "")
    perm = F.array_join(F.transform(srt, lambda x: x["i"].cast("string")), ",")
    return text, perm


def partial_row_items(df: DataFrame, cols: list[str] | None = None, seed=None, key: Column | None = None,
                      tag: str = "partial") -> Column:
    """TXT-4 helper: array of "c is v" for the cells that are not missing, in schema order or
    (with a seed) in per-row hash order.  Values are Python ``str`` without strip."""
    cols = cols or df.columns
    f = formatted(df, cols, None, upcast=False)
    if seed is None:
        return F.filter(F.array(*[F.when(~is_missing(df, c), F.concat(F.lit(c), F.lit(IS), f[c]))
                                  for c in cols]), lambda x: x.isNotNull())
    items = F.array(*[F.struct(hash_hex(seed, F.concat_ws(":", F.lit(tag), key.cast("string")), F.lit(c)).alias("h"),
                               F.when(~is_missing(df, c), F.concat(F.lit(c), F.lit(IS), f[c])).alias("s"))
                      for c in cols])
    return F.transform(F.filter(F.array_sort(items), lambda x: x["s"].isNotNull()), lambda x: x["s"])


def partial_row_text(df: DataFrame, cols=None, seed=None, key=None) -> Column:
    """TXT-4: non-null cells as "c is v" joined by ", "."""
    return F.array_join(partial_row_items(df, cols, seed, key), ", ")


def pick_missing(df: DataFrame, cols: list[str], seed, key: Column, tag: str = "missing") -> Column:
    """SMP-3: one random missing (null or NaN) column of the row (hash order), or null."""
    items = F.array(*[F.when(is_missing(df, c), F.struct(
        hash_hex(seed, F.concat_ws(":", F.lit(tag), key.cast("string")), F.lit(c)).alias("h"),
        F.lit(c).alias("c"))) for c in cols])
    return F.array_min(F.filter(items, lambda x: x.isNotNull()))["c"]


def impute_prompt(df: DataFrame, cols: list[str], seed, key: Column) -> Column:
    """TXT-5: partial text + ", " (if any) + "<missing col> is" (if any)."""
    enc = partial_row_text(df, cols, seed, key)
    miss = pick_missing(df, cols, seed, key)
    return F.concat(F.when(F.length(enc) > 0, F.concat(enc, F.lit(", "))).otherwise(F.lit("")),
                    F.when(miss.isNotNull(), F.concat(miss, F.lit(" is"))).otherwise(F.lit("")))


def clean_text(c: Column) -> Column:
    """TXT-10: drop <|endoftext|>, newline → space, drop carriage return."""
    return F.replace(F.replace(F.replace(c, F.lit(ENDOFTEXT), F.lit("")), F.lit("\n"), F.lit(" ")),
                     F.lit("\r"), F.lit(""))


def fix_question_mark(c: Column) -> Column:
    """TXT-11: the tokenizer decodes "is ?" as "is?"."""
    return F.regexp_replace(c, r"is\?", "is ?")


def strip_bos(c: Column) -> Column:
    """TXT-12: drop leading start token(s)."""
    return F.regexp_replace(c, r"^(<BOS>)+", "")
