"""Parsed tables from raw generated lines (TXT-13 … TXT-16, FLT-4/5, WIN-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.fmt import quoted
from sentable.functions.parse import with_lenient_fields, with_strict_fields
from sentable.functions.rows import keep_if
from sentable.functions.text import clean_text, fix_question_mark, strip_bos
from sentable.operators.encode import decode_labels
from sentable.operators.domain import domain_flags, domains, in_domain


def clean_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """TXT-10/11/12: the decode clean-up applied before parsing."""
    return df.withColumn(col, strip_bos(fix_question_mark(clean_text(F.col(col)))))


def parse_strict(df: DataFrame, cols: list[str], line: str = "line", terminated: bool = False, value_spaces: bool = False,
                 keep_failed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """TXT-13 / TXT-14: one projection; rows with a missing column are dropped
    (or, with ``keep_failed``, kept as all-null rows as the demo parser does)."""
    keep = keep if keep is not None else [c for c in df.columns if c != line]
    out = with_strict_fields(df, line, cols, keep, terminated, value_spaces)
    if keep_failed:
        return out.select(*keep, *[F.when(F.col("_complete"), F.col(quoted(c))).alias(c) for c in cols])
    return keep_if(out, "_complete").drop("_complete")


def parse_lenient(df: DataFrame, cols: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """TXT-15 + PRJ-10: every line yields a row."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    return with_lenient_fields(df, text, cols, keep)


def parse_flags(raw: DataFrame, real: DataFrame, cols: list[str], check: list[str], line: str = "line",
                fill: str | None = "?", clean: bool = True) -> DataFrame:
    """Strict parse with the complete flag and per-column domain flags kept."""
    src = clean_lines(raw, line) if clean else raw
    keep = [c for c in src.columns if c != line]
    parsed = with_strict_fields(src, line, cols, keep)
    return domain_flags(parsed, domains(real, check, fill), check)


def parse_samples(raw: DataFrame, real: DataFrame, cols: list[str], check: list[str], line: str = "line",
                  fill: str | None = "?", clean: bool = True, enc: DataFrame | None = None,
                  enc_cols: list[str] | None = None, value_spaces: bool = False) -> DataFrame:
    """TXT-16: clean → strict parse → label decode (of ``enc_cols``, if the model
    was fitted on labels) → domain filter → clean table (all text)."""
    src = clean_lines(raw, line) if clean else raw
    parsed = parse_strict(src, cols, line, value_spaces=value_spaces)
    if enc is not None:
        parsed = decode_labels(parsed, enc, enc_cols)
    return in_domain(parsed, domains(real, check, fill), check)

