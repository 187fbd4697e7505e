"""SURVEY §5 properties."""

from pyspark.sql import functions as F

from sentable.functions.fmt import formatted
from sentable.functions.text import row_text
from sentable.operators import experts as X
from sentable.operators.encode import decode_labels, encode_labels, fit_labels
from sentable.operators.parsing import clean_lines, parse_strict
from sentable.plans.fixtures import FIXTURES, load

B, A = FIXTURES["B"], FIXTURES["A"]


def test_parse_inverts_row_text_without_spaces(spark, small_dir):
    df = load(spark, small_dir, "B").filter(~F.col("o_orderpriority").contains(" "))
    lines = df.select("row_key", row_text(df, B.cols).alias("line"))
    parsed = {r.row_key: tuple(r[c] for c in B.cols) for r in parse_strict(clean_lines(lines), B.cols).collect()}
    f = formatted(df, B.cols, "nan")
    want = {r.row_key: tuple(r[c] for c in B.cols) for r in df.select("row_key", *[f[c].alias(c) for c in B.cols]).collect()}
    assert parsed == want


def test_decode_encode_roundtrip(spark, small_dir):
    df = load(spark, small_dir, "A")
    cols = A.ords + A.labs
    enc = fit_labels(df.drop("row_key"), cols)
    back = decode_labels(encode_labels(df, enc, cols), enc, cols)
    f = formatted(df, cols, "?")
    want = sorted(tuple(r) for r in df.select("row_key", *[f[c].alias(c) for c in cols]).collect())
    assert sorted(tuple(r) for r in back.select("row_key", *cols).collect()) == want


def test_sampling_independent_of_shuffle_partitions(spark, small_dir):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = load(spark, small_dir, "B")
            m = X.fit(df.drop("row_key"), B.cols, bins=8)
            s = X.sample(m, df.select(F.col("row_key").alias("sid")), 42, temperature=0.7)
            out.append(sorted(tuple(r) for r in s.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
