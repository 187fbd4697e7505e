"""Goldens from FIXTURES.md §3 (columns age, sex)."""

from pyspark.sql import functions as F

from sentable.operators.parsing import clean_lines, parse_lenient, parse_strict

LINES = [
    ("age is 39<EOC>sex is M<EOC>", ("39", "M"), ("39", "M")),
    ("sex is M<EOC>age is 39<EOC>", ("39", "M"), ("39", "M")),
    ("age is 39<EOC>age is 40<EOC>sex is M<EOC>", ("39", "M"), ("39", "M")),
    ("age is<EOC>age is 40<EOC>sex is M<EOC>", ("40", "M"), ("40", "M")),
    ("age was 39<EOC>sex is M<EOC>", ("39", "M"), ("39", "M")),
    ("age is <EOC>sex is M<EOC>", ("", "M"), ("", "M")),
    ("age is 39<EOC>sex is M", ("39", "M"), None),
    ("age is 39<EOC>", None, None),
    ("age is 39<EOC>sex is not stated<EOC>", None, None),
    ("age is 39<EOC> sex is M<EOC>", None, None),
    ("age is 39<EOC>sex is?<EOC>", None, None),
    ("age is 39<EOC>sex is M<EOC>job is x<EOC>", ("39", "M"), ("39", "M")),
    ("age is a<b<EOC>sex is M<EOC>", ("a<b", "M"), ("a<b", "M")),
]
COLS = ["age", "sex"]


def _lines(spark):
    return spark.createDataFrame([(i, l) for i, (l, _, _) in enumerate(LINES)], "k int, line string")


def test_strict(spark):
    got = {r.k: (r.age, r.sex) for r in parse_strict(_lines(spark), COLS).collect()}
    want = {i: s for i, (_, s, _) in enumerate(LINES) if s is not None}
    assert got == want


def test_terminated_keeps_failed_rows(spark):
    rows = parse_strict(_lines(spark), COLS, terminated=True, keep_failed=True).collect()
    got = {r.k: (r.age, r.sex) for r in rows}
    want = {i: (t if t is not None else (None, None)) for i, (_, _, t) in enumerate(LINES)}
    assert got == want


def test_question_mark_repair(spark):
    df = spark.createDataFrame([(0, "<BOS>age is 39<EOC>sex is?<EOC>")], "k int, line string")
    assert [(r.age, r.sex) for r in parse_strict(clean_lines(df), COLS).collect()] == [("39", "?")]


def test_lenient(spark):
    texts = ["age is 39, sex is M", "age is 39", "age is None, sex is M", "age is 39, age is 40, sex is M",
             "age, sex is M"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: (r.age, r.sex) for r in parse_lenient(df, COLS).collect()}
    assert got == {0: ("39", "M"), 1: ("39", "placeholder"), 2: (None, "M"), 3: ("39", "M"),
                   4: ("placeholder", "M")}


def test_impute_prompt(spark):
    from sentable.functions.text import impute_prompt
    df = spark.createDataFrame([("a", 39, None), ("b", 39, "M"), ("c", None, None)], "k string, age int, sex string")
    got = {r.k: r.p for r in df.select("k", impute_prompt(df, COLS, 1, F.col("k")).alias("p")).collect()}
    assert got["a"] == "age is 39, sex is"
    assert got["b"] in ("age is 39, sex is M, ", "sex is M, age is 39, ")
    assert got["c"] in ("age is", "sex is")
