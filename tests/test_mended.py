"""Probes of answers that depended on size or values, or lost data."""

import math

import pytest
from pyspark.sql import functions as F

from sentable.functions.text import impute_prompt, partial_row_text
from sentable.operators.dist import draw_from_one, intervals
from sentable.operators.experts import GROUP, weighted
from sentable.operators.parsing import clean_lines, parse_strict
from sentable.operators.prep import coerce_numeric, fill_na, fill_na_all, missing_profile
from sentable.operators.starts import start_categorical, start_prompts
from sentable.sources.io import read_split, write_clean, write_snapshot
from sentable.streaming.parse_stream import run_available


def test_fractional_weights(spark):
    dist = spark.createDataFrame([("A", 0.6), ("B", 0.4), ("C", 0.0)], "value string, n double")
    got = start_categorical(spark.range(1000).toDF("sid"), dist, "x", 42)
    n = {r.prompt: r["count"] for r in got.groupBy("prompt").count().collect()}
    assert set(n) == {"x is A", "x is B"} and abs(n["x is A"] - 600) <= 50


def test_draw_has_no_nested_loop(spark):
    dist = spark.createDataFrame([("A", 3), ("B", 1)], "value string, n long")
    probes = spark.range(10).select("id", (F.col("id") / 10).alias("_u"))
    plan = draw_from_one(probes, dist)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_temperature_depends_on_ratios_only(spark):
    t = 0.7
    small = [(str(k), k) for k in range(1, 26)]
    for scale in (1, 10 ** 6):
        df = spark.createDataFrame([(0, "c", 0, "", v, n * scale) for v, n in small],
                                   "order_id long, col string, level long, ctx string, value string, n long")
        w = {r.value: r.n for r in weighted(df, t).collect()}
        assert all(math.isclose(w[v] / w["25"], (n / 25) ** (1 / t), rel_tol=1e-6) for v, n in small)
    many = spark.range(1_000_000).select(F.lit(0).cast("long").alias("order_id"), F.lit("c").alias("col"),
                                         F.lit(0).cast("long").alias("level"), F.lit("").alias("ctx"),
                                         F.col("id").cast("string").alias("value"),
                                         F.when(F.col("id") == 0, 10 ** 6).otherwise(F.col("id") % 50 + 1).cast("long").alias("n"))
    w = weighted(many, t)
    by = {r.n0: (r.lo, r.hi) for r in w.join(many.select("value", F.col("n").alias("n0")), "value").groupBy("n0").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi")).collect()}
    assert all(lo == hi for lo, hi in by.values())
    assert all(by[n][0] < by[n + 1][0] for n in range(1, 50))
    assert w.agg(F.sum("n")).first()[0] < 2 ** 53 and "total" in intervals(w, GROUP).columns


def test_strict_parse_of_long_values(spark):
    value = "<" * 1_000_000
    df = spark.createDataFrame([(0, f"age is {value}<EOC>sex is M<EOC>"), (1, "age is a<EO<EOC>sex is <EOC")], "k int, line string")
    got = {r.k: (len(r.age), r.sex) for r in parse_strict(df, ["age", "sex"]).collect()}
    assert got == {0: (1_000_000, "M"), 1: (4, "<EOC")}


def test_names_and_values_with_spaces(spark):
    df = spark.createDataFrame([(0, "my col is 5<EOC>job is not stated<EOC>")], "k int, line string")
    assert parse_strict(df, ["my col"]).count() == 0
    got = parse_strict(df, ["my col", "job"], value_spaces=True).first()
    assert (got["my col"], got["job"]) == ("5", "not stated")


def test_csv_snapshot_keeps_values(spark, tmp_path):
    rows = [("x\ny", "train"), ("  pad  ", "train"), ('say "hi", ok', "train"), ("back\\slash", "train"), ("NA", "train"), ("z", "val")]
    write_snapshot(spark.createDataFrame(rows, "v string, split string"), str(tmp_path), "t", "2024 01", fmt="csv")
    got = read_split(spark, str(tmp_path), "t", "train", fmt="csv",
                     schema=spark.createDataFrame([], "v string, split string, version string").schema)
    want = [None if v == "NA" else v for v, s in rows if s == "train"]
    assert sorted((r.v for r in got.collect()), key=str) == sorted(want, key=str)


def test_one_rule_for_missing_cells(spark):
    df = spark.createDataFrame([(1, float("nan"), None, None), (2, 1.5, True, "x"), (None, 2.0, False, None)],
                               "i int, d double, b boolean, s string")
    cols = ["i", "d", "b", "s"]
    assert [r.n_missing for r in missing_profile(df, cols).collect()] == [3, 0, 2]
    assert df.select(partial_row_text(df, cols).alias("t")).first().t == "i is 1"
    assert df.select(impute_prompt(df, ["d"], 1, F.lit("k")).alias("t")).first().t == "d is"
    assert [tuple(r) for r in fill_na(df).collect()][0][2:] == ("?", "?")
    assert fill_na(df).schema["d"].dataType.simpleString() == "double"
    assert [tuple(r) for r in fill_na_all(df).collect()] == [("1", "?", "?", "?"), ("2", "1.5", "True", "x"), ("?", "2.0", "False", "?")]


def test_infinities_are_numbers(spark):
    df = spark.createDataFrame([("inf",), ("-Infinity",), (" 3 ",), ("1d",), ("nan",)], "v string")
    assert [r.v for r in coerce_numeric(df, ["v"]).collect()] == [float("inf"), float("-inf"), 3.0, None, None]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a")], "`edu.num` int, `x y` string")
    assert df.select(partial_row_text(df).alias("t")).first().t == "edu.num is 1, x y is a"
    assert fill_na_all(df).columns == df.columns and missing_profile(df, df.columns).first().n_missing == 0


def test_clean_text_meets_every_rule(spark):
    df = spark.createDataFrame([(0, "<BOS><BOS>age is 3<EOC>sex\r is?<EOC><|endoftext|>"), (1, "a\nb")], "k int, line string")
    assert [r.line for r in clean_lines(df).orderBy("k").collect()] == ["age is 3<EOC>sex is ?<EOC>", "a b"]


def test_no_survivors(spark, tmp_path):
    real = spark.createDataFrame([("39", "M")], "age string, sex string")
    src = tmp_path / "in"
    spark.createDataFrame([("nonsense",)], "value string").write.text(str(src))
    out = run_available(spark, str(src), real, ["age", "sex"], ["sex"], str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.columns == ["age", "sex"] and out.count() == 0
    spark.createDataFrame([("age is 39<EOC>sex is M<EOC>",)], "value string").write.mode("append").text(str(src))
    out = run_available(spark, str(src), real, ["age", "sex"], ["sex"], str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [tuple(r) for r in out.collect()] == [("39", "M")]
    assert not write_clean(out.limit(0), str(tmp_path / "clean")) and not (tmp_path / "clean").exists()


def test_start_sampler_errors(spark):
    keys = spark.range(3).toDF("sid")
    dist = spark.createDataFrame([("A", 1)], "value string, n long")
    for bad in ({"start_col": "x"}, {"start_dist": ("categorical", dist)}, {"start_col": "x", "start_dist": ("odd", dist)}):
        with pytest.raises(ValueError):
            start_prompts(keys, ["x"], 1, **bad)
    with pytest.raises(ValueError):
        start_categorical(keys, dist.limit(0), "x", 1)


def test_completion_uses_later_given_cells(spark):
    from sentable.operators import experts as X
    real = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 20).alias("c1"),
                                    F.concat(F.lit("x"), F.floor(F.col("id") / 20) % 7).alias("c2"),
                                    F.concat(F.lit("v"), F.col("id") % 20).alias("c3"))
    cols = ["c1", "c2", "c3"]
    part = spark.range(200).select(F.col("id").cast("string").alias("row_key"), F.lit(None).cast("string").alias("c1"),
                                   F.lit(None).cast("string").alias("c2"), F.concat(F.lit("v"), F.col("id") % 20).alias("c3"))
    assert X.needed_pairs(part, cols) == [("c1", "c3"), ("c2", "c3")]
    model = X.fit(real, cols, pairs=X.needed_pairs(part, cols))
    out = X.impute(model, part, 1)
    assert out.dropped == 0 and out.rows.where("c1 = c3").count() == 200
    prompts = spark.range(100).select("id", F.concat(F.lit("c3 is v"), F.col("id") % 20).alias("text")).withColumnRenamed("id", "sid")
    assert X.sample_from_prompts(model, prompts, 1).where("c1 = c3").count() == 100


def test_rows_that_cannot_be_filled_are_dropped_at_once(spark):
    from sentable.operators import experts as X
    real = spark.createDataFrame([("a", None), ("b", None)], "c1 string, c2 double")
    part = spark.createDataFrame([("k1", None, 1.0), ("k2", "a", None)], "row_key string, c1 string, c2 double")
    out = X.impute(X.fit(real, ["c1", "c2"]), part, 1)
    assert (out.dropped, out.attempts) == (1, 1) and [r.row_key for r in out.rows.collect()] == ["k1"]
