import random

from pyspark.sql import functions as F

from sentable.functions.fmt import format_value, py_double_str
from pyspark.sql import types as T


def test_double_text_matches_python(spark):
    rnd = random.Random(5)
    vals = [23.0, 0.0001, 0.001, 1e-05, 1e7, 1e16, 1.5e16, 123456789.123, -0.0, 0.1, 1e22, 2.5e-7, 901.0,
            12345678.9, -1.25e-5, float("nan"), float("inf"), -float("inf"), 9999999.999, 0.00099, 1e100, 1.5e-300]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 15) for _ in range(2000)]
    vals += [round(rnd.uniform(0, 1e5), 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", py_double_str(F.col("x")).alias("s")).collect()
    bad = [(r.x, r.s) for r in got if r.s != repr(r.x)]
    assert not bad


def test_other_types(spark):
    df = spark.createDataFrame([(3, True, "  a b \t", None)], "i int, b boolean, s string, n double")
    r = df.select(format_value(F.col("i"), T.IntegerType()).alias("i"),
                  format_value(F.col("i"), T.IntegerType(), as_double=True).alias("i2"),
                  format_value(F.col("b"), T.BooleanType()).alias("b"),
                  format_value(F.col("s"), T.StringType()).alias("s"),
                  format_value(F.col("n"), T.DoubleType(), "nan").alias("n")).first()
    assert (r.i, r.i2, r.b, r.s, r.n) == ("3", "3.0", "True", "a b", "nan")
