from pyspark.sql import functions as F

from sentable.operators.encode import decode_labels, fit_labels
from sentable.operators.split import split
from sentable.operators.tokens import pad_batch


def test_encoder_golden(spark):
    df = spark.createDataFrame([("10",), ("2",), ("1",)], "v string")
    enc = fit_labels(df, ["v"])
    assert sorted((r.value, r.id) for r in enc.collect()) == [("1", 0), ("10", 1), ("2", 2)]
    ids = spark.createDataFrame([(i, t) for i, t in enumerate(["0", "1.0", "1.5", "7", "x"])], "k int, v string")
    got = sorted((r.k, r.v) for r in decode_labels(ids, enc, ["v"]).collect())
    assert got == [(0, "1"), (1, "10")]


def test_split_sizes_exact_and_disjoint(spark):
    for n, want in [(768, (576, 57, 135)), (200, (150, 15, 35))]:
        df = spark.range(n).select(F.col("id").cast("string").alias("k"))
        s = split(df, 42, F.col("k"))
        c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
        assert (c["train"], c["val"], c["test"]) == want
        assert s.select("k").distinct().count() == n
        assert sorted(r.idx for r in s.collect()) == list(range(n))


def test_pad_golden(spark):
    df = spark.createDataFrame([(0, [7]), (1, [8, 9, 10])], "k int, ids array<long>").withColumn("batch_id", F.lit(0))
    got = {r.k: r.ids for r in pad_batch(df).collect()}
    assert got == {0: [0, 0, 7], 1: [8, 9, 10]}
