import pytest
from pyspark.sql import functions as F

from sentable.operators import backoff as K
from sentable.operators import experts as X
from sentable.operators.split import split
from sentable.plans.fixtures import FIXTURES, load


@pytest.mark.parametrize("alias", ["B", "D"])
def test_lower_loss_than_the_highest_level_alone(spark, small_dir, alias):
    fx = FIXTURES[alias]
    s = split(load(spark, small_dir, alias), 42, F.col("row_key"))
    m = X.fit(s.where("split = 'train'").select(*fx.cols), fx.cols)
    val = s.where("split = 'val'").select("row_key", *fx.cols)
    old = {r.column: r.loss for r in X.evaluate(m, val).collect()}
    new = {r.column: r.loss for r in K.evaluate(m, val.drop("row_key")).collect()}
    assert new.keys() == old.keys() and new["__mean__"] < old["__mean__"]


def test_probabilities_sum_to_one(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("a", "x", 2.5), ("b", "y", 9.0), ("b", "z", 4.0)]
    m = X.fit(spark.createDataFrame(rows, "p string, q string, r double"), bins=2)
    for given in (("a", "x"), ("b", "z"), ("new", "x"), ("new", "new")):
        values = sorted({str(r[2]) for r in rows}) + ["unseen"]
        cells = spark.createDataFrame([("r", v, "", given[1], given[0] + X.SEP + given[1]) for v in values],
                                      "col string, value string, c0 string, c1 string, c2 string")
        p = {r.value: r.p for r in K.probabilities(m, cells).collect()}
        assert abs(sum(p.values()) - 1) < 1e-12 and min(p.values()) > 0
