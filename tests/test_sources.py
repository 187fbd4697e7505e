import threading

import pytest
from pyspark.sql import functions as F

from sentable.operators import experts as X
from sentable.operators.select import coarser
from sentable.plans.fixtures import FIXTURES, load
from sentable.sources import versions
from sentable.sources.io import read_split, write_snapshot
from sentable.sources.layout import rows_at, write_layout


def rows(spark, lo, hi):
    return spark.range(lo, hi).withColumn("split", F.when(F.col("id") % 4 == 0, "val").otherwise("train"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_see_the_old_or_the_new_table_whole(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        read_split(spark, base, "t")
    write_snapshot(rows(spark, 0, 100), base, "t", "2026 01")
    pinned = read_split(spark, base, "t", split=None)
    # a second writer has written half of its files
    rows(spark, 100, 150).write.partitionBy("split").parquet(f"{base}/t/version=2026.02")
    assert ids(read_split(spark, base, "t", split=None)) == list(range(100))
    rows(spark, 150, 200).write.mode("append").partitionBy("split").parquet(f"{base}/t/version=2026.02")
    versions.publish(spark, f"{base}/t", "2026.02")
    assert ids(read_split(spark, base, "t", split=None)) == list(range(100, 200))
    assert ids(pinned) == list(range(100))
    assert ids(read_split(spark, base, "t", "val", version="2026.01")) == list(range(0, 100, 4))
    assert [tuple(r) for r in versions.history(spark, f"{base}/t").collect()] == [(1, "2026.01"), (2, "2026.02")]
    with pytest.raises(Exception):
        write_snapshot(rows(spark, 0, 1), base, "t", "2026 01")
    assert versions.latest(spark, f"{base}/t") == "2026.02"


def test_writers_that_publish_at_once_get_numbers_of_their_own(spark, tmp_path):
    got = []
    work = [threading.Thread(target=lambda k=k: got.append(versions.publish(spark, str(tmp_path), f"v{k}"))) for k in range(8)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert sorted(got) == list(range(1, 9))
    assert len(versions.history(spark, str(tmp_path)).collect()) == 8


def test_a_fetch_reads_only_the_blocks_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layout(spark.range(10_000).select(F.col("id").alias("idx"), (F.col("id") * 7).alias("v")), path, block_rows=500)
    for wanted in ([3], [0, 499, 9999], [10_000, -1], [5] * 3):
        got = rows_at(spark, path, wanted, block_rows=500)
        assert sorted(map(tuple, got.collect())) == sorted((p, 7 * p) for p in set(wanted) if 0 <= p < 10_000)
        scan = [n for n in _nodes(got) if "FileSourceScan" in n.getClass().getSimpleName()]
        files = scan[0].metrics().apply("numFiles").value()
        assert files <= len({p // 500 for p in wanted}) and files < 20
    many = list(range(0, 10_000, 7))
    assert rows_at(spark, path, many, block_rows=500).count() == len(many)
    keys = spark.createDataFrame([(2,), (2,), (777,), (None,)], "idx long")
    assert sorted(r.v for r in rows_at(spark, path, keys, block_rows=500).collect()) == [14, 777 * 7]


def _nodes(df):
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


@pytest.mark.parametrize("alias", ["B", "A"])
def test_merged_bins_are_the_bins_of_a_fit(spark, small_dir, alias):
    """Coarser tables made from one fit equal those of fits of their own, at every level."""
    fx = FIXTURES[alias]
    df = load(spark, small_dir, alias, key=False)
    edges = X.numeric_edges(df, fx.cols)
    pairs = [(c, g) for k, c in enumerate(fx.cols) for g in fx.cols[k + 1:]]
    fine = X.fit(df, fx.cols, bins=40, edges=edges, pairs=pairs)
    for b in (1, 4, 10):
        want = X.fit(df, fx.cols, bins=b, edges=edges, pairs=pairs)
        rows_of = lambda m: sorted(map(tuple, m.counts.select(*X.GROUP, "value", "n").collect()))
        assert rows_of(coarser(fine, b)) == rows_of(want)
    with pytest.raises(ValueError):
        coarser(fine, 3)


def test_evaluation_batches_keep_the_order_of_fractional_and_negative_keys(spark):
    from sentable.operators.split import epoch_batches
    keys = [1.4, 1.2, -0.5, -1.25, 0.0, 1e-9, 12.0, 100.75, 3.0]
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    got = epoch_batches(df, 1, F.col("k"), 0, 4, shuffle=False).orderBy("idx").collect()
    assert [r.k for r in got] == sorted(keys) and [r.batch_id for r in got] == [0] * 4 + [1] * 4 + [2]
