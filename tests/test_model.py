import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sentable.operators import experts as X
from sentable.plans.fixtures import FIXTURES, load

B = FIXTURES["B"]


def _counts(m):
    return sorted(tuple(r) for r in m.counts.collect())


def test_merge_equals_fit_of_union(spark, small_dir):
    df = load(spark, small_dir, "B", key=False)
    edges = X.numeric_edges(df, B.cols)
    a, b = df.filter("o_custkey % 2 = 0"), df.filter("o_custkey % 2 = 1")
    whole = X.fit(df, B.cols, bins=8, edges=edges)
    merged = X.merge(X.fit(a, B.cols, bins=8, edges=edges), X.fit(b, B.cols, bins=8, edges=edges))
    assert _counts(whole) == _counts(merged)


def test_samples_complete_and_in_domain(spark, small_dir):
    df = load(spark, small_dir, "B")
    m = X.fit(df.drop("row_key"), B.cols, bins=8)
    s = X.sample(m, df.select(F.col("row_key").alias("sid")), 42).collect()
    assert len(s) == df.count()
    dom = {c: {r[0] for r in m.counts.filter(F.col("col") == c).select("value").distinct().collect()} for c in B.cols}
    for r in s:
        for c in B.cols:
            assert r[c] is not None and r[c] in dom[c]


def test_greedy_is_deterministic_mode(spark, small_dir):
    df = load(spark, small_dir, "B")
    m = X.fit(df.drop("row_key"), B.cols, bins=8)
    rows = X.sample(m, df.select(F.col("row_key").alias("sid")).limit(20), 1, temperature=0).drop("sid").distinct().collect()
    assert len(rows) == 1
    top = Counter(r.o_custkey for r in df.select(F.col("o_custkey").cast("string")).collect())
    best = max(top.items(), key=lambda kv: (kv[1], [-ord(ch) for ch in kv[0]]))
    assert rows[0].o_custkey == min(k for k, v in top.items() if v == best[1])


def test_level0_loss_brute_force(spark):
    # single column: loss = mean over val of -ln((n(v)+1)/(N+V)), V = distinct + 1
    train = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "x string")
    val = spark.createDataFrame([("r1", "a"), ("r2", "z")], "row_key string, x string")
    m = X.fit(train, ["x"])
    got = {r.column: r.loss for r in X.evaluate(m, val).collect()}
    want = (-math.log(3 / 8) - math.log(1 / 8)) / 2
    assert abs(got["x"] - round(want, 6)) < 1e-9 and abs(got["__mean__"] - round(want, 6)) < 1e-9


def test_impute_fills_only_nulls(spark, small_dir):
    C = FIXTURES["C"]
    df = load(spark, small_dir, "C", nulls=True)
    m = X.fit(load(spark, small_dir, "C", key=False), C.cols, bins=8)
    r = X.impute(m, df, 42)
    out = {x.row_key: x for x in r.rows.collect()}
    assert len(out) + r.dropped == df.count()
    for x in df.collect():
        if x.row_key in out:
            y = out[x.row_key]
            assert all(y[c] is not None for c in C.cols)
            if x.c_mktsegment is not None:
                assert y.c_mktsegment == x.c_mktsegment
            if x.c_acctbal is not None:
                assert y.c_acctbal == x.c_acctbal


def test_prompts_keep_given_values(spark, small_dir):
    C = FIXTURES["C"]
    m = X.fit(load(spark, small_dir, "C", key=False), C.cols, bins=8)
    p = spark.createDataFrame([("s1", "c_mktsegment is BUILDING"), ("s2", "c_nationkey is 999, c_acctbal is None")],
                              "sid string, text string")
    got = {r.sid: r for r in X.sample_from_prompts(m, p, 3).collect()}
    assert got["s1"].c_mktsegment == "BUILDING" and got["s1"].c_nationkey is not None
    assert got["s2"].c_nationkey == "999" and got["s2"].c_acctbal is not None  # unseen context backs off


def test_orders_with_the_same_context_share_a_table(spark):
    """Counts of every order are those of plain counting; draws look at one table of each (column, context)."""
    from collections import Counter
    rows = [("p" if i % 3 else None, "q" * (i % 4), "rs"[i % 2], str(i % 5)) for i in range(60)]
    cols = ["a", "b", "c", "d"]
    m = X.fit(spark.createDataFrame(rows, cols), cols, cond="d", order="random", pairs=[("d", c) for c in cols[:3]])
    want, tables = Counter(), set()
    for oid, o in enumerate(m.orders):
        for j, c in enumerate(o):
            given = [[], o[j - 1:j], [o[0], o[j - 1]]][:min(j, 2) + 1]
            tables |= {(c, tuple(g)) for g in given}
            later = {X.NEXT_LEVEL + d: [g] for d, g in enumerate(o[j + 1:]) if d == 0 or c == "d"}
            for r in rows:
                cell = {k: v if v is not None else X.FILL_TEXT for k, v in zip(cols, r)}
                for level, g in [*enumerate(given), *later.items()]:
                    want[oid, c, level, X.SEP.join(cell[k] for k in g), cell[c]] += 1
    assert {tuple(r)[:5]: r.n for r in m.counts.collect()} == want
    t = X.draw_tables(m, completion=False)
    assert len(t.groups.select("order_id", "col", "level").distinct().collect()) == len(tables)
    keys = spark.range(200).select(F.col("id").cast("string").alias("sid"))
    got = X.sample(m, keys, 3, order_of=F.pmod(F.col("sid").cast("int"), F.lit(4)))
    apart = X.sample(m, keys, 3, order_of=F.pmod(F.col("sid").cast("int"), F.lit(4)), tables=X.draw_tables(m))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect())) and got.count() == 200


def test_rows_of_a_task_are_bounded(spark, tmp_path):
    """A file of one split is cut by its rows, so what a task of the fit holds does not grow with the table."""
    from sentable.sources.io import spread
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cut = spread(df, 2, rows_per_task=100)
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert cut.rdd.getNumPartitions() == 10 and max(sizes) <= 110 and sum(sizes) == 1000
    assert spread(df, 2).rdd.getNumPartitions() == 2


def test_evaluation_reads_only_its_levels_and_totals_once(spark, monkeypatch):
    from sentable.sources import io
    rows = [("pq"[i % 2], "abc"[i % 3], float(i % 4)) for i in range(48)]
    df = spark.createDataFrame(rows, "g string, h string, v double")
    m = X.fit(df, ["g", "h", "v"], bins=2)
    written, plain = {}, io.materialize
    monkeypatch.setattr(io, "materialize", lambda d, what, *a: written.setdefault(what, plain(d, what, *a)))
    got = {r["column"]: r["loss"] for r in X.evaluate(m, df).collect()}
    assert {r.level for r in written["eval-counts"].select("level").distinct().collect()} == {0, 1, 2}
    assert written["eval-totals"].count() == written["eval-counts"].select("col", "level", "ctx").distinct().count()
    assert got["g"] == round(-math.log(25 / 51), 6) and got["h"] == round(-math.log(9 / 28), 6)


def test_tempered_weights_scan_the_rows_once(spark):
    df = spark.createDataFrame([("pq"[i % 2], "abc"[i % 3]) for i in range(48)], "g string, h string")
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(df.rdd.map(lambda r: (seen.add(1), r)[1]), df.schema)
    m = X.fit(rows, ["g", "h"], edges={})
    t = X.draw_tables(m, 0.5)
    assert seen.value == 48 and t.entries.count() >= 5


def test_only_tables_of_drawn_columns_are_counted_and_once(spark, monkeypatch):
    from sentable.sources import io
    df = spark.createDataFrame([("pq"[i % 2], "abc"[i % 3], str(i % 4)) for i in range(48)], "g string, h string, v string")
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(df.rdd.map(lambda r: (seen.add(1), r)[1]), df.schema)
    written, plain = {}, io.materialize
    monkeypatch.setattr(io, "materialize", lambda d, what, *a: written.setdefault(what, plain(d, what, *a)))
    m = X.fit(rows, ["g", "h", "v"], cond="v", order="conditional", edges={})
    keys = spark.range(100).select(F.col("id").cast("string").alias("sid"), F.lit("2").alias("_st"))
    got = X.sample(m, keys, 5, given={"v": F.col("_st")})
    assert seen.value == 48
    kept = written["counts"].select("col", "level").distinct().collect()
    assert {tuple(r) for r in kept} == {("g", 0), ("g", 1), ("h", 0), ("h", 1), ("h", 2)}
    monkeypatch.undo()
    whole = X.sample(m, keys, 5, given={"v": F.col("_st")}, tables=X.draw_tables(m))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 100


def test_exact_copies_needs_no_join(spark):
    from sentable.operators.synth import exact_copies
    real = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "s string, x int")
    rows = spark.createDataFrame([("a", "1")] * 3 + [("b", None)] * 2 + [("b", "1"), (None, "1")], "s string, x string")
    got = exact_copies(rows, real, ["s", "x"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(got.first()) == (7, 5, round(5 / 7, 9))
    assert tuple(exact_copies(rows.limit(0), real, ["s", "x"]).first()) == (0, 0, 0.0)
