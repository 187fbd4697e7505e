import hashlib

from pyspark.sql import functions as F

from sentable.functions.hashing import hash_hex
from sentable.operators.index import with_exact_index


def _brute(keys, seed, tag):
    return {i: k for i, k in enumerate(sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{tag}:{k}".encode()).hexdigest(), k)))}


def test_index_matches_sort(spark):
    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.idx: r.k for r in with_exact_index(df, hash_hex(3, "t", F.col("k")), digits=2).collect()}
    assert got == _brute(keys, 3, "t")


def test_hot_copies_are_chunked_and_exact(spark):
    # 40 copies of one row (more than the chunk size) plus unique rows
    rows = [("hot",)] * 40 + [(f"u{i}",) for i in range(30)]
    df = spark.createDataFrame(rows, "k string")
    out = with_exact_index(df, hash_hex(1, "t", F.col("k")), chunk=7).collect()
    assert sorted(r.idx for r in out) == list(range(70))
    assert sum(1 for r in out if r.k == "hot") == 40


def test_independent_of_partitioning(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    a = {(r.k, r.idx) for r in with_exact_index(df.repartition(7), hash_hex(9, "t", F.col("k"))).collect()}
    b = {(r.k, r.idx) for r in with_exact_index(df.coalesce(1), hash_hex(9, "t", F.col("k"))).collect()}
    assert a == b


def test_rank_within_shared_prefix_many_buckets(spark):
    from sentable.operators.index import rank_within
    rows = [("a", f"Customer#{i:06d}") for i in range(3000)] + [("b", f"x{i}") for i in range(500)] + [("c", "only")]
    df = spark.createDataFrame(rows, "g string, k string")
    got = {(r.g, r.k): r.rank for r in rank_within(df, ["g"], "k", sample=200, buckets=16).collect()}
    want = {}
    for g in ("a", "b", "c"):
        for i, k in enumerate(sorted(k for gg, k in rows if gg == g)):
            want[(g, k)] = i
    assert got == want


def test_rows_are_expanded_apart_only_where_a_bucket_is_large(spark):
    df = spark.createDataFrame([("hot",)] * 40 + [(f"u{i}",) for i in range(30)], "k string")
    plain, hot = (with_exact_index(df, hash_hex(1, "t", F.col("k")), chunk=c, with_count="n") for c in (40, 39))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(plain) and "Union" in plan(hot)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.collect()))
    assert {r.n for r in plain.collect()} == {70}
    assert with_exact_index(df.limit(0), hash_hex(1, "t", F.col("k")), with_count="n").collect() == []


def test_a_value_list_is_indexed_once(spark):
    from sentable.operators.starts import continuous_list, start_continuous
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(spark.sparkContext.parallelize(range(50)).map(lambda i: (seen.add(1), (str(i), i / 4))[1]),
                               "k string, x double")
    keys = spark.range(20).select(F.col("id").cast("string").alias("sid"))
    got = start_continuous(keys, continuous_list(df, "x", 42, "k"), "x", 42).collect()
    assert seen.value == 2 * 50 and len(got) == 20      # the sizes of buckets, then the rows
