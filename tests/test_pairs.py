import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sentable.operators import pairs as P
from sentable.operators import quantiles as Q
from sentable.operators import walk as W
from sentable.plans.fixtures import FIXTURES, load


def keyed(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("sid"))


# ------------------------------------------------------------------ quantiles
def numbers(rng, n):
    return [rng.choice([0.0, rng.gauss(0, 1), rng.lognormvariate(3, 2), 7.5]) for _ in range(n)]


def test_edges_within_the_stated_rank_error(spark):
    rng = random.Random(1)
    xs = numbers(rng, 20_000) + [None, float("nan"), float("inf")]
    nodes = Q.sketch(spark.createDataFrame([(x,) for x in xs], "x double"), accuracy=256)
    real = sorted(x for x in xs if x is not None and math.isfinite(x))
    n = len(real)
    rows = nodes.orderBy("lo").collect()
    assert sum(r.n for r in rows) == n
    assert all(r.n <= n // 256 or r.lo == r.hi for r in rows)
    frequent = max(Counter(real).values())
    for e in Q.edge_table(nodes, 20).collect():
        assert e["rank"] == sum(x < e.edge for x in real)
        assert 0 <= e["rank"] - e.b * n / 20 <= max(n / 256, frequent)


def test_an_outlier_moves_no_edge_by_more_than_a_rank_step(spark):
    rng = random.Random(2)
    xs = [rng.gauss(100, 15) for _ in range(20_000)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    real = sorted(xs)
    rank = lambda v: sum(x < v for x in real)
    a, b = (Q.edges(Q.sketch(frame(v), accuracy=200), 20)["x"] for v in (xs, [*xs, 1e12]))
    assert len(a) == len(b) == 19
    assert all(abs(rank(x) - rank(y)) <= len(xs) / 200 for x, y in zip(a, b))


def test_merged_sketches_add_their_errors(spark):
    rng = random.Random(3)
    parts = [[rng.gauss(m, 5) for _ in range(6000)] for m in (0, 30)]
    sketches = [Q.sketch(spark.createDataFrame([(x,) for x in p], "x double"), accuracy=200) for p in parts]
    real = sorted(parts[0] + parts[1])
    for e in Q.edge_table(Q.merge_sketches(*sketches), 10).collect():
        assert abs(sum(x < e.edge for x in real) - e.b * len(real) / 10) <= 2 * len(real) / 200 + 1


def test_draws_inside_bins_follow_the_distribution(spark):
    rng = random.Random(4)
    xs = [rng.lognormvariate(0, 1) for _ in range(5000)]
    df = spark.createDataFrame([(x, int(x * 10)) for x in xs], "x double, k int")
    m = P.fit(df, bins=10)
    got = P.sample(m, keyed(spark, 5000), 5).toPandas()
    assert set(got.x.round(12)) - {round(x, 12) for x in xs}               # values that training does not have
    for share in (0.1, 0.5, 0.9, 0.99):
        assert abs((got.x < sorted(xs)[int(share * 5000)]).mean() - share) < 0.03
    assert (got.k == got.k.astype(int)).all()


# ----------------------------------------------------------------- trees
def dependent(rng, n):
    """Column e depends on b, and d on a; c stands alone."""
    out = []
    for _ in range(n):
        a, b = rng.choice("xyz"), rng.choice("pqrs")
        out.append((a, b, rng.choice("01"), a.upper() if rng.random() < .9 else "?", b + b if rng.random() < .9 else "--"))
    return out


def test_tree_finds_the_parents_and_samples_keep_joint_frequencies(spark):
    rows = dependent(random.Random(6), 6000)
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    m = P.fit(df)
    mi = {(r.a, r.b): r.mi for r in P.mutual_information(m).collect()}
    for x in range(5):
        for y in range(x + 1, 5):
            both, one, two = Counter((r[x], r[y]) for r in rows), Counter(r[x] for r in rows), Counter(r[y] for r in rows)
            want = sum(n / 6000 * math.log(n * 6000 / (one[s] * two[t])) for (s, t), n in both.items())
            assert abs(mi["abcde"[x], "abcde"[y]] - want) < 1e-8
    parents = dict(P.tree(m))
    assert parents["e"] is None and parents["b"] == "e" and (parents["a"] == "d" or parents["d"] == "a")
    got = P.sample(m, keyed(spark, 6000), 7).collect()
    for x, y in (("b", "e"), ("a", "d")):
        real, drawn = (Counter((r["abcde".index(x)], r["abcde".index(y)]) for r in rows), Counter((r[x], r[y]) for r in got))
        for k in real:
            assert abs(real[k] - drawn[k]) < 5 * math.sqrt(real[k] + 25)
        assert not set(drawn) - set(real)


def test_merged_models_are_the_model_of_all_rows(spark, small_dir):
    B = FIXTURES["B"]
    df = load(spark, small_dir, "B", key=False)
    whole = P.fit(df, B.cols)
    parts = [P.fit(df.where(f"o_custkey % 2 = {k}"), B.cols, nodes=whole.nodes, inner=whole.edges) for k in (0, 1)]
    both = P.merge(*parts)
    rows = lambda x: sorted(map(tuple, x.select("a", "b", "sa", "sb", "n").collect()))
    assert rows(both.pairs) == rows(whole.pairs)


# ------------------------------------------------------------------ orders
def test_many_orders_one_plan(spark, small_dir):
    D = FIXTURES["D"]
    m = P.fit(load(spark, small_dir, "D", key=False), D.cols)
    got = P.sample_any_order(m, keyed(spark, 1000), 3).collect()
    assert len({r.order for r in got}) > 100 and all(sorted(r.order.split(",")) == sorted(D.cols) for r in got)
    first = P.sample_any_order(m, keyed(spark, 50), 3, first="l_tax").collect()
    assert {r.order.split(",")[0] for r in first} == {"l_tax"}
    joins = []
    for orders in (F.array(*[F.lit(c) for c in D.cols]), P.row_orders(keyed(spark, 1), D.cols, 3)):
        plan = P.sample_any_order(m, keyed(spark, 100), 3, orders=orders)._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join"))
    assert joins[0] == joins[1]


# ---------------------------------------------------------------- imputation
def brute_scores(rows, row, c):
    """Log-linear scores of each candidate of column c, from the rows themselves."""
    given = [g for g in range(len(row)) if row[g] is not None and g != c]
    n = Counter(r[c] for r in rows)
    kinds = [len({r[g] for r in rows}) for g in range(len(row))]
    near = {r[c] for r in rows if any(r[g] == row[g] for g in given)}
    out = {}
    for v in near or set(n):
        out[v] = math.log(n[v])
        for g in given:
            both = sum(r[c] == v and r[g] == row[g] for r in rows)
            out[v] += math.log((both + P.SMOOTH) / (n[v] + P.SMOOTH * kinds[g]))
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    rows = dependent(rng, 500)
    m = P.fit(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"))
    holes = [(f"k{i}", *[None if rng.random() < .4 else x for x in r]) for i, r in enumerate(dependent(rng, 60))]
    holes += [("none", None, None, None, None, None), ("new", "unseen", None, None, None, None)]
    df = spark.createDataFrame(holes, "row_key string, a string, b string, c string, d string, e string")
    got = defaultdict(dict)
    for r in P.candidates(m, df).collect():
        got[r.row_key, "abcde".index(r.col)][r.value] = r.score
    for key, *row in holes:
        for c in range(5):
            want = brute_scores(rows, row, c) if row[c] is None else {}
            assert got[key, c].keys() == want.keys()
            assert all(abs(got[key, c][v] - s) < 1e-6 for v, s in want.items())


def test_all_given_cells_beat_the_nearest_one(spark):
    """Hidden cells of e depend on a and c together with b, which stand apart from it in the table."""
    from sentable.operators import experts as X
    rng = random.Random(9)
    cols = "a string, b string, c string, d string, e string"

    def row():
        a, b, c = rng.choice("xy"), rng.choice("pq"), rng.choice("01")
        return a, b, c, rng.choice("mno"), "".join((a if rng.random() < .95 else "x", b if rng.random() < .95 else "p", c))
    train = spark.createDataFrame([row() for _ in range(3000)], cols)
    real = [(f"k{i}", *row()) for i in range(500)]
    hidden = spark.createDataFrame([(*r[:5], None) for r in real], "row_key string, " + cols)
    joint = {r.row_key: r.e for r in P.impute(P.fit(train), hidden, 1, temperature=0).collect()}
    near = {r.row_key: r.e for r in X.impute(X.fit(train), hidden, 1, temperature=0).rows.collect()}
    hits = lambda out: sum(out[r[0]] == r[5] for r in real)
    assert hits(joint) > 400 > 2 * hits(near) or hits(joint) > hits(near) + 100


def test_drawn_cells_follow_their_weights(spark):
    rows = [("x", "p")] * 75 + [("x", "q")] * 25 + [("y", "r")] * 50
    m = P.fit(spark.createDataFrame(rows, "a string, b string"))
    df = spark.range(4000).selectExpr("string(id) AS row_key", "'x' AS a", "string(null) AS b")
    got = Counter(r.b for r in P.impute(m, df, 5).collect())
    assert set(got) == {"p", "q"} and abs(got["p"] / 4000 - 0.75) < 0.03
    assert {r.b for r in P.impute(m, df, 5, temperature=0).collect()} == {"p"}


def test_given_cells_stay_and_missing_numbers_are_filled(spark, small_dir):
    C = FIXTURES["C"]
    df = load(spark, small_dir, "C", nulls=True)
    got = {r.row_key: r for r in P.impute(P.fit(df.drop("row_key"), C.cols), df, 2).collect()}
    for r in df.collect():
        for c in C.cols:
            assert got[r.row_key][c] is not None
            if r[c] is not None:
                assert got[r.row_key][c] == r[c]


# ------------------------------------------------------------------- walks
def test_walks_take_counted_steps_and_spell_new_values(spark):
    rng = random.Random(10)
    values = [f"{rng.choice(['-', ''])}{rng.randrange(100, 999)}.{rng.randrange(10)}" for _ in range(300)] + ["7", "1e+16"]
    cells = spark.createDataFrame([("v", "", x) for x in values], "col string, ctx string, value string")
    heads = W.fit_heads(cells, W.DIGITS)
    steps = {(r.pos, r["shape"], r.token, r.next): r.n for r in heads.collect()}
    starts = spark.range(2000).selectExpr("string(id) AS sid", "'v' AS col", "'' AS ctx")
    got = W.walk(heads, starts, 3, free=W.DIGITS).collect()
    assert len(got) == 2000
    new = 0
    import re
    for r in got:
        float(r.value)
        p = ["", *re.findall(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]", r.value), ""]
        for i in range(len(p) - 1):
            shape = "".join(t for t in p[:i + 1] if not re.match(W.DIGITS, t))
            assert steps[i, shape, p[i], p[i + 1]] > 0
        new += r.value not in values
    assert new > 100
    again = Counter(r.value[0] for r in got)
    assert abs(again["-"] / 2000 - sum(v[0] == "-" for v in values) / len(values)) < 0.05
    assert W.walk(heads.limit(0), starts, 3).count() == 0


@pytest.mark.parametrize("cols", [["l_tax"], ["l_returnflag"]])
def test_one_column_and_empty_tables(spark, small_dir, cols):
    df = load(spark, small_dir, "D", key=False).select(*cols)
    m = P.fit(df, cols)
    assert P.tree(m) == [(cols[0], None)] and P.sample(m, keyed(spark, 20), 1).count() == 20
    none = P.fit(df.limit(0), cols)
    assert none.singles.count() == 0 and P.sample(none, keyed(spark, 0), 1).count() == 0


def test_numbers_look_up_the_nodes_of_one_block(spark):
    """A row meets a few nodes of its bin, by a join, and gets the value of the one its rank is in."""
    rng = random.Random(12)
    xs = [rng.choice([rng.uniform(0, 1e6), rng.gauss(5e5, 10), 7.0]) for _ in range(30_000)]
    m = P.fit(spark.createDataFrame([(x,) for x in xs], "n double"), bins=4)
    table = Q.bin_nodes(m.nodes, m.edges)
    listed, nodes = table.count(), m.nodes.count()
    assert nodes > 500 and listed < 2 * nodes + 4
    drawn = spark.range(3000).select(F.col("id").cast("string").alias("sid"), F.element_at(
        F.array(*[F.lit(b) for b in ("0", "1", "2", "3", "-1", "9")]), (F.col("id") % 6 + 1).cast("int")).alias("n"))
    x = P.numbers(m, drawn, 5)
    assert "nodes" not in x._jdf.queryExecution().optimizedPlan().toString()      # no row carries all nodes of its bin
    cells = defaultdict(list)
    for r in m.nodes.collect():
        cells[sum(e <= r.lo for e in m.edges["n"])].append((r.lo, r.hi, r.n))
    u = {r.sid: r.u for r in drawn.select("sid", P.uniform(5, F.lit("inside:n"), F.col("sid")).alias("u")).collect()}
    got = {r.sid: r.n for r in x.collect()}
    assert len(got) == 3000
    for r in drawn.collect():
        want, at = None, sorted(cells.get(int(r.n), []))
        rank = math.floor(u[r.sid] * sum(k for _, _, k in at))
        for lo, hi, k in at:
            if rank < k:
                want = lo + (hi - lo) * (rank / k)
                break
            rank -= k
        assert got[r.sid] == want
