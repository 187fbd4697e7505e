import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentable.llm import near_dedup as N
from sentable.llm.components import components
from tests.llm.data import AWKWARD, stored


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The class of each row: components of pairs with similarity of 0.8 or more, and of equal texts."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    g = [grams(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or g[i] and g[j] and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i][0])
    return sorted((sorted(x, key=str) for x in out.values()), key=str)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    for wa, wb in ((np.ones(300), (np.arange(300) < 200) * 1.0), (rng.integers(1, 9, 300) * 1.0, rng.integers(1, 9, 300) * 1.0)):
        a, b = (e[wa > 0], wa[wa > 0]), (e[wb > 0], wb[wb > 0])
        s = N.signatures([a, b], k=3000)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.04
    one = N.signatures([(e[:1], np.ones(1)), (e[:1], np.ones(1)), (e[1:2], np.ones(1))])
    assert (one[0] == one[1]).all() and not (one[0] == one[2]).any()


def test_classes_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows = list(AWKWARD)
    for k in range(40):
        base = some(rng.randrange(30, 200))
        for c in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = "new" + str(rng.random())[2:6]
            rows.append((1000 + 10 * k + c, " ".join(t)))
    passage = some(60)                                        # shared, but not enough to be similar
    rows += [(5000 + i, " ".join(some(60) + passage + some(60))) for i in range(40)]
    star = some(120)                                          # close to one text, less so to each other
    rows.append((7000, " ".join(star)))
    for i in range(1, 41):
        t = list(star)
        t[(i * 3) % 120] = f"s{i}"
        t[(i * 7 + 50) % 120] = f"q{i}"
        rows.append((7000 + i, " ".join(t)))
    out = N.NearDuplicates(stored(spark, tmp_path, rows, clash=True)).classes().collect()
    by = defaultdict(list)
    for r in out:
        by[(r.class_id, r.class_size)].append(r)
    got = defaultdict(list)
    for (c, n), members in by.items():
        ids = [m.id for m in members]
        got[c].append(sorted(ids, key=str))
        assert sum(m.kept for m in members) >= 1
    flat = sorted((x for v in got.values() for x in v), key=str)
    want = brute(rows)
    nulls = lambda gs: sorted((g for g in gs if None not in g), key=str)
    assert nulls(flat) == nulls(want)
    assert sum(r.kept for r in out) == len(want)


def test_a_large_group_of_near_copies_is_one_class(spark, tmp_path):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(t)))
    out = N.NearDuplicates(stored(spark, tmp_path, rows)).classes().collect()
    assert {(r.class_id, r.class_size) for r in out} == {(0, 600)}
    assert [r.id for r in out if r.kept] == [0]


def on_one_template(n):
    """Texts of one template, unlike each other, and near copies of each fourth one."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        t = [f"t{k}" for k in range(110)] + [f"o{i}x{k}" for k in range(15 + i % 3)]
        rows.append((10 * i, " ".join(t)))
        if i % 4 == 0:
            for k in rng.sample(range(110, len(t) - 4), 2):
                t[k] = f"c{i}y{k}"
            rows.append((10 * i + 1, " ".join(t)))
    g = {i: grams(t) for i, t in rows}
    similar = lambda a, b: len(g[a] & g[b]) / len(g[a] | g[b])
    assert all(0.8 <= similar(i, i - 1) < 0.95 for i in g if i % 10) and 0.7 < similar(0, 50) < 0.8
    return rows


@pytest.mark.parametrize("n, weighting", [(1200, "set"), (200, "count")])
def test_near_copies_among_many_texts_of_one_template(spark, tmp_path, n, weighting):
    rows = on_one_template(n)
    got = defaultdict(list)
    for r in N.NearDuplicates(stored(spark, tmp_path, rows), weighting=weighting).classes().collect():
        got[r.class_id].append(r.id)
    assert sorted((sorted(x, key=str) for x in got.values()), key=str) == brute(rows)


def test_components_of_chains(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(1000, 1005), (1003, 1005), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges.union(more)).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1005: 1000, 1003: 1000}


def test_empty(spark, tmp_path):
    assert N.NearDuplicates(stored(spark, tmp_path, [])).classes().collect() == []


def test_counts_of_darts_have_their_law_at_any_mean():
    for mean in (0.03, 1.0, 40.0, 700.0, 5_000.0, 200_000.0):
        cdf = N.poisson_cdf(mean)
        p = np.diff(cdf, prepend=0.0)
        n = np.arange(len(p))
        assert abs(cdf[-1] - 1) < 1e-6 and abs((n * p).sum() / mean - 1) < 1e-5
        assert abs((p * (n - mean) ** 2).sum() / mean - 1) < 1e-4
