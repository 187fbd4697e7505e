import math
import random

import duckdb
import numpy as np
import pytest

from sentable.llm import pq_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4):
    """Lloyd's rounds with Python's integers: every part against every entry."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w:(p + 1) * w] for _, v, _ in kept] for p in range(4)]
    books = [parts[p][:entries] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for x in parts[p]:
                members.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e
                        for k, e in enumerate(books[p])]
    out = []
    for j, (i, _, label) in enumerate(kept):
        found = [nearest(parts[p][j], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, error, label in out:
        totals[label] = totals.get(label, 0) + error
    h = pq_codes.digest(np.array(books, object))
    return sorted(((i, c, e, totals[label], h) for i, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def clustered(rng, n, width=8, scale=1.0):
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, scale / 8) for c in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e5])
def test_codes_equal_plain_rounds(spark, scale):
    """Few distinct integers make ties; large ones need exact integers."""
    rows = clustered(random.Random(3), 700, scale=scale)
    rows += [(i + 5000, rows[i][1], 1) for i in range(0, 700, 3)]                 # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(pq_codes.codes(df)) == brute(rows)


def test_balls_compare_less_and_agree(spark):
    rng = np.random.default_rng(1)
    book = rng.integers(-500, 500, (64, 4))
    x = rng.integers(-500, 500, (4000, 4))
    code, dist = pq_codes.nearest(x, book)
    moved = book.copy()
    moved[::5] += rng.integers(-40, 40, moved[::5].shape)
    shift = np.sqrt(((moved - book) ** 2).sum(1).astype(float))
    radius = np.sqrt([dist[code == k].max(initial=0) for k in range(64)])
    balls = pq_codes.Balls(moved, shift > 0, (radius + shift).tolist())
    assert min(map(len, balls.neighbours)) < 63 and not all(len(n) == 63 for n in balls.neighbours)
    again = balls.reassigned(x, code, dist)
    want = pq_codes.nearest(x, moved)
    assert (again[0] == want[0]).all() and (again[1] == want[1]).all()
    # nothing has moved: neither entries nor distances are computed anew
    still = pq_codes.Balls(book, np.zeros(64, bool), radius.tolist())
    assert all(still.still) and (still.reassigned(x, code, dist)[0] == code).all()


def test_awkward_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 2),
            (5, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [0.5, -0.5, 1e-9, -1e-9], None), (7, [0.5, 0.25, 0.0, -3.0], None),
            (7, [0.5, 0.25, 0.0, -3.0], None), (7, [0.1, 0.25, 0.0, -3.0], 9), (-4, [0.5, 0.25, 0.0, -3.0], 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pq_codes.codes(df)) == brute(rows)
    assert pq_codes.codes(df.where("vec_id > 100")).count() == 0
    clash = df.selectExpr("*", "'x' AS v", "'x' AS code", "1 AS dist", "2 AS vid", "3 AS part")
    kept, _ = pq_codes.quantise(clash)
    assert kept.count() == 5 and {"v", "code", "code_", "dist", "dist_", "part"} <= set(kept.columns)
    assert [r.code for r in kept.select("code").distinct().collect()] == ["x"]
    with pytest.raises(ValueError):
        pq_codes.codes(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA))


def test_query_equals_its_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    assert got(pq_codes.query(spark, small_dir)) == sorted(con.execute(pq_codes.SQL).fetchall(), key=str)
