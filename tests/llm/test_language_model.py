import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sentable.llm import language_model as M
from tests.llm.data import AWKWARD, stored


def test_base_score_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "HOT_BITS", 5)                     # most tokens go the way by join
    rows = AWKWARD + [(100 + i, " ".join(["The", f"w{i % 13}", f"rare{i}", "x y", f"w{i % 5}\t\v"])) for i in range(200)]
    got = sorted(map(tuple, M.score(stored(spark, tmp_path, rows, clash=True)).drop("score").collect()), key=str)
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not out(i) for t in toks(text))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n,
                    sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for i, t in rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(0)
    n = 20
    chain = np.roll(np.arange(n), -1)                         # each class is mostly followed by the next
    ids = [0]
    for _ in range(20_000):
        ids.append(int(chain[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(n)))
    ids = np.array(ids)
    keys, counts = np.unique((ids[:-2] * n + ids[1:-1]) * n + ids[2:], return_counts=True)
    model = M.Model(np.bincount(ids, minlength=n).astype(float))
    for r in range(30):
        model.train(keys, counts, seed=r)
    g1, g2, bias, log_z = model.tables()
    p = np.exp(g1[:, None] + g2[None] + bias - log_z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    a, b, w = ids[:-2], ids[1:-1], ids[2:]
    assert np.log(p[a, b, w]).mean() > np.log(model.noise[w]).mean() + 1


def test_score_is_the_models_probability(spark, tmp_path, monkeypatch):
    """Scores equal the class model's and the counts' product, taken text by text."""
    kept, real = [], M.fit
    monkeypatch.setattr(M, "fit", lambda t, u: kept.append(real(t, u)) or kept[-1])
    rows = AWKWARD + [(100 + i, " ".join([f"w{(i * j) % 400}" for j in range(i % 40)] + ["über", "naïve.", f"rare{i}", "12"])) for i in range(300)]
    got = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in M.score(stored(spark, tmp_path, rows)).collect()))
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    texts = [(i, M.tokens((t or "").encode())) for i, t in rows]
    c = Counter(t for i, ts in texts if not out(i) for t in ts)
    top = sorted((t for t in c if t != M.END and len(t) <= M.HOT_BYTES), key=lambda t: (-c[t], t))[:M.CLASSES - M.ENDINGS - 1]
    own = {t: M.ENDINGS + k for k, t in enumerate([M.END, *top])}
    kind = lambda t: own.get(t, M.ending(t))
    n, v = Counter(), Counter()
    for t, m in c.items():
        n[kind(t)] += m
        v[kind(t)] += 1
    g1, g2, bias, log_z = kept[0].tables()
    want = []
    for i, ts in texts:
        total, a, b = 0.0, own[M.END], own[M.END]
        for t in ts:
            k = kind(t)
            total += float(g1[a, k] + g2[b, k] + bias[k] - log_z[a, b]) / math.log(10)
            if k < M.ENDINGS:
                total += math.log10((c[t] + 1) / (n[k] + v[k] + 1))
            a, b = b, k
        want.append((str(i), len(ts), total))
    want.sort()
    assert len({kind(t) for t in c if t not in own}) > 3
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert not [(g, w) for g, w in zip(got, want) if not math.isclose(g[2], w[2], rel_tol=1e-4)][:5]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_beats_unigrams_on_held_out_text(spark, size):
    rows = M.query(spark, f"/root/testdata/{size}").groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()
    assert len(rows) == 2
    assert all(r["sum(score)"] > 0.99 * r["sum(base_score)"] for r in rows)


def test_scores_do_not_depend_on_tasks(spark, small_dir, tmp_path):
    """The same files cut into other tasks, and dealt over other partitions."""
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{small_dir}/documents.parquet").repartition(7).write.parquet(path)
    scores = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for tasks, parts in ((1, 3), (16, 9)):
        spark.conf.set("spark.sql.files.minPartitionNum", str(tasks))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            scores.append({r.doc_id: r.score for r in M.score(spark.read.parquet(path)).collect()})
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(s, scores[1][i], rel_tol=1e-12) for i, s in scores[0].items())


def test_empty(spark, tmp_path):
    assert M.score(stored(spark, tmp_path, [])).collect() == []
