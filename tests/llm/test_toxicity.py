import numpy as np
from pyspark.sql import functions as F

from sentable.llm import toxicity as X
from tests.llm.data import AWKWARD, frame, stored


def biased(spark, n=600):
    """Labelled sentences in which toxic ones name a group far more often than others."""
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = [f"w{k}" for k in rng.integers(0, 60, 12)]
        if toxic:
            w.append(["moron", "scum"][i % 2])
        if rng.random() < (0.7 if toxic else 0.05):
            w.append("muslim")
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_swaps_lower_the_weight_of_group_terms(spark):
    docs, labels = biased(spark)
    plain, fair = (X.fit(docs, labels, cf_weight=c) for c in (0.0, 5.0))
    neutral = frame(spark, [(1, "w1 w2 w3 muslim w4"), (2, "w1 w2 w3 w4"), (3, "w1 w2 moron")])
    score = lambda m: {r.doc_id: r.score for r in X.score(neutral, m).collect()}
    a, b = score(plain), score(fair)
    assert b[1] < a[1] and b[1] - b[2] < 0.5 * (a[1] - a[2])
    assert b[3] > 0.7 > b[1]


def test_counterfactuals():
    assert X.swaps({b"a", b"frau"}) == [(["p:frau", "w:frau"], ["p:mann", "w:mann"])]
    assert X.swaps({b"a"}) == []
    for ws in ({b"women", b"womens", b"men", b"girlish", b"boys", b"muslim"}, {b"black", b"blacks", b"frauen", b"gay"}):
        texts = [(ws - {t}) | {u} for ts in X.IDENTITY for t in (x.encode() for x in ts) if t in ws
                 for u in (x.encode() for x in ts) if u not in ws]
        want = [(sorted(X.features(ws) - X.features(c)), sorted(X.features(c) - X.features(ws))) for c in texts]
        assert X.swaps(ws) == want


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = X.query(spark, d).where("held_out").join(spark.read.parquet(d + "/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    # a few toxic words occur in under MIN_DOCS of the 2,600 training texts here (recall is 0.99 with 14,000)
    assert n.get((0, 1), 0) == 0 and n[1, 1] >= 0.7 * (n[1, 1] + n.get((1, 0), 0))


def test_awkward_rows(spark, tmp_path):
    _, labels = biased(spark, 60)
    docs = stored(spark, tmp_path, AWKWARD, clash=True)
    weights = X.fit(docs, labels.union(spark.createDataFrame([(None, 1, 1), (3, 1, None), (4, 0, 0), (4, 0, 1)], labels.schema)),
                    min_docs=1)
    out = X.score(docs, weights).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert X.score(docs, X.fit(docs, labels.limit(0))).select(F.max("predicted")).first()[0] == 0
    none = stored(spark, tmp_path, [], "none")
    assert X.score(none, X.fit(none, labels)).collect() == []
