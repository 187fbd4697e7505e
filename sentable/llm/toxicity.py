"""Toxicity: a counterfactual-regularised linear classifier over words.

Features of a text are its distinct words and their first four and five
characters (inflected forms share these).  The ``FEATURES`` features that
separate the labels best on the training sample are chosen by a distributed
count; a logistic model is then trained on the driver by proximal gradient
descent (L1) on rows of chosen feature numbers, at most ``SAMPLE`` of them.

Every training text that names a group (``IDENTITY``) is paired with copies in
which the term is swapped for others of its set.  Besides the loss of the labels, the
training minimises ``CF_WEIGHT`` times the squared change of the logit between a text
and its copies, so a mention as such moves the score little.

Only the text enters a score.  Labels are learned from documents whose
crc32(doc_id as text) mod 3 is not 1.  Null text counts as empty and scores
like any text without known features.  A document whose labels disagree counts as
toxic; null labels or ids are not learned from.  Without labels of both kinds
the model is the base rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sentable.llm.common import WORD_BYTES, cut, extended, fold, numbered, replacing, scanned, ship, table, tidy, without_rows

SAMPLE = 40_000        # labelled rows to learn from, at most (a uniform sample by a hash of the id)
FEATURES = 2_000      # features the model keeps
MIN_DOCS = 5           # training documents that must hold a feature
FOLDS, HELD_OUT = 3, 1
CF_WEIGHT, L1, STEPS = 1.0, 3e-5, 600
CUT = 0.7
PREFIXES = (4, 5)

# Sets of group terms that may be swapped for each other.
IDENTITY = [
    "woman man girl boy".split(), "women men girls boys".split(),
    "muslim christian jewish hindu buddhist atheist".split(), "muslims christians jews hindus buddhists atheists".split(),
    "black white asian african latino arab".split(), "gay lesbian straight bisexual transgender".split(),
    "immigrant refugee foreigner citizen".split(), "immigrants refugees foreigners citizens".split(),
    "frau mann".split(), "frauen männer".split(), "mujer hombre".split(), "mujeres hombres".split(),
    "femme homme".split(), "femmes hommes".split(),
]


def words(text: str | None) -> set[bytes]:
    """The distinct words, A-Z lower-cased."""
    return set((text or "").encode("utf-8", "replace").translate(WORD_BYTES).split())


def word_features(w: bytes) -> list[str]:
    s = w.decode("utf-8", "replace")
    return ["w:" + s] + ["p:" + s[:n] for n in PREFIXES if len(s) >= n]


def features(ws: set[bytes]) -> set[str]:
    return {f for w in ws for f in word_features(w)}


def swaps(ws: set[bytes]) -> list[tuple[list[str], list[str]]]:
    """The counterfactuals of a text: each of its group terms swapped for every other of its set, as the
    features that the text loses by that and those that it gains."""
    out, count = [], None
    for terms in IDENTITY:
        terms = [t.encode() for t in terms]
        for t in terms:
            if t not in ws:
                continue
            count = count or Counter(f for w in ws for f in word_features(w))
            old = [f for f in word_features(t) if count[f] == 1]          # no other word has them
            for u in terms:
                if u not in ws:
                    new = [f for f in word_features(u) if not count[f]]
                    out.append((sorted(set(old) - set(word_features(u))), sorted(new)))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``sample`` labelled texts outside the held-out fold.  The ids are
    drawn first; being bounded they are broadcast, so no other text moves."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                        & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
           .groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
           .orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(sample))
    ids = cut(ids, "toxicity-sample")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(ids), "_id").select("text", "toxic")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, features, swapped): a text's features and how those of its counterfactuals differ."""
    for b in batches:
        toxic, feats, swapped = [], [], []
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            ws = words(text)
            toxic.append(y)
            feats.append(sorted(features(ws)))
            swapped.append([list(c) for c in swaps(ws)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array(feats, pa.list_(pa.string())),
             pa.array(swapped, pa.list_(pa.list_(pa.list_(pa.string()))))], ["toxic", "features", "swapped"])


def choose(rows: DataFrame, n_features: int, min_docs: int) -> list[str]:
    """The features with the largest chi-square statistic, and every group term."""
    totals = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    pos, n = float(totals["p"] or 0), float(totals["n"])
    if not 0 < pos < n:
        return []
    counts = (rows.select("toxic", F.explode("features").alias("f")).groupBy("f")
              .agg(F.sum("toxic").alias("a"), F.count("*").alias("d")).where(F.col("d") >= min_docs))
    a, d = F.col("a").cast("double"), F.col("d").cast("double")
    gap = a - d * pos / n
    best = counts.orderBy((gap * gap / (d * (n - d + 1))).desc(), "f").limit(n_features).select("f")
    terms = {f for ts in IDENTITY for t in ts for f in word_features(t.encode())}
    return sorted({r["f"] for r in best.collect()} | terms)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES,
        min_docs: int = MIN_DOCS, cf_weight: float = CF_WEIGHT, id_col: str = "doc_id",
        text_col: str = "text") -> dict[str, float]:
    """Weights by feature; the bias is under the empty name.  What reaches the
    driver: ``n_features`` names, and for ``sample`` rows the numbers of their chosen features and of those
    in which their counterfactuals differ."""
    spark = docs.sparkSession
    ship(spark)
    rows = cut(training_rows(docs, labels, sample, id_col, text_col).mapInArrow(
        tidy(_extract), "toxic int, features array<string>, swapped array<array<array<string>>>"), "toxicity-rows")
    names = choose(rows, n_features, min_docs)
    number = {f: i for i, f in enumerate(names)}
    known = spark.sparkContext.broadcast(number)

    def to_numbers(batches):
        num = known.value
        for b in batches:
            ids = [[num[f] for f in fs if f in num] for fs in b.column("features").to_pylist()]
            alt = [[[[num[f] for f in fs if f in num] for fs in c] for c in cs] for cs in b.column("swapped").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(ids, pa.list_(pa.int32())), pa.array(
                alt, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["toxic", "ids", "alt"])

    data = rows.mapInArrow(to_numbers, "toxic int, ids array<int>, alt array<array<array<int>>>").toArrow()
    y = data["toxic"].to_numpy().astype(np.float64)
    ids = data["ids"].to_pylist()
    pairs = [(lost, gained) for cs in data["alt"].to_pylist() for lost, gained in cs]
    return dict(zip(["", *names], train(y, ids, pairs, len(names), cf_weight)))


class Sparse:
    """Rows of feature numbers, each feature 0 or 1."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.col = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], size)


def train(y, rows, pairs, n_features: int, cf_weight: float, l1: float = L1, steps: int = STEPS) -> np.ndarray:
    """Bias and weights minimising log loss + l1 * |w| + cf_weight * mean squared
    logit change of counterfactual pairs: proximal gradient steps, scaled by
    feature (AdaGrad)."""
    n = max(1, len(y))
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    bias, w = float(np.log(rate / (1 - rate))), np.zeros(n_features)
    if not n_features or not 0 < y.sum() < len(y):
        return np.concatenate([[bias], w])
    x = Sparse(rows)
    left, right = Sparse([a for a, _ in pairs]), Sparse([b for _, b in pairs])
    step = 0.5
    seen, bseen = np.full(n_features, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x.dot(w) + bias)))
        g = x.back(p - y, n_features) / n
        if pairs:
            gap = left.dot(w) - right.dot(w)
            g += 2 * cf_weight * (left.back(gap, n_features) - right.back(gap, n_features)) / len(pairs)
        gb = float((p - y).mean())
        seen += g * g
        bseen += gb * gb
        eta = step / np.sqrt(seen)
        w -= eta * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - eta * l1)
        bias -= 0.1 * gb / np.sqrt(bseen)
    return np.concatenate([[bias], w])


def score(docs: DataFrame, weights: dict[str, float], text_col: str = "text", cut_at: float = CUT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (columns of these names are replaced)."""
    ship(docs.sparkSession)
    docs = replacing(docs, "score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast({f: w for f, w in weights.items() if f == "" or w})
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        weight = model.value
        bias = weight[""]
        for b in batches:
            scores = []
            for text in b.column(at).to_pylist():
                found = {f for w in words(text) for f in word_features(w) if f in weight}
                logit = bias + sum(weight[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-min(max(logit, -700.0), 700.0))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(tidy(run), extended(docs, score=DoubleType())).withColumn(
        "predicted", (F.col("score") >= cut_at).cast("int"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; all others stay as they are."""
    weights = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    docs = scanned(docs)
    scored = score(numbered(docs, "text"), weights)
    gone = cut(scored.where("predicted = 1").select("rid"), "toxic")
    return without_rows(docs, gone)
