"""Near-dedup by DartMinHash signatures of weighted word shingles.

Each element (a shingle of five words) owns a plane of weight by rank, cut into
regions; hashing alone says how many darts hit a region (Poisson), and each dart's
weight, rank and coordinate.  A dart counts if it lands below the element's
weight.  A signature holds, for each of ``K`` coordinates, the dart of lowest rank; two
texts agree on a coordinate with the probability of their weighted Jaccard similarity.
Rank regions double, and a text throws only until its coordinates are filled, so
the work is about the number of shingles and not ``K`` times it.
Weights are 1 (``weighting="set"``) or the shingle's count (``"count"``).

Signatures are joined in ``BANDS`` bands; at similarity 0.8 a pair meets in none
with a probability of 3e-6.

* Texts with equal words are one representative.
* In each bucket all members are paired with its leader, the member that meets most
  others over all bands.  Pairs are verified on their shingles; components of
  verified pairs are formed.
* Buckets of up to ``SMALL`` members that still hold several components pair their
  members across components.
* The members of larger ones are joined exactly, by prefixes: with elements in a
  fixed order, rare ones first, the first element that two similar texts share comes
  so early in both that enough of them can follow it.  What a template's texts
  all share comes last, so texts on one template meet only if they may be similar.

Words are lower-cased runs of letters and digits; a text of under five has one shingle of all.
Texts without words are only copies of identical texts.  Null counts as empty.
The row with the smallest doc_id of a class stays (ties: the first in the scan).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import WORD_BYTES, cut, numbered, scanned, small_side, table, text_or_empty, tidy, without_rows
from sentable.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
FIRST = 2.0 ** -5        # the lowest rank region is [0, FIRST); each next one doubles the reach
SMALL = 32
RANKED = 200_000         # at most so many common elements are ordered by their counts; the others come first
COUNTED = 2_000_000      # elements counted at once in a task
SLICE = 500
CACHE = 100_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


@lru_cache(maxsize=256)
def poisson_cdf(mean: float) -> np.ndarray:
    """P(count <= n) for n from 0 until it is 1."""
    n = np.arange(int(mean + 10 * mean ** 0.5 + 21))
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(n * np.log(mean) - mean - log_factorial))       # in logarithms: exp(-mean) may be 0


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(words: list[bytes], hashes: Words, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``n`` words, repeats included."""
    a = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    if not len(a):
        return a
    width = min(n, len(a))
    out = np.full(len(a) - width + 1, _U(width))
    for k in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + a[k:len(a) - width + 1 + k])
    return out


def weighted(sh: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    e, n = np.unique(sh, return_counts=True)
    return e, (n if weighting == "count" else np.ones(len(e))).astype(np.float64)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """Signatures (a row of ``k`` dart numbers each) of non-empty (elements, weights)."""
    count = len(docs)
    sig = np.zeros((count, k), np.uint64)
    filled = np.zeros((count, k), bool)
    element = np.concatenate([e for e, _ in docs])
    weight = np.concatenate([w for _, w in docs])
    doc = np.repeat(np.arange(count), [len(e) for e, _ in docs])
    total = np.bincount(doc, weight, count)
    enough = k * np.log(k) + 2 * k              # darts that fill all coordinates, mostly
    low, high, region = 0.0, FIRST, 0
    active = np.ones(len(element), bool)
    while active.any():
        e, w, d = element[active], weight[active], doc[active]
        darts = [_throw(e, w, d, w_low, w_high, low, high, region, v)
                 for v, (w_low, w_high) in enumerate(_weight_regions(w.max()))]
        rank, number, at = (np.concatenate(x) for x in zip(*darts))
        coordinate = (mix(number ^ _U(0xD6E8FEB86659FD93)) % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")            # the last written, of lowest rank, stays
        at, coordinate, number = at[order], coordinate[order], number[order]
        new = ~filled[at, coordinate]
        sig[at[new], coordinate[new]] = number[new]
        filled[at[new], coordinate[new]] = True
        done = (total * high >= enough) & filled.all(axis=1)
        active = ~done[doc]
        low, high, region = high, 2 * high, region + 1
    return sig


def _weight_regions(most: float) -> list[tuple[float, float]]:
    """[0, 1), [1, 2), [2, 4), ... up to the largest weight."""
    out = [(0.0, 1.0)]
    while out[-1][1] < most:
        out.append((out[-1][1], 2 * out[-1][1]))
    return out


def _throw(e, w, d, w_low, w_high, low, high, region, v):
    """(rank, number, text) of the darts of one region that land below their element's weight."""
    reach = w > w_low
    e, w, d = e[reach], w[reach], d[reach]
    seed = mix(e ^ mix(np.array([1 + region * 64 + v], np.uint64)))
    n = np.searchsorted(poisson_cdf((w_high - w_low) * (high - low)), unit(seed), side="right")
    some = np.flatnonzero(n)
    each = np.repeat(some, n[some])
    k = np.arange(len(each)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
    number = mix(seed[each] + _U(0x9E3779B97F4A7C15) * (k + 1).astype(np.uint64))
    height = w_low + (w_high - w_low) * unit(mix(number ^ _U(0xA0761D6478BD642F)))
    inside = height < w[each]
    each, number = each[inside], number[inside]
    rank = low + (high - low) * unit(mix(number ^ _U(0xE7037ED1A0B428DB)))
    return rank, number, d[each]


def bands(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(a[0]) and len(b[0]) else 0.0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketch(weighting: str):
    def run(batches):
        hashes = Words()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                copies, size, elements = [], [], []
                for text in b.column("text").to_pylist():
                    words = text.translate(WORD_BYTES).split()
                    h = xxhash.xxh3_128_intdigest(b" ".join(words) if words else text, seed=0 if words else 1)
                    copies.append((_signed(h >> 64), _signed(h & (1 << 64) - 1)))
                    elements.append(weighted(shingles(words, hashes), weighting))
                    size.append(float(elements[-1][1].sum()))
                full = [k for k, x in enumerate(size) if x]
                found = dict(zip(full, bands(signatures([elements[k] for k in full])).tolist())) if full else {}
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid"), b.column("id"), pa.array([c[0] for c in copies], pa.int64()),
                     pa.array([c[1] for c in copies], pa.int64()), pa.array(size, pa.float64()),
                     pa.array([found.get(k, []) for k in range(b.num_rows)], pa.list_(pa.int64()))],
                    ["rid", "id", "c1", "c2", "size", "bands"])
    return run


def _compare(weighting: str, threshold: float):
    def run(batches):
        hashes = Words()
        last: tuple = (None, None)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                ok = []
                for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                    if last[0] != x:
                        last = (x, weighted(shingles(x.translate(WORD_BYTES).split(), hashes), weighting))
                    other = weighted(shingles(y.translate(WORD_BYTES).split(), hashes), weighting)
                    ok.append(similarity(last[1], other) >= threshold - 1e-12)
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def units(text: bytes, hashes: Words, weighting: str) -> np.ndarray:
    """The elements of a text, one of weight n as n different ones: sets of the same similarity."""
    e, n = weighted(shingles(text.translate(WORD_BYTES).split(), hashes), weighting)
    n = n.astype(np.int64)
    again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    e = np.repeat(e, n)
    return np.where(again == 0, e, mix(e * _U(0x9E3779B97F4A7C15) + again.astype(np.uint64)))


def _common(weighting: str):
    """(unit, n) of units that are met more than once in a task; the order of the others does not matter."""
    def run(batches):
        hashes = Words()
        found: list = []
        many = 0

        def counted():
            e, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(e[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["unit", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                found.append(units(text, hashes, weighting))
                many += len(found[-1])
                if many > COUNTED:
                    yield counted()
                    found, many = [], 0
        if found:
            yield counted()
    return run


def _prefixes(weighting: str, threshold: float, common: np.ndarray, counts: np.ndarray):
    """(unit, rid, root, size, left): the units of which one must be shared with any
    similar text, and how many units, with this one, are left from there on."""
    def run(batches):
        hashes = Words()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                first, left, size = [], [], []
                for text in b.column("text").to_pylist():
                    e = units(text, hashes, weighting)
                    n = np.zeros(len(e), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, e), len(common) - 1)
                        n = np.where(common[at] == e, counts[at], 0)
                    keep = len(e) - int(np.ceil(threshold * len(e) - 1e-6)) + 1
                    first.append(e[np.lexsort((e, n))[:keep]])
                    left.append(len(e) - np.arange(len(first[-1])))
                    size.append(len(e))
                each = [len(x) for x in first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(b.column("rid").to_numpy(), each)),
                     pa.array(np.repeat(b.column("root").to_numpy(), each)), pa.array(np.repeat(size, each).astype(np.int64)),
                     pa.array(np.concatenate(left).astype(np.int64))], ["unit", "rid", "root", "size", "left"])
    return run


class NearDuplicates:
    """Classes of near duplicates of ``docs`` (id, text)."""

    def __init__(self, docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "set",
                 id_col: str = "doc_id", text_col: str = "text"):
        self.threshold, self.weighting, self.id_col = threshold, weighting, id_col
        docs = scanned(docs)
        self.texts = numbered(docs, id_col, text_col).select(
            "rid", F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
        kind = docs.schema[id_col].dataType.simpleString()
        self.rows = cut(self.texts.mapInArrow(
            tidy(_sketch(weighting)), f"rid long, id {kind}, c1 long, c2 long, size double, bands array<long>"), "sketches")
        reps = (self.rows.groupBy("c1", "c2").agg(
            F.min(F.struct("id", "rid")).alias("r"), F.count("*").alias("copies"),
            F.first("size").alias("size"), F.first("bands").alias("bands")))
        self.reps = cut(reps.select(F.col("r.rid").alias("rid"), F.col("r.id").alias("id"), "c1", "c2", "copies",
                                    "size", "bands"), "representatives")

    def verified(self, pairs: DataFrame, what: str) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        pairs = cut(pairs.select("a", "b"), what)
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), what + "-ids")
        t = cut(self.texts.select("rid", "text").join(small_side(wanted), "rid", "left_semi"), what + "-texts")
        both = (pairs.join(t.toDF("a", "text_a"), "a").join(t.toDF("b", "text_b"), "b")
                .select("a", "b", "text_a", "text_b"))
        return cut(both.mapInArrow(tidy(_compare(self.weighting, self.threshold)), "a long, b long"), what + "-similar")

    def fits(self, a: str, b: str):
        """Sizes alone do not rule the pair out."""
        return F.least(a, b) >= self.threshold * F.greatest(a, b) - 1e-9

    def roots(self) -> DataFrame:
        """(rid, root) of the representatives that some other one is similar to: the
        components of all similar pairs that meet in a band."""
        every = self.reps.select("rid", "size", F.posexplode("bands").alias("band", "h"))
        shared = every.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
        members = cut(every.join(small_side(cut(shared, "buckets")), ["band", "h"]), "members")
        degree = members.groupBy("rid").agg(F.sum("n").alias("degree"))
        leader = (members.join(degree, "rid").groupBy("band", "h")
                  .agg(F.max(F.struct("degree", (-F.col("rid")).alias("back"), "size")).alias("l"))
                  .select("band", "h", (-F.col("l.back")).alias("a"), F.col("l.size").alias("size_a")))
        stars = (members.join(leader, ["band", "h"]).where((F.col("a") != F.col("rid")) & self.fits("size_a", "size"))
                 .select("a", F.col("rid").alias("b")).distinct())
        roots = components(self.verified(stars, "stars")).withColumnRenamed("node", "rid")
        rest = self._across(members, roots)
        if rest is None:
            return roots
        # what the remaining pairs join, between the components found so far
        more = self.verified(rest, "rest").join(roots.toDF("a", "root_a"), "a", "left").join(
            roots.toDF("b", "root_b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(more)
        both = roots.join(joined.toDF("root", "to"), "root", "left").select("rid", F.coalesce("to", "root").alias("root"))
        new = joined.join(roots, F.col("node") == F.col("rid"), "left_anti").select(F.col("node").alias("rid"), "root")
        return both.union(new)

    def _across(self, members: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Pairs of different components that meet in a bucket; None if there is none such bucket.

        A pair is emitted by the first bucket that it meets in: that one holds two
        components as well, so it is either small or joined by prefixes."""
        m = members.join(small_side(roots), "rid", "left").select(
            "rid", "size", F.coalesce("root", "rid").alias("root"), "band", F.xxhash64("band", "h").alias("key"))
        buckets = cut(m.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
                      .where("lo < hi").select("key", "n"), "mixed")
        if buckets.isEmpty():
            return None
        m = cut(m.join(small_side(buckets), "key"), "mixed-members")
        small = m.where(F.col("n") <= SMALL).join(self.reps.select("rid", "bands"), "rid").select(
            "key", "band", "rid", "root", "size", "bands")
        agree = F.size(F.filter(F.zip_with(F.slice("bands_a", F.lit(1), F.col("band") + 1), F.slice("bands_b", F.lit(1), F.col("band") + 1),
                                           lambda x, y: x == y), lambda same: same))
        pairs = small.toDF("key", "band", "a", "root_a", "size_a", "bands_a").join(
            small.drop("band").toDF("key", "b", "root_b", "size_b", "bands_b"), "key").where(
            (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & self.fits("size_a", "size_b")
            & (agree == 1)).select("a", "b")
        hot = cut(m.where(F.col("n") > SMALL).select("rid", "root").distinct(), "hot")
        return pairs.distinct() if hot.isEmpty() else pairs.union(self._by_prefix(hot)).distinct()

    def _by_prefix(self, hot: DataFrame) -> DataFrame:
        """Pairs of different components of ``hot`` (rid, root), with all similar ones among them.

        Components are met before their members are, so a large one is not compared with itself."""
        texts = cut(self.texts.select("rid", "text").join(small_side(hot), "rid"), "hot-texts")
        counts = cut(texts.select("text").mapInArrow(tidy(_common(self.weighting)), "unit long, n long")
                     .groupBy("unit").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n"))), "unit-counts")
        least, many = 64, 0
        for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
            many += r["count"]
            if many > RANKED:
                break
            least = r.level
        ranked = counts.where(F.col("level") >= least).select("unit", "n").toArrow()
        unit, n = ranked["unit"].to_numpy().view(np.uint64), ranked["n"].to_numpy()
        order = np.argsort(unit)
        p = cut(texts.mapInArrow(tidy(_prefixes(self.weighting, self.threshold, unit[order], n[order])),
                                 "unit long, rid long, root long, size long, left long"), "prefixes")
        share = self.threshold / (1 + self.threshold)      # of both sizes, that similar texts have in common
        first = F.col("left") >= 2 * share * F.col("size") - 1e-6      # may be shared with a text that is not smaller
        shared = p.groupBy("unit").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(first).alias("any")).where("lo < hi AND any")
        p = cut(p.join(small_side(cut(shared.select("unit"), "shared-units")), "unit"), "shared-prefixes")
        enough = F.least("left_a", "left_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-6
        group = lambda x: x.groupBy("unit", "root").agg(F.min("size").alias("size"), F.max("left").alias("left"))
        met = cut(group(p.where(first)).toDF("unit", "root_a", "size_a", "left_a").join(
            group(p).toDF("unit", "root_b", "size_b", "left_b"), "unit").where((F.col("root_a") != F.col("root_b")) & enough)
            .select("unit", "root_a", "root_b"), "met")
        p = p.select("unit", "root", "rid", "size", "left")
        return (met.join(p.where(first).toDF("unit", "root_a", "a", "size_a", "left_a"), ["unit", "root_a"])
                .join(p.toDF("unit", "root_b", "b", "size_b", "left_b"), ["unit", "root_b"])
                .where((F.col("size_a") <= F.col("size_b")) & enough)
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def classes(self) -> DataFrame:
        """(rid, id, class_id, class_size, kept) of each row."""
        roots = self.roots()
        reps = cut(self.reps.select("rid", "id", "c1", "c2", "copies").join(roots, "rid", "left")
                   .withColumn("root", F.coalesce("root", "rid")), "class-members")
        heads = reps.groupBy("root").agg(F.min(F.struct("id", "rid")).alias("head"), F.sum("copies").alias("class_size"))
        reps = cut(reps.join(heads, "root").select("c1", "c2", "head", "class_size"), "classes")
        return (self.rows.select("rid", "id", "c1", "c2").join(small_side(reps), ["c1", "c2"])
                .select("rid", "id", F.col("head.id").alias("class_id"), "class_size",
                        (F.col("head.rid") == F.col("rid")).alias("kept")))


def query(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "documents")).classes().select(
        F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest doc_id stays."""
    docs = scanned(docs)
    gone = NearDuplicates(docs).classes().where("NOT kept").select("rid")
    return without_rows(docs, cut(gone, "near-duplicates"))
