"""Scores of texts by a log-bilinear model trained with noise-contrastive estimation.

Tokens: the runs of characters other than white space, A-Z lower-cased, then one end token.
Training documents are those whose crc32(doc_id as text) mod 7 is not 2.

1. Tokens are counted over the whole corpus: combined in each task, summed by key.
2. Every token has one of ``CLASSES`` classes: the end and the most frequent training words have one
   each, any other word shares one of ``ENDINGS`` classes with words of like ending and length, which tell
   languages, inflections, numbers and names apart.  Class trigrams are counted over all training documents.
3. The model predicts a class from the two before: context vectors r pass through matrices
   C1 and C2, the sum meets target vectors t: s(w) = (r_a C1 + r_b C2) t_w + bias_w.  Each of ``SHARDS``
   shards of the trigram counts, named by a hash of the trigram and put in order, trains it in numpy with
   noise from the unigram counts; after a round the driver averages the shards' parameters and step
   sizes.  So the model does not depend on tasks, cores or runs.
4. Batched matrix products give log sum exp s over all classes for every context, so
   that log P(class | a, b) is normalised.  A word of a shared class k has in addition the probability
   (c + 1) / (N_k + V_k + 1) among the N_k training tokens and V_k kinds of its class.

Each text needs the counts of its tokens.  Tokens with at least 1 of 2**``HOT_BITS`` of all
occurrences (so there are at most 2**HOT_BITS, each of at most ``HOT_BYTES`` bytes) are broadcast.
The others are joined by token; none of these is a hot key.

Null text counts as empty and has the end token only.  A null id counts as the empty text
in the fold.  An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import cut, fold, numbered, table, text_or_empty, tidy

FOLDS, HELD_OUT = 7, 2
END = b"\n"
CLASSES, ENDINGS, DIM = 384, 192, 16
ROUNDS, SHARDS, BATCH, NOISE, RATE = 3, 32, 1024, 48, 0.3
HOT_BITS, HOT_BYTES = 20, 64
FLUSH = 200_000
REMEMBERED = 200_000      # words whose shared class a worker remembers
SLICE = 1_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _batches(batches):
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def _count(batches):
    """(token, c, c_all): occurrences in training documents and in all, combined as far as a task remembers."""
    train, held = Counter(), Counter()

    def flush():
        keys = list(train.keys() | held.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([train[k] for k in keys], pa.int64()),
             pa.array([train[k] + held[k] for k in keys], pa.int64())], ["token", "c", "c_all"])
        train.clear()
        held.clear()
        return out

    for b in _batches(batches):
        for text, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist()):
            (held if out else train).update(tokens(text))
        if len(train) + len(held) > FLUSH:
            yield flush()
    yield flush()


class Classes(dict):
    """The class of each token: the first ENDINGS are shared, the others are single tokens'."""

    def __missing__(self, t: bytes) -> int:
        k = ending(t)
        if len(self) < REMEMBERED and len(t) <= HOT_BYTES:
            self[t] = k
        return k


class Packed(dict):
    """Count and class of each broadcast token as one number; -1 - class of any other."""

    def __missing__(self, t: bytes) -> int:
        k = -1 - ending(t)
        if len(t) <= HOT_BYTES and len(self) < 2 * REMEMBERED:
            self[t] = k
        return k


def ending(t: bytes) -> int:
    """The class that a word shares: by its last two letters, whether it has signs or digits, and its length."""
    word = t.strip(b".,;:!?\"'()[]")
    signs = len(word) != len(t)
    kind = b"#" if word[-1:].isdigit() else word[-2:]
    return zlib.crc32(kind + (b"1" if signs else b"0") + (b"s" if len(word) < 5 else b"l")) % ENDINGS


def _class_ids(toks: list[bytes], classes: Classes) -> np.ndarray:
    return np.array([classes[t] for t in toks], np.int64)


def _contexts(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token; before a text's start stands the end token."""
    one = np.concatenate([[end], ids[:-1]])
    two = np.concatenate([[end, end], ids[:-2]])[:len(ids)]
    one[starts] = end
    two[starts] = end
    two[(starts + 1)[starts + 1 < len(ids)]] = end
    return two, one


def _flat(texts: list[list[bytes]], classes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of all tokens in a row, and where each text starts."""
    sizes = np.array([len(t) for t in texts])
    return _class_ids([t for ts in texts for t in ts], classes), np.cumsum(sizes) - sizes


def _trigrams(classes_b):
    def run(batches):
        classes, n = classes_b.value, CLASSES
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in _batches(batches):
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            if not texts:
                continue
            ids, starts = _flat(texts, classes)
            a, c = _contexts(ids, starts, classes[END])
            new, m = np.unique((a * n + c) * n + ids, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, m]), len(keys)).astype(np.int64)
            if len(keys) > 10 * FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
    return run


def _class_sizes(classes_b):
    """(class, tokens, kinds), combined by batch."""
    def run(batches):
        for b in batches:
            k = _class_ids(b.column("token").to_pylist(), classes_b.value)
            used, at = np.unique(k, return_inverse=True)
            n = np.bincount(at, b.column("c").to_numpy(), len(used)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n), pa.array(np.bincount(at, minlength=len(used)))], ["k", "n", "v"])
    return run


class Model:
    """Parameters of the log-bilinear model."""

    NAMES = ("r", "c1", "c2", "t", "bias")

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 1):
        rng, n = np.random.default_rng(seed), len(unigram)
        self.noise = unigram / unigram.sum()
        self.r = rng.normal(0, 0.1, (n, dim))
        self.t = rng.normal(0, 0.1, (n, dim))
        self.c1, self.c2 = np.eye(dim) * 0.5, np.eye(dim)
        self.bias = np.log(self.noise)
        self.seen = [np.full(p.shape, 1e-6) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def train(self, keys: np.ndarray, counts: np.ndarray, seed: int, noise: int = NOISE, rate: float = RATE) -> None:
        """One pass over weighted trigrams.  Each batch shares ``noise`` draws from the unigram
        distribution; a trigram is told from noise with log odds s(w) - log(noise * q(w)).
        Weights are counts over the mean batch's, so that a frequent trigram moves more."""
        n, rng = len(self.noise), np.random.default_rng(seed)
        order = rng.permutation(len(keys))
        scale = float(counts.sum()) / max(1.0, len(keys) / BATCH)
        log_q = np.log(noise * self.noise)
        cdf = np.cumsum(self.noise)
        for k in range(0, len(keys), BATCH):
            key, weight = keys[order[k:k + BATCH]], counts[order[k:k + BATCH]] / scale
            a, b, w = key // (n * n), key // n % n, key % n
            z = np.minimum(np.searchsorted(cdf, rng.random(noise)), n - 1)
            h = self.r[a] @ self.c1 + self.r[b] @ self.c2
            s_w = np.einsum("ij,ij->i", h, self.t[w]) + self.bias[w] - log_q[w]
            s_z = h @ self.t[z].T + self.bias[z] - log_q[z]
            g_w = -weight / (1 + np.exp(np.clip(s_w, -30, 30)))             # d loss / d s
            g_z = weight[:, None] / (1 + np.exp(np.clip(-s_z, -30, 30)))
            g_h = g_w[:, None] * self.t[w] + g_z @ self.t[z]
            grads = [np.zeros_like(p) for p in self.parameters()]
            np.add.at(grads[0], a, g_h @ self.c1.T)
            np.add.at(grads[0], b, g_h @ self.c2.T)
            grads[1], grads[2] = self.r[a].T @ g_h, self.r[b].T @ g_h
            np.add.at(grads[3], w, g_w[:, None] * h)
            np.add.at(grads[3], z, g_z.T @ h)
            np.add.at(grads[4], w, g_w)
            np.add.at(grads[4], z, g_z.sum(axis=0))
            for p, g, s in zip(self.parameters(), grads, self.seen):
                s += g * g
                p -= rate * g / np.sqrt(s)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(g1, g2, bias, log_z) with log P(w | a, b) = g1[a, w] + g2[b, w] + bias[w] - log_z[a, b]."""
        g1, g2 = self.r @ self.c1 @ self.t.T, self.r @ self.c2 @ self.t.T
        log_z = np.empty((len(self.bias),) * 2)
        e1, e2 = np.exp(g1), np.exp(g2 + self.bias)          # sum over w of e1[a, w] * e2[b, w]
        for k in range(0, len(log_z), 128):
            log_z[k:k + 128] = np.log(e1[k:k + 128] @ e2.T)
        return tuple(x.astype(np.float32) for x in (g1, g2, self.bias, log_z))


def fit(trigrams: DataFrame, unigram: np.ndarray) -> Model:
    """Rounds of training on shards of the trigram table (at most CLASSES**3 rows), each from
    the average of the round before, weighted by the shards' tokens."""
    sc = trigrams.sparkSession.sparkContext
    model = Model(unigram)
    shards = cut(trigrams.select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("shard"), "key", "n"), "lm-shards")
    for number in range(ROUNDS):
        start = sc.broadcast(model)

        def run(rows: pa.Table) -> pa.Table:
            keys, counts = rows["key"].to_numpy(), rows["n"].to_numpy()
            order = np.argsort(keys)                     # rows come as tasks ended; the shard is always the same
            own, shard = start.value, int(rows["shard"][0].as_py())  # noqa: B023
            own = copy.deepcopy(own)                     # a worker may train several shards
            own.train(keys[order], counts[order], seed=number * SHARDS + shard)  # noqa: B023
            blob = np.concatenate([p.ravel() for p in [*own.parameters(), *own.seen]]).astype(np.float32).tobytes()
            return pa.table({"shard": [shard], "n": [int(counts.sum())], "blob": pa.array([blob], pa.binary())})

        trained = sorted(shards.groupBy("shard").applyInArrow(run, "shard long, n long, blob binary").collect())
        if not trained:
            break
        weights = np.array([r["n"] for r in trained], np.float64)
        mean = np.average([np.frombuffer(r["blob"], np.float32) for r in trained], axis=0, weights=weights)
        for p in [*model.parameters(), *model.seen]:
            p[...] = mean[:p.size].reshape(p.shape)
            mean = mean[p.size:]
    return model


def _score(hot_b, tables_b, end: int, within_b):
    """A row a text with what the broadcast counts and the model give, and a row for each other token of it."""
    names = ["rid", "token", "n", "id", "held_out", "n_tokens", "n_known", "base", "model"]

    def run(batches):
        hot = hot_b.value
        g1, g2, bias, log_z = tables_b.value
        within = within_b.value          # by class: log10(N + V + 1) of the shared ones
        for b in _batches(batches):
            rids = b.column("rid").to_pylist()
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            if not texts:
                continue
            sizes = np.array([len(t) for t in texts])
            flat = [t for ts in texts for t in ts]
            known, starts = np.array([hot[t] for t in flat], np.int64), np.cumsum(sizes) - sizes
            rare = known < 0
            ids, count = np.where(rare, -1 - known, known % CLASSES), np.where(rare, -1, known // CLASSES)
            two, one = _contexts(ids, starts, end)
            lp = (g1[two, ids] + g2[one, ids] + bias[ids] - log_z[two, one]).astype(np.float64) / np.log(10)
            model = np.add.reduceat(lp, starts)
            log_c = np.log10(np.maximum(count, 0) + 1)
            base = np.add.reduceat(log_c, starts)
            other = ids < ENDINGS
            model += np.add.reduceat(np.where(other, log_c, 0.0) - within[ids], starts)
            n_known = np.add.reduceat((count > 0).astype(np.int64), starts)
            of_text = np.repeat(np.arange(len(texts)), sizes)
            rows = Counter((of_text[i], flat[i]) for i in np.flatnonzero(rare).tolist())
            rid2, token, n = [rids[k] for k, _ in rows], [t for _, t in rows], list(rows.values())
            docs = len(texts)
            none = [None] * len(rows)
            # a text's own row has a token with a space, which no token has, so it joins nothing
            yield pa.RecordBatch.from_arrays([
                pa.array([*rids, *rid2], pa.int64()), pa.array([*(b" %d" % r for r in rids), *token], pa.binary()),
                pa.array([*[0] * docs, *n], pa.int64()),
                pa.concat_arrays([b.column("id"), pa.nulls(len(rows), b.column("id").type)]),
                pa.array([*b.column("held_out").to_pylist(), *none], pa.bool_()),
                *[pa.array([*x.tolist(), *none], kind) for x, kind in (
                    (np.array([len(t) for t in texts]), pa.int64()), (n_known, pa.int64()),
                    (base, pa.float64()), (model, pa.float64()))]], names)
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    texts = numbered(docs, id_col, text_col).select(
        "rid", F.col(f"`{id_col}`").alias("id"), (fold(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"),
        text_or_empty(text_col).cast("binary").alias("text"))
    counts = cut(texts.select("held_out", "text").mapInArrow(_count, "token binary, c long, c_all long")
                 .groupBy("token").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("c_all").alias("n_all")).first()
    n, v, n_all = total["n"] or 0, total["v"], total["n_all"] or 0
    is_hot = (F.col("c_all") >= max(1.0, n_all / 2 ** HOT_BITS)) & (F.octet_length("token") <= HOT_BYTES)
    hot = counts.where(is_hot).select("token", "c").toArrow().to_pydict()
    hot = dict(zip(hot["token"], hot["c"]))
    top = sorted((t for t in hot if hot[t] > 0 and t != END), key=lambda t: (-hot[t], t))[:CLASSES - ENDINGS - 1]
    classes = Classes({t: ENDINGS + k for k, t in enumerate([END, *top])})
    # tokens and kinds of each class, counted where the tokens are: at most CLASSES rows come back
    sizes = counts.where("c > 0").mapInArrow(_class_sizes(sc.broadcast(classes)), "k long, n long, v long").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        size[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    unigram = np.maximum(size, 0.5)
    within = np.where(np.arange(CLASSES) < ENDINGS, np.log10(size + kinds + 1), 0.0)
    hot_b = sc.broadcast(Packed({t: c * CLASSES + classes.get(t, ending(t)) for t, c in hot.items()}))
    classes_b, within_b = sc.broadcast(classes), sc.broadcast(within)
    trigrams = (texts.where("NOT held_out").select("text").mapInArrow(_trigrams(classes_b), "key long, n long")
                .groupBy("key").agg(F.sum("n").alias("n")))
    tables_b = sc.broadcast(fit(trigrams, unigram).tables())
    rows = texts.mapInArrow(tidy(_score(hot_b, tables_b, classes[END], within_b)), f"rid long, token binary, n long, id {kind}, "
                            "held_out boolean, n_tokens long, n_known long, base double, model double")
    rare = counts.where(~is_hot & (F.col("c") > 0)).select("token", "c")
    rows = rows.join(rare, "token", "left")
    of_rare = F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 1)), F.lit(0.0))
    known_rare = F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))
    sums = rows.groupBy("rid").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + known_rare).alias("n_known"), (F.sum("base") + of_rare).alias("base"), (F.sum("model") + of_rare).alias("model"))
    return sums.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        F.col("model").alias("score"))


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
