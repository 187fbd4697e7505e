"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

1. Words are counted in one scan; those that are long and frequent enough are the vocabulary.
2. A single edit lies in a word's first half or leaves the first half as it is, so near words share
   the first half of the shorter one or the rest of it.  Each word goes into the groups of both
   halves, for its own length and for the next lower one; a pair of words is
   reported by the group that their longest common prefix names, and so once.
   A group of more than ``most`` words is cut in the same way within the part that may
   still differ, until that part is a single character.
3. Tasks hold whole groups in sorted order.  Each word is laid over its group's list
   from top to bottom: the band of the edit matrix (three cells a row) of the characters that a
   list word shares with the one before is kept, only its further characters add rows.  As soon as a
   row has no cell of at most one edit, the range of all list words with that prefix is
   skipped.  All words of a task make their steps together, as arrays.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.  A few occurrences, chosen by a
hash of the id and the run, lose a character (``DAMAGE``), a null id counting as the empty text.
Null and empty texts have no words, an empty table gives an empty result, repeated rows count
again.  A very long text is one array of words; a very long word is held by one task, as a
row is.  Ties between forms go to the word that is smallest in code-point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import ascii_lower, cut, ship, small_side, table, text_or_empty

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
DAMAGE = 31               # one of so many occurrences loses a character
RATIO = 10                # a form is at least so many times as frequent
GROUP_WORDS = 4_096
CHUNK = 1 << 16           # words that make their steps together
ANY = 1 << 30


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n): the words of all texts and their numbers of occurrences."""
    runs = F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word: Column = F.col("run")
    if damage:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
        word = word.otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


# ------------------------------------------------------------------ groups
def _group(word: Column, m, a, b, c) -> Column:
    """Of words of m or m + 1 characters that share the first a and the last b; reported are pairs
    whose longest common prefix is under c."""
    head, tail = F.substring(word, F.lit(1), a), F.when(b > 0, F.right(word, b)).otherwise("")
    return F.struct(F.xxhash64(m, a, b, c, head, tail).alias("gid"), m.alias("m"), a.alias("a"), b.alias("b"), c.alias("c"))


def _halves(word: Column, m, a, b, c) -> Column:
    free = m - a - b
    half = F.floor(free / 2).cast("int")
    return F.array(_group(word, m, a + half, b, c), _group(word, m, a, b + free - half, F.least(c, a + half)))


def groups(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(gid, m, a, b, c, word, n): each word in all its groups, none of which has over ``most`` words unless its
    words differ in one character at a given place."""
    zero, size = F.lit(0), F.length("word")
    both = F.flatten(F.transform(F.array(size - 1, size), lambda m: _halves(F.col("word"), m, zero, zero, F.lit(ANY))))
    rows = cut(words.select("word", "n", F.explode(both).alias("g")).select("word", "n", "g.*"), "spelling-groups")
    done = []
    while True:
        hot = (rows.where(F.col("m") - F.col("a") - F.col("b") > 1).groupBy("gid").agg(F.count("*").alias("size"))
               .where(F.col("size") > most).select("gid"))
        hot = cut(hot, "spelling-hot")
        if hot.isEmpty():
            break
        hot = small_side(hot)
        done.append(rows.join(hot, "gid", "left_anti"))
        parts = _halves(*[F.col(c) for c in ("word", "m", "a", "b", "c")])
        rows = cut(rows.join(hot, "gid", "left_semi").select("word", "n", F.explode(parts).alias("g"))
                   .select("word", "n", "g.*"), "spelling-groups")
    for d in done:
        rows = rows.unionByName(d)
    return rows


# ------------------------------------------------- one edit, over sorted lists
def band_steps():
    """The band as a number: cells i-1, i and i+1 of row i, each 0, 1 or 2 (more), and for each
    band and each outcome of the three comparisons the next row's band."""
    step = np.zeros((27, 8), np.uint8)
    for s in range(27):
        x, y, z = s // 9, s // 3 % 3, s % 3
        for e in range(8):
            low = min(x + (e >> 2), y + 1, 2)
            mid = min(y + (e >> 1 & 1), z + 1, low + 1, 2)
            step[s, e] = 9 * low + 3 * mid + min(z + (e & 1), mid + 1, 2)
    cells = np.array([[s // 9, s // 3 % 3, s % 3] for s in range(27)], np.uint8)
    return step, cells


STEP, CELLS = band_steps()
ALIVE = CELLS.min(axis=1) <= 1
FIRST, EQUAL = 9 * 2 + 3 * 0 + 1, 9 * 1 + 3 * 0 + 1       # the band of row 0, and of a later row of equal prefixes


class SortedLists:
    """Words of one or more groups, each group's in sorted order."""

    def __init__(self, gid: np.ndarray, chars: np.ndarray, size: np.ndarray):
        n = len(gid)
        self.size = size
        self.at = 1 + np.cumsum(size + 3) - (size + 3)             # a zero before each word, two after it
        self.flat = np.zeros(int((size + 3).sum()) + 1, np.uint8)
        self.flat[np.arange(len(chars)) + np.repeat(self.at - (np.cumsum(size) - size), size)] = chars
        first = np.flatnonzero(np.diff(gid, prepend=gid[0] - 1 if n else 0) != 0)
        sizes = np.diff(first, append=n)
        self.first, self.end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        self.lcp = self._shared(np.setdiff1d(np.arange(n), first, assume_unique=True))
        inner = np.where(self.lcp < 0, ANY, self.lcp)
        least = np.minimum.reduceat(inner, first) if n else inner
        self.top = np.repeat(np.minimum(least, size[first] - 1), sizes)      # what a whole group shares
        deepest = np.repeat(np.maximum.reduceat(self.lcp, first) if n else inner, sizes)
        self.skip = self._ends(deepest)

    def _shared(self, rows: np.ndarray) -> np.ndarray:
        """Characters shared with the word before; -1 for the first one of a group."""
        lcp = np.full(len(self.size), -1, np.int64)
        lcp[rows] = 0
        both = np.minimum(self.size[rows], self.size[rows - 1])
        d = 0
        while len(rows):
            same = (both > d) & (self.flat[self.at[rows] + d] == self.flat[self.at[rows - 1] + d])
            rows, both, d = rows[same], both[same], d + 1
            lcp[rows] = d
        return lcp

    def _ends(self, deepest: np.ndarray) -> np.ndarray:
        """For each word and character: the next word that does not share the prefix up to it."""
        n = len(self.size)
        ends = np.repeat(np.arange(1, n + 1), self.size + 3)
        ends = np.concatenate([[0], ends])                        # laid out as the characters are
        rows, d = np.flatnonzero(deepest > 0), 0
        while len(rows):
            at = np.where(self.lcp[rows] <= d, rows, n)
            after = np.minimum.accumulate(at[::-1])[::-1]
            after = np.append(after[1:], n)
            own = self.size[rows] > d
            ends[self.at[rows[own]] + d] = after[own]
            rows, d = rows[deepest[rows] > d + 1], d + 1
        return ends

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of words of a group that are one edit apart."""
        flat, at, size = self.flat, self.at, self.size
        band = np.zeros(len(flat), np.uint8)
        q = np.flatnonzero(self.end - self.first > 1)
        t, d = self.first[q], self.top[q]
        band[at[q] + d] = np.where(d > 0, EQUAL, FIRST)
        found_q, found_t = [], []
        while len(q):
            here, there = at[q] + d, at[t] + d
            c = flat[there]
            unlike = ((flat[here - 1] != c) * 4 + (flat[here] != c) * 2 + (flat[here + 1] != c)).astype(np.uint8)
            s = STEP[band[here], unlike]
            band[here + 1] = s
            alive, over = ALIVE[s], d + 1 == size[t]
            hit = np.flatnonzero(over & alive)
            hit = hit[CELLS[s[hit], np.clip(size[q[hit]] - size[t[hit]] + 1, 0, 2)] == 1]
            hit = hit[np.abs(size[q[hit]] - size[t[hit]]) <= 1]
            found_q.append(q[hit])
            found_t.append(t[hit])
            deeper = alive & ~over
            t = np.where(deeper, t, np.where(over, t + 1, self.skip[there]))
            on = deeper | (t < self.end[q])
            q, t, d, deeper = q[on], t[on], d[on], deeper[on]
            d = np.where(deeper, d + 1, self.lcp[t])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_t])

    def common(self, q: np.ndarray, t: np.ndarray, from_end: np.ndarray) -> np.ndarray:
        """Characters that words q and t share from the start, or from the end."""
        out = np.zeros(len(q), np.int64)
        rows, d = np.arange(len(q)), 0
        least = np.minimum(self.size[q], self.size[t])
        while len(rows):
            x, y, back = q[rows], t[rows], from_end[rows]
            same = least[rows] > d
            i = np.where(back, self.size[x] - 1 - d, d)
            j = np.where(back, self.size[y] - 1 - d, d)
            same &= self.flat[self.at[x] + i] == self.flat[self.at[y] + j]
            rows, d = rows[same], d + 1
            out[rows] = d
        return out

    def word(self, k: int, reverse: bool) -> str:
        text = self.flat[self.at[k]:self.at[k] + self.size[k]].tobytes().decode("latin-1")
        return text[::-1] if reverse else text


def _best(batch: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) for each word that has near words in its group."""
    gid, m, a, b, c, n = (batch.column(x).to_numpy() for x in ("gid", "m", "a", "b", "c", "n"))
    text = batch.column("s").combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    chars = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    lists = SortedLists(gid, chars, np.diff(offsets))
    q, t = lists.near()
    reverse = b > a
    ok = np.minimum(lists.size[q], lists.size[t]) == m[q]
    q, t = q[ok], t[ok]
    back = reverse[q]
    head, tail = lists.common(q, t, back), lists.common(q, t, ~back)
    ok = (head >= a[q]) & (head < c[q]) & (tail >= b[q])
    q, t = q[ok], t[ok]
    order = np.lexsort((-n[t], q))
    q, t = q[order], t[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    rows = []
    for i, j in zip(starts.tolist(), np.append(starts[1:], len(q)).tolist()):
        k = int(q[i])
        tied = t[i:j][n[t[i:j]] == n[t[i]]]
        rows.append((lists.word(k, reverse[k]), j - i, int(n[t[i]]), min(lists.word(int(x), reverse[k]) for x in tied)))
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                       pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                                      ["word", "n_near", "best_n", "best"])


def _scan(chunk: int):
    def run(batches):
        held = None
        for b in batches:
            here = pa.Table.from_batches([b])
            held = here if held is None else pa.concat_tables([held, here])
            if held.num_rows >= chunk:
                gid = held.column("gid").to_numpy()
                last = int(np.searchsorted(gid, gid[-1]))         # the last group may go on in the next batch
                if last:
                    yield _best(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield _best(held)
    return run


def near_words(words: DataFrame, most: int = GROUP_WORDS, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n) that have near words."""
    ship(words.sparkSession)
    scanned = F.when(F.col("b") > F.col("a"), F.reverse("word")).otherwise(F.col("word"))
    rows = groups(words, most).select("gid", "m", "a", "b", "c", "n", F.encode(scanned, "ISO-8859-1").alias("s"))
    found = (rows.repartition("gid").sortWithinPartitions("gid", "s")
             .mapInArrow(_scan(chunk), "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("back"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.back")).alias("best_n"), F.col("b.best").alias("best")))


def variants(words: DataFrame, ratio: int = RATIO, most: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words`` (word, n)."""
    words = cut(words, "spelling-words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    every = cut(words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    # counts grow along a chain of forms, so it ends; pointers double each round
    steps = cut(every.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "spelling-steps")
    while True:
        far = cut(steps.join(steps.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        if far.where("moved").isEmpty():
            break
        steps = far.select("word", "to")
    return every.join(steps.select("word", F.col("to").alias("_root")), "word", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(vocabulary(table(spark, sf_dir, "documents")))
