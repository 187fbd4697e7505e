"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (parted by white space, A-Z lower-cased); blank lines
are always kept.  Lines with equal words are copies: the earliest stays, by
(doc_id, place of the document in the scan, line number).  The bound grows with the length: a line of
at least ``MIN_WORDS`` words is also dropped if an earlier one is within one word edit (a word put in, left
out or replaced), a shorter one of at least ``MIN_CHARS`` characters if an earlier one is within one character
edit that touches no digit (so numbered headings stay), one still shorter only as a copy.  What is
edited is called a unit below: a word of the former, a character of the latter.

1. Copies collapse to distinct lines, each with its earliest place.
2. A pair within one edit shares its first or its last half (by the shorter one's
   number of units).  Lines that share neither with any other distinct line have no partner, and
   only the rest, S, goes on, numbered in order of place.
3. S emits hashed variants: the whole line and the line without its i-th unit;
   those that only one line has are left out of what follows.
   Equal variants without the i-th unit of both: a replacement.  A whole line equal to a
   variant of another: a unit put in.  In each group of equal variants a line is joined
   with the group's earliest, never with every other.
4. The units of each pair found are compared by edit distance.

Documents come back with the lines that stay.  Null text counts as empty and
stays null; repeated rows are copies of each other's lines; an empty table gives an empty result.  A text
is read line by line however long it is; a very long line is held by one task, as a row is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sentable.llm.common import (LOWER_BYTES, cut, extended, fresh, numbered, replacing, scanned, small_side, table, text_or_empty,
                                 tidy, with_row_id)

MIN_WORDS, MIN_CHARS = 8, 12
SLICE = 1_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_words(line: bytes) -> list[bytes]:
    return line.translate(LOWER_BYTES).split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def units(ws: list[bytes], min_words: int = MIN_WORDS) -> list[bytes]:
    """The words of a line, the characters of a shorter one; none if it is too short for edits."""
    if len(ws) >= min_words:
        return ws
    text = b" ".join(ws).decode("utf-8", "replace")
    return [c.encode() for c in text] if len(text) >= MIN_CHARS else []


def half_keys(us: list[bytes], of_words: bool = True) -> list[int]:
    """Keys of the first and the last half, for pairs whose shorter line has as many units or one less."""
    out, kind = [], 0 if of_words else 1 << 40
    for s in (len(us), len(us) - 1):
        half = (s - 1) // 2
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(us[:half]), kind + 2 * s)))
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(us[-half:]), kind + 2 * s + 1)))
    return out


def _slices(batches):
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def _line_rows(min_words: int):
    """(rid, id, line, h1, h2, k0..k3) of every line with words."""
    def run(batches):
        for b in _slices(batches):
            rows = []
            for rid, i, text in zip(*(b.column(c).to_pylist() for c in ("rid", "id", "text"))):
                for n, line in enumerate(text.split(b"\n")):
                    ws = line_words(line)
                    if ws:
                        h = xxhash.xxh3_128_intdigest(b" ".join(ws))
                        us = units(ws, min_words)
                        keys = half_keys(us, us is ws) if us else [None] * 4
                        rows.append((rid, i, n, _signed(h >> 64), _signed(h & (1 << 64) - 1), *keys))
            types = [pa.int64(), b.schema.field("id").type, pa.int32(), *[pa.int64()] * 6]
            cols = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["rid", "id", "line", "h1", "h2", "k0", "k1", "k2", "k3"])
    return run


def _lines_of(batches):
    """(rid, line, words) of the wanted line numbers of each text."""
    for b in _slices(batches):
        rows = []
        for rid, text, wanted in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "wanted"))):
            lines = text.split(b"\n")
            rows += [(rid, n, b" ".join(line_words(lines[n]))) for n in wanted]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))],
                                         ["rid", "line", "words"])


def variants(ws: list[bytes]) -> np.ndarray:
    """Hashes of the line (first) and of the line without its i-th unit (i from 0)."""
    m = len(ws)
    a = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, m)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _P)]).astype(np.uint64))
    terms = a * power
    before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    total = before[-1]
    without = before[:-1] + (total - before[1:]) * _P_INVERSE
    out = np.concatenate([[total ^ np.uint64(m)], without ^ np.uint64(m - 1)])
    out = (out ^ (out >> np.uint64(29))) * _P
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _variant_rows(min_words: int):
    def run(batches):
        for b in _slices(batches):
            keys, places = [], []
            for w in b.column("words").to_pylist():
                ws = w.split()
                us = units(ws, min_words)
                here = np.arange(-1, len(us), dtype=np.int32)
                if us is not ws:              # a digit of a short line is never left out
                    here = here[[True, *(not u.isdigit() for u in us)]]
                keys.append(variants(us)[here + 1])
                places.append(here)
            n = [len(x) for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)),
                                              pa.array(np.repeat(b.column("sid").to_numpy(), n))], ["key", "i", "sid"])
    return run


def within_one(a: list[bytes], b: list[bytes], digits: bool = True) -> bool:
    """Edit distance at most 1; ``digits``: the edit may touch a digit."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    same = len(a) == len(b)
    if not digits and any(u.isdigit() for u in [*b[i:i + 1], *(a[i:i + 1] if same else [])]):
        return False
    return a[i + same:] == b[i + 1:]


def _verify(min_words: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("words").to_pylist(), b.column("other").to_pylist()):
                x, y = x.split(), y.split()
                long = len(x) >= min_words
                ok.append(long == (len(y) >= min_words) and within_one(units(x, min_words), units(y, min_words), long))
            yield pa.RecordBatch.from_arrays([b.column("sid").filter(pa.array(ok, pa.bool_()))], ["sid"])
    return run


def near_lines(docs: DataFrame, distinct: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2) of distinct lines that an earlier line is within one edit of."""
    lines = with_row_id(distinct, "lid")
    keyed = lines.where("k0 IS NOT NULL").select("lid", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    some = keyed.join(small_side(cut(shared, "line-halves")), "k", "left_semi").select("lid").distinct()
    some = lines.select("lid", "h1", "h2", "place").join(small_side(cut(some, "line-ids")), "lid", "left_semi")
    some = cut(some.orderBy("place").select(F.monotonically_increasing_id().alias("sid"), "h1", "h2",
                                            F.col("place.rid").alias("rid"), F.col("place.line").alias("line")), "line-survivors")
    wanted = some.groupBy("rid").agg(F.collect_list("line").alias("wanted"))
    wanted = small_side(wanted)
    texts = numbered_text(docs).join(wanted, "rid").select("rid", "text", "wanted").mapInArrow(
        tidy(_lines_of), "rid long, line int, words binary")
    texts = cut(texts.join(small_side(some), ["rid", "line"]).select("sid", "h1", "h2", "words"), "line-texts")
    # variants that only one line has (nearly all) drop out before the joins
    every = texts.select("sid", "words").mapInArrow(tidy(_variant_rows(min_words)), "key long, i int, sid long")
    again = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    v = cut(every.join(small_side(cut(again, "line-keys")), "key", "left_semi"), "line-variants")
    first = v.where("i >= 0").groupBy("key", "i").agg(F.min("sid").alias("o"), F.count("*").alias("n")).where("n > 1")
    replaced = v.join(first.drop("n"), ["key", "i"]).where("sid > o").select("sid", "o")
    whole = v.where("i = -1").select("key", F.col("sid").alias("o"))
    longer = v.where("i >= 0").join(whole, "key").where("sid > o").select("sid", "o")
    least = v.where("i >= 0").groupBy("key").agg(F.min("sid").alias("o"))
    shorter = v.where("i = -1").join(least, "key").where("sid > o").select("sid", "o")
    pairs = cut(replaced.union(longer).union(shorter).groupBy("sid").agg(F.min("o").alias("o")), "line-pairs")
    both = (pairs.join(texts.select("sid", "words"), "sid")
            .join(texts.select(F.col("sid").alias("o"), F.col("words").alias("other")), "o").select("sid", "words", "other"))
    return texts.select("sid", "h1", "h2").join(both.mapInArrow(tidy(_verify(min_words)), "sid long"), "sid", "left_semi").select("h1", "h2")


def numbered_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return numbered(docs, id_col, text_col).select("rid", F.col(f"`{id_col}`").alias("id"),
                                                   text_or_empty(text_col).cast("binary").alias("text"))


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, kept): the numbers of the lines with words that stay; no row where none does."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = numbered_text(source).mapInArrow(tidy(_line_rows(min_words)), f"rid long, id {kind}, line int, h1 long, h2 long, "
                                            "k0 long, k1 long, k2 long, k3 long")
    distinct = cut(rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "rid", "line")).alias("place"),
                                                *[F.max(k).alias(k) for k in ("k0", "k1", "k2", "k3")]), "lines")
    near = small_side(cut(near_lines(source, distinct, min_words), "near-lines"))
    return (distinct.join(near, ["h1", "h2"], "left_anti").select("place.rid", "place.line")
            .groupBy("rid").agg(F.collect_list("line").alias("kept")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as its text, and ``n_lines`` and ``n_kept``, its lines with
    words before and after (columns of these names are replaced)."""
    docs = replacing(scanned(docs), "n_lines", "n_kept")
    names = docs.columns
    at = names.index(text_col)
    rid, kept_col = fresh(docs, "rid"), fresh(docs, "kept")
    kept = kept_lines(docs, min_words, id_col, text_col).toDF(rid, kept_col)
    rows = with_row_id(docs, rid).join(kept, rid, "left").select(
        *[F.col(f"`{c}`") for c in [*names, kept_col]])

    def rebuild(batches):
        for b in _slices(batches):
            text, before, after = [], [], []
            for t, kept_here in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                keep = set(kept_here or ())
                lines = (t or "").split("\n")
                full = [bool(x.encode("utf-8", "replace").split()) for x in lines]
                before.append(sum(full))
                after.append(len(keep))
                text.append(None if t is None else "\n".join([x for n, x in enumerate(lines) if n in keep or not full[n]]))
            cols = list(b.columns[:len(names)])
            cols[at] = pa.array(text, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(after, pa.int64())],
                                             [*names, "n_lines", "n_kept"])

    return rows.mapInArrow(tidy(rebuild), extended(docs, n_lines=LongType(), n_kept=LongType()))


def query(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents keep the lines that stay; a document that
    loses all its lines with words goes (one that had none stays as it is)."""
    names = docs.columns
    own = {c: fresh(docs, c + "_") for c in ("n_lines", "n_kept") if c in names}     # not to be replaced
    out = dedup_lines(docs.withColumnsRenamed(own)).where("n_lines = 0 OR n_kept > 0").drop("n_lines", "n_kept")
    out = out.withColumnsRenamed({v: k for k, v in own.items()})
    lengths = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return out.withColumns(lengths).select(*[F.col(f"`{c}`") for c in names])
