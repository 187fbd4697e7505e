"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a vocabulary file (``DEFAULT_MODEL``, a parameter).  A
unigram file's scores are log probabilities already; a BPE file's are merge
ranks, turned into the log probabilities of a Zipf law over the ranks.

Encoding puts a space before a non-empty text and marks spaces.  A piece has
marks at its start only and never a newline (checked when the file is loaded),
so the best segmentation of a text is made of the best segmentations of its units:
a run of marks with the characters up to the next mark or newline.  Units are
segmented once a worker and batch, all new ones in lockstep: at each position
the trie steps through the units' bytes together.  A character without a piece costs
``UNKNOWN`` below the worst score and becomes its UTF-8 bytes.  Of equal scores the
segmentation whose last piece is longest wins.

A mark character in the text itself becomes bytes, so decoding restores every
valid text exactly.  Null counts as the empty text, which has no pieces.
"""

from __future__ import annotations

import math
import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from sentable.llm.common import extended, fresh, replacing, ship, table, text_or_empty, tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = b"\xff"                       # stands for the space mark; not a byte of any UTF-8 text
UNITS = re.compile(rb"\xff+[^\xff\n]*|[^\xff\n]+|\n")
UNKNOWN = 10.0
CACHE, LONGEST = 100_000, 64         # units remembered by a task, and the bytes of the longest one
SLICE = 250                          # documents encoded together

NEW = ["piece_ids", "n_byte_pieces", "decoded"]

Vocab = namedtuple("Vocab", "pieces scores byte_ids base check value unknown")
_loaded: dict[str, Vocab] = {}


def load(path: str = DEFAULT_MODEL) -> Vocab:
    """The vocabulary: piece bytes, log scores, ids of byte pieces, and the trie."""
    if path not in _loaded:
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_unused(i) or p.is_byte(i))]
        scores = {i: p.get_score(i) for i in plain}
        if any(s < -200 for s in scores.values()):           # merge ranks, not log probabilities
            weight = {i: 1 / (2.7 - s) for i, s in scores.items()}
            total = math.log(sum(weight.values()))
            scores = {i: math.log(w) - total for i, w in weight.items()}
        pieces = [b""] * n
        for i in plain:
            pieces[i] = p.id_to_piece(i).replace("▁", "\0").encode().replace(b"\0", MARK)
        byte_ids = [0] * 256
        for i in range(n):
            if p.is_byte(i):
                b = int(p.id_to_piece(i)[3:-1], 16)
                byte_ids[b], pieces[i] = i, bytes([b])
        _loaded[path] = vocabulary(pieces, scores, byte_ids)
    return _loaded[path]


def vocabulary(pieces: list[bytes], scores: dict[int, float], byte_ids: list[int]) -> Vocab:
    """``scores``: of the pieces that segment text, by id; the others are byte pieces or never used."""
    for i in scores:
        if MARK in pieces[i].lstrip(MARK) or b"\n" in pieces[i]:
            raise ValueError(f"piece {i} spans words or lines")
    all_scores = np.full(len(pieces), -np.inf)
    all_scores[list(scores)] = list(scores.values())
    base, check, value = double_array({pieces[i]: i for i in sorted(scores, reverse=True)})
    return Vocab(pieces, all_scores, np.array(byte_ids, np.int32), base, check, value,
                 min(scores.values(), default=0.0) - UNKNOWN)


def double_array(keys: dict[bytes, int]):
    """A trie as arrays: node s has a child t = base[s] + byte iff check[t] == s;
    value[t] is the key's number where a key ends, else -1.  The root is node 0."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, number in keys.items():
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = number
    size = 512 + 2 * len(children)
    used = np.zeros(size, bool)
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used[:256] = True                 # a base is a free slot less the first byte, so slots start past all bytes
    place = {0: 0}
    low = 256
    order = [0]
    for node in order:                # breadth first; the list grows as nodes are placed
        own = place[node]
        if node in ends:
            value[own] = ends[node]
        if not children[node]:
            continue
        bytes_ = np.array(sorted(children[node]))
        while True:
            while low < size and used[low]:
                low += 1
            if low + 512 > size:
                more = size
                used = np.concatenate([used, np.zeros(more, bool)])
                base = np.concatenate([base, np.zeros(more, np.int32)])
                check, value = (np.concatenate([a, np.full(more, -1, np.int32)]) for a in (check, value))
                size += more
            free = low + np.flatnonzero(~used[low:size - 256])
            start = next((int(c[0]) for k in range(0, len(free), 256) if len(c := free[k:k + 256][
                ~used[(free[k:k + 256] - bytes_[0])[:, None] + bytes_].any(axis=1)])), None)
            if start is not None:
                break
            used = np.concatenate([used, np.zeros(size, bool)])
            base = np.concatenate([base, np.zeros(size, np.int32)])
            check, value = (np.concatenate([a, np.full(size, -1, np.int32)]) for a in (check, value))
            size *= 2
        b0 = start - int(bytes_[0])
        base[own] = b0
        for b, child in children[node].items():
            used[b0 + b] = True
            check[b0 + b] = own
            place[child] = b0 + b
            order.append(child)
    return base, check, value


def segment(units: list[bytes], v: Vocab) -> list[list[int]]:
    """The best segmentation of each unit, all units in lockstep."""
    longest, count = max(map(len, units)), len(units)
    size = np.array([len(u) for u in units])
    text = np.zeros((longest + 1, count), np.uint8)          # zero past the end: no piece goes on there
    flat = np.frombuffer(b"".join(units), np.uint8)
    col = np.repeat(np.arange(count), size)
    text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), col] = flat
    best = np.full((longest + 1, count), -np.inf)
    best[0] = 0.0
    came = np.zeros((longest + 1, count), np.int32)          # start of the last piece
    last = np.full((longest + 1, count), -1, np.int32)       # its id; -1 for bytes
    for i in range(longest):
        u = np.flatnonzero((size > i) & (best[i] > -np.inf))
        if not len(u):
            continue
        lead = text[i, u]
        width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 1))))
        width = np.minimum(width, size[u] - i)
        unknown = np.ones(len(u), bool)                      # no piece is just this character
        node, at, k = np.zeros(len(u), np.int32), np.arange(len(u)), 0
        while len(at):
            inside = i + k < size[u[at]]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            child = v.base[node] + text[i + k, u[at]]
            ok = v.check[child] == node
            at, node, k = at[ok], child[ok], k + 1
            piece = v.value[node]
            ends = piece >= 0
            here, piece = at[ends], piece[ends]
            unknown[here[width[here] == k]] = False
            _better(best, came, last, i, i + k, u[here], best[i, u[here]] + v.scores[piece], piece)
        lone = np.flatnonzero(unknown)
        for w in np.unique(width[lone]):
            x = u[lone[width[lone] == w]]
            _better(best, came, last, i, i + int(w), x, best[i, x] + v.unknown, np.full(len(x), -1, np.int32))
    out = []
    for j, unit in enumerate(units):
        ids, end = [], len(unit)
        while end:
            start = came[end, j]
            if last[end, j] >= 0:
                ids.append(int(last[end, j]))
            else:
                ids.extend(int(v.byte_ids[b]) for b in reversed(unit[start:end]))
            end = start
        out.append(ids[::-1])
    return out


def _better(best, came, last, start, end, cols, score, piece) -> None:
    wins = score > best[end, cols]
    cols = cols[wins]
    best[end, cols], came[end, cols], last[end, cols] = score[wins], start, piece[wins]


def segment_all(units: list[bytes], v: Vocab, cells: int = 500_000) -> dict[bytes, list[int]]:
    """Units of like length together, so that no batch has over ``cells`` positions (but one unit's)."""
    units = sorted(units, key=len)
    out, i = {}, 0
    while i < len(units):
        j = i + 1
        while j < len(units) and (len(units[j]) + 1) * (j + 1 - i) <= cells and len(units[j]) <= 2 * len(units[i]) + 8:
            j += 1
        out.update(zip(units[i:j], segment(units[i:j], v)))
        i = j
    return out


class Encoder:
    """Piece ids of texts; units that were met before are remembered as 32-bit integers in a row."""

    def __init__(self, v: Vocab):
        self.v, self.known, self.older = v, {}, {}

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [UNITS.findall((b" " + t).replace(b" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE // 2:          # units not met since the last time are forgotten
            self.known, self.older = {}, self.known
        known, older, here = self.known, self.older, {}
        new = set().union(*split).difference(known)
        known.update((u, older[u]) for u in new if u in older)
        for u, ids in segment_all([u for u in new if u not in older], self.v).items():
            (known if len(u) <= LONGEST else here)[u] = np.array(ids, np.int32).tobytes()
        if here:
            known = known | here
        return [np.frombuffer(b"".join([known[u] for u in units]), np.int32) for units in split]


def decode(ids, v: Vocab) -> bytes:
    text = b"".join([v.pieces[i] for i in ids])
    return text.replace(MARK, b" ")[1:]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with piece_ids array<int>, n_byte_pieces and decoded, the text made from the ids
    again (columns of these names are replaced)."""
    ship(docs.sparkSession)
    docs = replacing(docs, *NEW)
    v = docs.sparkSession.sparkContext.broadcast(load(model))
    names = docs.columns

    def run(batches):
        encoder = Encoder(v.value)
        is_byte = np.zeros(len(encoder.v.pieces), bool)
        is_byte[encoder.v.byte_ids] = True
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), SLICE):
                b = whole.slice(k, SLICE)
                ids = encoder(b.column(len(names)).to_pylist())
                sizes = np.array([0] + [len(x) for x in ids])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), pa.array(flat))
                n_bytes = pa.array([int(is_byte[x].sum()) for x in ids], pa.int64())
                text = pa.array([decode(x.tolist(), encoder.v) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], lists, n_bytes, text],
                                                 [*names, *NEW])

    schema = extended(docs, piece_ids=ArrayType(IntegerType()), n_byte_pieces=LongType(), decoded=BinaryType())
    return (docs.withColumn(fresh(docs, "bytes"), text_or_empty(text_col).cast("binary"))
            .mapInArrow(tidy(run), schema).withColumn("decoded", F.col("decoded").cast("string")))


def query(spark, sf_dir):
    """The ids of every text, and whether decoding gives the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "n_byte_pieces", "piece_ids",
        (F.col("decoded") == text_or_empty()).alias("round_trip"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their piece ids; the text is what these decode to.  The stage's
    columns get underscores where a column of the documents has their name."""
    own = {c: fresh(docs, c + "_in") for c in docs.columns if c.lower() in NEW}      # not to be replaced
    out = encode(docs.withColumnsRenamed(own)).withColumn("text", F.when(F.col("text").isNotNull(), F.col("decoded")))
    out = out.drop("decoded").withColumnsRenamed({c: fresh(docs, c) for c in NEW if c != "decoded"})
    return out.withColumnsRenamed({v: k for k, v in own.items()})
