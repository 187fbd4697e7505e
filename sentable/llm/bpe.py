"""BPE encoding and decoding: tree concatenation of independently encoded parts.

Texts of at most ``piece`` characters are encoded as they are, in the task that reads
them.  A longer text is cut into pieces of that size, wherever the cuts fall; the pieces are
dealt to tasks and encoded there in parallel.  Then neighbours are joined level by
level, as a tree: a join re-encodes a window around the cut, from a token boundary
before it to one after it, and grows the window until its first token is the one that
the left part has there and its last token the one that the right part has.
A part is never encoded as a whole again.

A window may begin or end only where that says the same about the whole text
(``Codec.edge``): at a place where the splitting pattern always ends a match, or inside a run of
letters, digits, signs or spaces, which is one unit of the merges.  Inside a unit the
agreement is exact: a sequence of tokens is a unit's encoding if and only if each two
neighbours are the encoding of their bytes, and each pair of neighbours then stands in
the left part's encoding, in the window's or in the right part's.

The vocabulary is a file of the tokenizers library (``DEFAULT_TOKENIZER``, a parameter), read by the driver.
Tokens are those of that library's ``encode(text, add_special_tokens=False)``
without truncation and padding: a special token's string in a text becomes that token.
Pieces and windows are encoded by tiktoken's faster merge loop if the vocabulary numbers its tokens in
order of their merges, as that loop takes them, and else by the tokenizers library.  Decoding concatenates the
tokens' bytes.

Null counts as the empty text, which has no tokens.  Very long texts are spread over tasks and
need no more memory than their own tokens.  Repeated rows and ids give a row each; an
empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sentable.llm.common import cut, extended, fresh, replacing, ship, table, text_or_empty

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE = 32_768            # characters encoded as one
BATCH_CHARS = 1 << 18     # characters handed to the library together
MARGIN = 24               # bytes of the smallest window on either side of a cut
REACH = 16                # bytes around a place that decide whether a window may end there
# The splitting pattern of byte-level vocabularies, and the code points its \s matches.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    ones for themselves, the other bytes in order by the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def char_class(c: str) -> str | None:
    """space, letter, number or other, as the splitting pattern sees it; None if versions of
    Unicode may differ about it."""
    if ord(c) in SPACES:
        return "S"
    kind = unicodedata.category(c)
    if kind in ("Cn", "Zs", "Zl", "Zp") or 0x1C <= ord(c) <= 0x1F:
        return None
    return kind[0] if kind[0] in "LN" else "O"


class Codec:
    """Encodes and decodes with one vocabulary, given as the text of its file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # tasks share a machine's cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        table_ = byte_characters()
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.tokens = [self.special[i] if i in self.special else
                       bytes(table_[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.size = np.array([len(t) for t in self.tokens])
        self.start = np.cumsum(self.size) - self.size
        self.fast = self._merge_loop(json.loads(vocabulary))

    def _merge_loop(self, file: dict):
        """tiktoken's encoder of the same vocabulary, where it gives the same tokens; else None."""
        model, split = file["model"], file["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        ordered = (model["type"] == "BPE" and made == list(range(256, 256 + len(made))) and not model.get("dropout")
                   and not model.get("ignore_merges") and split.get("type") == "ByteLevel"
                   and not split.get("add_prefix_space") and split.get("use_regex") and not file["normalizer"])
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in file["added_tokens"])
        if not (ordered and plain):
            return None
        import tiktoken
        ranks = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                                 special_tokens={t.decode(): i for i, t in self.special.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return self._library(texts)
        return [self.fast.encode_to_numpy(t, allowed_special="all") for t in texts]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def decode_all(self, parts: list[np.ndarray]) -> pa.Array:
        """The bytes of each of ``parts``, as binary values."""
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        size = self.size[ids]
        ends = np.cumsum(size)
        text = self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([0] + [len(p) for p in parts])
        offsets = np.append(0, ends)[last].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(text)])

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def edge(self, text: bytes, at: int) -> bool:
        """Whether a window may begin or end at this place of ``text``."""
        if text[at] & 0xC0 == 0x80:                                     # inside a character
            return False
        for s in self.special.values():                                 # inside a special token's string
            if text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0:
                return False
        before = text[max(0, at - REACH):at].decode(errors="ignore")[-3:]
        after = text[at:at + 4].decode(errors="ignore")[:1]
        left, right = char_class(before[-1]), char_class(after)
        if left is None or right is None:
            return False
        if left != right:                       # a match always ends here, but for " x" and contractions
            return left != "S" and not (left == "O" and right == "L")
        return "'" not in before and after != "'"                       # inside a run

    def join(self, left: np.ndarray, right: np.ndarray, margin: int = MARGIN) -> np.ndarray:
        """The encoding of two texts in a row, from the encodings of either."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        reach = 16
        while True:
            a, b = left[-reach:].tolist(), right[:reach].tolist()
            text = self.decode(a)
            middle = len(text)
            text += self.decode(b)
            whole_a, whole_b = len(a) == len(left), len(b) == len(right)
            begin = self._begin(text, a, middle, margin, whole_a)
            end = self._end(text, b, middle, margin, whole_b)
            if begin is None or end is None:          # no such place yet among the tokens looked at
                reach *= 2
                continue
            (i, at), (j, to) = begin, end
            window = self.encode([text[at:to].decode()])[0]
            if (i == 0 and whole_a or window[0] == a[i]) and (j == len(b) and whole_b or window[-1] == b[j - 1]):
                return np.concatenate([left[:len(left) - len(a) + i], window, right[j:]])
            margin *= 2

    def _begin(self, text: bytes, a: list[int], middle: int, margin: int, whole: bool):
        """(token, byte) of the last place to begin that is ``margin`` bytes before the cut."""
        at = middle
        for i in range(len(a) - 1, -1, -1):
            at -= len(self.tokens[a[i]])
            if i == 0 and whole:
                return 0, 0
            if at < REACH and not whole:
                return None
            if middle - at >= margin and self.edge(text, at):
                return i, at
        return None

    def _end(self, text: bytes, b: list[int], middle: int, margin: int, whole: bool):
        at = middle
        for j, token in enumerate(b, 1):
            at += len(self.tokens[token])
            if j == len(b) and whole:
                return j, at
            if len(text) - at < REACH and not whole:
                return None
            if at - middle >= margin and self.edge(text, at):
                return j, at
        return None


def concatenated(codec: Codec, parts: list[np.ndarray]) -> np.ndarray:
    """All parts of one text, joined as a tree."""
    while len(parts) > 1:
        parts = [codec.join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, np.uint32)


def _batches(texts: list[str]):
    """Ranges of at most ``BATCH_CHARS`` characters, but for one text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > BATCH_CHARS:
            yield first, k
            first, size = k, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def _encoded(vocabulary, text: str, ids: str):
    """Column ``text`` of each batch replaced by its encoding ``ids``."""
    def run(batches):
        codec = None
        for whole in batches:
            codec = codec or Codec(vocabulary.value)
            k = whole.schema.get_field_index(text)
            texts = [x or "" for x in whole.column(k).to_pylist()]
            for first, end in _batches(texts):
                found = codec.encode(texts[first:end])
                columns = whole.slice(first, end - first).columns
                columns[k] = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, [*whole.schema.names[:k], ids, *whole.schema.names[k + 1:]])
    return run


def _finished(codec: Codec, b: pa.RecordBatch, names: list[str], parts: list[np.ndarray], packed: bool) -> pa.RecordBatch:
    """Columns ``names`` of a batch with the tokens and the text decoded from them."""
    if packed:
        ids = pa.array([x.tobytes() for x in parts], pa.binary())
    else:
        offsets = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], ids, codec.decode_all(parts)],
                                      [*names, "token_ids", "decoded"])


def _whole(vocabulary, text: str, names: list[str], packed: bool):
    """Texts that are encoded as they are."""
    def run(batches):
        codec = None
        for whole in batches:
            codec = codec or Codec(vocabulary.value)
            texts = whole.column(text).to_pylist()
            for first, end in _batches(texts):
                yield _finished(codec, whole.slice(first, end - first), names, codec.encode(texts[first:end]), packed)
    return run


def _outputs(vocabulary, ids: str, names: list[str], packed: bool):
    """Texts whose pieces have been joined."""
    def run(batches):
        codec = None
        for whole in batches:
            codec = codec or Codec(vocabulary.value)
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                yield _finished(codec, b, names, [np.frombuffer(b.column(ids)[0].as_py(), np.uint32)], packed)
    return run


def _cut_up(piece: int, names: list[str], text: str):
    """A row for each piece; the first one carries the row's other columns."""
    def run(batches):
        for b in batches:
            for r, t in enumerate(b.column(text).to_pylist()):
                parts = [t[k:k + piece] for k in range(0, len(t), piece)]
                at = pa.array([r] + [None] * (len(parts) - 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(names[0])[r].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                     pa.array(parts, pa.string()), *[b.column(c).take(at) for c in names[1:]]],
                    [names[0], "seq", "ids", *names[1:]])
    return run


def _joined(vocabulary, rid: str, seq: str, ids: str):
    """Rows in order of (rid, seq): each odd piece is joined to the one before it."""
    def run(batches):
        codec, held = None, None
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                r, s = row.column(rid)[0].as_py(), row.column(seq)[0].as_py()
                if held is not None and held[:2] == (r, s - 1) and s % 2:
                    codec = codec or Codec(vocabulary.value)
                    two = [np.frombuffer(x.column(ids)[0].as_py(), np.uint32) for x in (held[2], row)]
                    yield _with(held[2], {ids: codec.join(*two).tobytes(), seq: s // 2})
                    held = None
                    continue
                if held is not None:
                    yield _with(held[2], {seq: held[1] // 2})
                held = r, s, row
        if held is not None:
            yield _with(held[2], {seq: held[1] // 2})
    return run


def _with(row: pa.RecordBatch, values: dict) -> pa.RecordBatch:
    columns = [pa.array([values[f.name]], f.type) if f.name in values else row.column(k) for k, f in enumerate(row.schema)]
    return pa.RecordBatch.from_arrays(columns, schema=row.schema)


def encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, text_col: str = "text", piece: int = PIECE,
           packed: bool = False) -> DataFrame:
    """``docs`` with token_ids array<int> (``packed``: their little-endian 32-bit integers as one binary) and
    decoded, the text made from the ids again."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    docs = replacing(docs, "token_ids", "decoded")
    names = docs.columns
    rid, seq, ids = (fresh(docs, x) for x in ("rid", "seq", "ids"))
    text = docs.withColumn(ids, text_or_empty(text_col))
    own = docs.schema.fields
    numbers = [StructField(rid, LongType()), StructField(seq, IntegerType())]
    coded = StructField(ids, BinaryType())
    schema = extended(docs, token_ids=BinaryType() if packed else ArrayType(IntegerType()), decoded=BinaryType())
    short = text.where(F.length(ids) <= piece).mapInArrow(_whole(vocabulary, ids, names, packed), schema)
    # one job from the scan to the written pieces: the row numbers that group them are of that job
    long = (text.where(F.length(ids) > piece).withColumn(rid, F.monotonically_increasing_id())
            .mapInArrow(_renamed(_cut_up(piece, [rid, *names], ids), [rid, seq, ids, *names]),
                        StructType([*numbers, StructField(ids, StringType()), *own]))
            .repartition(rid, seq)
            .mapInArrow(_encoded(vocabulary, ids, ids), StructType([*numbers, coded, *own])))
    long = cut(long, "bpe-pieces")
    most = long.agg(F.max(seq)).first()[0] or 0
    while most:
        half = F.floor(F.col(f"`{seq}`") / 2)
        pairs = (long.repartition(F.col(f"`{rid}`"), half).sortWithinPartitions(rid, seq))
        long = cut(pairs.mapInArrow(_joined(vocabulary, rid, seq, ids), long.schema), "bpe-joined")
        most //= 2
    return short.union(long.mapInArrow(_outputs(vocabulary, ids, names, packed), schema)).withColumn(
        "decoded", F.col("decoded").cast("string"))


def _renamed(run, names: list[str]):
    return lambda batches: (pa.RecordBatch.from_arrays(b.columns, names) for b in run(batches))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, packed=True).select(
        "doc_id", F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
