"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One scan writes a fingerprint table: row place, doc_id, a 52-bit
   fingerprint and the SHA-256 of the normalised text.
2. Senders (blocks of at most ``SENDER_ROWS`` rows of one scan task) sort their
   distinct fingerprints, cut them by owner (the leading bits) and send each
   owner one Golomb-Rice coded message.
3. Owners decode their messages, find fingerprints sent more than once and
   answer each message with a bitmap.  A sender sends a fingerprint once however
   many rows carry it, so a hot text costs one entry a sender.
4. Senders turn bitmaps (and repeats of their own) into suspect fingerprints.
5. Only texts of suspect fingerprints are shuffled; grouping them by their bytes
   verifies equality.  Copies collapse map-side before that shuffle.

Texts are equal if identical after lower-casing A-Z; null counts as empty.  The
row with the largest doc_id stays (of repeated doc_ids the last row in the
scan; null ids rank lowest).  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import ascii_lower, cut, numbered, small_side, text_or_empty

FINGERPRINT_BITS = 52
SENDER_SHIFT = 20          # a sender holds at most 2**20 rows
OWNER_ROWS = 1 << 20       # rows an owner serves on average
MIN_OWNER_BITS = 5         # 32 owners at least


def rice_encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of the gaps of ascending distinct integers: quotients
    in unary (zeros ended by a one), then the remainders, ``b`` bits each."""
    gaps = np.diff(sorted_values, prepend=0).astype(np.int64)
    b = max(0, int(np.log2(max(1.0, gaps.mean() * 0.69))))
    ends = np.cumsum((gaps >> b) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(b - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return b, np.packbits(np.concatenate([unary, low])).tobytes()


def rice_decode(n: int, b: int, blob: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits)[:n] + 1      # the first n ones end the unary codes
    quotients = np.diff(ends, prepend=0) - 1
    low = bits[ends[-1]:ends[-1] + n * b].reshape(n, b).astype(np.int64)
    rest = low @ (1 << np.arange(b - 1, -1, -1, dtype=np.int64)) if b else np.zeros(n, np.int64)
    return np.cumsum((quotients.astype(np.int64) << b) + rest)


def encoder(owner_bits: int):
    shift = FINGERPRINT_BITS - owner_bits

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(pdf["h"].to_numpy())
        owner = h >> shift
        out = []
        for part in np.split(h, np.flatnonzero(np.diff(owner)) + 1):
            o = int(part[0]) >> shift
            b, blob = rice_encode(part - (o << shift))
            out.append((key[0], o, len(part), b, blob))
        return pd.DataFrame(out, columns=["sender", "owner", "n", "b", "blob"])
    return send


def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The owner: a bitmap over each message's fingerprints, set where
    another sender sent the same one."""
    lists = [rice_decode(n, b, blob) for n, b, blob in zip(pdf["n"], pdf["b"], pdf["blob"])]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    dup = (counts > 1)[inverse]
    maps = [np.packbits(x).tobytes() for x in np.split(dup, np.cumsum([len(x) for x in lists])[:-1])]
    return pd.DataFrame({"sender": pdf["sender"], "owner": key[0], "n": pdf["n"], "bitmap": maps})


def receive(key: tuple, rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
    """The sender: its fingerprints that are duplicated here or elsewhere."""
    h, counts = np.unique(rows["h"].to_numpy(), return_counts=True)
    maps = maps.sort_values("owner")       # owners are leading bits: their lists follow each other in h
    there = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for n, m in zip(maps["n"], maps["bitmap"])]
    return pd.DataFrame({"h": h[(np.concatenate(there) == 1) | (counts > 1)]})


def suspects(fp: DataFrame) -> DataFrame:
    """Distinct fingerprints that more than one row of ``fp`` (rid, h) has."""
    n = fp.count()
    owner_bits = max(MIN_OWNER_BITS, int(np.ceil(np.log2(max(1, n / OWNER_ROWS)))))
    rows = fp.select(F.shiftright("rid", SENDER_SHIFT).alias("sender"), "h")
    sent = rows.groupBy("sender").applyInPandas(
        encoder(owner_bits), "sender long, owner long, n int, b int, blob binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "sender long, owner long, n int, bitmap binary")
    return (rows.groupBy("sender").cogroup(answers.groupBy("sender"))
            .applyInPandas(receive, "h long").groupBy("h").agg(F.count("*").alias("_senders")).select("h"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    norm = (numbered(docs, id_col, text_col)
            .select("rid", F.col(f"`{id_col}`").alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm")))
    h = F.shiftrightunsigned(F.xxhash64("norm"), 64 - FINGERPRINT_BITS).alias("h")
    fp = cut(norm.select("rid", "id", h, F.unhex(F.sha2("norm", 256)).alias("sha")), "fingerprints")
    hot = cut(suspects(fp.select("rid", "h")), "suspects")
    texts = norm.select("norm", h).join(small_side(hot), "h", "left_semi")
    classes = (texts.groupBy("h", "norm").agg(F.count("*").alias("n"))          # equal bytes, counted
               .where("n > 1").select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "n"))
    classes = small_side(cut(classes, "classes"))
    winners = (fp.join(classes, ["h", "sha"])
               .groupBy("h", "sha").agg(F.max(F.struct("id", "rid")).alias("w"), F.max("n").alias("n")))
    winners = small_side(cut(winners, "winners"))
    return (fp.join(winners, ["h", "sha"], "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("w.id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                    (F.col("w").isNull() | (F.col("w.rid") == F.col("rid"))).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def query(spark, sf_dir):
    from sentable.llm.common import table
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
