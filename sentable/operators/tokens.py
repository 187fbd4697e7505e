"""Tokens (TOK-1 … TOK-6, WIN-4, AGG-8, GEN-2), re-aimed.

The reference uses a pretrained BPE tokenizer; here pieces come from one
fixed pattern and ids from corpus counts.  Everything is long form
(key, pos, piece) → join on the vocabulary → regroup per cell or row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentable.operators.index import rank_within
from sentable.operators.joins import small_side

# Piece pattern and reserved ids.
PIECE_RE = r"<BOS>|<EOC>|[A-Za-z]+|[0-9]|[^A-Za-z0-9]"
PAD, BOS_ID, EOC_ID, UNK = 0, 1, 2, 3
FIRST_FREE = 4
SPECIAL = {"<BOS>": BOS_ID, "<EOC>": EOC_ID}


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE_RE), 0)


def build_vocab(texts: DataFrame, col: str = "text") -> DataFrame:
    """TOK-1: (piece, n, id); ids by (count desc, piece) after the reserved ones.

    Ranking without a global sort: (count desc, piece) is encoded as one
    string key and ranked exactly over order-preserving sampled buckets
    (``rank_within``), so no task holds the whole vocabulary."""
    p = texts.select(F.explode(pieces(F.col(col))).alias("piece"))
    from sentable.sources.io import materialize
    counts = p.filter(~F.col("piece").isin(list(SPECIAL))).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "piece-counts")      # the ranking reads it several times
    # order (n desc, piece) as one string key: fixed-width complement of n, then the piece
    key = F.concat(F.lpad((F.lit(10 ** 18) - F.col("n")).cast("string"), 19, "0"), F.lit("\u0001"), F.col("piece"))
    ranked = rank_within(counts.withColumn("_g", F.lit(0)).withColumn("_key", key), ["_g"], "_key", "_r")
    body = ranked.select("piece", F.col("n").cast("long").alias("n"), (F.col("_r") + FIRST_FREE).cast("long").alias("id"))
    spark = texts.sparkSession
    special = spark.createDataFrame([("<PAD>", 0, PAD), ("<BOS>", 0, BOS_ID), ("<EOC>", 0, EOC_ID), ("<UNK>", 0, UNK)],
                                    "piece string, n long, id long")
    return special.unionByName(body)


def token_long(df: DataFrame, keys: list[str], text: Column, vocab: DataFrame,
               max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """(keys..., pos, piece, token) for every piece of ``text``."""
    from sentable.sources.io import materialize
    # the vocabulary is a small model artefact: written once, then size-checked
    vm = materialize(vocab.select("piece", F.col("id").alias("token")), "vocab")
    v = small_side(vm, max_broadcast_rows)
    if v is not vm:
        # broadcast lookup keeps the input's partitioning, so hashing the
        # (one-row-per-text) input by its first key lets the later per-key
        # regroup run without moving the (many) token rows
        df = df.repartition(keys[0])
    x = df.select(*keys, F.posexplode(pieces(text)).alias("pos", "piece"))
    return x.join(v, "piece", "left").withColumn("token", F.coalesce("token", F.lit(UNK)).cast("long")) \
            .withColumn("pos", F.col("pos").cast("long"))


def regroup(long: DataFrame, keys: list[str], out: str = "ids") -> DataFrame:
    """Token arrays per key in position order (a sorted collect per small group)."""
    g = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return g.select(*keys, F.transform("_t", lambda s: s["token"]).alias(out))


def cell_sentences(df: DataFrame, cols: list[str], texts: dict[str, Column], keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(F.array(*[F.struct(F.lit(c).alias("col"),
                                                            F.concat(F.lit(c + " is "), texts[c], F.lit("<EOC>")).alias("s"))
                                                   for c in cols])).alias("col_idx", "_cs")) \
             .select(*keep, F.col("col_idx").cast("long").alias("col_idx"), "_cs.col", "_cs.s")


def tokenize_cells(sent: DataFrame, vocab: DataFrame, keys: list[str], max_len: int = 20) -> DataFrame:
    """TOK-2: per-cell ids truncated to ``max_len`` (may drop <EOC>) and padded
    on the left to exactly ``max_len`` with PAD."""
    long = token_long(sent, keys, F.col("s"), vocab)
    ids = regroup(long, keys)
    t = F.slice("ids", 1, max_len)
    return ids.select(*keys, F.concat(F.array_repeat(F.lit(PAD).cast("long"), F.lit(max_len) - F.size(t)), t).alias("ids"))


def pad_left(ids: Column, n: Column, pad: int = PAD) -> Column:
    """TOK-4: left-pad to length n."""
    return F.concat(F.array_repeat(F.lit(pad).cast("long"), F.greatest(n - F.size(ids), F.lit(0))), ids)


def pad_right(ids: Column, n: Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(n - F.size(ids), F.lit(0))))


def pad_batch(df: DataFrame, ids: str = "ids", batch: str = "batch_id", side: str = "left") -> DataFrame:
    """AGG-8 + TOK-4: pad every sequence to its batch's longest one (a window
    over the batch, which is small by definition)."""
    x = df.withColumn("_mx", F.max(F.size(ids)).over(Window.partitionBy(batch)))
    f = pad_left if side == "left" else pad_right
    return x.withColumn(ids, f(F.col(ids), F.col("_mx"))).drop("_mx")


def collate(df: DataFrame, ids: str = "ids", batch: str = "batch_id") -> DataFrame:
    """TOK-5: pad to the batch maximum on the tokenizer's default (right)
    side, attention mask, labels = copy of inputs."""
    x = df.withColumn("_mx", F.max(F.size(ids)).over(Window.partitionBy(batch)))
    mask = pad_right(F.transform(F.col(ids), lambda _: F.lit(1).cast("long")), F.col("_mx"), 0)
    x = x.withColumn("input_ids", pad_right(F.col(ids), F.col("_mx"))).withColumn("attention_mask", mask)
    return x.withColumn("labels", F.col("input_ids")).drop("_mx", ids)


def next_token_pairs(long: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-4: token t predicts t+1 inside each cell (a window per small cell)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return long.withColumn("next", F.lead("token").over(w)).filter(F.col("next").isNotNull())


def fit_token_head(pairs: DataFrame, head: str = "col") -> DataFrame:
    """GEN-2: next-token counts of each column's head."""
    return pairs.groupBy(head, "token", "next").agg(F.count(F.lit(1)).alias("n"))
