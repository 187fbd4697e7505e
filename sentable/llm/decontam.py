"""Benchmark decontamination by spaced seeds.

A mask is laid over the words at each position; its zeros ignore a word, so a
seed still hits if words there were substituted.  Hashes of benchmark seeds
(distinct normalised items only, broadcast after a count) are joined with those of
the documents.  A hit names an alignment of item and document; around it the
words are compared.  A document is contaminated by an item if some window of
``SPAN`` aligned words (or the whole item, if shorter) has at least ``SHARE`` of
them equal.  ``MASKS`` hit each such window: of the masks of five words that begin with two
neighbours they are a smallest greedy choice that does so for all places that the unequal words
of 10 to 20 may have (a test goes through them).  An item of under ``WHOLE`` words is found verbatim only, by a
hash of all of it; of under ``LEAST`` words it is no evidence and never found.

Documents are hashed in blocks of ``BLOCK`` words that overlap by the longest
mask, so a row's size is bounded however long a text is.  Only documents with hits
are read again.  Words are lower-cased runs of letters and digits.  Null texts
and items have no words.  Repeated rows are reported each; equal items under their smallest id.  Empty
tables of documents or items give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.functions.rows import barrier, keep_if
from sentable.llm.common import cut, numbered, scanned, small_side, table, without_rows
from sentable.llm.licenses import words_of

MASKS = ["11111", "111011", "110100011"]      # all start with 11
WHOLE, LEAST = 10, 4
SPAN, SHARE = 20, 0.8
BLOCK = 1024


def used(mask: str) -> list[int]:
    return [j for j, c in enumerate(mask) if c == "1"]


def places(df: DataFrame, words: str, count: Column, masks: list[str], *keep: Column) -> DataFrame:
    """A row for each of the first ``count`` places of the array ``words``: ``at`` and the
    words o0, o1, ... there and after it that some mask uses (null past the end)."""
    offsets = sorted({j for m in masks for j in used(m)})
    ahead = F.arrays_zip(*[F.slice(words, j + 1, count).alias(f"o{j}") for j in offsets])
    return df.select(*keep, F.posexplode(ahead).alias("at", "o")).select(*keep, "at", "o.*")


def pair() -> Column:
    return F.xxhash64("o0", "o1")


def seed_array(masks: list[str]) -> Column:
    """The seeds at a place; null for a mask that goes past the end."""
    return F.array(*[F.when(F.col(f"o{used(m)[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[f"o{j}" for j in used(m)]))
                     for k, m in enumerate(masks)])


def short_masks() -> list[str]:
    """A mask of the whole of each item that is too short for windows."""
    return ["1" * n for n in range(LEAST, WHOLE)]


def benchmark_seeds(benchmark: DataFrame, masks: list[str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(items, seeds): distinct word sequences under their smallest id, and their seeds: those of ``masks``, and
    of a short item the one of all its words."""
    items = (benchmark.select(F.col(f"`{id_col}`").alias("item_id"), words_of(text_col).alias("item"))
             .where(F.size("item") >= LEAST)
             .groupBy("item").agg(F.min("item_id").alias("item_id")))
    items = cut(items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "item"), "benchmark-items")
    every = masks + short_masks()
    s = places(items.withColumn("words", F.size("item")), "item", F.size("item"), every, F.col("item_no"), F.col("words"))
    long = F.slice(seed_array(every), 1, len(masks))
    whole = F.array(F.get(seed_array(every), F.col("words") - LEAST + len(masks)))
    seeds = F.when(F.col("words") >= WHOLE, long).when(F.col("at") == 0, whole)
    s = s.select("item_no", F.col("at").alias("item_at"), pair().alias("pair"), F.explode(seeds).alias("seed"))
    return items, cut(s.where("seed IS NOT NULL"), "benchmark-seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: list[str] | None = None, span: int = SPAN,
                 share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(rid, doc_id, item_id, first_word, n_words, n_equal): for each contaminated document and item
    the best alignment's stretch of matching windows, in words of the document, and its equal words."""
    docs, masks = scanned(docs), masks or MASKS
    items, known = benchmark_seeds(benchmark, masks, item_col, item_text)
    masks = masks + short_masks()
    longest = max(map(len, masks))
    numbered_docs = numbered(docs, id_col, text_col)
    words = numbered_docs.select("rid", words_of(text_col).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(BLOCK))
    blocks = words.select("rid", F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("from"), F.slice("words", s + 1, BLOCK + longest - 1).alias("w")))).alias("b")).select("rid", "b.*")
    here = places(blocks, "w", F.lit(BLOCK), masks, F.col("rid"), F.col("from"))
    # all masks use their first two words: places whose pair no benchmark seed starts with drop out
    here = here.withColumn("pair", pair()).join(
        small_side(cut(known.select("pair").distinct(), "benchmark-pairs")), "pair", "left_semi")
    hashed = here.select("rid", (F.col("from") + F.col("at")).alias("at"), F.explode(seed_array(masks)).alias("seed"))
    hits = (hashed.join(small_side(known.drop("pair")), "seed")
            .select("rid", "item_no", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    hits = cut(hits, "seed-hits")
    near = barrier(numbered_docs.join(small_side(cut(hits.select("rid").distinct(), "hit-documents")), "rid", "left_semi")
                   .select("rid", F.col(f"`{id_col}`").alias("doc_id"), words_of(text_col).alias("words")))
    near = near.join(small_side(hits), "rid").join(_broadcast_items(items), "item_no")
    size = F.size("item")
    width = F.least(F.lit(span), size)
    need = F.when(size < WHOLE, size).otherwise(F.ceil(width * share - 1e-9))
    equal = F.transform("item", lambda w, k: F.when(F.get("words", F.col("shift") + k) == w, 1).otherwise(0))
    near = barrier(near.select("rid", "doc_id", "item_id", "shift", size.alias("size"), width.alias("width"),
                               need.alias("need"), equal.alias("equal")))
    total = lambda start, n: F.aggregate(F.slice("equal", start + 1, n), F.lit(0), lambda a, x: a + x)
    good = F.filter(F.sequence(F.lit(0), F.col("size") - F.col("width")),
                    lambda s: total(s, F.col("width")) >= F.col("need"))
    near = keep_if(near.withColumn("good", good), F.size("good") > 0)
    first, end = F.array_min("good"), F.array_max("good") + F.col("width")
    near = near.select("rid", "doc_id", "item_id", total(first, end - first).cast("long").alias("n_equal"),
                       (F.col("shift") + first).cast("long").alias("first_word"),
                       (end - first).cast("long").alias("n_words"))
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("back"), "n_words")).alias("b")
    return near.groupBy("rid", "doc_id", "item_id").agg(best).select(
        "rid", "doc_id", "item_id", (-F.col("b.back")).alias("first_word"), "b.n_words", "b.n_equal")


def _broadcast_items(items: DataFrame) -> DataFrame:
    """Items are broadcast only up to 8 MB of words."""
    size = items.agg(F.sum(F.octet_length(F.array_join("item", " ")))).first()[0] or 0
    return F.broadcast(items) if size <= 8 << 20 else items


def query(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    docs = scanned(docs)
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select("rid").distinct()
    return without_rows(docs, cut(bad, "contaminated"))
