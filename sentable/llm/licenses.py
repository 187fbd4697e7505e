"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of ``WINDOW`` words of a document, one every ``STRIDE``
words, so a run of up to 33 words (a template has at most 32) lies whole in
some block.  A block matches a template T if it holds at least ``THRESHOLD`` of
T's distinct words (containment).  Tokens are ordered by their frequency in the whole
corpus, rarest first.  With o = ceil(THRESHOLD * |T|), a pair can only reach
overlap o if

* the first |T| - o + 1 tokens of T and the first |B| - o + 1 tokens of the
  block share a token (prefix filter),
* the block has at least o tokens of the template vocabulary (length filter),
* 1 + the smaller number of tokens after the shared one reaches o (positional
  filter);

pairs that pass are verified by counting their overlap, so no match is lost.
Block tokens outside the template vocabulary can never overlap and are left
out.  Templates are a constant list, so their index is a bounded broadcast.

Base matches are places where the words of a fixed phrase stand consecutively.
Null or empty texts have no words, no labels and score 0.  Each input row gives
one row; repeated rows and ids are kept apart by their place in the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentable.llm.common import cut, numbered, small_side, split_words, table, text_or_empty

WINDOW, STRIDE, THRESHOLD = 64, 32, 0.9

# Phrases whose consecutive words are a base match.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
        ("mit license", "mit")]

# The opening notices of common licenses, at most 32 distinct words each.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "licensed under the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "released into the public domain under cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "copyright all rights reserved no part of this publication may be reproduced"),
]


def template_sets(templates=None) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, text in (templates or TEMPLATES)]


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * size - 1e-9)


def words_of(text_col: str) -> Column:
    return split_words(text_or_empty(text_col))


def token_order(docs: DataFrame, text_col: str, vocab: list[str]) -> dict[str, int]:
    """Rank of each template token by its count in the whole corpus, rarest
    first (ties by token).  The driver gets one row a token."""
    used = docs.select(F.explode(F.filter(words_of(text_col), lambda w: w.isin(vocab))).alias("w"))
    n = {r["w"]: r["n"] for r in used.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (n.get(w, 0), w)))}


def phrase_places(words: str, at: Column, phrase: str) -> Column:
    """Starts of ``phrase`` among ``at``, the places of words that may begin one."""
    parts = phrase.split()
    return F.filter(at, lambda i: _all([F.get(F.col(words), (i + k).cast("int")) == F.lit(p)
                                        for k, p in enumerate(parts)]))


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    sets = template_sets(templates)
    rank = token_order(docs, text_col, sorted({w for _, ws in sets for w in ws}))
    ordered = [(label, sorted(rank[w] for w in ws)) for label, ws in sets]
    index = spark.createDataFrame(
        [(ws[i], t, i, len(ws), needed(len(ws), threshold), label, ws) for t, (label, ws) in enumerate(ordered)
         for i in range(len(ws) - needed(len(ws), threshold) + 1)],
        "token int, t int, i int, t_size int, need int, label string, t_tokens array<int>")
    prefix_words = sorted({w for w, r in rank.items() if any(
        r in ws[:len(ws) - needed(len(ws), threshold) + 1] for _, ws in ordered)})
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])

    scanned = numbered(docs, id_col, text_col).select("rid", F.col(f"`{id_col}`").alias("id"),
                                                      words_of(text_col).alias("words"))
    heads = sorted({p.split()[0] for p, _ in BASE})
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(heads))
    scanned = scanned.select(
        "*", F.when(F.arrays_overlap("words", F.array(*[F.lit(h) for h in heads])), at)
        .otherwise(F.array().cast("array<int>")).alias("at"))
    places = [phrase_places("words", F.col("at"), p) for p, _ in BASE]
    # only documents with a word of some template's prefix can match: windows for these alone
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - WINDOW + STRIDE - 1), F.lit(STRIDE))
    block = lambda s: F.array_sort(F.transform(F.array_distinct(F.filter(
        F.slice("words", s + 1, WINDOW), lambda w: w.isin(list(rank)))), lambda w: F.element_at(ranks, w)))
    blocks = (F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in prefix_words])),
                     F.transform(starts, block)).otherwise(F.array().cast("array<array<int>>")))
    scanned = scanned.select("rid", "id", F.size("words").cast("long").alias("n_words"),
                             *[p.alias(f"p{k}") for k, p in enumerate(places)], blocks.alias("blocks"))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    scanned = cut(scanned.select("rid", "id", "n_words", F.size(every).cast("long").alias("n_base"),
                                 F.array_min(every).cast("long").alias("first_word"),
                                 F.array_max(every).cast("long").alias("last_word"), base.alias("base"), "blocks"),
                  "license-blocks")

    tokens = (scanned.where(F.size("blocks") > 0).select("rid", F.posexplode("blocks").alias("b", "tokens"))
              .select("rid", "b", "tokens", F.size("tokens").alias("b_size"),
                      F.posexplode("tokens").alias("j", "token")))
    left = F.least(F.col("t_size") - F.col("i"), F.col("b_size") - F.col("j"))
    pairs = (tokens.join(F.broadcast(index), "token")
             .where((F.col("b_size") >= F.col("need")) & (F.col("j") <= F.col("b_size") - F.col("need"))
                    & (left >= F.col("need")))
             .withColumn("overlap", F.size(F.array_intersect("tokens", "t_tokens")))
             .where("overlap >= need"))
    found = (pairs.groupBy("rid").agg(F.collect_set("label").alias("found"),
                                      F.max(F.col("overlap") / F.col("t_size")).alias("score")))
    found = small_side(cut(found, "license-pairs"))
    return (scanned.drop("blocks").join(found, "rid", "left")
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                    joined_labels(F.col("base")).alias("base_labels"),
                    joined_labels(F.concat("base", F.coalesce("found", F.array().cast("array<string>"))))
                    .alias("labels"),
                    F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
                    .alias("score")))


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    sets = template_sets()
    rows = ", ".join(f"({k}, '{label}', {ws!r})" for k, (label, ws) in enumerate(sets))
    places = ", ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in
                                                              enumerate(phrase.split())) + f") AS p{n}"
        for n, (phrase, _) in enumerate(BASE))
    every = " || ".join(f"p{n}" for n in range(len(BASE)))
    base = " || ".join(f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, (_, label) in enumerate(BASE))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(t, label, ws) AS (VALUES {rows}),
p AS (SELECT doc_id, w, {places} FROM d),
b AS (SELECT doc_id, len(w) AS n_words, {every} AS every_place, {base} AS base FROM p),
k AS (SELECT doc_id, unnest(range(0, greatest(1, len(w) - {WINDOW} + {STRIDE}), {STRIDE})) AS s, w FROM d),
f AS (SELECT doc_id, label, len(list_intersect(w[s + 1:s + {WINDOW}], ws)) / len(ws) AS c, len(ws) AS n
      FROM k, t WHERE len(list_intersect(w[s + 1:s + {WINDOW}], ws)) >= ceil({THRESHOLD} * len(ws) - 1e-9)),
g AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS score FROM f GROUP BY doc_id)
SELECT b.doc_id, n_words, len(every_place) AS n_base, list_min(every_place) AS first_word,
       list_max(every_place) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
