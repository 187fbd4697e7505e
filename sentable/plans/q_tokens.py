"""Queries: vocabulary, token arrays, padding, collation, token heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentable.functions.fmt import formatted
from sentable.functions.text import row_text
from sentable.operators import tokens as T
from sentable.operators.split import shuffle_index
from sentable.plans.fixtures import FIXTURES, load, sql_fmt, sql_load
from sentable.plans.q_prep import SEED, sql_indexed
from sentable.plans.registry import query
from sentable.plans.workloads import sql_sentences

A = FIXTURES["A"]
PAT = T.PIECE_RE
MAXLEN = 20
BATCH = 16


def _corpus(spark, sf):
    df = load(spark, sf, "A")
    return df.select("row_key", row_text(df, A.cols).alias("text"))


def _vocab(spark, sf):
    return T.build_vocab(_corpus(spark, sf))


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_CORPUS_SQL = f"SELECT row_key, '<BOS>' || {sql_sentences('A')} AS text FROM ({sql_load('A')})"
_VOCAB_SQL = (f"SELECT piece, n, (row_number() OVER (ORDER BY n DESC, piece) - 1 + {T.FIRST_FREE})::BIGINT AS id FROM "
              f"(SELECT piece, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '{PAT}')) AS piece "
              f"FROM ({_CORPUS_SQL})) WHERE piece NOT IN ('<BOS>', '<EOC>') GROUP BY piece) "
              f"UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<BOS>', 0, 1 UNION ALL SELECT '<EOC>', 0, 2 "
              f"UNION ALL SELECT '<UNK>', 0, 3")


@query("build_vocab", _VOCAB_SQL)
def _build_vocab(spark, sf):
    return _vocab(spark, sf)


_SENT_SQL = " UNION ALL ".join(
    f"SELECT row_key, {i}::BIGINT AS col_idx, '{c}' AS col, '{c} is ' || {sql_fmt(c, A.kinds[c], 'nan')} || '<EOC>' AS s "
    f"FROM ({sql_load('A')})" for i, c in enumerate(A.cols))


def _sql_long(src, keys, text):
    k = ", ".join(keys)
    return (f"SELECT {k}, pos, piece, coalesce(v.id, {T.UNK})::BIGINT AS token FROM "
            f"(SELECT {k}, unnest(l) AS piece, unnest(range(len(l)))::BIGINT AS pos FROM "
            f"(SELECT {k}, regexp_extract_all({text}, '{PAT}') AS l FROM ({src}))) x "
            f"LEFT JOIN (SELECT piece AS vp, id FROM ({_VOCAB_SQL})) v ON v.vp = x.piece")


def _sql_lists(src, keys, text):
    k = ", ".join(keys)
    return f"SELECT {k}, list(token ORDER BY pos) AS ids FROM ({_sql_long(src, keys, text)}) GROUP BY ALL"


def _sent(spark, sf):
    df = load(spark, sf, "A")
    return T.cell_sentences(df, A.cols, formatted(df, A.cols, "nan", upcast=False), ["row_key"])


_CELL_KEYS = ["row_key", "col_idx", "col"]


@query("tokenize_cells",
       f"SELECT row_key, col_idx, col, array_to_string(list_concat(list_transform(range(greatest({MAXLEN} - len(t), 0)), "
       f"lambda x: 0::BIGINT), t), ',') AS ids FROM (SELECT *, list_slice(ids, 1, {MAXLEN}) AS t FROM "
       f"({_sql_lists(_SENT_SQL, _CELL_KEYS, 's')}))")
def _tokenize_cells(spark, sf):
    t = T.tokenize_cells(_sent(spark, sf), _vocab(spark, sf), _CELL_KEYS, MAXLEN)
    return t.select(*_CELL_KEYS, _ids_str(F.col("ids")).alias("ids"))


_ROW_SQL = _sql_lists(_CORPUS_SQL, ["row_key"], "text")


@query("tokenize_row", f"SELECT row_key, array_to_string(ids, ',') AS ids, len(ids)::BIGINT AS n_tokens FROM ({_ROW_SQL})")
def _tokenize_row(spark, sf):
    """TOK-3: one sequence for the whole row, no padding; labels = inputs."""
    long = T.token_long(_corpus(spark, sf), ["row_key"], F.col("text"), _vocab(spark, sf))
    r = T.regroup(long, ["row_key"])
    return r.select("row_key", _ids_str(F.col("ids")).alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


def _rows_batched(spark, sf):
    long = T.token_long(_corpus(spark, sf), ["row_key"], F.col("text"), _vocab(spark, sf))
    r = T.regroup(long, ["row_key"])
    idx = shuffle_index(r, SEED, F.col("row_key"))
    return idx.withColumn("batch_id", F.floor(F.col("idx") / BATCH).cast("long")).drop("idx")


_BATCHED_SQL = (f"SELECT r.row_key, r.ids, (i.idx // {BATCH})::BIGINT AS batch_id FROM ({_ROW_SQL}) r JOIN "
                f"({sql_indexed('SELECT row_key FROM (' + _CORPUS_SQL + ')', SEED, 'shuffle')}) i USING (row_key)")


@query("pad_batch", f"SELECT row_key, batch_id, array_to_string(list_concat(list_transform(range(mx - len(ids)), "
                    f"lambda x: 0::BIGINT), ids), ',') AS ids FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx "
                    f"FROM ({_BATCHED_SQL}))")
def _pad_batch(spark, sf):
    p = T.pad_batch(_rows_batched(spark, sf))
    return p.select("row_key", "batch_id", _ids_str(F.col("ids")).alias("ids"))


@query("collate", f"SELECT row_key, batch_id, array_to_string(list_concat(ids, list_transform(range(mx - len(ids)), "
                  f"lambda x: 0::BIGINT)), ',') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda x: 1::BIGINT), "
                  f"list_transform(range(mx - len(ids)), lambda x: 0::BIGINT)), ',') AS attention_mask, "
                  f"array_to_string(list_concat(ids, list_transform(range(mx - len(ids)), lambda x: 0::BIGINT)), ',') AS labels "
                  f"FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM ({_BATCHED_SQL}))")
def _collate(spark, sf):
    c = T.collate(_rows_batched(spark, sf))
    return c.select("row_key", "batch_id", *[_ids_str(F.col(x)).alias(x) for x in ("input_ids", "attention_mask", "labels")])


_NAMES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col, '{c}' AS s" for c in A.cols)


@query("column_name_tokens", f"SELECT col, array_to_string(ids, ',') AS ids FROM ({_sql_lists(_NAMES_SQL, ['col'], 's')})")
def _column_name_tokens(spark, sf):
    """TOK-6: token ids of the bare column names (used to force switches)."""
    names = spark.createDataFrame([(c, c) for c in load(spark, sf, "A", key=False).columns], "col string, s string")
    r = T.regroup(T.token_long(names, ["col"], F.col("s"), _vocab(spark, sf)), ["col"])
    return r.select("col", _ids_str(F.col("ids")).alias("ids"))


_LONG_CELLS = _sql_long(_SENT_SQL, _CELL_KEYS, "s")
_PAIRS_SQL = (f"SELECT * FROM (SELECT row_key, col_idx, col, pos, token, lead(token) OVER (PARTITION BY row_key, col_idx, col "
              f"ORDER BY pos) AS next FROM ({_LONG_CELLS})) WHERE next IS NOT NULL")


def _pairs(spark, sf):
    long = T.token_long(_sent(spark, sf), _CELL_KEYS, F.col("s"), _vocab(spark, sf))
    return T.next_token_pairs(long, _CELL_KEYS).select(*_CELL_KEYS, "pos", "token", "next")


@query("next_token_pairs", _PAIRS_SQL)
def _next_token_pairs(spark, sf):
    return _pairs(spark, sf)


@query("fit_token_head", f"SELECT col, token, next, count(*)::BIGINT AS n FROM ({_PAIRS_SQL}) GROUP BY ALL")
def _fit_token_head(spark, sf):
    return T.fit_token_head(_pairs(spark, sf))
