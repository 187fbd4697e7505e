"""Fixtures of the operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Columns whose names the operators use themselves.
CLASHING = ["rid", "id", "h", "norm", "n", "words", "key", "size", "kept", "bytes", "score", "predicted", "n_lines",
            "n_kept", "piece_ids", "decoded", "seed", "at", "token", "line"]


def frame(spark, rows):
    """documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def stored(spark, tmp_path, rows, name="documents", clash=False):
    """The same, as a file, with columns that clash with inner names if asked for."""
    df = frame(spark, rows)
    if clash:
        for c in CLASHING:
            df = df.selectExpr("*", f"'x' AS `{c}`")
    path = str(tmp_path / f"{name}.parquet")
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls, empty and very long texts, ties and repeated rows.
AWKWARD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a b c"), (None, None), (4, LONG), (5, LONG), (6, "\n\n"),
           (7, "Ünï ▁ é 漢字 🎉  two\tspaces\r\n"), (8, "A b C"), (9, "..."), (-5, "a b c")]
