import itertools

import pytest

from sentable.llm import common, decontam, exact_dedup, line_dedup, near_dedup, pieces, secrets, toxicity, warc
from sentable.sources.io import materialize
from tests.llm.data import stored

FILES = 6


@pytest.fixture(scope="module")
def input_dir(spark, small_dir, tmp_path_factory):
    """The small tables, dealt over several files."""
    out = tmp_path_factory.mktemp("cut")
    for name in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").repartition(FILES).write.parquet(f"{out}/{name}.parquet")
    return str(out)


QUERIES = {
    "op2": exact_dedup.query, "op3": decontam.query, "op4": secrets.query, "op6": near_dedup.query,
    "op8": line_dedup.query, "op9": warc.query,
    "stage7": lambda s, d: toxicity.stage(s, common.table(s, d, "documents"), d),
    "stage8": lambda s, d: line_dedup.stage(s, common.table(s, d, "documents"), d),
    "stage6": lambda s, d: near_dedup.stage(s, common.table(s, d, "documents"), d),
    "stage3": lambda s, d: decontam.stage(s, common.table(s, d, "documents"), d),
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_keep_their_numbers_when_scans_are_cut_otherwise(spark, input_dir, monkeypatch, name):
    """Between any two jobs the number of tasks a scan is cut into changes, as when executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    want = sorted(map(str, QUERIES[name](spark, input_dir).collect()))
    numbers = itertools.cycle([1, 16, 3, 7, 2])

    def cut_otherwise(df, what, *more):
        out = materialize(df, what, *more)
        spark.conf.set(key, str(next(numbers)))
        return out

    monkeypatch.setattr(common, "materialize", cut_otherwise)
    try:
        got = sorted(map(str, QUERIES[name](spark, input_dir).collect()))
    finally:
        spark.conf.unset(key)
    assert got == want


def test_numbers_are_those_of_files_and_rows(spark, input_dir):
    docs = common.table(spark, input_dir, "documents")
    ids = [(r.rid, r.doc_id) for r in common.numbered(docs, "doc_id").collect()]
    assert len({r for r, _ in ids}) == docs.count() and len({r >> common.ROW_BITS for r, _ in ids}) == FILES
    assert common.numbered(spark.range(10), "id").select("rid").distinct().count() == 10
    clash = docs.selectExpr("*", "1 AS _metadata", "2 AS _path", "3 AS _at", "4 AS rid")
    assert common.numbered(clash, "_metadata", "_path", "_at").distinct().count() == docs.count()


def test_stage_keeps_columns_that_clash(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "a b"), (2, None)], clash=True).selectExpr("*", "'y' AS n_byte_pieces")
    out = pieces.stage(spark, docs, "")
    assert out.columns == [*docs.columns, "piece_ids_", "n_byte_pieces_"]
    assert out.select("piece_ids", "decoded", "n_byte_pieces").distinct().collect() == [("x", "x", "y")]
    assert [r.piece_ids_ for r in out.where("doc_id = 2").collect()] == [[]]
