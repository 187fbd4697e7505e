import corpus_pipeline as C
from sentable.llm import registry
from tests.llm.data import AWKWARD, stored


def test_stages_keep_clean_documents(spark, small_dir):
    docs = spark.read.parquet(small_dir + "/documents.parquet")
    out = C.run(spark, small_dir)
    assert out.columns == [*docs.columns, "piece_ids", "n_byte_pieces"]
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 0.4 * docs.count() < len(ids) < docs.count()


def test_stages_take_awkward_and_empty_documents(spark, small_dir, tmp_path):
    for name, rows in (("awkward", AWKWARD), ("none", [])):
        docs = stored(spark, tmp_path, rows, name, clash=True)
        columns = docs.columns
        for k, (_, stage) in enumerate(C.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, small_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < len(C.STAGES) - 1:
                assert docs.columns == columns
        if not rows:
            assert docs.count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 14))
