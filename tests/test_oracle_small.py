"""DuckDB oracle on sf0.001 for a representative subset (the driver runs all
queries at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from oracle_check import TABLES, digest  # noqa: E402

import __spark_entry__ as E  # noqa: E402

SUBSET = ["stringify", "parse_strict", "parse_terminated", "parse_lenient", "parse_report", "split", "fit_labels",
          "decode_labels", "start_categorical", "start_continuous", "permuted_row_text", "fit_experts",
          "sample_fixed", "sample_random_order", "eval_loss", "impute", "tokenize_cells", "pad_batch",
          "synthesize", "stream_parse", "snapshot_roundtrip", "read_split", "sample_prompts"]


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_oracle(spark, small_dir, con, name):
    sdf = E.queries()[name](spark, small_dir)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
