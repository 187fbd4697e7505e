"""Plan checks: no Python UDFs; every query has an oracle unless documented."""

import __spark_entry__ as E
from sentable.plans import load_all

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")
NO_ORACLE = set()
CHEAP = ["parse_samples", "split", "fit_experts", "tokenize_cells", "impute_prompt", "cumulative_weights",
         "encode_labels", "growing_prefix"]


def test_registry_complete():
    q, o = load_all()
    assert set(q) - set(o) == NO_ORACLE
    assert len(q) >= 70 and set(q) <= set(E.queries())


def test_no_python_in_plans(spark, small_dir):
    q = E.queries()
    for name in CHEAP:
        plan = q[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in PYTHON_NODES), name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["sid", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    assert df.count() > 0


def test_parse_extraction_not_pushed_into_a_filter(spark, small_dir):
    """keep_if: the regex extraction runs once in a projection, never inside a
    Filter pushed down under the exchange that spreads the scan."""
    plan = E.queries()["parse_strict"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [ln for ln in plan.splitlines() if "Filter" in ln and "regexp_extract_all" in ln]


def test_draw_chain_has_no_nested_loop_join(spark, small_dir):
    for name in ("sample_fixed", "synthesize"):
        plan = E.queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
