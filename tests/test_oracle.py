"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from tallyframe.plans import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "test"}


# Matrix products, the caller's model function and the t quantile run in Arrow batches.
ARROW = {
    "mean_ci_t", "encode_beliefs", "reparameterize", "score_grid", "score_grid_collapsed", "simulate", "rate_tasks",
    "rating_summary", "answer_tasks_personas", "answer_tasks_general", "blend_scores", "blend_scores_generative",
    "simulate_references", "simulate_sparse",
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))
    assert name in ARROW or not any(node in plan for node in ("EvalPython", "MapInArrow", "MapInPandas"))
    same, ours, theirs, only_ours, only_theirs = compare(df, con, catalog.ORACLES[name])
    assert same
    assert ours == theirs and ours > 0
    assert not only_ours and not only_theirs, (only_ours[:3], only_theirs[:3])
