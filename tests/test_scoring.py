"""Scores of assertions: results on a small table, and that rows move by pair once."""

import pytest

from stratadoc.operators import scoring as S

ROWS = [(1, "slot.inventory", "PASS"), (1, "slot.inventory", "FAIL"), (1, "protected.object", "UNKNOWN"), (1, "other", "PASS"), (2, "protected.style", "NOT_APPLICABLE"), (2, None, "PASS"), (None, "protected.style", "PASS")]


@pytest.fixture(scope="module")
def assertions(spark):
    return spark.createDataFrame(ROWS, "pair_id long, dimension string, status string")


def test_dimensions_views_and_coverage(assertions):
    scores = {(r.pair_id, r.dimension): (r.score, r.passed, r.failed, r.unknown, r.not_applicable) for r in S.dimension_scores(assertions).collect()}
    assert len(scores) == 24 and {k: v for k, v in scores.items() if any(v)} == {(1, "slot.inventory"): (10.0, 1, 1, 0, 0), (1, "protected.object"): (0.0, 0, 0, 1, 0), (2, "protected.style"): (15.0, 0, 0, 0, 1)}
    views = {(r.pair_id, r.view): (r.score, r.weight, r.passed, r.failed, r.unknown, r.not_applicable) for r in S.view_scores(S.dimension_scores(assertions)).collect()}
    assert views == {
        (1, "slot"): (10.0, 50.0, 1, 1, 0, 0), (1, "protected"): (0.0, 50.0, 0, 0, 1, 0), (1, None): (10.0, 100.0, 1, 1, 1, 0),
        (2, "slot"): (0.0, 50.0, 0, 0, 0, 0), (2, "protected"): (15.0, 50.0, 0, 0, 0, 1), (2, None): (15.0, 100.0, 0, 0, 0, 1),
        (None, "slot"): (0.0, 50.0, 0, 0, 0, 0), (None, "protected"): (0.0, 50.0, 0, 0, 0, 0), (None, None): (0.0, 100.0, 0, 0, 0, 0),
    }
    assert {r.pair_id: r.coverage for r in S.coverage_scores(assertions).collect()} == {1: 0.15, 2: 0.15, None: 0.0}


@pytest.mark.parametrize("scores", [S.coverage_scores, lambda a: S.view_scores(S.dimension_scores(a))])
def test_rows_move_by_pair_once(assertions, scores):
    plan = scores(assertions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pair_id") == plan.count("Exchange") == 1 and "Join" not in plan
