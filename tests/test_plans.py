"""Plan-shape guards: no cartesian / nested-loop joins, pruned scans, partial top-n limits."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_metrics_large_single_pruned_scan(spark):
    plan = plan_of(E.queries()["metrics_large"](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if ln.startswith("(") and "Scan parquet" in ln]
    assert len(scans) == 1
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_top_n_limits_before_shuffle(spark):
    plan = plan_of(E.queries()["examples_top_n"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_predictions_without_text_do_not_read_it(spark):
    plan = plan_of(E.queries()["run_summary"](spark, SF_SMALL))
    assert "text:string" not in plan


def test_leakage_broadcasts_small_reference(spark):
    plan = plan_of(E.queries()["ngram_overlap"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_vote_alignment_is_one_aggregation(spark):
    plan = plan_of(E.queries()["weighted_vote"](spark, SF_SMALL))
    joins = [ln for ln in plan.splitlines() if ln.startswith("(") and "Join" in ln and "Broadcast" not in ln]
    assert joins == []  # no shuffle joins: common ids and alignment come from the same groupBy
