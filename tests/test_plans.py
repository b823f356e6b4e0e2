"""Plans that would hold at scale: no nested loops, no Python, filters at the files."""

import pytest

from siltstone.functions import scalars
from siltstone.operators import aggregates, ctes, joins, scans, setops, windows

FAMILIES = {n: q for f in (scans, joins, aggregates, windows, setops, ctes, scalars) for n, q in f.family.queries().items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(FAMILIES) - {"join_cross"}))
def test_no_pairs_and_no_python(name, spark, sf):
    text = plan(FAMILIES[name](spark, sf))
    assert not any(x in text for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"))


def test_filters_and_columns_reach_the_files(spark, sf):
    text = plan(FAMILIES["cte_single"](spark, sf))
    assert "GreaterThan(o_totalprice,150000.0)" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


def test_a_diamond_is_one_scan_and_one_shuffle(spark, sf):
    text = plan(FAMILIES["cte_diamond"](spark, sf))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_top_k_keeps_k_rows_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(FAMILIES["topk_per_group"](spark, sf))
