"""Every registered query of the library itself against its SQL."""

import pytest

from siltstone.plans import registry

from .compare import same


def test_each_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"agg_approx_distinct"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf, duck):
    same(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


def test_approximate_count_is_near(spark, sf):
    import pyspark.sql.functions as F

    got = {r[0]: r[1] for r in registry.QUERIES["agg_approx_distinct"](spark, sf).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey")).collect()}
    assert all(abs(got[k] - n) <= 0.2 * n for k, n in want.items())


def test_filters_and_columns_reach_the_files(spark, sf):
    plan = registry.QUERIES["filter_compare"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan and "p_comment" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
