import pytest

from gneiss.plans import catalogue
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, data, name):
    agree(catalogue.QUERIES[name](spark, data), catalogue.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_stay_in_the_jvm(spark, data):
    """Queries of expressions only run no Python and no Cartesian product."""
    for name in ("bond_length", "frame_transform", "connectivity", "stretch_mode", "sterimol_b1", "correlated_pairs", "class_measures", "durbin_watson"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_scans_read_only_what_they_need(spark, data):
    plan = catalogue.QUERIES["anti_done"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan and "EqualTo(o_orderstatus,P)" in plan
