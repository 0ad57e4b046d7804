"""Every query with a SQL twin agrees with it; the plans have the shape they should."""

import pytest

from conftest import SMALL
from furrow.catalog import all_queries, all_sql
from oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_agrees_with_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SMALL), con, all_sql()[name]) is None


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def plan(spark, name):
    return all_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reshape_is_one_stage(spark):
    assert "Exchange" not in plan(spark, "multivalue_long")


def test_top_n_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "top_n_ties")


def test_cells_stay_where_they_are_for_the_thresholds(spark):
    text = plan(spark, "small_scale_class")
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_total_row_comes_from_one_scan(spark):
    assert plan(spark, "pooled_pct_with_total").count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["small_scale_class", "weighted_quantile", "median_strict", "mode_first", "regrid_bilinear", "stack_layers"])
def test_no_single_task_stage(spark, name):
    assert "SinglePartition" not in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "stack_layers")
    assert "l_quantity" in text and "l_extendedprice" not in text
    assert "PushedFilters: [IsNotNull" in plan(spark, "filter_predicates")
