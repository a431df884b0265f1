"""The plans that the queries come to: filters and columns reach the scan, and nothing leaves the JVM."""

import re

import pytest

from sluice import queries
from sluice.operators import results
from sluice.operators.mask import masked_frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(queries.ask(spark, sf, "SELECT [c_custkey] FROM dbo.customer WHERE c_nationkey = @n", {"n": 3}))
    assert "EqualTo(c_nationkey,3)" in text and "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text and "Exchange" not in text


def test_masks_are_one_projection(spark, sf):
    df = masked_frame(results.normalized(queries.ask(spark, sf, "SELECT c_custkey, c_name AS email FROM customer WHERE c_acctbal > 0")), "s")
    assert not re.search("Exchange|Python|Arrow|Window", plan(df)) and "GreaterThan(c_acctbal,0.0)" in plan(df)


def test_a_cap_comes_before_the_window(spark, sf):
    df = results.bounded(results.capped(results.normalized(queries.ask(spark, sf, "SELECT l_orderkey FROM lineitem ORDER BY l_orderkey")), 50), 1000)
    assert "TakeOrderedAndProject(limit=50" in plan(df)


@pytest.mark.parametrize("name", ["update_cow", "delete_cow"])
def test_rewrites_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(queries.queries()[name](spark, sf))


def test_partial_aggregation_before_the_shuffle(spark, sf):
    text = plan(queries.queries()["agg_group"](spark, sf))
    assert text.index("HashAggregate") < text.index("Exchange hashpartitioning") < text.rindex("HashAggregate") and "partial_count" in text


@pytest.mark.parametrize("name", sorted(queries.READS))
def test_reads_stay_in_the_jvm(spark, sf, name):
    assert not re.search("Python|ArrowEval|CartesianProduct", plan(queries.queries()[name](spark, sf)))


def test_interval_joins_are_hash_joins(spark, sf):
    assert not re.search("NestedLoop|Cartesian", plan(queries.queries()["interval_join"](spark, sf)))


def test_a_merge_shuffles_only_pairs(spark, sf):
    """With a small source the table isn't shuffled: the window is over the rows that match, by the key of the join."""
    text = plan(queries.queries()["merge_repeats_update"](spark, sf))
    assert text.count("row_number() windowspecdefinition") == 2 and "FullOuter" not in text
