"""Plan shape: pushdown, pruning, broadcast of bounded sides, no Python UDF rows."""

import pytest

from staylens.operators import insights as A
from staylens.operators import retrieval as E
from staylens.plans import context
from staylens.plans.catalog import queries
from staylens.sources.tables import raw_bookings, search_queries, search_vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nation_is_broadcast_and_columns_pruned(spark, sf_small):
    p = plan(raw_bookings(spark, sf_small))
    assert "BroadcastHashJoin" in p
    assert "o_comment" not in p  # only needed columns are read


def test_materialized_table_prunes_partitions(spark, sf_small, scratch):
    try:
        context.materialize_bookings(spark, sf_small, "bookings_plan_test")
        b = context.bookings(spark, sf_small)
        q = b.where("arrival_date_year = 2017 and arrival_date_month_num = 7 and hotel = 'City Hotel'")
        p = plan(q)
        assert "PartitionFilters: [isnotnull(arrival_date_year" in p
        assert "PushedFilters: [IsNotNull(hotel), EqualTo(hotel,City Hotel)]" in p
        assert q.count() == q.where("true").count()
        from_table = sorted(A.revenue_trends(b).collect())
    finally:
        context.forget_materialized(sf_small)
    assert from_table == sorted(A.revenue_trends(context.bookings(spark, sf_small)).collect())


def test_dense_knn_has_no_cartesian_product(spark, sf_small):
    p = plan(E.knn(search_queries(spark, sf_small), search_vectors(spark, sf_small), 5))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "MapInPandas" in p


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_row_at_a_time_python_and_no_cross_join(spark, sf_small, name):
    p = plan(queries()[name](spark, sf_small))
    assert "BatchEvalPython" not in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_package_functions_travel_by_value():
    """Executors need no installed copy of the package (e.g. for mapInPandas)."""
    import staylens.operators.retrieval as mod
    from pyspark import cloudpickle

    assert cloudpickle.cloudpickle._should_pickle_by_reference(mod._running_topk) is False
