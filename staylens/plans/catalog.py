"""All registered queries, imported in one place."""

from __future__ import annotations

from staylens.plans import (  # noqa: F401
    q_collection, q_documents, q_evaluation, q_insights, q_retrieval, q_routing, q_stores, q_views,
)
from staylens.plans.registry import ORACLES, QUERIES

SF_SMOKE = "/root/testdata/sf0.001"
FLAGSHIP = "a1_revenue_trends"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def entry(spark):
    return QUERIES[FLAGSHIP](spark, SF_SMOKE)
