"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

from oracle_util import compare, duck
from staylens.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
WITH_SQL = sorted(ORACLES)
WITHOUT_SQL = sorted(set(queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    compare(queries()[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows_only(spark, name):
    df = queries()[name](spark, SF)
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    assert set(WITHOUT_SQL) == {"a13_insight_payloads", "e1_embed_booking_documents"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.queries()) >= set(queries())
