"""Invariants over the insight results (sf0.001 tables)."""

import pytest
from pyspark.sql import functions as F

from staylens.operators import insights as A
from staylens.operators import views as B
from staylens.plans.context import bookings


@pytest.fixture(scope="module")
def b(spark, sf_small):
    return bookings(spark, sf_small).persist()


def test_confirmed_plus_canceled_is_total(b):
    for r in A.room_type_distribution(b).collect():
        assert r.confirmed_bookings + r.canceled_bookings == r.booking_count
    for r in A.geographical_distribution(b).collect():
        assert r.confirmed_bookings + r.canceled_bookings == r.booking_count


def test_monthly_revenue_adds_up(b):
    months = sum(r.total_revenue for r in A.revenue_trends(b).collect())
    total = b.where("is_canceled = 0").agg(F.sum(F.col("revenue").cast("decimal(18,2)"))).first()[0]
    assert abs(months - float(total)) < 1e-6


def test_bins_plus_zero_lead_is_confirmed(b):
    bins = sum(r.booking_count for r in A.lead_time_bins(b).collect())
    zero = b.where("is_canceled = 0 and lead_time <= 0").count()
    assert bins + zero == b.where("is_canceled = 0").count()


def test_quartiles_ordered(b):
    s = A.lead_time_stats(b).first()
    assert s.min_lead_time <= s.p25_lead_time <= s.median_lead_time <= s.p75_lead_time <= s.p90_lead_time
    assert s.median_lead_time == s.p50_lead_time


def test_golden_counts(b):
    # FIXTURES.md golden counts at sf0.001
    assert b.count() == 1484
    assert b.where("is_canceled = 1").count() == 485
    assert b.where("country = 'Unknown'").count() == 56
    assert b.where("adr <= 0").count() == 28
    bins = [r.booking_count for r in A.lead_time_bins(b).collect()]
    assert bins == [16, 46, 122, 182, 372, 259]
    july = b.where("is_canceled = 0 and arrival_date_year = 2017 and arrival_date_month_num = 7")
    assert july.count() == 10
    assert float(july.agg(F.sum(F.col("revenue").cast("decimal(18,2)"))).first()[0]) == 12089613.25


def test_zero_in_first_bin_flag(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (7, 0), (8, 0), (365, 0), (366, 0), (5, 1)],
                               "lead_time int, is_canceled int")
    default = [r.booking_count for r in A.lead_time_bins(df).collect()]
    inclusive = [r.booking_count for r in A.lead_time_bins(df, zero_in_first_bin=True).collect()]
    assert default == [2, 1, 0, 0, 1, 1]
    assert inclusive == [3, 1, 0, 0, 1, 1]


def test_top_k_ties_broken_by_key(spark):
    df = spark.createDataFrame([("B", 0), ("A", 0), ("C", 0), ("C", 0)], "country string, is_canceled int")
    df = df.withColumn("revenue", F.lit(1.0))
    got = [r.country for r in A.top_countries(df, 2).collect()]
    assert got == ["C", "A"]


def test_most_common_room_share(b):
    r = B.most_common_room(b).first()
    assert r.total_bookings == b.count()
    assert abs(r.share_pct - 100.0 * r.booking_count / r.total_bookings) < 1e-9
