"""Values that the tables do not hold: infinity, huge and tiny amounts, null lead times."""

import math

import pytest
from pyspark.sql import functions as F

from staylens.functions.columns import exact_avg, exact_sum
from staylens.operators import insights, routing
from staylens.plans import context

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("values", [
    [100.0, 0.004, 0.004], [1e17, 1.5, 2.25], [1e17] * 4, [0.1] * 1000, [1e25, 3.0], [None, 2.0], [None], [],
    [100.0, math.inf, 1e17, 0.004], [-math.inf, 5.0], [4e-7] * 1000, [1.0000004, 2.5, 4e-7, -3e-9],
])
def test_sum_and_average_take_every_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = df.agg(exact_sum("x").alias("s"), exact_avg("x").alias("a"), F.count("x").alias("n")).first()
    present = [v for v in values if v is not None]
    if not present:
        assert got["s"] is None and got["a"] is None
    else:
        assert got["s"] == pytest.approx(math.fsum(present), rel=1e-15)
        assert got["a"] == pytest.approx(math.fsum(present) / len(present), rel=1e-15)


@pytest.fixture(scope="module")
def odd_bookings(spark):
    b = context.bookings(spark, SF)
    k = F.pmod(F.xxhash64("booking_id"), F.lit(97))
    return b.withColumn("lead_time", F.when(k % 4 != 0, F.col("lead_time"))) \
        .withColumn("adr", F.when(k == 1, F.lit(1e17)).when(k == 2, F.lit(0.004)).otherwise(F.col("adr"))) \
        .withColumn("revenue", F.when(k == 3, F.lit(math.inf)).when(k == 5, F.lit(0.004)).otherwise(F.col("revenue")))


PAIRS = [
    insights.revenue_trends, insights.cancellation_rates, insights.geographical_distribution,
    insights.lead_time_histogram, insights.adr_by_hotel_room, insights.market_segment_analysis,
    insights.day_of_month_distribution, insights.room_type_distribution, routing.revenue_grid,
    routing.cancellation_by_country, routing.average_price_by_hotel, routing.room_type_popularity,
    routing.country_distribution, routing.stay_duration_by_hotel, routing.lead_time_by_hotel,
]


@pytest.fixture(scope="module")
def cube(odd_bookings):
    return insights.InsightCube(odd_bookings)


@pytest.mark.parametrize("fn", PAIRS, ids=lambda f: f.__name__)
def test_direct_and_cube_agree(fn, odd_bookings, cube):
    def rows(df):
        return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) and abs(v) < 1e9 else
                             f"{v:.12e}" if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()),
                      key=repr)
    assert rows(fn(odd_bookings)) == rows(fn(cube))


def test_null_lead_times_weigh_nothing(odd_bookings):
    got = {r["hotel"]: r["avg_lead_time"] for r in routing.lead_time_by_hotel(odd_bookings).collect()}
    want = {r["hotel"]: r["a"] for r in odd_bookings.groupBy("hotel").agg(F.avg("lead_time").alias("a")).collect()}
    assert got == pytest.approx(want)
    mean = insights.lead_time_stats(odd_bookings).first()["mean_lead_time"]
    assert mean == pytest.approx(odd_bookings.where("is_canceled = 0").agg(F.avg("lead_time")).first()[0])


def test_payload_fields_aggregate_the_bookings_once(spark, sf_small, monkeypatch):
    from staylens.plans import q_stores

    made, cube = [], q_stores.insight_cube
    monkeypatch.setattr(q_stores, "insight_cube", lambda *a: made.append(cube(*a)) or made[-1])
    q_stores.a13_payload_fields(spark, sf_small)
    assert len(made) == 1
