"""Registered queries: dashboard views."""

from __future__ import annotations

from staylens.operators import views as B
from staylens.plans.context import bookings
from staylens.plans.oracle import mavg, msum, with_bookings
from staylens.plans.q_insights import GEO_SQL, ROOM_SQL, SEGMENT_SQL
from staylens.plans.registry import register

_TRENDS = f"""
SELECT arrival_date_year, arrival_date_month_num,
       CASE WHEN arrival_date_month_num IS NOT NULL
            THEN printf('%04d-%02d', arrival_date_year, arrival_date_month_num) END AS date,
       {msum('revenue')} AS total_revenue
FROM bookings WHERE is_canceled = 0 GROUP BY arrival_date_year, arrival_date_month_num"""


@register("b1_revenue_kpis", with_bookings(f"""
SELECT {msum('total_revenue')} AS total_revenue,
       {msum('total_revenue')} / CAST(COUNT(*) AS DOUBLE) AS avg_monthly_revenue,
       arg_max(date, (total_revenue, -(arrival_date_year * 100 + COALESCE(arrival_date_month_num, 0))))
         AS best_month
FROM ({_TRENDS}) t"""))
def b1_revenue_kpis(spark, sf_dir):
    return B.revenue_kpis(bookings(spark, sf_dir))


_GEO_RATE = f"""
SELECT *, CAST(canceled_bookings AS DOUBLE) / CAST(booking_count AS DOUBLE) * 100.0 AS cancellation_rate_pct
FROM ({GEO_SQL}) g"""


@register("b2_geo_with_rate", with_bookings(_GEO_RATE))
def b2_geo_with_rate(spark, sf_dir):
    return B.geo_with_rate(bookings(spark, sf_dir))


@register("b3_top_countries_by_revenue", with_bookings(
    f"SELECT * FROM ({_GEO_RATE}) x ORDER BY total_revenue DESC, country LIMIT 10"))
def b3_top_countries_by_revenue(spark, sf_dir):
    return B.top_countries_by_revenue(bookings(spark, sf_dir), 10)


SEARCH_TEXT = "Nation_1"


@register("b4_search_countries", with_bookings(
    f"SELECT * FROM ({_GEO_RATE}) x WHERE strpos(lower(country), lower('{SEARCH_TEXT}')) > 0"))
def b4_search_countries(spark, sf_dir):
    return B.search_countries(bookings(spark, sf_dir), SEARCH_TEXT)


@register("b4_search_countries_blank", with_bookings(
    f"SELECT * FROM ({_GEO_RATE}) x ORDER BY booking_count DESC, country LIMIT 20"))
def b4_search_countries_blank(spark, sf_dir):
    return B.search_countries(bookings(spark, sf_dir), "")


@register("b5_rates_per_hotel", with_bookings(f"""
SELECT hotel, reserved_room_type, avg_daily_rate, booking_count,
       row_number() OVER (PARTITION BY hotel ORDER BY avg_daily_rate DESC, reserved_room_type) AS rate_rank
FROM (SELECT hotel, reserved_room_type, {mavg('adr')} AS avg_daily_rate, COUNT(*) AS booking_count
      FROM bookings WHERE is_canceled = 0 AND adr > 0 GROUP BY hotel, reserved_room_type) a"""))
def b5_rates_per_hotel(spark, sf_dir):
    return B.rates_per_hotel(bookings(spark, sf_dir))


@register("b6_segment_scatter", with_bookings(f"""
SELECT market_segment, avg_daily_rate, cancellation_rate, booking_count, avg_stay_duration
FROM ({SEGMENT_SQL}) s"""))
def b6_segment_scatter(spark, sf_dir):
    return B.segment_scatter(bookings(spark, sf_dir))


@register("b7_room_with_rate", with_bookings(f"""
SELECT *, CAST(canceled_bookings AS DOUBLE) / CAST(booking_count AS DOUBLE) * 100.0 AS cancellation_rate_pct
FROM ({ROOM_SQL}) r ORDER BY booking_count DESC, reserved_room_type"""))
def b7_room_with_rate(spark, sf_dir):
    return B.room_with_rate(bookings(spark, sf_dir))


@register("b8_most_common_room", with_bookings(f"""
SELECT arg_min(reserved_room_type, (-booking_count, reserved_room_type)) AS reserved_room_type,
       MAX(booking_count) AS booking_count, SUM(booking_count)::BIGINT AS total_bookings,
       CAST(MAX(booking_count) AS DOUBLE) / CAST(SUM(booking_count) AS DOUBLE) * 100.0 AS share_pct
FROM ({ROOM_SQL}) r"""))
def b8_most_common_room(spark, sf_dir):
    return B.most_common_room(bookings(spark, sf_dir))
