"""Registered queries: cleaning (C) and insight aggregations (A)."""

from __future__ import annotations

from staylens.operators import clean as C
from staylens.operators import insights as A
from staylens.plans.context import bookings, insight_cube, raw
from staylens.plans.oracle import avg_int, mavg, msum, pct, with_bookings, with_raw
from staylens.plans.registry import register

CLEAN_COLS = ", ".join(C.CLEAN_COLUMNS)


# --- cleaning -------------------------------------------------------------

@register("c1_impute", with_raw("""
SELECT booking_id, COALESCE(country, 'Unknown') AS country, COALESCE(agent, 0.0) AS agent,
       COALESCE(company, 0.0) AS company, COALESCE(children, 0.0) AS children FROM raw"""))
def c1_impute(spark, sf_dir):
    return C.impute(raw(spark, sf_dir)).select(
        "booking_id", "country", "agent", "company", "children")


@register("c2_drop_empty_bookings", with_raw("""
SELECT booking_id, adults, COALESCE(children, 0.0) AS children, babies FROM raw
WHERE NOT (adults IS NOT DISTINCT FROM 0 AND COALESCE(children, 0.0) IS NOT DISTINCT FROM 0
           AND babies IS NOT DISTINCT FROM 0)"""))
def c2_drop_empty_bookings(spark, sf_dir):
    return (C.drop_empty_bookings(C.impute(raw(spark, sf_dir)))
            .select("booking_id", "adults", "children", "babies"))


@register("c3_replace_meal", with_raw("""
SELECT booking_id, CASE WHEN meal = 'Undefined' THEN 'SC' ELSE meal END AS meal FROM raw"""))
def c3_replace_meal(spark, sf_dir):
    return C.replace_meal(raw(spark, sf_dir)).select("booking_id", "meal")


@register("c4_c8_derived_columns", with_bookings("""
SELECT booking_id, arrival_date_month_num, arrival_date, adr, total_stay_duration, revenue
FROM bookings"""))
def c4_c8_derived_columns(spark, sf_dir):
    return bookings(spark, sf_dir).select(
        "booking_id", "arrival_date_month_num", "arrival_date", "adr",
        "total_stay_duration", "revenue")


@register("c9_clean_bookings", with_bookings(f"SELECT {CLEAN_COLS} FROM bookings"))
def c9_clean_bookings(spark, sf_dir):
    return bookings(spark, sf_dir)


_NUM = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


@register("c10_quality_report", with_raw(f"""
SELECT COUNT(*) AS rows_in,
       COUNT(*) FILTER (WHERE d) AS rows_dropped,
       COUNT(*) FILTER (WHERE NOT d) AS rows_out,
       COUNT(*) FILTER (WHERE NOT d AND country IS NULL) AS country_imputed,
       COUNT(*) FILTER (WHERE NOT d AND agent IS NULL) AS agent_imputed,
       COUNT(*) FILTER (WHERE NOT d AND company IS NULL) AS company_imputed,
       COUNT(*) FILTER (WHERE NOT d AND children IS NULL) AS children_imputed,
       COUNT(*) FILTER (WHERE NOT d AND meal = 'Undefined') AS meal_replaced,
       COUNT(*) FILTER (WHERE NOT d AND (v IS NULL OR isnan(v))) AS adr_defaulted,
       COUNT(*) FILTER (WHERE NOT d AND m IS NULL) AS month_unknown,
       COUNT(*) FILTER (WHERE NOT d AND (m IS NULL OR TRY_CAST(make_date(arrival_date_year, m,
             arrival_date_day_of_month) AS DATE) IS NULL)) AS arrival_date_null
FROM (SELECT *,
        (adults IS NOT DISTINCT FROM 0 AND COALESCE(children, 0.0) IS NOT DISTINCT FROM 0
         AND babies IS NOT DISTINCT FROM 0) AS d,
        CASE WHEN regexp_full_match(trim(adr), '{_NUM}') THEN TRY_CAST(trim(adr) AS DOUBLE) END AS v,
        CASE arrival_date_month WHEN 'January' THEN 1 WHEN 'February' THEN 2
              WHEN 'March' THEN 3 WHEN 'April' THEN 4 WHEN 'May' THEN 5 WHEN 'June' THEN 6
              WHEN 'July' THEN 7 WHEN 'August' THEN 8 WHEN 'September' THEN 9
              WHEN 'October' THEN 10 WHEN 'November' THEN 11 WHEN 'December' THEN 12 END AS m
      FROM raw) t"""))
def c10_quality_report(spark, sf_dir):
    return C.quality_report(raw(spark, sf_dir))


# --- insights -------------------------------------------------------------

@register("a1_revenue_trends", with_bookings(f"""
SELECT arrival_date_year, arrival_date_month_num,
       CASE WHEN arrival_date_month_num IS NOT NULL
            THEN printf('%04d-%02d', arrival_date_year, arrival_date_month_num) END AS date,
       {msum('revenue')} AS total_revenue, COUNT(*) AS booking_count
FROM bookings WHERE is_canceled = 0
GROUP BY arrival_date_year, arrival_date_month_num
ORDER BY arrival_date_year, arrival_date_month_num"""))
def a1_revenue_trends(spark, sf_dir):
    return A.shown(A.revenue_trends(bookings(spark, sf_dir)), "revenue_trends")


_CANCEL_SQL = f"""
SELECT hotel, COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       COUNT(*) AS total_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate
FROM bookings"""


@register("a2_cancellation_by_hotel", with_bookings(_CANCEL_SQL + " GROUP BY hotel"))
def a2_cancellation_by_hotel(spark, sf_dir):
    return A.cancellation_by_hotel(bookings(spark, sf_dir))


@register("a3_cancellation_overall", with_bookings(f"""
SELECT COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings, COUNT(*) AS total_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate
FROM bookings"""))
def a3_cancellation_overall(spark, sf_dir):
    return A.cancellation_overall(bookings(spark, sf_dir))


@register("a2_a3_cancellation_rates", with_bookings(f"""
SELECT CASE WHEN GROUPING(hotel) = 1 THEN 'overall' ELSE 'hotel' END AS level, hotel,
       COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings, COUNT(*) AS total_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate
FROM bookings GROUP BY GROUPING SETS ((hotel), ())"""))
def a2_a3_cancellation_rates(spark, sf_dir):
    return A.cancellation_rates(bookings(spark, sf_dir))


_GEO_SQL = f"""
SELECT country, COUNT(*) AS booking_count,
       COUNT(*) FILTER (WHERE is_canceled = 0) AS confirmed_bookings,
       COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       {msum('CASE WHEN is_canceled = 0 THEN revenue ELSE 0.0 END')} AS total_revenue
FROM bookings GROUP BY country"""


@register("a4_geographical_distribution", with_bookings(_GEO_SQL + " ORDER BY booking_count DESC, country"))
def a4_geographical_distribution(spark, sf_dir):
    return A.shown(A.geographical_distribution(bookings(spark, sf_dir)), "geographical_distribution")


@register("a5_top_countries", with_bookings(f"""
SELECT country, booking_count FROM ({_GEO_SQL}) g
ORDER BY booking_count DESC, country LIMIT 20"""))
def a5_top_countries(spark, sf_dir):
    return A.top_countries(bookings(spark, sf_dir), 20)


_HIST_SQL = """
SELECT lead_time, COUNT(*) AS booking_count FROM bookings WHERE is_canceled = 0
GROUP BY lead_time"""


@register("a6_lead_time_histogram", with_bookings(_HIST_SQL + " ORDER BY lead_time"))
def a6_lead_time_histogram(spark, sf_dir):
    return A.shown(A.lead_time_histogram(bookings(spark, sf_dir)), "lead_time_histogram")


@register("a7_lead_time_stats", with_bookings("""
SELECT MIN(lead_time) AS min_lead_time, MAX(lead_time) AS max_lead_time,
       CAST(SUM(lead_time) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_lead_time,
       quantile_cont(lead_time, 0.5) AS median_lead_time,
       quantile_cont(lead_time, 0.25) AS p25_lead_time,
       quantile_cont(lead_time, 0.5) AS p50_lead_time,
       quantile_cont(lead_time, 0.75) AS p75_lead_time,
       quantile_cont(lead_time, 0.9) AS p90_lead_time
FROM bookings WHERE is_canceled = 0"""))
def a7_lead_time_stats(spark, sf_dir):
    return A.lead_time_stats(bookings(spark, sf_dir))


_BINS_VALUES = """
bins(bin_order, bin) AS (VALUES (1, '0-7 days'), (2, '8-30 days'), (3, '31-90 days'),
  (4, '91-180 days'), (5, '181-365 days'), (6, '365+ days'))"""
_BIN_CASE = """CASE WHEN lead_time > 0 AND lead_time <= 7 THEN 1
  WHEN lead_time > 7 AND lead_time <= 30 THEN 2 WHEN lead_time > 30 AND lead_time <= 90 THEN 3
  WHEN lead_time > 90 AND lead_time <= 180 THEN 4 WHEN lead_time > 180 AND lead_time <= 365 THEN 5
  WHEN lead_time > 365 THEN 6 END"""


@register("a8_lead_time_bins", with_bookings(f"""
SELECT CAST(bins.bin_order AS INTEGER) AS bin_order, bins.bin,
       CAST(COALESCE(c.booking_count, 0) AS BIGINT) AS booking_count
FROM bins LEFT JOIN (
  SELECT {_BIN_CASE} AS bin_order, COUNT(*) AS booking_count
  FROM bookings WHERE is_canceled = 0 GROUP BY 1) c ON c.bin_order = bins.bin_order
ORDER BY bins.bin_order""", _BINS_VALUES))
def a8_lead_time_bins(spark, sf_dir):
    return A.shown(A.lead_time_bins(bookings(spark, sf_dir)), "lead_time_bins")


@register("a9_adr_by_hotel_room", with_bookings(f"""
SELECT hotel, reserved_room_type, {mavg('adr')} AS avg_daily_rate, COUNT(*) AS booking_count
FROM bookings WHERE is_canceled = 0 AND adr > 0
GROUP BY hotel, reserved_room_type ORDER BY hotel, avg_daily_rate DESC"""))
def a9_adr_by_hotel_room(spark, sf_dir):
    return A.shown(A.adr_by_hotel_room(bookings(spark, sf_dir)), "adr_by_hotel_room")


_SEGMENT_SQL = f"""
SELECT market_segment, COUNT(*) AS booking_count,
       COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate,
       {mavg('adr')} AS avg_daily_rate, {avg_int('total_stay_duration')} AS avg_stay_duration
FROM bookings GROUP BY market_segment"""


@register("a10_market_segment_analysis", with_bookings(_SEGMENT_SQL + " ORDER BY booking_count DESC"))
def a10_market_segment_analysis(spark, sf_dir):
    return A.shown(A.market_segment_analysis(bookings(spark, sf_dir)), "market_segment_analysis")


@register("a11_day_of_month_distribution", with_bookings("""
SELECT arrival_date_day_of_month, COUNT(*) AS booking_count FROM bookings WHERE is_canceled = 0
GROUP BY arrival_date_day_of_month ORDER BY arrival_date_day_of_month"""))
def a11_day_of_month_distribution(spark, sf_dir):
    return A.shown(A.day_of_month_distribution(bookings(spark, sf_dir)), "day_of_month_distribution")


_ROOM_SQL = f"""
SELECT reserved_room_type, COUNT(*) AS booking_count,
       COUNT(*) FILTER (WHERE is_canceled = 0) AS confirmed_bookings,
       COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       {mavg('adr')} AS avg_daily_rate, {avg_int('total_stay_duration')} AS avg_stay_duration
FROM bookings GROUP BY reserved_room_type"""


@register("a12_room_type_distribution", with_bookings(_ROOM_SQL + " ORDER BY booking_count DESC"))
def a12_room_type_distribution(spark, sf_dir):
    return A.shown(A.room_type_distribution(bookings(spark, sf_dir)), "room_type_distribution")


# shared SQL pieces for other query modules
GEO_SQL = _GEO_SQL
ROOM_SQL = _ROOM_SQL
SEGMENT_SQL = _SEGMENT_SQL
HIST_SQL = _HIST_SQL
BINS_VALUES = _BINS_VALUES
BIN_CASE = _BIN_CASE


@register("a13_insight_payloads")
def a13_insight_payloads(spark, sf_dir):
    """The five stored insight documents (JSON text), all from one bookings scan.
    JSON number text differs between engines, so the check is rows-only; the
    payload structure is tested against the insight results."""
    from staylens.operators.payloads import insight_payloads

    return insight_payloads(insight_cube(spark, sf_dir))
