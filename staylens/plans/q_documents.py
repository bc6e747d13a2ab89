"""Registered queries: documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.render import sql_text
from staylens.operators import documents as D
from staylens.plans.context import bookings, insight_cube
from staylens.plans.oracle import mavg, msum, pct, with_bookings
from staylens.plans.q_insights import BIN_CASE, BINS_VALUES, GEO_SQL, ROOM_SQL, SEGMENT_SQL
from staylens.plans.registry import register

BOOKING_DOCS_CTE = f"""
bdocs AS (
  SELECT 'booking_' || CAST(booking_id AS VARCHAR) AS id, booking_id,
         {sql_text(D.BOOKING_LINES)} AS document
  FROM (SELECT *, CASE WHEN is_canceled = 1 THEN 'Canceled' ELSE 'Confirmed' END AS status
        FROM bookings) b)"""

_TRENDS = f"""
SELECT CASE WHEN arrival_date_month_num IS NOT NULL
            THEN printf('%04d-%02d', arrival_date_year, arrival_date_month_num) END AS date,
       {msum('revenue')} AS total_revenue, COUNT(*) AS booking_count
FROM bookings WHERE is_canceled = 0 GROUP BY arrival_date_year, arrival_date_month_num"""

REVENUE_DOCS = f"""
SELECT 'revenue_trend_' || COALESCE(date, 'None') AS id, 'revenue_trends' AS insight_type,
       {sql_text(D.REVENUE_DOC)} AS document
FROM (SELECT *, COALESCE(total_revenue / CAST(booking_count AS DOUBLE), 0.0) AS avg_revenue
      FROM ({_TRENDS}) t) t"""

_RATES = f"""
SELECT CASE WHEN GROUPING(hotel) = 1 THEN 'overall' ELSE 'hotel' END AS level, hotel,
       COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings, COUNT(*) AS total_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate
FROM bookings GROUP BY GROUPING SETS ((hotel), ())"""

CANCEL_DOCS = f"""
SELECT CASE WHEN level = 'overall' THEN 'cancellation_rate_overall' ELSE 'cancellation_rate_' || hotel END AS id,
       'cancellation_rate' AS insight_type,
       CASE WHEN level = 'overall' THEN {sql_text(D.CANCEL_OVERALL_DOC)}
            ELSE {sql_text(D.CANCEL_HOTEL_DOC)} END AS document
FROM ({_RATES}) r"""

GEO_DOCS = f"""
SELECT 'geo_dist_' || country AS id, 'geographical_distribution' AS insight_type,
       {sql_text(D.GEO_DOC)} AS document
FROM (SELECT *, CAST(canceled_bookings AS DOUBLE) / CAST(booking_count AS DOUBLE) * 100.0 AS cancel_pct
      FROM ({GEO_SQL}) g WHERE booking_count > 10) g"""

_STATS = """
SELECT MIN(lead_time) AS min_lead_time, MAX(lead_time) AS max_lead_time,
       CAST(SUM(lead_time) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_lead_time,
       quantile_cont(lead_time, 0.5) AS median_lead_time, quantile_cont(lead_time, 0.25) AS p25_lead_time,
       quantile_cont(lead_time, 0.75) AS p75_lead_time, quantile_cont(lead_time, 0.9) AS p90_lead_time
FROM bookings WHERE is_canceled = 0"""

_BINS = f"""
SELECT bins.bin_order, bins.bin, CAST(COALESCE(c.booking_count, 0) AS BIGINT) AS booking_count
FROM bins LEFT JOIN (SELECT {BIN_CASE} AS bin_order, COUNT(*) AS booking_count
                     FROM bookings WHERE is_canceled = 0 GROUP BY 1) c ON c.bin_order = bins.bin_order"""

LEAD_DOCS = f"""
SELECT 'lead_time_stats' AS id, 'lead_time_distribution' AS insight_type,
       {sql_text(D.LEAD_STATS_DOC)} AS document FROM ({_STATS}) s
UNION ALL
SELECT 'lead_time_dist_' || bin, 'lead_time_distribution', {sql_text(D.LEAD_BIN_DOC)} FROM ({_BINS}) b"""

ADR_DOCS = f"""
SELECT 'adr_' || hotel || '_' || reserved_room_type AS id, 'adr_by_room_type' AS insight_type,
       {sql_text(D.ADR_DOC)} AS document
FROM (SELECT hotel, reserved_room_type, {mavg('adr')} AS avg_daily_rate, COUNT(*) AS booking_count
      FROM bookings WHERE is_canceled = 0 AND adr > 0 GROUP BY hotel, reserved_room_type) a"""

SEGMENT_DOCS = f"""
SELECT 'segment_' || market_segment AS id, 'market_segment_analysis' AS insight_type,
       {sql_text(D.SEGMENT_DOC)} AS document FROM ({SEGMENT_SQL}) s"""

ROOM_SUMMARY_DOCS = f"""
SELECT 'room_type_summary' AS id, 'room_type_distribution' AS insight_type,
       {sql_text(D.ROOM_SUMMARY_DOC)} AS document
FROM (SELECT arg_min(reserved_room_type, (-booking_count, reserved_room_type)) AS reserved_room_type,
             MAX(booking_count) AS booking_count, SUM(booking_count)::BIGINT AS total_bookings,
             CAST(MAX(booking_count) AS DOUBLE) / CAST(SUM(booking_count) AS DOUBLE) * 100.0 AS share_pct
      FROM ({ROOM_SQL}) r) m"""

ROOM_DOCS = f"""
SELECT 'room_type_' || reserved_room_type AS id, 'room_type_distribution' AS insight_type,
       {sql_text(D.ROOM_DOC)} AS document FROM ({ROOM_SQL}) r"""

INSIGHT_DOCS = " UNION ALL ".join(
    f"SELECT * FROM ({x}) d" for x in (REVENUE_DOCS, CANCEL_DOCS, GEO_DOCS, LEAD_DOCS, ADR_DOCS,
                                       SEGMENT_DOCS, ROOM_SUMMARY_DOCS, ROOM_DOCS))
INSIGHT_DOCS_CTE = f"idocs AS ({INSIGHT_DOCS})"


@register("d1_booking_documents", with_bookings("SELECT id, document FROM bdocs", BOOKING_DOCS_CTE))
def d1_booking_documents(spark, sf_dir):
    return D.booking_documents(bookings(spark, sf_dir)).select("id", "document")


@register("d2_booking_metadata", with_bookings("""
SELECT 'booking_' || CAST(booking_id AS VARCHAR) AS id, hotel, arrival_date_year AS year,
       arrival_date_month AS month, country, is_canceled = 1 AS is_canceled, revenue, adr
FROM bookings"""))
def d2_booking_metadata(spark, sf_dir):
    d = D.booking_documents(bookings(spark, sf_dir))
    return d.select("id", *[F.col(f"metadata.{c}").alias(c) for c in
                            ("hotel", "year", "month", "country", "is_canceled", "revenue", "adr")])


def _reg(name, sql, fn, needs_bins=False):
    extra = (BINS_VALUES,) if needs_bins else ()

    @register(name, with_bookings(sql, *extra))
    def q(spark, sf_dir):
        return fn(bookings(spark, sf_dir)).select("id", "insight_type", "document")
    return q


_reg("d3_revenue_documents", REVENUE_DOCS, D.revenue_documents)
_reg("d4_cancellation_documents", CANCEL_DOCS, D.cancellation_documents)
_reg("d5_geo_documents", GEO_DOCS, D.geo_documents)
_reg("d6_lead_time_documents", LEAD_DOCS, D.lead_time_documents, needs_bins=True)
_reg("d7_adr_documents", ADR_DOCS, D.adr_documents)
_reg("d8_segment_documents", SEGMENT_DOCS, D.segment_documents)
_reg("d9_room_summary_document", ROOM_SUMMARY_DOCS, D.room_summary_document)
_reg("d10_room_documents", ROOM_DOCS, D.room_documents)


@register("d11_insight_documents", with_bookings(INSIGHT_DOCS, BINS_VALUES))
def d11_insight_documents(spark, sf_dir):
    return D.insight_documents(insight_cube(spark, sf_dir)).select("id", "insight_type", "document")


def _r6(c: str) -> str:
    return f"floor({c} * 1000000.0 + 0.5) / 1000000.0"


_ADR = f"""SELECT hotel, reserved_room_type, {mavg('adr')} AS avg_daily_rate, COUNT(*) AS booking_count
           FROM bookings WHERE is_canceled = 0 AND adr > 0 GROUP BY hotel, reserved_room_type"""
METADATA_FIELDS = {"subtype": "string", "level": "string", "date": "string", "hotel": "string", "country": "string",
                   "room_type": "string", "segment": "string", "bin": "string", "most_common_room": "string",
                   "booking_count": "bigint", "total_bookings": "bigint", "canceled_bookings": "bigint",
                   "confirmed_bookings": "bigint", "count": "bigint", "most_common_count": "bigint", "revenue": "double",
                   "total_revenue": "double", "rate": "double", "cancellation_rate": "double", "avg_rate": "double", "avg_duration": "double",
                   "min": "double", "max": "double", "mean": "double", "median": "double"}
_METADATA_PARTS = (
    f"SELECT 'revenue_trend_' || COALESCE(date, 'None') AS id, 'revenue_trends' AS insight_type, date, "
    f"{_r6('total_revenue')} AS revenue, booking_count FROM ({_TRENDS}) t",
    f"SELECT CASE WHEN level = 'overall' THEN 'cancellation_rate_overall' ELSE 'cancellation_rate_' || hotel END AS id, "
    f"'cancellation_rate' AS insight_type, level, CASE WHEN level = 'hotel' THEN hotel END AS hotel, "
    f"{_r6('cancellation_rate')} AS rate, total_bookings, canceled_bookings FROM ({_RATES}) r",
    f"SELECT 'geo_dist_' || country AS id, 'geographical_distribution' AS insight_type, country, booking_count, "
    f"confirmed_bookings, canceled_bookings, {_r6('total_revenue')} AS total_revenue FROM ({GEO_SQL}) g WHERE booking_count > 10",
    "SELECT 'lead_time_stats' AS id, 'lead_time_distribution' AS insight_type, 'statistics' AS subtype, "
    + ", ".join(f"{_r6(f'CAST({n}_lead_time AS DOUBLE)')} AS {n}" for n in ("min", "max", "mean", "median")) + f" FROM ({_STATS}) s",
    f"SELECT 'lead_time_dist_' || bin AS id, 'lead_time_distribution' AS insight_type, 'distribution' AS subtype, bin, "
    f"booking_count AS count FROM ({_BINS}) b",
    f"SELECT 'adr_' || hotel || '_' || reserved_room_type AS id, 'adr_by_room_type' AS insight_type, hotel, "
    f"reserved_room_type AS room_type, {_r6('avg_daily_rate')} AS avg_rate, booking_count FROM ({_ADR}) a",
    f"SELECT 'segment_' || market_segment AS id, 'market_segment_analysis' AS insight_type, market_segment AS segment, "
    f"booking_count, {_r6('cancellation_rate')} AS cancellation_rate, {_r6('avg_daily_rate')} AS avg_rate, "
    f"{_r6('avg_stay_duration')} AS avg_duration FROM ({SEGMENT_SQL}) s",
    f"SELECT 'room_type_summary' AS id, 'room_type_distribution' AS insight_type, 'summary' AS subtype, "
    f"arg_min(reserved_room_type, (-booking_count, reserved_room_type)) AS most_common_room, "
    f"MAX(booking_count) AS most_common_count, SUM(booking_count) AS total_bookings FROM ({ROOM_SQL}) r",
    f"SELECT 'room_type_' || reserved_room_type AS id, 'room_type_distribution' AS insight_type, "
    f"reserved_room_type AS room_type, booking_count, confirmed_bookings, canceled_bookings, "
    f"{_r6('avg_daily_rate')} AS avg_rate, {_r6('avg_stay_duration')} AS avg_duration FROM ({ROOM_SQL}) r")
_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}


@register("d11_insight_metadata", with_bookings(
    "SELECT id, insight_type, " + ", ".join(f'CAST("{n}" AS {_DUCK[k]}) AS "{n}"' for n, k in METADATA_FIELDS.items())
    + " FROM (" + " UNION ALL BY NAME ".join(f"(SELECT * FROM ({x}) x)" for x in _METADATA_PARTS) + ") m", BINS_VALUES))
def d11_insight_metadata(spark, sf_dir):
    """Every field of the insight documents' records, one column each."""
    return D.insight_documents(insight_cube(spark, sf_dir)).select(
        "id", "insight_type", *[D.metadata_field(n, k).alias(n) for n, k in METADATA_FIELDS.items()])
