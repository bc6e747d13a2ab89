"""Registered queries: profiling (P), routing (R1-R5) and routed queries (Q1-Q7)."""

from __future__ import annotations

from staylens.functions.render import sql_line, sql_text
from staylens.operators import profile as P
from staylens.operators import routing as R
from staylens.operators.clean import CLEAN_COLUMNS
from staylens.plans.context import bookings, insight_cube, raw
from staylens.plans.oracle import avg_int, mavg, msum, pct, with_bookings, with_raw
from staylens.plans.registry import register
from staylens.plans.sql_text import QUESTIONS_CTE, ROUTED_CTE
from staylens.sources.files import RAW_SCHEMA
from staylens.sources.tables import questions

RAW_COLS = [f.name for f in RAW_SCHEMA.fields]
RAW_TYPES = {f.name: f.dataType.simpleString() for f in RAW_SCHEMA.fields}
DESCRIBE_COLS = [c for c in RAW_COLS if c not in ("booking_id",)
                 and RAW_TYPES[c] in ("int", "bigint", "double")]


def _r6(expr: str) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0"


# --- profiling ------------------------------------------------------------

@register("p1_preview", with_bookings(
    f"SELECT {', '.join(CLEAN_COLUMNS)} FROM bookings ORDER BY booking_id LIMIT 5"))
def p1_preview(spark, sf_dir):
    return P.preview(bookings(spark, sf_dir), 5)


_TYPES_VALUES = ", ".join(f"('{c}', '{t}')" for c, t in RAW_TYPES.items())


@register("p2_column_info", with_raw(f"""
SELECT u.column_name, u.non_null_count, t.data_type
FROM (UNPIVOT (SELECT {', '.join(f'COUNT({c}) AS {c}' for c in RAW_COLS)} FROM raw)
      ON {', '.join(RAW_COLS)} INTO NAME column_name VALUE non_null_count) u
JOIN (VALUES {_TYPES_VALUES}) t(column_name, data_type) USING (column_name)"""))
def p2_column_info(spark, sf_dir):
    return P.column_info(raw(spark, sf_dir))


def _nulls_sql(table: str, cols, stage: str) -> str:
    agg = ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)
    return (f"SELECT '{stage}' AS stage, column_name, null_count FROM "
            f"(UNPIVOT (SELECT {agg} FROM {table}) ON {', '.join(cols)} "
            f"INTO NAME column_name VALUE null_count)")


@register("p3_null_counts", with_bookings(
    _nulls_sql("raw", RAW_COLS, "before") + " UNION ALL " + _nulls_sql("bookings", CLEAN_COLUMNS, "after")))
def p3_null_counts(spark, sf_dir):
    before = P.null_counts(raw(spark, sf_dir), "before")
    after = P.null_counts(bookings(spark, sf_dir), "after")
    return before.unionByName(after)


def _describe_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, COUNT({x}) AS count, {_r6(f'AVG({x})')} AS mean, "
            f"{_r6(f'STDDEV_SAMP({x})')} AS std, {_r6(f'MIN({x})')} AS min, "
            f"{_r6(f'quantile_cont({x}, 0.25)')} AS p25, {_r6(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{_r6(f'quantile_cont({x}, 0.75)')} AS p75, {_r6(f'MAX({x})')} AS max FROM raw")


@register("p4_describe", with_raw(" UNION ALL ".join(_describe_sql(c) for c in DESCRIBE_COLS)))
def p4_describe(spark, sf_dir):
    return P.describe(raw(spark, sf_dir), DESCRIBE_COLS)


@register("p5_value_counts_meal", with_bookings(
    "SELECT meal, COUNT(*) AS count FROM bookings GROUP BY meal ORDER BY count DESC, meal"))
def p5_value_counts_meal(spark, sf_dir):
    return P.value_counts(bookings(spark, sf_dir), "meal")


@register("p6_row_count", with_bookings("SELECT COUNT(*) AS row_count FROM bookings"))
def p6_row_count(spark, sf_dir):
    return P.row_count(bookings(spark, sf_dir))


# --- routing --------------------------------------------------------------

@register("r1_r4_route_questions", with_bookings(
    "SELECT question_id, text, route, month, year, hotel FROM routed", QUESTIONS_CTE, ROUTED_CTE))
def r1_r4_route_questions(spark, sf_dir):
    return R.route_questions(questions(spark, sf_dir))


_GRID_CTE = f"""
grid AS (
  SELECT arrival_date_month_num AS g_month,
         CAST(CASE WHEN GROUPING(arrival_date_year) = 1 THEN NULL ELSE arrival_date_year END AS INTEGER) AS g_year,
         {msum('revenue')} AS total_revenue, COUNT(*) AS booking_count, {mavg('adr')} AS avg_daily_rate
  FROM bookings WHERE is_canceled = 0
  GROUP BY GROUPING SETS ((arrival_date_year, arrival_date_month_num), (arrival_date_month_num)))"""

_Q1_BODY = """
SELECT r.question_id, r.month, r.year, g.total_revenue,
       CAST(COALESCE(g.booking_count, 0) AS BIGINT) AS booking_count, g.avg_daily_rate
FROM routed r LEFT JOIN grid g ON r.month = g.g_month AND r.year IS NOT DISTINCT FROM g.g_year
WHERE r.route = 'revenue'"""


@register("q1_revenue_for_period", with_bookings(_Q1_BODY, QUESTIONS_CTE, ROUTED_CTE, _GRID_CTE))
def q1_revenue_for_period(spark, sf_dir):
    b = bookings(spark, sf_dir)
    return R.revenue_for_period(R.route_questions(questions(spark, sf_dir)), b)


_Q2_SQL = f"""
SELECT country, COUNT(*) AS total_bookings, COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       {pct('COUNT(*) FILTER (WHERE is_canceled = 1)', 'COUNT(*)')} AS cancellation_rate
FROM bookings GROUP BY country HAVING COUNT(*) > 10
ORDER BY cancellation_rate DESC, country LIMIT 10"""


@register("q2_cancellation_by_country", with_bookings(_Q2_SQL))
def q2_cancellation_by_country(spark, sf_dir):
    return R.cancellation_by_country(bookings(spark, sf_dir))


_Q3_SQL = f"""
SELECT hotel, booking_count, avg_daily_rate, AVG(avg_daily_rate) OVER () AS overall_avg_daily_rate
FROM (SELECT hotel, COUNT(*) AS booking_count, {mavg('adr')} AS avg_daily_rate
      FROM bookings WHERE is_canceled = 0 AND adr > 0 GROUP BY hotel) h"""


@register("q3_average_price_by_hotel", with_bookings(_Q3_SQL))
def q3_average_price_by_hotel(spark, sf_dir):
    return R.average_price_by_hotel(bookings(spark, sf_dir))


_Q4_SQL = f"""
SELECT reserved_room_type, booking_count, confirmed_bookings, avg_daily_rate,
       row_number() OVER (ORDER BY booking_count DESC, reserved_room_type) AS popularity_rank
FROM (SELECT reserved_room_type, COUNT(*) AS booking_count,
             COUNT(*) FILTER (WHERE is_canceled = 0) AS confirmed_bookings, {mavg('adr')} AS avg_daily_rate
      FROM bookings GROUP BY reserved_room_type) r"""


@register("q4_room_type_popularity", with_bookings(_Q4_SQL + " ORDER BY popularity_rank"))
def q4_room_type_popularity(spark, sf_dir):
    return R.room_type_popularity(bookings(spark, sf_dir)).orderBy("popularity_rank")


_Q5_SQL = f"""
SELECT *, CAST(total_bookings AS DOUBLE) / CAST(SUM(total_bookings) OVER () AS DOUBLE) * 100.0 AS share_pct,
       COUNT(*) OVER () AS countries_shown
FROM (SELECT country, COUNT(*) AS total_bookings,
             COUNT(*) FILTER (WHERE is_canceled = 0) AS confirmed_bookings,
             COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
             {msum('revenue')} AS total_revenue
      FROM bookings GROUP BY country HAVING COUNT(*) > 5
      ORDER BY total_bookings DESC, country LIMIT 20) t"""


@register("q5_country_distribution", with_bookings(_Q5_SQL))
def q5_country_distribution(spark, sf_dir):
    return R.country_distribution(bookings(spark, sf_dir))


_Q6_SQL = f"""
SELECT hotel, COUNT(*) AS booking_count, {avg_int('total_stay_duration')} AS avg_stay_duration,
       MIN(total_stay_duration) AS min_stay, MAX(total_stay_duration) AS max_stay
FROM bookings WHERE is_canceled = 0 GROUP BY hotel"""


@register("q6_stay_duration_by_hotel", with_bookings(_Q6_SQL))
def q6_stay_duration_by_hotel(spark, sf_dir):
    return R.stay_duration_by_hotel(bookings(spark, sf_dir))


_Q7_SQL = f"""
SELECT hotel, COUNT(*) AS booking_count, {avg_int('lead_time')} AS avg_lead_time,
       MIN(lead_time) AS min_lead_time, MAX(lead_time) AS max_lead_time,
       quantile_cont(lead_time, 0.25) AS p25_lead_time, quantile_cont(lead_time, 0.5) AS median_lead_time,
       quantile_cont(lead_time, 0.75) AS p75_lead_time
FROM bookings GROUP BY hotel"""


@register("q7_lead_time_by_hotel", with_bookings(_Q7_SQL))
def q7_lead_time_by_hotel(spark, sf_dir):
    return R.lead_time_by_hotel(bookings(spark, sf_dir))


def _agg_text(rows_sql: str, row_lines, order: str, head_lines=None, head_where: str = "") -> str:
    """SQL: head (from one row) + rows concatenated in order."""
    body = f"string_agg({sql_text(row_lines)}, '' ORDER BY {order})"
    if head_lines is None:
        return f"SELECT {body} AS body FROM ({rows_sql}) x"
    head = f"MAX(CASE WHEN {head_where or 'TRUE'} THEN {sql_text(head_lines)} END)"
    return f"SELECT {head} || {body} AS answer FROM ({rows_sql}) x"


_STAY_ROWS = f"SELECT *, COUNT(*) OVER () AS n_hotels FROM ({_Q6_SQL}) s"
_STAY_ROW = (f"CASE WHEN n_hotels > 1 THEN {sql_text(R.STAY_MANY)} ELSE {sql_text(R.STAY_ONE)} END")
_LEAD_HEAD = sql_line(R.LEAD_HEAD[0])

_TEXTS_CTE = f"""
texts AS (
  SELECT 'cancellation' AS route, CAST(NULL AS VARCHAR) AS hotel_key,
         {sql_text(R.CANCEL_HEAD)} || body AS answer
  FROM ({_agg_text(_Q2_SQL, R.CANCEL_ROW, 'cancellation_rate DESC, country')}) a
  UNION ALL
  SELECT 'average', NULL, answer FROM ({_agg_text(_Q3_SQL, R.PRICE_ROW, 'hotel', R.PRICE_HEAD)}) a
  UNION ALL
  SELECT 'room', NULL, answer
  FROM ({_agg_text(_Q4_SQL, R.ROOM_ROW, 'popularity_rank', R.ROOM_HEAD, 'popularity_rank = 1')}) a
  UNION ALL
  SELECT 'distribution', NULL, answer
  FROM ({_agg_text(_Q5_SQL, R.DIST_ROW, 'total_bookings DESC, country', R.DIST_HEAD)}) a
  UNION ALL
  SELECT 'stay', NULL, 'SQL Results for Stay Duration Query:\n' || string_agg({_STAY_ROW}, '' ORDER BY hotel)
  FROM ({_STAY_ROWS}) s
  UNION ALL
  SELECT 'lead', NULL, {_LEAD_HEAD} || string_agg({sql_text(R.LEAD_BLOCK)}, '' ORDER BY hotel)
  FROM ({_Q7_SQL}) l
  UNION ALL
  SELECT 'lead', hotel, {_LEAD_HEAD} || {sql_text(R.LEAD_BLOCK)} FROM ({_Q7_SQL}) l1)"""

_R5_BODY = f"""
SELECT r.question_id, r.text, r.route,
       CASE WHEN r.route = 'revenue' THEN {sql_text(R.REVENUE_LINES)}
            WHEN r.route = 'lead' THEN COALESCE(t.answer, {_LEAD_HEAD})
            ELSE t.answer END AS answer
FROM (SELECT r.*, g.total_revenue, CAST(COALESCE(g.booking_count, 0) AS BIGINT) AS booking_count,
             g.avg_daily_rate
      FROM routed r LEFT JOIN grid g
        ON r.route = 'revenue' AND r.month = g.g_month AND r.year IS NOT DISTINCT FROM g.g_year) r
LEFT JOIN texts t ON r.route = t.route AND r.hotel IS NOT DISTINCT FROM t.hotel_key"""


@register("r5_routed_answers", with_bookings(_R5_BODY, QUESTIONS_CTE, ROUTED_CTE, _GRID_CTE, _TEXTS_CTE))
def r5_routed_answers(spark, sf_dir):
    return R.routed_answers(questions(spark, sf_dir), insight_cube(spark, sf_dir))


ROUTE_TEXTS_CTE = _TEXTS_CTE
GRID_CTE = _GRID_CTE
R5_BODY = _R5_BODY
