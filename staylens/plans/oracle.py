"""DuckDB SQL oracles, one per registered query.

Each oracle starts from the same two CTEs, written independently of the
Spark code: ``raw`` derives raw bookings from the driver tables and
``bookings`` applies the cleaning rules.  Money is DuckDB's own FSUM, rounded
to cents at output only (the tables hold cents), and every computed column is cast to the Spark result type.
"""

from __future__ import annotations

NUMERIC_TEXT = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

RAW_CTE = """
li AS (SELECT l_orderkey, COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT
    o.o_orderkey + 1 AS booking_id,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
    CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS is_canceled,
    CAST((o.o_orderkey * 37 + o.o_custkey) % 500 AS INTEGER) AS lead_time,
    CAST(year(o.o_orderdate) + 20 AS INTEGER) AS arrival_date_year,
    monthname(o.o_orderdate) AS arrival_date_month,
    CAST(day(o.o_orderdate) AS INTEGER) AS arrival_date_day_of_month,
    CAST(o.o_custkey % 3 AS INTEGER) AS stays_in_weekend_nights,
    CAST(COALESCE(li.n_lines, 0) AS INTEGER) AS stays_in_week_nights,
    CAST(CASE WHEN o.o_orderkey % 97 = 0 THEN 0 ELSE 1 + o.o_custkey % 3 END AS INTEGER) AS adults,
    CAST(CASE WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 97 = 0 THEN 0
              ELSE o.o_orderkey % 2 END AS DOUBLE) AS children,
    CAST(CASE WHEN o.o_orderkey % 97 <> 0 AND o.o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS INTEGER) AS babies,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'BB' WHEN '2-HIGH' THEN 'HB'
         WHEN '3-MEDIUM' THEN 'FB' WHEN '4-NOT SPECIFIED' THEN 'Undefined' ELSE 'SC' END AS meal,
    CASE WHEN n.n_nationkey = 24 THEN NULL ELSE n.n_name END AS country,
    c.c_mktsegment AS market_segment,
    substr('ABCDEFG', CAST(o.o_custkey % 7 + 1 AS INTEGER), 1) AS reserved_room_type,
    CAST(CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE o.o_custkey % 50 END AS DOUBLE) AS agent,
    CAST(CASE WHEN o.o_custkey % 11 <> 0 THEN NULL ELSE o.o_custkey % 30 END AS DOUBLE) AS company,
    CASE WHEN o.o_orderkey % 101 = 0 THEN 'n/a' WHEN o.o_orderkey % 103 = 0 THEN '-6.38'
         ELSE CAST(o.o_totalprice AS VARCHAR) END AS adr
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
)"""

CLEAN_CTE = """
imputed AS (
  SELECT booking_id, hotel, is_canceled, lead_time, arrival_date_year, arrival_date_month,
         arrival_date_day_of_month, stays_in_weekend_nights, stays_in_week_nights, adults,
         COALESCE(children, 0.0) AS children, babies,
         CASE WHEN meal = 'Undefined' THEN 'SC' ELSE meal END AS meal,
         COALESCE(country, 'Unknown') AS country, market_segment, reserved_room_type,
         COALESCE(agent, 0.0) AS agent, COALESCE(company, 0.0) AS company, adr,
         CAST(CASE arrival_date_month WHEN 'January' THEN 1 WHEN 'February' THEN 2
              WHEN 'March' THEN 3 WHEN 'April' THEN 4 WHEN 'May' THEN 5 WHEN 'June' THEN 6
              WHEN 'July' THEN 7 WHEN 'August' THEN 8 WHEN 'September' THEN 9
              WHEN 'October' THEN 10 WHEN 'November' THEN 11 WHEN 'December' THEN 12
              END AS INTEGER) AS arrival_date_month_num,
         CASE WHEN regexp_full_match(trim(adr), '%s')
              THEN TRY_CAST(trim(adr) AS DOUBLE) END AS adr_parsed
  FROM raw
  WHERE NOT (adults IS NOT DISTINCT FROM 0 AND COALESCE(children, 0.0) IS NOT DISTINCT FROM 0
             AND babies IS NOT DISTINCT FROM 0)
),
bookings AS (
  SELECT booking_id, hotel, is_canceled, lead_time, arrival_date_year, arrival_date_month,
         arrival_date_day_of_month, stays_in_weekend_nights, stays_in_week_nights, adults,
         children, babies, meal, country, market_segment, reserved_room_type, agent, company,
         CASE WHEN adr_parsed IS NULL OR isnan(adr_parsed) THEN 0.0 ELSE adr_parsed END AS adr,
         arrival_date_month_num,
         make_date(arrival_date_year, arrival_date_month_num, arrival_date_day_of_month) AS arrival_date,
         CAST(stays_in_weekend_nights + stays_in_week_nights AS INTEGER) AS total_stay_duration,
         (CASE WHEN adr_parsed IS NULL OR isnan(adr_parsed) THEN 0.0 ELSE adr_parsed END)
           * CAST(stays_in_weekend_nights + stays_in_week_nights AS INTEGER) AS revenue
  FROM imputed
)""" % NUMERIC_TEXT.replace("'", "''")


def with_bookings(body: str, *extra_ctes: str) -> str:
    """``WITH raw, bookings[, extra...] <body>``."""
    ctes = [RAW_CTE.strip(), CLEAN_CTE.strip(), *[c.strip() for c in extra_ctes]]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_raw(body: str, *extra_ctes: str) -> str:
    ctes = [RAW_CTE.strip(), *[c.strip() for c in extra_ctes]]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def msum(expr: str) -> str:
    return f"ROUND(FSUM(CAST({expr} AS DOUBLE)), 2)"


def mavg(expr: str) -> str:
    return f"({msum(expr)} / CAST(COUNT({expr}) AS DOUBLE))"


def pct(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE))"


def avg_int(expr: str) -> str:
    return f"(CAST(SUM({expr}) AS DOUBLE) / CAST(COUNT({expr}) AS DOUBLE))"


def fixed(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"printf('%.{digits}f', floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) / {scale})"
