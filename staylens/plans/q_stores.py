"""Registered queries that write a source or store, read it back and are compared with SQL over what was
written (S2-S4, S7-S11, S13, S16, S17, A13, U5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staylens.operators import evaluation as V
from staylens.operators import payloads as P
from staylens.operators.collection import Collection
from staylens.operators.documents import booking_documents, insight_documents
from staylens.plans.context import bookings, insight_cube, raw
from staylens.plans.oracle import with_bookings
from staylens.plans.q_documents import BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE
from staylens.plans.q_evaluation import _evaluated
from staylens.plans.q_insights import BIN_CASE, BINS_VALUES, GEO_SQL, ROOM_SQL, SEGMENT_SQL
from staylens.plans.q_retrieval import SCAN_COLS
from staylens.plans.registry import ORACLES, register
from staylens.plans.session import checkpoint_path
from staylens.plans.sql_text import QUERY_LOG_CTE
from staylens.sources import store as S
from staylens.sources.files import write_clean_csv, write_clean_table
from staylens.sources.tables import query_log

_COLS = ", ".join(SCAN_COLS)


def _place(spark, name: str) -> str:
    return checkpoint_path(spark, f"stores/{name}_{uuid.uuid4().hex}")


# --- sources ---------------------------------------------------------------------

@register("s2_clean_csv", with_bookings(f"SELECT {_COLS} FROM bookings"))
def s2_clean_csv(spark, sf_dir):
    rows, path = bookings(spark, sf_dir).select(*SCAN_COLS), _place(spark, "s2")
    write_clean_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@register("s3_clean_table", with_bookings(f"SELECT {_COLS}, arrival_date_month_num FROM bookings"))
def s3_clean_table(spark, sf_dir):
    path = _place(spark, "s3")
    write_clean_table(bookings(spark, sf_dir), path)
    return spark.read.parquet(path).select(*SCAN_COLS, "arrival_date_month_num")


@register("s4_table_lookups", with_bookings("""
SELECT 'month' AS lookup, booking_id, country, revenue FROM bookings WHERE arrival_date_year = 2015 AND arrival_date_month_num = 7
UNION ALL SELECT 'date', booking_id, country, revenue FROM bookings WHERE arrival_date BETWEEN DATE '2014-03-01' AND DATE '2014-03-10'
UNION ALL SELECT 'hotel', booking_id, country, revenue FROM bookings WHERE hotel = 'Resort Hotel' AND arrival_date_year = 2016
UNION ALL SELECT 'canceled', booking_id, country, revenue FROM bookings WHERE is_canceled = 1 AND arrival_date_year = 2013
UNION ALL SELECT 'country', booking_id, country, revenue FROM bookings WHERE country = 'FRANCE'"""))
def s4_table_lookups(spark, sf_dir):
    """The lookups that the table's layout serves, on the stored table."""
    path = _place(spark, "s4")
    write_clean_table(bookings(spark, sf_dir), path)
    t, out = spark.read.parquet(path), None
    for name, cond in (("month", "arrival_date_year = 2015 AND arrival_date_month_num = 7"),
                       ("date", "arrival_date BETWEEN DATE '2014-03-01' AND DATE '2014-03-10' AND arrival_date_year = 2014 "
                                "AND arrival_date_month_num = 3"),
                       ("hotel", "hotel = 'Resort Hotel' AND arrival_date_year = 2016"),
                       ("canceled", "is_canceled = 1 AND arrival_date_year = 2013"), ("country", "country = 'FRANCE'")):
        rows = t.where(cond).select(F.lit(name).alias("lookup"), "booking_id", "country", "revenue")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- insights ----------------------------------------------------------------------

def _stored_payloads(spark, cube, name: str) -> S.VersionedTable:
    table = S.VersionedTable(spark, _place(spark, name))
    P.generate_all_insights(cube, table)
    return table


@register("s7_upsert_insight", with_bookings("""
SELECT hotel AS insight_id, 'count' AS insight_type, '{"total_bookings":' || COUNT(*) || '}' AS insight_data, '{}' AS metadata
FROM bookings GROUP BY hotel"""))
def s7_upsert_insight(spark, sf_dir):
    """Two upserts of one insight a hotel: data of the second, type of the first."""
    table, b = S.VersionedTable(spark, _place(spark, "s7")), bookings(spark, sf_dir)
    for rows, kind in ((b.where("booking_id % 10 <> 0"), "count"), (b, "other")):
        S.upsert_insights(table, rows.groupBy("hotel").agg(F.count(F.lit(1)).alias("total_bookings")).select(
            F.col("hotel").alias("insight_id"), F.lit(kind).alias("insight_type"),
            F.to_json(F.struct("total_bookings")).alias("insight_data"), F.lit(None).cast("string").alias("metadata")))
    return table.read().drop("timestamp")


@register("s8_get_insight", with_bookings("""
SELECT 'cancellation_rate' AS insight_id, COUNT(*) FILTER (WHERE is_canceled = 1) AS canceled_bookings,
       COUNT(*) AS total_bookings FROM bookings"""))
def s8_get_insight(spark, sf_dir):
    cube = insight_cube(spark, sf_dir)
    schema = P.payload_schema(cube, "cancellation_rate")
    found = S.get_insight(_stored_payloads(spark, cube, "s8"), "cancellation_rate", schema)
    return found.select("insight_id", "payload.overall.canceled_bookings", "payload.overall.total_bookings")


@register("s9_get_all_insights", with_bookings("""
SELECT i.insight_id, CASE WHEN i.insight_id = 'revenue_trends' THEN m.months END AS months
FROM (VALUES ('revenue_trends'), ('cancellation_rate'), ('geographical_distribution'), ('lead_time_distribution'),
      ('additional_insights')) i(insight_id),
     (SELECT CAST(COUNT(DISTINCT arrival_date_year * 100 + arrival_date_month_num) AS INTEGER) AS months
      FROM bookings WHERE is_canceled = 0) m"""))
def s9_get_all_insights(spark, sf_dir):
    return S.get_all_insights(_stored_payloads(spark, insight_cube(spark, sf_dir), "s9")).select(
        "insight_id", F.json_array_length(F.get_json_object("insight_data", "$.dates")).alias("months"))


@register("s10_select_insights", with_bookings("""
SELECT i.insight_id, CASE WHEN i.insight_id = 'cancellation_rate' THEN n END AS total_bookings
FROM (VALUES ('revenue_trends'), ('cancellation_rate')) i(insight_id), (SELECT COUNT(*) AS n FROM bookings) b"""))
def s10_select_insights(spark, sf_dir):
    """Two insights asked of an empty store, which is then filled."""
    table, cube = S.VersionedTable(spark, _place(spark, "s10")), insight_cube(spark, sf_dir)
    found = S.select_insights(table, ["revenue_trends", "cancellation_rate"], lambda: P.generate_all_insights(cube, table))
    return found.select("insight_id", F.get_json_object("insight_data", "$.overall.total_bookings").cast("long").alias("total_bookings"))


@register("s16_payload_json", with_bookings("""
SELECT hotel, '{"bookings":' || COUNT(*) || ',"canceled":' || COUNT(*) FILTER (WHERE is_canceled = 1) || ',"by":{"hotel":"' || hotel || '"}}' AS payload
FROM bookings GROUP BY hotel"""))
def s16_payload_json(spark, sf_dir):
    b = bookings(spark, sf_dir).groupBy("hotel").agg(
        F.count(F.lit(1)).alias("bookings"), F.count_if(F.col("is_canceled") == 1).alias("canceled"))
    return b.select("hotel", S.payload_json(F.struct("bookings", "canceled", F.struct("hotel").alias("by"))).alias("payload"))


_FIELDS = (
    ("revenue_trends", "dates", "booking_counts", ()), ("revenue_trends", "dates", "revenues", ()),
    ("cancellation_rate", "hotels", "cancellation_rates", ("by_hotel",)),
    ("geographical_distribution", "countries", "total_revenue", ()),
    ("geographical_distribution", "countries", "booking_counts", ("top_20",)),
    ("lead_time_distribution", "bins", "counts", ("distribution",)),
    ("additional_insights", "segments", "avg_rates", ("market_segment_analysis",)),
    ("additional_insights", "room_types", "booking_counts", ("room_type_distribution",)),
)


def _field_sql(insight: str, field: str, label: str, value: str, order: str, source: str) -> str:
    return f"""SELECT '{insight}' AS insight, '{field}' AS field, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS position,
       {label} AS label, CAST({value} AS DOUBLE) AS value FROM ({source}) t"""


_MONTHS = """SELECT printf('%04d-%02d', arrival_date_year, arrival_date_month_num) AS date, ROUND(FSUM(revenue), 2) AS total_revenue,
       COUNT(*) AS booking_count FROM bookings WHERE is_canceled = 0 GROUP BY 1"""


@register("a13_payload_fields", with_bookings("\nUNION ALL ".join([
    _field_sql("revenue_trends", "booking_counts", "date", "booking_count", "date", _MONTHS),
    _field_sql("revenue_trends", "revenues", "date", "total_revenue", "date", _MONTHS),
    _field_sql("cancellation_rate", "by_hotel.cancellation_rates", "hotel", "rate", "hotel",
               "SELECT hotel, CAST(COUNT(*) FILTER (WHERE is_canceled = 1) AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE) AS rate "
               "FROM bookings GROUP BY hotel"),
    _field_sql("geographical_distribution", "total_revenue", "country", "total_revenue", "booking_count DESC, country", GEO_SQL),
    _field_sql("geographical_distribution", "top_20.booking_counts", "country", "booking_count", "booking_count DESC, country",
               f"SELECT * FROM ({GEO_SQL}) g ORDER BY booking_count DESC, country LIMIT 20"),
    _field_sql("lead_time_distribution", "distribution.counts", "bin", "n", "bin_order",
               "SELECT bins.bin_order, bins.bin, COALESCE(c.n, 0) AS n FROM bins LEFT JOIN (SELECT " + BIN_CASE +
               " AS o, COUNT(*) AS n FROM bookings WHERE is_canceled = 0 GROUP BY 1) c ON c.o = bins.bin_order"),
    _field_sql("additional_insights", "market_segment_analysis.avg_rates", "market_segment", "avg_daily_rate",
               "booking_count DESC, market_segment", SEGMENT_SQL),
    _field_sql("additional_insights", "room_type_distribution.booking_counts", "reserved_room_type", "booking_count",
               "booking_count DESC, reserved_room_type", ROOM_SQL)]), BINS_VALUES))
def a13_payload_fields(spark, sf_dir):
    """The stored payloads parsed again: one row for each value of their labelled series."""
    cube, out = insight_cube(spark, sf_dir), None
    stored = _stored_payloads(spark, cube, "a13").read()
    for insight, label, value, path in _FIELDS:
        schema = P.payload_schema(cube, insight)
        row = stored.where(F.col("insight_id") == insight).select(F.from_json("insight_data", schema).alias("p"))
        at = ".".join(("p", *path))
        series = row.select(F.posexplode(F.arrays_zip(F.col(f"{at}.{label}").alias("label"), F.col(f"{at}.{value}").alias("value")))
                            .alias("position", "x"))
        rows = series.select(F.lit(insight).alias("insight"), F.lit(".".join((*path, value))).alias("field"), "position",
                             F.col("x.label").alias("label"), F.col("x.value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- query log, collections, summary, streamed revenue --------------------------------

@register("s11_append_query_log", f"""
WITH {QUERY_LOG_CTE.strip()}
SELECT query_text, 2 * COUNT(*) AS rows_logged, 2 * COUNT(*) AS ids, MAX(execution_time) AS longest
FROM query_log GROUP BY query_text""")
def s11_append_query_log(spark, sf_dir):
    """The log appended to twice: every row is there, every id differs."""
    path = _place(spark, "s11")
    rows = query_log(spark, sf_dir).select("query_text", F.lit("answer").alias("response"), "execution_time")
    for _ in range(2):
        S.append_query_log(spark, path, rows)
    return spark.read.parquet(path).groupBy("query_text").agg(
        F.count(F.lit(1)).alias("rows_logged"), F.count_distinct("query_id").alias("ids"), F.max("execution_time").alias("longest"))


@register("s13_collections", with_bookings("""
SELECT 'bookings_data' AS collection, id, hotel, document FROM (SELECT d.*, b.hotel FROM bdocs d JOIN bookings b USING (booking_id)) t
WHERE hotel = 'Resort Hotel'
UNION ALL SELECT 'insights_data', id, NULL, document FROM idocs""", BINS_VALUES, BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE))
def s13_collections(spark, sf_dir):
    """Both collections written and read, the bookings filtered by their stored metadata."""
    b, i = (Collection(spark, _place(spark, f"s13_{n}")) for n in ("bookings", "insights"))
    b.add(booking_documents(bookings(spark, sf_dir)))
    i.add(insight_documents(insight_cube(spark, sf_dir)))
    return b.documents().where("metadata.hotel = 'Resort Hotel'") \
        .select(F.lit("bookings_data").alias("collection"), "id", F.col("metadata.hotel").alias("hotel"), "document") \
        .unionByName(i.documents().select(F.lit("insights_data").alias("collection"), "id",
                                          F.lit(None).cast("string").alias("hotel"), "document"))


@register("s17_summary_json", ORACLES["v8_accuracy_summary"])
def s17_summary_json(spark, sf_dir):
    rows, path = V.accuracy_summary(_evaluated(spark, sf_dir)), _place(spark, "s17")
    S.write_summary_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register("u5_streaming_revenue", with_bookings("""
SELECT arrival_date_year, arrival_date_month_num, ROUND(FSUM(revenue), 2) AS total_revenue, COUNT(*) AS booking_count
FROM bookings WHERE is_canceled = 0 GROUP BY arrival_date_year, arrival_date_month_num"""))
def u5_streaming_revenue(spark, sf_dir):
    """Monthly revenue kept by a stream over two deliveries of raw files."""
    from staylens.streaming.index_stream import start_revenue_stream

    place = _place(spark, "u5")
    for name, part in (("a", "booking_id % 10 <> 0"), ("b", "booking_id % 10 = 0")):
        raw(spark, sf_dir).where(part).write.parquet(f"{place}/in/{name}")
        start_revenue_stream(spark, f"{place}/in/*", f"{place}/table", f"{place}/offsets").awaitTermination()
    return S.VersionedTable(spark, f"{place}/table").read().select(
        "arrival_date_year", "arrival_date_month_num", "total_revenue", "booking_count")
