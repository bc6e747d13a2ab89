"""Insight payloads (A13) and the insight refresh job.

A payload is a struct of parallel arrays built from an insight result.
``collect_list`` gives no order, so rows are collected as structs whose
first field is the sort key and sorted with ``array_sort`` before being
split into arrays.  Each collect runs over an aggregated result (one row per
month, hotel, country, room type...), never over bookings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.constants import INSIGHT_DESCRIPTIONS, INSIGHT_TYPES
from staylens.operators import insights as A


def _arrays(df: DataFrame, sort_key, fields: dict[str, str]) -> F.Column:
    """Aggregate: struct of arrays ``{name: [row[col] in sort order]}``."""
    rows = F.array_sort(F.collect_list(F.struct(sort_key.alias("_k"),
                                                *[F.col(c).alias(c) for c in set(fields.values())])))
    return F.struct(*[F.transform(rows, _field(c)).alias(name) for name, c in fields.items()])


def _field(name: str):
    return lambda r: r[name]


def _combine(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row frames with one column each -> one row with all columns.

    Union plus ``first(ignorenulls)``: a single tiny aggregate, no cross join.
    """
    names = list(parts)
    u = None
    for name, df in parts.items():
        one = df.select(F.col(name))
        u = one if u is None else u.unionByName(one, allowMissingColumns=True)
    return u.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def revenue_trends_payload(b: DataFrame) -> DataFrame:
    t = A.revenue_trends(b)
    key = F.struct("arrival_date_year", "arrival_date_month_num")
    return t.agg(_arrays(t, key, {"dates": "date", "revenues": "total_revenue",
                                  "booking_counts": "booking_count"}).alias("payload"))


def cancellation_payload(b: DataFrame) -> DataFrame:
    r = A.cancellation_rates(b)
    hotels = r.where(F.col("level") == "hotel")
    by_hotel = hotels.agg(_arrays(hotels, F.col("hotel"), {
        "hotels": "hotel", "cancellation_rates": "cancellation_rate",
        "canceled_bookings": "canceled_bookings", "total_bookings": "total_bookings"}).alias("by_hotel"))
    overall = r.where(F.col("level") == "overall").select(F.struct(
        "cancellation_rate", "canceled_bookings", "total_bookings").alias("overall"))
    return _combine({"by_hotel": by_hotel, "overall": overall}).select(
        F.struct("by_hotel", "overall").alias("payload"))


def geographical_payload(b: DataFrame, top_n: int = 20) -> DataFrame:
    g = A.geographical_distribution(b).withColumn(
        "rk", F.row_number().over(_global().orderBy(F.desc("booking_count"), "country")))
    allc = g.agg(_arrays(g, F.col("rk"), {
        "countries": "country", "booking_counts": "booking_count",
        "confirmed_bookings": "confirmed_bookings", "canceled_bookings": "canceled_bookings",
        "total_revenue": "total_revenue"}).alias("all"))
    top = g.where(F.col("rk") <= top_n)
    topc = top.agg(_arrays(top, F.col("rk"), {"countries": "country",
                                              "booking_counts": "booking_count"}).alias("top_20"))
    c = _combine({"all": allc, "top_20": topc})
    return c.select(F.struct("all.countries", "all.booking_counts", "all.confirmed_bookings",
                             "all.canceled_bookings", "all.total_revenue", "top_20").alias("payload"))


def lead_time_payload(b: DataFrame) -> DataFrame:
    s = A.lead_time_stats(b).select(F.struct(
        F.col("min_lead_time").alias("min"), F.col("max_lead_time").alias("max"),
        F.col("mean_lead_time").alias("mean"), F.col("median_lead_time").alias("median"),
        F.struct(F.col("p25_lead_time").alias("25"), F.col("p50_lead_time").alias("50"),
                 F.col("p75_lead_time").alias("75"), F.col("p90_lead_time").alias("90"))
        .alias("percentiles")).alias("statistics"))
    bins = A.lead_time_bins(b)
    dist = bins.agg(_arrays(bins, F.col("bin_order"), {"bins": "bin", "counts": "booking_count"})
                    .alias("distribution"))
    return _combine({"statistics": s, "distribution": dist}).select(
        F.struct("statistics", "distribution").alias("payload"))


def additional_payload(b: DataFrame) -> DataFrame:
    adr = A.adr_by_hotel_room(b)
    adr_p = adr.agg(_arrays(adr, F.struct("hotel", -F.col("avg_daily_rate"), "reserved_room_type"), {
        "hotel_types": "hotel", "room_types": "reserved_room_type",
        "avg_rates": "avg_daily_rate", "booking_counts": "booking_count"}).alias("adr_by_room_type"))
    seg = A.market_segment_analysis(b)
    seg_p = seg.agg(_arrays(seg, F.struct(-F.col("booking_count"), "market_segment"), {
        "segments": "market_segment", "booking_counts": "booking_count",
        "cancellation_rates": "cancellation_rate", "avg_rates": "avg_daily_rate",
        "avg_stay_durations": "avg_stay_duration"}).alias("market_segment_analysis"))
    day = A.day_of_month_distribution(b)
    day_p = day.agg(_arrays(day, F.col("arrival_date_day_of_month"), {
        "days": "arrival_date_day_of_month", "booking_counts": "booking_count"})
        .alias("day_of_month_distribution"))
    room = A.room_type_distribution(b)
    room_p = room.agg(_arrays(room, F.struct(-F.col("booking_count"), "reserved_room_type"), {
        "room_types": "reserved_room_type", "booking_counts": "booking_count",
        "confirmed_bookings": "confirmed_bookings", "canceled_bookings": "canceled_bookings",
        "avg_rates": "avg_daily_rate", "avg_stay_durations": "avg_stay_duration"})
        .alias("room_type_distribution"))
    parts = {"adr_by_room_type": adr_p, "market_segment_analysis": seg_p,
             "day_of_month_distribution": day_p, "room_type_distribution": room_p}
    return _combine(parts).select(F.struct(*parts).alias("payload"))


BUILDERS = {
    "revenue_trends": revenue_trends_payload,
    "cancellation_rate": cancellation_payload,
    "geographical_distribution": geographical_payload,
    "lead_time_distribution": lead_time_payload,
    "additional_insights": additional_payload,
}


def insight_payloads(b: DataFrame) -> DataFrame:
    """Five rows (insight_id, insight_type, insight_data JSON, metadata JSON)."""
    b = A.InsightCube(b) if isinstance(b, DataFrame) else b  # one scan for all five
    out = None
    for insight_id, insight_type in INSIGHT_TYPES:
        row = BUILDERS[insight_id](b).select(
            F.lit(insight_id).alias("insight_id"), F.lit(insight_type).alias("insight_type"),
            F.to_json("payload").alias("insight_data"),
            F.to_json(F.struct(F.lit(INSIGHT_DESCRIPTIONS[insight_id]).alias("description")))
            .alias("metadata"))
        out = row if out is None else out.unionByName(row)
    return out


def payload_schema(b: DataFrame, insight_id: str):
    """Schema to parse a stored payload back with ``from_json``."""
    return BUILDERS[insight_id](b).schema["payload"].dataType


def generate_all_insights(b: DataFrame, table) -> int:
    """Compute all payloads from one scan of the clean bookings (the insight
    aggregate) and store them with a single upsert (one new table version)."""
    from staylens.sources.store import upsert_insights

    return upsert_insights(table, insight_payloads(b))


def _global():
    from pyspark.sql import Window
    return Window.partitionBy()
