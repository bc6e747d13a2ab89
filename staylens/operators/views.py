"""Dashboard data views (B1-B8): small projections over insight results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.columns import exact_sum
from staylens.operators import insights as A


def revenue_kpis(b: DataFrame) -> DataFrame:
    """B1: total revenue, average per month, first month with the top revenue."""
    t = A.revenue_trends(b)
    order = F.col("arrival_date_year") * 100 + F.coalesce(F.col("arrival_date_month_num"), F.lit(0))
    return t.agg(
        exact_sum("total_revenue").alias("total_revenue"),
        F.try_divide(exact_sum("total_revenue"), F.count(F.lit(1)).cast("double"))
        .alias("avg_monthly_revenue"),
        F.max_by("date", F.struct(F.col("total_revenue"), -order)).alias("best_month"))


def _rate(canceled: str, total: str):
    # (canceled / total) * 100, in that order
    return F.try_divide(F.col(canceled).cast("double"), F.col(total).cast("double")) * F.lit(100.0)


def geo_with_rate(b: DataFrame) -> DataFrame:
    """B2: A4 plus the cancellation rate in percent."""
    return A.geographical_distribution(b).withColumn(
        "cancellation_rate_pct", _rate("canceled_bookings", "booking_count"))


def top_countries_by_revenue(b: DataFrame, n: int = 10) -> DataFrame:
    """B3."""
    return (geo_with_rate(b).orderBy(F.desc("total_revenue"), "country").limit(n))


def search_countries(b: DataFrame, text: str, blank_rows: int = 20) -> DataFrame:
    """Case-insensitive substring match on country; blank text -> first rows."""
    g = geo_with_rate(b)
    if not text or not text.strip():
        return g.orderBy(F.desc("booking_count"), "country").limit(blank_rows)
    return g.where(F.lower(F.col("country")).contains(text.lower()))


def rates_per_hotel(b: DataFrame) -> DataFrame:
    """Per hotel, its room types by average rate (rank 1 = most expensive)."""
    w = Window.partitionBy("hotel").orderBy(F.desc("avg_daily_rate"), "reserved_room_type")
    return (A.adr_by_hotel_room(b).withColumn("rate_rank", F.row_number().over(w))
            .orderBy("hotel", "rate_rank"))


def segment_scatter(b: DataFrame) -> DataFrame:
    """Rate vs. cancellation vs. size per market segment."""
    return A.market_segment_analysis(b).select(
        "market_segment", "avg_daily_rate", "cancellation_rate", "booking_count", "avg_stay_duration")


def room_with_rate(b: DataFrame) -> DataFrame:
    """A12 plus the cancellation rate, most booked first."""
    return (A.room_type_distribution(b)
            .withColumn("cancellation_rate_pct", _rate("canceled_bookings", "booking_count"))
            .orderBy(F.desc("booking_count"), "reserved_room_type"))


def most_common_room(b: DataFrame) -> DataFrame:
    """Most booked room type, its bookings and share of all bookings.

    One global aggregate over the per-room rows; ties go to the first room
    type in key order.
    """
    r = A.room_type_distribution(b)
    top = F.min_by(F.struct(F.col("reserved_room_type"), F.col("booking_count")),
                   F.struct(-F.col("booking_count"), F.col("reserved_room_type")))
    out = r.agg(top.alias("top"), F.sum("booking_count").alias("total_bookings"))
    return out.select(
        F.col("top.reserved_room_type").alias("reserved_room_type"),
        F.col("top.booking_count").alias("booking_count"),
        "total_bookings",
        (F.col("top.booking_count").cast("double") / F.col("total_bookings").cast("double")
         * F.lit(100.0)).alias("share_pct"))
