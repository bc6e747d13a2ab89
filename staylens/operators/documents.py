"""Searchable documents.

Booking documents are a narrow projection of the clean bookings (no
shuffle).  Insight documents are projections of the insight aggregates, so
they are a few hundred rows whatever the data size.  Numbers are printed
with fixed decimals (rounded half up) so the text does not depend on an
engine's float printing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.columns import round_half_up
from staylens.functions.render import L, spark_text
from staylens.operators import insights as A

NL = "\n"


def _lines(*lines):
    """Join template lines with newlines (no trailing newline)."""
    out = []
    for i, ln in enumerate(lines):
        out.append(L(ln.fmt + (NL if i < len(lines) - 1 else ""), *ln.args))
    return out


# --- fixed values: document text formats (labels and order of the lines) ---
BOOKING_LINES = _lines(
    L("Booking ID: %d", ("d", "booking_id")),
    L("Hotel: %s", ("s", "hotel")),
    L("Status: %s", ("s", "status")),
    L("Country: %s", ("s", "country")),
    L("Arrival Date: %d-%s", ("d", "arrival_date_year"), ("s", "arrival_date_month")),
    L("Lead Time: %d days", ("d", "lead_time")),
    L("Room Type: %s", ("s", "reserved_room_type")),
    L("Daily Rate: $%s", ("f2", "adr")),
    L("Total Revenue: $%s", ("f2", "revenue")),
    L("Stay Duration: %d days", ("d", "total_stay_duration")),
    L("Market Segment: %s", ("s", "market_segment")),
)


def _status():
    return F.when(F.col("is_canceled") == 1, F.lit("Canceled")).otherwise(F.lit("Confirmed"))


def booking_documents(b: DataFrame, with_booking: bool = False) -> DataFrame:
    """D1 + D2: (id, booking_id, document, metadata struct); ``booking``: the clean row itself, if asked for."""
    row = [F.struct(*b.columns).alias("booking")] if with_booking else []
    return b.withColumn("status", _status()).select(
        F.concat(F.lit("booking_"), F.col("booking_id").cast("string")).alias("id"),
        "booking_id",
        spark_text(BOOKING_LINES).alias("document"),
        booking_metadata().alias("metadata"), *row)


def booking_metadata():
    """Metadata kept with each booking document."""
    return F.struct(
        F.col("hotel").alias("hotel"),
        F.col("arrival_date_year").cast("int").alias("year"),
        F.col("arrival_date_month").alias("month"),
        F.col("country").alias("country"),
        (F.col("is_canceled") == 1).alias("is_canceled"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("adr").cast("double").alias("adr"))


# --- insight documents ------------------------------------------------------
# --- fixed values: insight document text formats ---------------------------

REVENUE_DOC = _lines(
    L("Revenue Insight:"),
    L("Month: %s", ("s", "date")),
    L("Total Revenue: $%s", ("f2", "total_revenue")),
    L("Number of Bookings: %d", ("d", "booking_count")),
    L("Average Revenue per Booking: $%s", ("f2", "avg_revenue")),
)
CANCEL_OVERALL_DOC = _lines(
    L("Cancellation Rate Insight:"),
    L("Overall cancellation rate: %s%%", ("f2", "cancellation_rate")),
    L("Total bookings: %d", ("d", "total_bookings")),
    L("Canceled bookings: %d", ("d", "canceled_bookings")),
)
CANCEL_HOTEL_DOC = _lines(
    L("Cancellation Rate Insight:"),
    L("Hotel: %s", ("s", "hotel")),
    L("Cancellation rate: %s%%", ("f2", "cancellation_rate")),
    L("Total bookings: %d", ("d", "total_bookings")),
    L("Canceled bookings: %d", ("d", "canceled_bookings")),
)
GEO_DOC = _lines(
    L("Geographical Distribution Insight:"),
    L("Country: %s", ("s", "country")),
    L("Total bookings: %d", ("d", "booking_count")),
    L("Confirmed bookings: %d", ("d", "confirmed_bookings")),
    L("Canceled bookings: %d", ("d", "canceled_bookings")),
    L("Cancellation rate: %s%%", ("f2", "cancel_pct")),
    L("Total revenue: $%s", ("f2", "total_revenue")),
)
LEAD_STATS_DOC = _lines(
    L("Lead Time Distribution Insight:"),
    L("Minimum lead time: %d days", ("d", "min_lead_time")),
    L("Maximum lead time: %d days", ("d", "max_lead_time")),
    L("Mean lead time: %s days", ("f2", "mean_lead_time")),
    L("Median lead time: %s days", ("f2", "median_lead_time")),
    L("25th percentile: %s days", ("f2", "p25_lead_time")),
    L("75th percentile: %s days", ("f2", "p75_lead_time")),
    L("90th percentile: %s days", ("f2", "p90_lead_time")),
)
LEAD_BIN_DOC = _lines(
    L("Lead Time Distribution Insight:"),
    L("Lead time range: %s", ("s", "bin")),
    L("Number of bookings: %d", ("d", "booking_count")),
)
ADR_DOC = _lines(
    L("Average Daily Rate Insight:"),
    L("Hotel: %s", ("s", "hotel")),
    L("Room Type: %s", ("s", "reserved_room_type")),
    L("Average Rate: $%s", ("f2", "avg_daily_rate")),
    L("Number of Bookings: %d", ("d", "booking_count")),
)
SEGMENT_DOC = _lines(
    L("Market Segment Insight:"),
    L("Segment: %s", ("s", "market_segment")),
    L("Number of Bookings: %d", ("d", "booking_count")),
    L("Cancellation Rate: %s%%", ("f2", "cancellation_rate")),
    L("Average Daily Rate: $%s", ("f2", "avg_daily_rate")),
    L("Average Stay Duration: %s days", ("f2", "avg_stay_duration")),
)
ROOM_SUMMARY_DOC = _lines(
    L("Room Type Distribution Summary:"),
    L("Most common room type: %s", ("s", "reserved_room_type")),
    L("Number of bookings for most common room: %d", ("d", "booking_count")),
    L("Percentage of total bookings: %s%%", ("f1", "share_pct")),
    L("Total bookings across all room types: %d", ("d", "total_bookings")),
)
ROOM_DOC = _lines(
    L("Room Type Insight:"),
    L("Room Type: %s", ("s", "reserved_room_type")),
    L("Total Bookings: %d", ("d", "booking_count")),
    L("Confirmed Bookings: %d", ("d", "confirmed_bookings")),
    L("Canceled Bookings: %d", ("d", "canceled_bookings")),
    L("Average Daily Rate: $%s", ("f2", "avg_daily_rate")),
    L("Average Stay Duration: %s days", ("f2", "avg_stay_duration")),
)


def _metadata(insight_type: str, fields: dict[str, str | F.Column]):
    """A document's record of its own shape as a variant: integers as long, other numbers to 6 decimals."""
    record = [F.lit(insight_type).alias("insight_type")]
    record += [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()]
    return F.to_variant_object(F.struct(*record)).alias("metadata")


def _count(name: str):
    return F.col(name).cast("long")


def _number(name: str):
    return round_half_up(F.col(name).cast("double"), 6)


def _doc(df: DataFrame, id_col, lines, insight_type: str, **fields) -> DataFrame:
    return df.select(id_col.alias("id"), F.lit(insight_type).alias("insight_type"),
                     spark_text(lines).alias("document"), _metadata(insight_type, fields))


def revenue_documents(b: DataFrame) -> DataFrame:
    """D3: one per month; average revenue per booking is 0 without bookings."""
    t = A.revenue_trends(b).withColumn(
        "avg_revenue", F.coalesce(F.try_divide(F.col("total_revenue"),
                                               F.col("booking_count").cast("double")), F.lit(0.0)))
    return _doc(t, F.concat(F.lit("revenue_trend_"), F.coalesce(F.col("date"), F.lit("None"))),
                REVENUE_DOC, "revenue_trends", date="date", revenue=_number("total_revenue"),
                booking_count=_count("booking_count"))


def cancellation_documents(b: DataFrame) -> DataFrame:
    """One overall document and one per hotel, tagged with ``level``."""
    r = A.cancellation_rates(b)
    counts = {"rate": _number("cancellation_rate"), "total_bookings": _count("total_bookings"),
              "canceled_bookings": _count("canceled_bookings")}
    overall = r.where(F.col("level") == "overall").select(
        F.lit("cancellation_rate_overall").alias("id"), F.lit("cancellation_rate").alias("insight_type"),
        spark_text(CANCEL_OVERALL_DOC).alias("document"),
        _metadata("cancellation_rate", {"level": "level", **counts}), F.col("level"))
    hotels = r.where(F.col("level") == "hotel").select(
        F.concat(F.lit("cancellation_rate_"), F.col("hotel")).alias("id"),
        F.lit("cancellation_rate").alias("insight_type"),
        spark_text(CANCEL_HOTEL_DOC).alias("document"),
        _metadata("cancellation_rate", {"level": "level", "hotel": "hotel", **counts}), F.col("level"))
    return overall.unionByName(hotels)


def geo_documents(b: DataFrame, min_bookings: int = 10) -> DataFrame:
    """Countries with more than ``min_bookings`` bookings."""
    g = (A.geographical_distribution(b).where(F.col("booking_count") > min_bookings)
         .withColumn("cancel_pct", F.col("canceled_bookings").cast("double")
                     / F.col("booking_count").cast("double") * F.lit(100.0)))
    return _doc(g, F.concat(F.lit("geo_dist_"), F.col("country")), GEO_DOC, "geographical_distribution",
                country="country", booking_count=_count("booking_count"), confirmed_bookings=_count("confirmed_bookings"),
                canceled_bookings=_count("canceled_bookings"), total_revenue=_number("total_revenue"))


def lead_time_documents(b: DataFrame) -> DataFrame:
    """One statistics document and one per bin."""
    s = _doc(A.lead_time_stats(b), F.lit("lead_time_stats"), LEAD_STATS_DOC, "lead_time_distribution",
             subtype=F.lit("statistics"), **{n: _number(f"{n}_lead_time") for n in ("min", "max", "mean", "median")})
    bins = _doc(A.lead_time_bins(b), F.concat(F.lit("lead_time_dist_"), F.col("bin")),
                LEAD_BIN_DOC, "lead_time_distribution", subtype=F.lit("distribution"), bin="bin",
                count=_count("booking_count"))
    return s.unionByName(bins)


def adr_documents(b: DataFrame) -> DataFrame:
    """One per hotel and room type."""
    return _doc(A.adr_by_hotel_room(b),
                F.concat(F.lit("adr_"), F.col("hotel"), F.lit("_"), F.col("reserved_room_type")),
                ADR_DOC, "adr_by_room_type", hotel="hotel", room_type="reserved_room_type",
                avg_rate=_number("avg_daily_rate"), booking_count=_count("booking_count"))


def segment_documents(b: DataFrame) -> DataFrame:
    """One per market segment."""
    return _doc(A.market_segment_analysis(b), F.concat(F.lit("segment_"), F.col("market_segment")),
                SEGMENT_DOC, "market_segment_analysis", segment="market_segment", booking_count=_count("booking_count"),
                cancellation_rate=_number("cancellation_rate"), avg_rate=_number("avg_daily_rate"),
                avg_duration=_number("avg_stay_duration"))


def room_summary_document(b: DataFrame) -> DataFrame:
    """The most common room (first maximum), its count and share, and the total."""
    from staylens.operators.views import most_common_room

    return _doc(most_common_room(b), F.lit("room_type_summary"), ROOM_SUMMARY_DOC,
                "room_type_distribution", subtype=F.lit("summary"), most_common_room="reserved_room_type",
                most_common_count=_count("booking_count"), total_bookings=_count("total_bookings"))


def room_documents(b: DataFrame) -> DataFrame:
    """One per room type."""
    return _doc(A.room_type_distribution(b), F.concat(F.lit("room_type_"), F.col("reserved_room_type")),
                ROOM_DOC, "room_type_distribution", room_type="reserved_room_type", booking_count=_count("booking_count"),
                confirmed_bookings=_count("confirmed_bookings"), canceled_bookings=_count("canceled_bookings"),
                avg_rate=_number("avg_daily_rate"), avg_duration=_number("avg_stay_duration"))


def metadata_field(name: str, kind: str = "string"):
    """A field of a document's ``metadata`` variant; null where the record has no such field."""
    return F.try_variant_get(F.col("metadata"), f"$.{name}", kind)


def insight_documents(b: DataFrame) -> DataFrame:
    """All insight documents (day-of-month is not embedded, as in the original), each with ``metadata``,
    a variant: records of different insights have different fields (``metadata_field`` reads one).

    Every part reads the same shared-scan cube, so the bookings are read once.
    """
    b = A.InsightCube(b) if isinstance(b, DataFrame) else b
    parts = [revenue_documents(b), cancellation_documents(b).drop("level"), geo_documents(b),
             lead_time_documents(b), adr_documents(b), segment_documents(b),
             room_summary_document(b), room_documents(b)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
