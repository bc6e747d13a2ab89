"""Insight aggregations.

Every insight is a hash aggregate over the clean bookings with a partial
(map-side) aggregation before the exchange, so low-cardinality keys such as
the two hotels or seven room types cannot skew a reducer: each map task
sends at most one row per key.  Money is summed in DECIMAL(18,2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.columns import count_if, exact_avg, exact_parts, exact_sum, pct, sum_of_parts
from staylens.functions.constants import LEAD_TIME_EDGES, LEAD_TIME_LABELS



# Display order of each insight (the order the original's SQL returned).
# Building blocks stay unsorted: a sort is applied once, where a result is shown.
DISPLAY_ORDER = {
    "revenue_trends": ["arrival_date_year", "arrival_date_month_num"],
    "geographical_distribution": [("booking_count", "desc"), "country"],
    "lead_time_histogram": ["lead_time"],
    "lead_time_bins": ["bin_order"],
    "adr_by_hotel_room": ["hotel", ("avg_daily_rate", "desc"), "reserved_room_type"],
    "market_segment_analysis": [("booking_count", "desc"), "market_segment"],
    "day_of_month_distribution": ["arrival_date_day_of_month"],
    "room_type_distribution": [("booking_count", "desc"), "reserved_room_type"],
}


def shown(df: DataFrame, insight: str) -> DataFrame:
    """``df`` sorted in the display order of ``insight``."""
    keys = [F.desc(k[0]) if isinstance(k, tuple) else F.col(k) for k in DISPLAY_ORDER[insight]]
    return df.orderBy(*keys)


def confirmed():
    return F.col("is_canceled") == 0


def canceled():
    return F.col("is_canceled") == 1


def _avg_int(col: str):
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def revenue_trends(b: DataFrame) -> DataFrame:
    """A1: confirmed revenue and bookings per (year, month), labelled YYYY-MM."""
    agg = (b.where(confirmed())
           .groupBy("arrival_date_year", "arrival_date_month_num")
           .agg(exact_sum("revenue").alias("total_revenue"),
                F.count(F.lit(1)).alias("booking_count")))
    label = F.when(F.col("arrival_date_month_num").isNotNull(),
                   F.format_string("%04d-%02d", "arrival_date_year", "arrival_date_month_num"))
    return (agg.select("arrival_date_year", "arrival_date_month_num", label.alias("date"),
                       "total_revenue", "booking_count"))


def cancellation_rates(b: DataFrame) -> DataFrame:
    """A2 + A3 in one scan: GROUPING SETS ((hotel), ())."""
    agg = b.rollup("hotel").agg(
        count_if(canceled()).alias("canceled_bookings"),
        F.count(F.lit(1)).alias("total_bookings"),
        F.grouping("hotel").alias("g"))
    return agg.select(
        F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.lit("hotel")).alias("level"),
        "hotel", "canceled_bookings", "total_bookings",
        pct(F.col("canceled_bookings"), F.col("total_bookings")).alias("cancellation_rate"))


def cancellation_by_hotel(b: DataFrame) -> DataFrame:
    """A2."""
    return (cancellation_rates(b).where(F.col("level") == "hotel")
            .select("hotel", "canceled_bookings", "total_bookings", "cancellation_rate"))


def cancellation_overall(b: DataFrame) -> DataFrame:
    """A3."""
    return (cancellation_rates(b).where(F.col("level") == "overall")
            .select("canceled_bookings", "total_bookings", "cancellation_rate"))


def geographical_distribution(b: DataFrame) -> DataFrame:
    """A4: per country; revenue counts confirmed bookings only."""
    return (b.groupBy("country").agg(
        F.count(F.lit(1)).alias("booking_count"),
        count_if(confirmed()).alias("confirmed_bookings"),
        count_if(canceled()).alias("canceled_bookings"),
        exact_sum(F.when(confirmed(), F.col("revenue")).otherwise(F.lit(0.0))).alias("total_revenue")))


def top_countries(b: DataFrame, n: int = 20) -> DataFrame:
    """A5: top-n of A4 by bookings (TakeOrderedAndProject, country breaks ties)."""
    return (geographical_distribution(b).select("country", "booking_count")
            .orderBy(F.desc("booking_count"), "country").limit(n))


def lead_time_histogram(b: DataFrame) -> DataFrame:
    """Confirmed bookings per exact lead time."""
    return (b.where(confirmed()).groupBy("lead_time")
            .agg(F.count(F.lit(1)).alias("booking_count")))


def lead_time_stats(b: DataFrame) -> DataFrame:
    """Statistics over the compact histogram A6, weighted by its counts.

    ``percentile(value, p, frequency)`` interpolates linearly exactly like
    expanding every booking, but its state is one entry per distinct lead
    time instead of one per booking.
    """
    h = lead_time_histogram(b)
    ps = F.percentile(F.col("lead_time"), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]),
                      F.col("booking_count"))
    stats = h.agg(
        F.min("lead_time").alias("min_lead_time"),
        F.max("lead_time").alias("max_lead_time"),
        F.try_divide(F.sum(F.col("lead_time") * F.col("booking_count")).cast("double"),
                     F.sum(F.when(F.col("lead_time").isNotNull(), F.col("booking_count"))).cast("double"))
        .alias("mean_lead_time"),
        ps.alias("ps"))
    return stats.select(
        "min_lead_time", "max_lead_time", "mean_lead_time",
        F.col("ps")[1].alias("median_lead_time"),
        F.col("ps")[0].alias("p25_lead_time"),
        F.col("ps")[1].alias("p50_lead_time"),
        F.col("ps")[2].alias("p75_lead_time"),
        F.col("ps")[3].alias("p90_lead_time"))


def lead_time_bin_order(lead_time, zero_in_first_bin: bool = False):
    """Right-closed bins (0,7] (7,30] (30,90] (90,180] (180,365] (365,inf).

    Lead time 0 falls in no bin (null) unless ``zero_in_first_bin``.
    """
    lo = LEAD_TIME_EDGES
    first_lo = (lead_time >= lo[0]) if zero_in_first_bin else (lead_time > lo[0])
    expr = F.when(first_lo & (lead_time <= lo[1]), F.lit(1))
    for i in range(1, len(lo) - 1):
        expr = expr.when((lead_time > lo[i]) & (lead_time <= lo[i + 1]), F.lit(i + 1))
    return expr.when(lead_time > lo[-1], F.lit(len(lo)))


def lead_time_bins(b: DataFrame, zero_in_first_bin: bool = False) -> DataFrame:
    """Counts per bin from the histogram; empty bins report 0.

    The six-row bin frame is fixed in size, so it is broadcast into the
    outer join.
    """
    spark = b.sparkSession
    bins = spark.createDataFrame(
        [(i + 1, label) for i, label in enumerate(LEAD_TIME_LABELS)],
        "bin_order int, bin string")
    counts = (lead_time_histogram(b)
              .select(lead_time_bin_order(F.col("lead_time"), zero_in_first_bin).alias("bin_order"),
                      "booking_count")
              .where(F.col("bin_order").isNotNull())
              .groupBy("bin_order").agg(F.sum("booking_count").alias("booking_count")))
    return (F.broadcast(bins).join(counts, "bin_order", "left")
            .select("bin_order", "bin",
                    F.coalesce(F.col("booking_count"), F.lit(0)).cast("long").alias("booking_count")))


def adr_by_hotel_room(b: DataFrame) -> DataFrame:
    """Confirmed, positive rate; average rate per hotel and room type."""
    return (b.where(confirmed() & (F.col("adr") > 0))
            .groupBy("hotel", "reserved_room_type")
            .agg(exact_avg("adr").alias("avg_daily_rate"),
                 F.count(F.lit(1)).alias("booking_count")))


def market_segment_analysis(b: DataFrame) -> DataFrame:
    """A10: all bookings per market segment."""
    return (b.groupBy("market_segment").agg(
        F.count(F.lit(1)).alias("booking_count"),
        count_if(canceled()).alias("canceled_bookings"),
        exact_avg("adr").alias("avg_daily_rate"),
        _avg_int("total_stay_duration").alias("avg_stay_duration"))
        .select("market_segment", "booking_count", "canceled_bookings",
                pct(F.col("canceled_bookings"), F.col("booking_count")).alias("cancellation_rate"),
                "avg_daily_rate", "avg_stay_duration"))


def day_of_month_distribution(b: DataFrame) -> DataFrame:
    """Confirmed bookings per arrival day of month."""
    return (b.where(confirmed()).groupBy("arrival_date_day_of_month")
            .agg(F.count(F.lit(1)).alias("booking_count")))


def room_type_distribution(b: DataFrame) -> DataFrame:
    """All bookings per reserved room type."""
    return (b.groupBy("reserved_room_type").agg(
        F.count(F.lit(1)).alias("booking_count"),
        count_if(confirmed()).alias("confirmed_bookings"),
        count_if(canceled()).alias("canceled_bookings"),
        exact_avg("adr").alias("avg_daily_rate"),
        _avg_int("total_stay_duration").alias("avg_stay_duration")))


# --- shared scan: every insight from one GROUPING SETS aggregate -----------

CUBE_SETS = [
    ("trend", ["arrival_date_year", "arrival_date_month_num"]),
    ("hotel", ["hotel"]),
    ("all", []),
    ("country", ["country"]),
    ("lead", ["lead_time"]),
    ("hotel_room", ["hotel", "reserved_room_type"]),
    ("segment", ["market_segment"]),
    ("day", ["arrival_date_day_of_month"]),
    ("room", ["reserved_room_type"]),
    ("month", ["arrival_date_month_num"]),
    ("hotel_lead", ["hotel", "lead_time"]),
]
CUBE_COLUMNS = ["arrival_date_year", "arrival_date_month_num", "hotel", "country", "lead_time",
                "reserved_room_type", "market_segment", "arrival_date_day_of_month"]


def _gid(keys) -> int:
    n = len(CUBE_COLUMNS)
    return sum(1 << (n - 1 - i) for i, c in enumerate(CUBE_COLUMNS) if c not in keys)


class InsightCube:
    """All insight and routed-query measures in one pass: ``GROUPING SETS``
    over eleven key sets.

    The bookings are read once; Expand + partial aggregation turn each input
    row into at most one partial row per key set and task, and the single
    shuffle carries only those partials.  Each insight is a filter on the
    grouping id of the stored (small) result.
    """

    def __init__(self, b: DataFrame):
        self.sparkSession = b.sparkSession
        conf, canc = confirmed(), canceled()
        pos = conf & (F.col("adr") > 0)
        # the amounts are cut into their exact parts once a booking, not once a booking and key set
        amounts = {"rev_conf": F.when(conf, F.col("revenue")), "adr_sum": F.col("adr"), "adr_pos_sum": F.when(pos, F.col("adr")),
                   "rev_all": F.col("revenue"), "adr_conf_sum": F.when(conf, F.col("adr"))}
        parts = {name: exact_parts(c) for name, c in amounts.items()}
        b = b.select("*", *[c.alias(f"_{name}_{i}") for name, two in parts.items() for i, c in enumerate(two)])

        def added(name):
            return sum_of_parts(f"_{name}_0", f"_{name}_1").alias(name)

        self.df = b.groupingSets([[F.col(c) for c in keys] for _, keys in CUBE_SETS],
                                 *[F.col(c) for c in CUBE_COLUMNS]).agg(
            F.count(F.lit(1)).alias("total"),
            count_if(conf).alias("confirmed"),
            count_if(canc).alias("canceled"),
            added("rev_conf"),
            added("adr_sum"),
            F.count("adr").alias("adr_cnt"),
            added("adr_pos_sum"),
            F.count(F.when(pos, F.lit(1))).alias("adr_pos_cnt"),
            F.sum("total_stay_duration").alias("stay_sum"),
            F.count("total_stay_duration").alias("stay_cnt"),
            added("rev_all"),
            added("adr_conf_sum"),
            F.count(F.when(conf, F.col("adr"))).alias("adr_conf_cnt"),
            F.sum(F.when(conf, F.col("total_stay_duration"))).alias("stay_conf_sum"),
            F.count(F.when(conf, F.col("total_stay_duration"))).alias("stay_conf_cnt"),
            F.min(F.when(conf, F.col("total_stay_duration"))).alias("stay_conf_min"),
            F.max(F.when(conf, F.col("total_stay_duration"))).alias("stay_conf_max"),
            F.grouping_id().alias("gid"))
        # The result is a few rows per key.  It is checkpointed (written to the
        # shared checkpoint folder, lineage cut) so that every insight reads
        # the same stored rows: left as a plan, Catalyst would push each
        # insight's grouping-id filter into its own Expand and scan the
        # bookings once per insight again.
        from staylens.plans.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(self.sparkSession)
        self.df = self.df.checkpoint(eager=True)

    @classmethod
    def stored(cls, df: DataFrame) -> "InsightCube":
        """A cube read back from a stored result (same columns as ``df`` above)."""
        c = cls.__new__(cls)
        c.sparkSession = df.sparkSession
        c.df = df
        return c

    @classmethod
    def merged(cls, *cubes: "InsightCube") -> "InsightCube":
        """The cube of several disjoint sets of bookings: counts and sums are added up, extremes compared."""
        rows = cubes[0].df
        for c in cubes[1:]:
            rows = rows.unionByName(c.df)
        kinds = dict(rows.dtypes)
        measures = [c for c in rows.columns if c not in CUBE_COLUMNS and c != "gid"]
        by_name = {"stay_conf_min": F.min, "stay_conf_max": F.max}
        added = [by_name.get(c, exact_sum if kinds[c] == "double" else F.sum)(c).alias(c) for c in measures]
        return cls.stored(rows.groupBy(*CUBE_COLUMNS, "gid").agg(*added).select(*rows.columns))

    def part(self, name: str) -> DataFrame:
        keys = dict(CUBE_SETS)[name]
        return self.df.where(F.col("gid") == _gid(keys))


def _ratio(num: str, den: str):
    return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))


def _cube_revenue_trends(c: InsightCube) -> DataFrame:
    label = F.when(F.col("arrival_date_month_num").isNotNull(),
                   F.format_string("%04d-%02d", "arrival_date_year", "arrival_date_month_num"))
    return (c.part("trend").where(F.col("confirmed") > 0)
            .select("arrival_date_year", "arrival_date_month_num", label.alias("date"),
                    F.col("rev_conf").cast("double").alias("total_revenue"),
                    F.col("confirmed").alias("booking_count")))


def _cube_cancellation_rates(c: InsightCube) -> DataFrame:
    parts = c.df.where(F.col("gid").isin(_gid(["hotel"]), _gid([])))
    return parts.select(
        F.when(F.col("gid") == _gid([]), F.lit("overall")).otherwise(F.lit("hotel")).alias("level"),
        "hotel", F.col("canceled").alias("canceled_bookings"), F.col("total").alias("total_bookings"),
        pct(F.col("canceled"), F.col("total")).alias("cancellation_rate"))


def _cube_geographical(c: InsightCube) -> DataFrame:
    return (c.part("country").select(
        "country", F.col("total").alias("booking_count"), F.col("confirmed").alias("confirmed_bookings"),
        F.col("canceled").alias("canceled_bookings"),
        F.coalesce(F.col("rev_conf").cast("double"), F.lit(0.0)).alias("total_revenue")))


def _cube_lead_histogram(c: InsightCube) -> DataFrame:
    return (c.part("lead").where(F.col("confirmed") > 0)
            .select("lead_time", F.col("confirmed").alias("booking_count")))


def _cube_adr(c: InsightCube) -> DataFrame:
    return (c.part("hotel_room").where(F.col("adr_pos_cnt") > 0)
            .select("hotel", "reserved_room_type",
                    _ratio("adr_pos_sum", "adr_pos_cnt").alias("avg_daily_rate"),
                    F.col("adr_pos_cnt").alias("booking_count")))


def _cube_segments(c: InsightCube) -> DataFrame:
    return (c.part("segment").select(
        "market_segment", F.col("total").alias("booking_count"), F.col("canceled").alias("canceled_bookings"),
        pct(F.col("canceled"), F.col("total")).alias("cancellation_rate"),
        _ratio("adr_sum", "adr_cnt").alias("avg_daily_rate"),
        _ratio("stay_sum", "stay_cnt").alias("avg_stay_duration")))


def _cube_days(c: InsightCube) -> DataFrame:
    return (c.part("day").where(F.col("confirmed") > 0)
            .select("arrival_date_day_of_month", F.col("confirmed").alias("booking_count")))


def _cube_rooms(c: InsightCube) -> DataFrame:
    return (c.part("room").select(
        "reserved_room_type", F.col("total").alias("booking_count"),
        F.col("confirmed").alias("confirmed_bookings"), F.col("canceled").alias("canceled_bookings"),
        _ratio("adr_sum", "adr_cnt").alias("avg_daily_rate"),
        _ratio("stay_sum", "stay_cnt").alias("avg_stay_duration")))


def _dispatch(direct, from_cube):
    """An insight computed from bookings, or read off a shared InsightCube."""
    def fn(b, *args, **kwargs):
        if isinstance(b, InsightCube):
            return from_cube(b, *args, **kwargs)
        return direct(b, *args, **kwargs)
    fn.__doc__ = direct.__doc__
    fn.__name__ = direct.__name__
    return fn


revenue_trends = _dispatch(revenue_trends, _cube_revenue_trends)
cancellation_rates = _dispatch(cancellation_rates, _cube_cancellation_rates)
geographical_distribution = _dispatch(geographical_distribution, _cube_geographical)
lead_time_histogram = _dispatch(lead_time_histogram, _cube_lead_histogram)
adr_by_hotel_room = _dispatch(adr_by_hotel_room, _cube_adr)
market_segment_analysis = _dispatch(market_segment_analysis, _cube_segments)
day_of_month_distribution = _dispatch(day_of_month_distribution, _cube_days)
room_type_distribution = _dispatch(room_type_distribution, _cube_rooms)
