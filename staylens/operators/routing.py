"""Keyword-routed questions (R1-R5) and their analytical queries (Q1-Q7).

Questions are a DataFrame, never a driver loop: every route's aggregate is
computed once per run and joined to all questions that need it.  The
aggregates are tiny (one row per hotel, room type, month...), so AQE turns
those joins into broadcast hash joins from runtime sizes; the question
side is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.columns import count_if, exact_avg, exact_sum, pct
from staylens.functions.render import L, spark_line, spark_text
from staylens.functions.text import extract_hotel, extract_month, extract_year, route
from staylens.operators.insights import InsightCube, _dispatch, _ratio, canceled, confirmed



def _all():
    """Unpartitioned window: only ever used on results of a few rows."""
    return Window.partitionBy()


def route_questions(questions: DataFrame) -> DataFrame:
    """Route plus the parameters that route reads."""
    t = F.col("text")
    r = route(t)
    return questions.select(
        "question_id", "text", r.alias("route"),
        F.when(r == "revenue", extract_month(t)).alias("month"),
        F.when(r == "revenue", extract_year(t)).alias("year"),
        F.when(r == "lead", extract_hotel(t)).alias("hotel"))


# --- Q1 -------------------------------------------------------------------

def revenue_grid(b: DataFrame) -> DataFrame:
    """Confirmed revenue per (year, month) and per month over all years."""
    y, m = F.col("arrival_date_year"), F.col("arrival_date_month_num")
    g = (b.where(confirmed()).groupingSets([[y, m], [m]], y, m)
         .agg(exact_sum("revenue").alias("total_revenue"),
              F.count(F.lit(1)).alias("booking_count"),
              exact_avg("adr").alias("avg_daily_rate"),
              F.grouping("arrival_date_year").alias("all_years")))
    return g.select(m.alias("month"),
                    F.when(F.col("all_years") == 1, F.lit(None)).otherwise(y).cast("int").alias("year"),
                    "total_revenue", "booking_count", "avg_daily_rate")


def revenue_for_period(routed: DataFrame, b: DataFrame) -> DataFrame:
    """Q1 for every revenue question; an empty period gives null sums and 0 bookings."""
    q = routed.where(F.col("route") == "revenue").select("question_id", "month", "year")
    # at most 13 rows per arrival year (calendar bound)
    grid = F.broadcast(revenue_grid(b).withColumnRenamed("month", "g_month")
                       .withColumnRenamed("year", "g_year"))
    j = q.join(grid, (q.month == grid.g_month) & q.year.eqNullSafe(grid.g_year), "left")
    return j.select("question_id", "month", "year", "total_revenue",
                    F.coalesce(F.col("booking_count"), F.lit(0)).cast("long").alias("booking_count"),
                    "avg_daily_rate")


# fixed values (answer text formats of the routed queries) are kept next to
# each query below: REVENUE_LINES, CANCEL_*, PRICE_*, ROOM_*, DIST_*, STAY_*, LEAD_*
REVENUE_LINES = [
    L("SQL Results for Revenue Query:\n"),
    L("Total Revenue: $%s\n", ("f2", "total_revenue")),
    L("Number of Bookings: %d\n", ("d", "booking_count")),
    L("Average Daily Rate: $%s\n", ("f2", "avg_daily_rate")),
]


# --- Q2 -------------------------------------------------------------------

def cancellation_by_country(b: DataFrame, min_bookings: int = 10, n: int = 10) -> DataFrame:
    """Q2: countries with more than ``min_bookings``; highest rate first; top n."""
    agg = (b.groupBy("country").agg(F.count(F.lit(1)).alias("total_bookings"),
                                    count_if(canceled()).alias("canceled_bookings"))
           .where(F.col("total_bookings") > min_bookings))
    return (agg.select("country", "total_bookings", "canceled_bookings",
                       pct(F.col("canceled_bookings"), F.col("total_bookings")).alias("cancellation_rate"))
            .orderBy(F.desc("cancellation_rate"), "country").limit(n))


CANCEL_HEAD = [L("SQL Results for Cancellations by Location:\n")]
CANCEL_ROW = [L("Country: %s, Cancellation Rate: %s%%, ", ("s", "country"), ("f2", "cancellation_rate")),
              L("Canceled: %d of %d bookings\n", ("d", "canceled_bookings"), ("d", "total_bookings"))]


# --- Q3 -------------------------------------------------------------------

def average_price_by_hotel(b: DataFrame) -> DataFrame:
    """Q3: per hotel average rate; overall is the unweighted mean of hotel averages."""
    per = (b.where(confirmed() & (F.col("adr") > 0)).groupBy("hotel")
           .agg(F.count(F.lit(1)).alias("booking_count"), exact_avg("adr").alias("avg_daily_rate")))
    return per.withColumn("overall_avg_daily_rate", F.avg("avg_daily_rate").over(_all()))


PRICE_HEAD = [L("SQL Results for Average Price Query:\n"),
              L("Overall Average Daily Rate: $%s\n\n", ("f2", "overall_avg_daily_rate")),
              L("Breakdown by Hotel Type:\n")]
PRICE_ROW = [L("Hotel: %s, Average Daily Rate: $%s ", ("s", "hotel"), ("f2", "avg_daily_rate")),
             L("(Based on %d bookings)\n", ("d", "booking_count"))]


# --- Q4 -------------------------------------------------------------------

def room_type_popularity(b: DataFrame) -> DataFrame:
    """Q4: all bookings per room type, most booked first (rank 1 is 'most common')."""
    per = (b.groupBy("reserved_room_type")
           .agg(F.count(F.lit(1)).alias("booking_count"),
                count_if(confirmed()).alias("confirmed_bookings"),
                exact_avg("adr").alias("avg_daily_rate")))
    w = _all().orderBy(F.desc("booking_count"), "reserved_room_type")
    return per.withColumn("popularity_rank", F.row_number().over(w))


ROOM_HEAD = [L("SQL Results for Room Type Query:\n"),
             L("The most common room type booked is '%s' with %d bookings ",
               ("s", "reserved_room_type"), ("d", "booking_count")),
             L("(%d confirmed) and an average daily rate of $%s.\n\n",
               ("d", "confirmed_bookings"), ("f2", "avg_daily_rate")),
             L("Breakdown of room types by popularity:\n")]
ROOM_ROW = [L("Room Type: %s, Bookings: %d, ", ("s", "reserved_room_type"), ("d", "booking_count")),
            L("Confirmed: %d, Avg Rate: $%s\n", ("d", "confirmed_bookings"), ("f2", "avg_daily_rate"))]


# --- Q5 -------------------------------------------------------------------

def country_distribution(b: DataFrame, min_bookings: int = 5, n: int = 20) -> DataFrame:
    """Q5: top n countries by bookings; revenue includes canceled bookings; the
    share is of the rows shown (a window over at most n rows)."""
    top = (b.groupBy("country").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        count_if(confirmed()).alias("confirmed_bookings"),
        count_if(canceled()).alias("canceled_bookings"),
        exact_sum("revenue").alias("total_revenue"))
        .where(F.col("total_bookings") > min_bookings)
        .orderBy(F.desc("total_bookings"), "country").limit(n))
    shown = F.sum("total_bookings").over(_all())
    return top.select("*",
                      (F.col("total_bookings").cast("double") / shown.cast("double") * F.lit(100.0))
                      .alias("share_pct"),
                      F.count(F.lit(1)).over(_all()).alias("countries_shown"))


DIST_HEAD = [L("SQL Results for Country Distribution Query:\n"),
             L("Distribution of bookings across %d countries (showing top 20):\n\n",
               ("d", "countries_shown"))]
DIST_ROW = [L("Country: %s, Bookings: %d (%s%% of total), ",
              ("s", "country"), ("d", "total_bookings"), ("f1", "share_pct")),
            L("Confirmed: %d, Canceled: %d, ", ("d", "confirmed_bookings"), ("d", "canceled_bookings")),
            L("Revenue: $%s\n", ("f2", "total_revenue"))]


# --- Q6 -------------------------------------------------------------------

def stay_duration_by_hotel(b: DataFrame) -> DataFrame:
    """Q6: confirmed stays per hotel."""
    return (b.where(confirmed()).groupBy("hotel").agg(
        F.count(F.lit(1)).alias("booking_count"),
        F.try_divide(F.sum("total_stay_duration").cast("double"),
                     F.count("total_stay_duration").cast("double")).alias("avg_stay_duration"),
        F.min("total_stay_duration").alias("min_stay"),
        F.max("total_stay_duration").alias("max_stay")))


STAY_BLOCK = [L("  Average Stay Duration: %s days\n", ("f1", "avg_stay_duration")),
              L("  Minimum Stay: %d days\n", ("d", "min_stay")),
              L("  Maximum Stay: %d days\n", ("d", "max_stay")),
              L("  Based on %d bookings\n\n", ("d", "booking_count"))]
STAY_MANY = [L("Hotel Type: %s\n", ("s", "hotel")), *STAY_BLOCK]
STAY_ONE = [L("Data only available for %s:\n", ("s", "hotel")), *STAY_BLOCK,
            L("Note: No data is available for other hotel types in the dataset.\n")]


# --- Q7 -------------------------------------------------------------------

def lead_time_by_hotel(b: DataFrame, hotel: str | None = None) -> DataFrame:
    """Q7: all bookings; lead-time statistics per hotel with exact quartiles."""
    src = b if hotel is None else b.where(F.col("hotel") == hotel)
    ps = F.percentile("lead_time", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = src.groupBy("hotel").agg(
        F.count(F.lit(1)).alias("booking_count"),
        F.try_divide(F.sum("lead_time").cast("double"),
                     F.count("lead_time").cast("double")).alias("avg_lead_time"),
        F.min("lead_time").alias("min_lead_time"),
        F.max("lead_time").alias("max_lead_time"),
        ps.alias("ps"))
    return agg.select("hotel", "booking_count", "avg_lead_time", "min_lead_time", "max_lead_time",
                      F.col("ps")[0].alias("p25_lead_time"), F.col("ps")[1].alias("median_lead_time"),
                      F.col("ps")[2].alias("p75_lead_time"))


LEAD_HEAD = [L("SQL Results for Lead Time Query:\n")]
LEAD_BLOCK = [L("Hotel Type: %s\n", ("s", "hotel")),
              L("  Average Lead Time: %s days\n", ("f1", "avg_lead_time")),
              L("  Minimum Lead Time: %d days\n", ("d", "min_lead_time")),
              L("  Maximum Lead Time: %d days\n", ("d", "max_lead_time")),
              L("  Median Lead Time: %s days\n", ("f1", "median_lead_time")),
              L("  25th Percentile: %s days\n", ("f1", "p25_lead_time")),
              L("  75th Percentile: %s days\n", ("f1", "p75_lead_time")),
              L("  Based on %d bookings\n\n", ("d", "booking_count"))]


# --- the same queries read off a shared InsightCube ------------------------

def _cube_revenue_grid(c: InsightCube) -> DataFrame:
    def part(name, year):
        return (c.part(name).where(F.col("confirmed") > 0)
                .select(F.col("arrival_date_month_num").alias("month"), year.cast("int").alias("year"),
                        F.col("rev_conf").cast("double").alias("total_revenue"),
                        F.col("confirmed").alias("booking_count"),
                        _ratio("adr_conf_sum", "adr_conf_cnt").alias("avg_daily_rate")))
    return part("trend", F.col("arrival_date_year")).unionByName(part("month", F.lit(None)))


def _cube_cancellation_by_country(c: InsightCube, min_bookings: int = 10, n: int = 10) -> DataFrame:
    return (c.part("country").where(F.col("total") > min_bookings)
            .select("country", F.col("total").alias("total_bookings"),
                    F.col("canceled").alias("canceled_bookings"),
                    pct(F.col("canceled"), F.col("total")).alias("cancellation_rate"))
            .orderBy(F.desc("cancellation_rate"), "country").limit(n))


def _cube_average_price(c: InsightCube) -> DataFrame:
    per = (c.part("hotel").where(F.col("adr_pos_cnt") > 0)
           .select("hotel", F.col("adr_pos_cnt").alias("booking_count"),
                   _ratio("adr_pos_sum", "adr_pos_cnt").alias("avg_daily_rate")))
    return per.withColumn("overall_avg_daily_rate", F.avg("avg_daily_rate").over(_all()))


def _cube_room_popularity(c: InsightCube) -> DataFrame:
    per = c.part("room").select("reserved_room_type", F.col("total").alias("booking_count"),
                                F.col("confirmed").alias("confirmed_bookings"),
                                _ratio("adr_sum", "adr_cnt").alias("avg_daily_rate"))
    w = _all().orderBy(F.desc("booking_count"), "reserved_room_type")
    return per.withColumn("popularity_rank", F.row_number().over(w))


def _cube_country_distribution(c: InsightCube, min_bookings: int = 5, n: int = 20) -> DataFrame:
    top = (c.part("country").where(F.col("total") > min_bookings)
           .select("country", F.col("total").alias("total_bookings"),
                   F.col("confirmed").alias("confirmed_bookings"),
                   F.col("canceled").alias("canceled_bookings"),
                   F.col("rev_all").cast("double").alias("total_revenue"))
           .orderBy(F.desc("total_bookings"), "country").limit(n))
    shown = F.sum("total_bookings").over(_all())
    return top.select("*",
                      (F.col("total_bookings").cast("double") / shown.cast("double") * F.lit(100.0))
                      .alias("share_pct"),
                      F.count(F.lit(1)).over(_all()).alias("countries_shown"))


def _cube_stay_duration(c: InsightCube) -> DataFrame:
    return (c.part("hotel").where(F.col("confirmed") > 0)
            .select("hotel", F.col("confirmed").alias("booking_count"),
                    _ratio("stay_conf_sum", "stay_conf_cnt").alias("avg_stay_duration"),
                    F.col("stay_conf_min").alias("min_stay"), F.col("stay_conf_max").alias("max_stay")))


def _cube_lead_time(c: InsightCube, hotel: str | None = None) -> DataFrame:
    """Per hotel from the (hotel, lead time) counts: weighted exact quartiles."""
    h = c.part("hotel_lead")
    if hotel is not None:
        h = h.where(F.col("hotel") == hotel)
    ps = F.percentile(F.col("lead_time"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("total"))
    agg = h.groupBy("hotel").agg(
        F.sum("total").alias("booking_count"),
        F.try_divide(F.sum(F.col("lead_time") * F.col("total")).cast("double"),
                     F.sum(F.when(F.col("lead_time").isNotNull(), F.col("total"))).cast("double")).alias("avg_lead_time"),
        F.min("lead_time").alias("min_lead_time"), F.max("lead_time").alias("max_lead_time"),
        ps.alias("ps"))
    return agg.select("hotel", "booking_count", "avg_lead_time", "min_lead_time", "max_lead_time",
                      F.col("ps")[0].alias("p25_lead_time"), F.col("ps")[1].alias("median_lead_time"),
                      F.col("ps")[2].alias("p75_lead_time"))


revenue_grid = _dispatch(revenue_grid, _cube_revenue_grid)
cancellation_by_country = _dispatch(cancellation_by_country, _cube_cancellation_by_country)
average_price_by_hotel = _dispatch(average_price_by_hotel, _cube_average_price)
room_type_popularity = _dispatch(room_type_popularity, _cube_room_popularity)
country_distribution = _dispatch(country_distribution, _cube_country_distribution)
stay_duration_by_hotel = _dispatch(stay_duration_by_hotel, _cube_stay_duration)
lead_time_by_hotel = _dispatch(lead_time_by_hotel, _cube_lead_time)


# --- R5: answer text per route -------------------------------------------

def _concat_ordered(df: DataFrame, order_cols, line: str, head=None, keys=()) -> DataFrame:
    """Concatenate ``line`` in the given order per key group (a few rows each);
    ``head`` is a column equal on every row (or set on one row only)."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols],
                                                   F.col(line).alias("_line"))))
    body = F.array_join(F.transform(ordered, lambda x: x["_line"]), "")
    aggs = [body.alias("body")]
    if head is not None:
        aggs.append(F.max(head).alias("head"))
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)


def _rows_text(df: DataFrame, row_lines, order_cols, head=None) -> DataFrame:
    lines = df.select("*", spark_text(row_lines).alias("_row"))
    return _concat_ordered(lines, order_cols, "_row", head)


def _answer(route_name: str, text) -> list:
    return [F.lit(route_name).alias("route"), text.alias("answer")]


def route_answer_texts(b: DataFrame) -> DataFrame:
    """R5 for every route without question parameters, plus lead per hotel.

    Result: (route, hotel_key, answer); hotel_key is null for 'all hotels'.
    """
    b = InsightCube(b) if isinstance(b, DataFrame) else b
    q2 = cancellation_by_country(b).withColumn("rk", F.row_number().over(
        _all().orderBy(F.desc("cancellation_rate"), "country")))
    t2 = _rows_text(q2, CANCEL_ROW, ["rk"]).select(
        *_answer("cancellation", F.concat(spark_text(CANCEL_HEAD), F.col("body"))))

    q3 = average_price_by_hotel(b)
    t3 = _rows_text(q3, PRICE_ROW, ["hotel"], head=spark_text(PRICE_HEAD)).select(
        *_answer("average", F.concat("head", "body")))

    q4 = room_type_popularity(b)
    t4 = _rows_text(q4, ROOM_ROW, ["popularity_rank"],
                    head=F.when(F.col("popularity_rank") == 1, spark_text(ROOM_HEAD))).select(
        *_answer("room", F.concat("head", "body")))

    q5 = country_distribution(b).withColumn("rk", F.row_number().over(
        _all().orderBy(F.desc("total_bookings"), "country")))
    t5 = _rows_text(q5, DIST_ROW, ["rk"], head=spark_text(DIST_HEAD)).select(
        *_answer("distribution", F.concat("head", "body")))

    q6 = stay_duration_by_hotel(b).withColumn("n_hotels", F.count(F.lit(1)).over(_all()))
    q6 = q6.withColumn("_row", F.when(F.col("n_hotels") > 1, spark_text(STAY_MANY))
                       .otherwise(spark_text(STAY_ONE)))
    t6 = _concat_ordered(q6, ["hotel"], "_row").select(
        *_answer("stay", F.concat(F.lit("SQL Results for Stay Duration Query:\n"), F.col("body"))))

    parts = [t.withColumn("hotel_key", F.lit(None).cast("string")) for t in (t2, t3, t4, t5, t6)]
    q7 = lead_time_by_hotel(b).withColumn("_row", spark_text(LEAD_BLOCK))
    head7 = spark_line(LEAD_HEAD[0])
    parts.append(_concat_ordered(q7, ["hotel"], "_row").select(
        *_answer("lead", F.concat(head7, F.col("body"))),
        F.lit(None).cast("string").alias("hotel_key")))
    parts.append(q7.select(*_answer("lead", F.concat(head7, F.col("_row"))),
                           F.col("hotel").alias("hotel_key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("route", "hotel_key", "answer")


def routed_answers(questions: DataFrame, b: DataFrame) -> DataFrame:
    """R5 for every question: (question_id, text, route, answer); null when unrouted.

    Both joins have a small build side (the revenue grid, the route texts),
    so the question stream is read once and never shuffled.
    """
    b = InsightCube(b) if isinstance(b, DataFrame) else b  # one scan of the bookings
    routed = route_questions(questions)
    # Both build sides have a structural bound, so they are broadcast and the
    # question stream is never shuffled: the grid has at most 13 rows per
    # arrival year (calendar), the texts one row per route plus one per hotel.
    grid = F.broadcast(revenue_grid(b).withColumnRenamed("month", "g_month")
                       .withColumnRenamed("year", "g_year"))
    with_rev = routed.join(
        grid, (routed.route == "revenue") & (routed.month == grid.g_month)
        & routed.year.eqNullSafe(grid.g_year), "left")
    with_rev = with_rev.withColumn(
        "booking_count", F.coalesce(F.col("booking_count"), F.lit(0)).cast("long"))
    texts = F.broadcast(route_answer_texts(b))
    j = with_rev.join(texts, (with_rev.route == texts.route)
                      & with_rev.hotel.eqNullSafe(texts.hotel_key), "left")
    answer = (F.when(with_rev.route == "revenue", spark_text(REVENUE_LINES))
              .when(with_rev.route == "lead", F.coalesce(texts.answer, spark_line(LEAD_HEAD[0])))
              .otherwise(texts.answer))
    return j.select(with_rev.question_id, with_rev.text, with_rev.route, answer.alias("answer"))
