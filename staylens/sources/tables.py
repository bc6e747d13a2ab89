"""Inputs derived from the driver's Parquet tables.

The bookings data set of the original application is a CSV that is not
shipped; the deterministic derivations below turn the TPC-H style tables
into the same shapes (raw bookings, questions, query log, request log,
answers, vectors).  Every derivation is a narrow projection or a keyed
join, so its cost grows linearly with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.constants import (
    ANSWER_TEXTS, EVENT_ENDPOINTS, PRIORITY_MEALS, QUESTIONS,
)


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _case(col, pairs, default):
    expr = None
    for key, value in pairs:
        expr = (F.when(col == key, F.lit(value)) if expr is None
                else expr.when(col == key, F.lit(value)))
    return expr.otherwise(default)


def raw_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw booking per order, with every column the cleaning step reads.

    Plan shape: lineitem is pre-aggregated to one count per order key
    (partial aggregation before the shuffle), joined to orders on the unique
    order key; customers join on the customer key (AQE splits a hot
    customer); nation is the fixed 25-row dimension and is broadcast.
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                        "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    lines = (read_table(spark, sf_dir, "lineitem", "l_orderkey")
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")))

    j = (orders
         .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
         .join(customer, orders.o_custkey == customer.c_custkey)
         .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))

    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    return j.select(
        (k + 1).alias("booking_id"),
        F.when(k % 3 == 0, "Resort Hotel").otherwise("City Hotel").alias("hotel"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("is_canceled"),
        ((k * 37 + c) % 500).cast("int").alias("lead_time"),
        (F.year("o_orderdate") + 20).cast("int").alias("arrival_date_year"),
        F.date_format("o_orderdate", "MMMM").alias("arrival_date_month"),
        F.dayofmonth("o_orderdate").cast("int").alias("arrival_date_day_of_month"),
        (c % 3).cast("int").alias("stays_in_weekend_nights"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("int").alias("stays_in_week_nights"),
        F.when(k % 97 == 0, 0).otherwise(1 + c % 3).cast("int").alias("adults"),
        F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, 0).otherwise(k % 2)
         .cast("double").alias("children"),
        F.when((k % 97 != 0) & (k % 41 == 0), 1).otherwise(0).cast("int").alias("babies"),
        _case(F.col("o_orderpriority"), PRIORITY_MEALS, F.lit("SC")).alias("meal"),
        F.when(F.col("n_nationkey") == 24, F.lit(None).cast("string"))
         .otherwise(F.col("n_name")).alias("country"),
        F.col("c_mktsegment").alias("market_segment"),
        F.substring(F.lit("ABCDEFG"), (c % 7 + 1).cast("int"), 1).alias("reserved_room_type"),
        F.when(c % 5 == 0, F.lit(None)).otherwise(c % 50).cast("double").alias("agent"),
        F.when(c % 11 != 0, F.lit(None)).otherwise(c % 30).cast("double").alias("company"),
        F.when(k % 101 == 0, "n/a").when(k % 103 == 0, "-6.38")
         .otherwise(F.col("o_totalprice").cast("string")).alias("adr"),
    )


def _question_text(event_id):
    return F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]),
                        (event_id % len(QUESTIONS) + 1).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per event: the question set in rotation."""
    ev = read_table(spark, sf_dir, "events", "event_id")
    return ev.select(F.col("event_id").alias("question_id"),
                     _question_text(F.col("event_id")).alias("text"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    return ev.select((F.col("event_id") + 1).alias("query_id"),
                     _question_text(F.col("event_id")).alias("query_text"),
                     F.col("ts").cast("timestamp").alias("timestamp"),
                     F.col("value").alias("execution_time"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return ev.select(
        _case(F.col("event_type"), EVENT_ENDPOINTS, F.lit(None).cast("string")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).cast("int").alias("status_code"),
        F.col("value").alias("execution_time"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type").isin("click", "purchase"),
               _question_text(F.col("event_id"))).alias("question"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "value")
    pick = F.element_at(F.array(*[F.lit(a) for a in ANSWER_TEXTS]),
                        (F.col("event_id") % len(ANSWER_TEXTS) + 1).cast("int"))
    return ev.select(F.col("event_id").alias("question_id"),
                     _question_text(F.col("event_id")).alias("question"),
                     pick.alias("answer"),
                     F.col("value").alias("execution_time"),
                     (F.col("event_id") % 10).cast("int").alias("context_count"))


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, as the searched side of a whole search."""
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a whole search: every vector with an id divisible by 20."""
    return search_vectors(spark, sf_dir).where(F.col("vec_id") % 20 == 0)
