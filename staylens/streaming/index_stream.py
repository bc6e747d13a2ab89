"""Streaming refresh of the booking index (U4) and of monthly revenue.

Raw booking files arrive in a folder.  Both jobs read it with the file
source and a declared schema, and run with ``Trigger.AvailableNow`` (or any
other trigger) from a checkpoint in the shared checkpoint folder, so a
restarted job resumes where it stopped.

* U4 keeps no streaming state: each micro-batch is cleaned, anti-joined
  with the id ranges of the index it touches and appended.  A replayed batch
  finds its ids already indexed, so replays cannot duplicate documents.
* ``start_search_stream`` keeps the whole searchable store (documents, postings, insight
  aggregate, payloads, insight documents) in step; every sink is keyed by the micro-batch or
  by the state it leads to, so a batch replayed after a crash between two sinks completes them.
* U5 keeps one aggregation row per (year, month) in the state store
  (bounded by the calendar, so no watermark is needed) and writes the
  updated rows of each micro-batch with a keyed upsert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.columns import exact_sum
from staylens.operators.clean import clean_bookings
from staylens.operators.documents import booking_documents
from staylens.operators.incremental import SearchStore, refresh_search
from staylens.sources.files import RAW_SCHEMA
from staylens.sources.store import BookingIndex, VersionedTable


def raw_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return reader.option("header", True).csv(folder)
    return reader.parquet(folder)


def start_index_stream(spark: SparkSession, folder: str, index_base: str, checkpoint: str,
                       fmt: str = "parquet", available_now: bool = True):
    """U4: keep the booking documents collection in step with arriving files."""
    index = BookingIndex(spark, index_base)

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        index.add_new(booking_documents(clean_bookings(batch)))

    writer = raw_stream(spark, folder, fmt).writeStream.foreachBatch(upsert_batch) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_search_stream(spark: SparkSession, folder: str, base: str, checkpoint: str, fmt: str = "parquet",
                        available_now: bool = True, max_files_per_trigger: int | None = None, buckets: int | None = None):
    """U4: keep search and insights in step with arriving files.  ``base`` belongs to this stream: its ledger
    names the micro-batches of the checkpoint."""
    store = SearchStore(spark, base, buckets)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        refresh_search(clean_bookings(batch), store, key=f"batch_{batch_id}")

    writer = raw_stream(spark, folder, fmt, max_files_per_trigger).writeStream.foreachBatch(refresh) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_revenue_stream(spark: SparkSession, folder: str, table_base: str, checkpoint: str,
                         fmt: str = "parquet", available_now: bool = True):
    """Monthly confirmed revenue (A1) maintained as files arrive."""
    table = VersionedTable(spark, table_base)
    clean = clean_bookings(raw_stream(spark, folder, fmt))
    agg = (clean.where(F.col("is_canceled") == 0)
           .groupBy("arrival_date_year", "arrival_date_month_num")
           .agg(exact_sum("revenue").alias("total_revenue"),
                F.count(F.lit(1)).alias("booking_count")))

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            "arrival_date_year", "arrival_date_month_num",
            F.when(F.col("arrival_date_month_num").isNotNull(),
                   F.format_string("%04d-%02d", "arrival_date_year", "arrival_date_month_num")).alias("date"),
            "total_revenue", "booking_count")
        table.upsert(rows, ["arrival_date_year", "arrival_date_month_num"])

    writer = (agg.writeStream.outputMode("update").foreachBatch(upsert_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
