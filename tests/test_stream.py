"""Structured Streaming: final state equals the batch result, replays are safe."""

from pyspark.sql import functions as F

from staylens.operators import insights as A
from staylens.operators.clean import clean_bookings
from staylens.sources.store import BookingIndex, VersionedTable
from staylens.sources.tables import raw_bookings
from staylens.streaming.index_stream import start_index_stream, start_revenue_stream


def _drop(spark, raw, folder, cond, name):
    raw.where(cond).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_index_and_revenue_streams(spark, sf_small, scratch):
    raw = raw_bookings(spark, sf_small)
    folder = f"{scratch}/incoming"
    _drop(spark, raw, folder, F.col("booking_id") % 10 != 0, "part1")
    idx, rev = f"{scratch}/index", f"{scratch}/revenue"
    s = start_index_stream(spark, folder + "/*", idx, f"{scratch}/ck_index")
    s.awaitTermination()
    r = start_revenue_stream(spark, folder + "/*", rev, f"{scratch}/ck_rev")
    r.awaitTermination()
    # the late batch arrives
    _drop(spark, raw, folder, F.col("booking_id") % 10 == 0, "part2")
    start_index_stream(spark, folder + "/*", idx, f"{scratch}/ck_index").awaitTermination()
    start_revenue_stream(spark, folder + "/*", rev, f"{scratch}/ck_rev").awaitTermination()
    # full replay from a fresh checkpoint must not duplicate documents
    start_index_stream(spark, folder + "/*", idx, f"{scratch}/ck_index2").awaitTermination()

    clean = clean_bookings(raw)
    index = BookingIndex(spark, idx).read()
    assert index.count() == clean.count()
    assert index.select("id").distinct().count() == clean.count()

    streamed = {(x.arrival_date_year, x.arrival_date_month_num): (x.booking_count, x.total_revenue)
                for x in VersionedTable(spark, rev).read().collect()}
    batch = {(x.arrival_date_year, x.arrival_date_month_num): (x.booking_count, x.total_revenue)
             for x in A.revenue_trends(clean).collect()}
    assert streamed == batch
