"""Stores: versioned upserts, insights, query log, collections, JSON payloads."""

import json

from pyspark.sql import functions as F

from staylens.operators import payloads as PL
from staylens.plans.context import bookings
from staylens.sources import store as S


def test_upsert_twice_equals_once(spark, scratch):
    t = S.VersionedTable(spark, f"{scratch}/docs")
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, document string")
    S.add_documents(t, new)
    S.add_documents(t, new)
    assert sorted((r.id, r.document) for r in t.read().collect()) == [("a", "x"), ("b", "y")]
    S.add_documents(t, spark.createDataFrame([("a", "z")], "id string, document string"))
    assert sorted((r.id, r.document) for r in t.read().collect()) == [("a", "z"), ("b", "y")]
    assert t.versions() == [2, 3]          # older versions go after a commit


def test_insight_upsert_keeps_type_and_defaults_metadata(spark, scratch):
    t = S.VersionedTable(spark, f"{scratch}/insights")
    first = spark.createDataFrame([("revenue_trends", "time_series", '{"a":1}', None)],
                                  "insight_id string, insight_type string, insight_data string, metadata string")
    S.upsert_insights(t, first)
    second = spark.createDataFrame([("revenue_trends", "other", '{"a":2}', '{"d":1}')],
                                   "insight_id string, insight_type string, insight_data string, metadata string")
    S.upsert_insights(t, second)
    rows = t.read().collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.insight_type, r.insight_data, r.metadata) == ("time_series", '{"a":2}', '{"d":1}')
    assert S.get_insight(t, "revenue_trends").first().insight_data == '{"a":2}'
    assert S.get_insight(t, "missing").count() == 0


def test_generate_and_select_insights(spark, scratch, sf_small):
    b = bookings(spark, sf_small)
    t = S.VersionedTable(spark, f"{scratch}/insights2")
    calls = []

    def regen():
        calls.append(1)
        PL.generate_all_insights(b, t)

    got = S.select_insights(t, ["revenue_trends", "cancellation_rate"], regen)
    assert sorted(r.insight_id for r in got.collect()) == ["cancellation_rate", "revenue_trends"]
    assert len(calls) == 1
    S.select_insights(t, ["revenue_trends"], regen)
    assert len(calls) == 1  # nothing missing: no regeneration
    allrows = S.get_all_insights(t).collect()
    assert len(allrows) == 5 and all(r.insight_data for r in allrows)
    rev = json.loads([r for r in allrows if r.insight_id == "revenue_trends"][0].insight_data)
    assert rev["dates"][0] < rev["dates"][-1] and len(rev["dates"]) == len(rev["revenues"])
    lead = json.loads([r for r in allrows if r.insight_id == "lead_time_distribution"][0].insight_data)
    assert lead["distribution"]["counts"] == [16, 46, 122, 182, 372, 259]
    schema = PL.payload_schema(b, "cancellation_rate")
    parsed = S.get_insight(t, "cancellation_rate", schema).first().payload
    assert parsed.overall.total_bookings == 1484


def test_query_log_append_and_recent(spark, scratch):
    path = f"{scratch}/log"
    rows = spark.createDataFrame([("q1", "a1", 0.5), ("q2", "a2", 0.7)],
                                 "query_text string, response string, execution_time double")
    S.append_query_log(spark, path, rows)
    S.append_query_log(spark, path, rows.limit(1))
    log = spark.read.parquet(path)
    ids = sorted(r.query_id for r in log.collect())
    assert len(set(ids)) == 3 and ids[-1] > ids[1]
    recent = S.recent_queries(log, 2).collect()
    assert [r.query_id for r in recent] == sorted(ids, reverse=True)[:2]
    assert log.where(F.col("feedback").isNotNull()).count() == 0


def test_index_status_empty(spark):
    counts = spark.createDataFrame([("bookings_data", 3), ("insights_data", 0)],
                                   "collection string, row_count long")
    assert {r.status for r in S.index_status(counts).collect()} == {"empty"}


def test_summary_json(spark, scratch):
    df = spark.createDataFrame([(15, 0.625)], "questions_tested long, average_accuracy double")
    S.write_summary_json(df, f"{scratch}/summary")
    back = spark.read.json(f"{scratch}/summary").first()
    assert back.questions_tested == 15


def test_incremental_index_update(spark, scratch, sf_small):
    from staylens.operators.incremental import incremental_index_update, last_indexed_id

    b = bookings(spark, sf_small)
    bcoll = S.BookingIndex(spark, f"{scratch}/bookings_data", range_size=500)
    icoll = S.collection(spark, scratch, "insights_data")
    older = b.where(F.col("booking_id") % 10 != 0)
    assert incremental_index_update(older, bcoll, icoll) == older.count()
    assert incremental_index_update(older, bcoll, icoll) == 0          # nothing new: no-op
    added = incremental_index_update(b, bcoll, icoll)                   # the late batch
    assert added == b.count() - older.count()
    assert bcoll.read().count() == b.count()
    assert bcoll.read().select("id").distinct().count() == b.count()
    from staylens.operators.documents import insight_documents

    assert icoll.read().count() == insight_documents(b).count()
    top = last_indexed_id(bcoll.read()).first().last_indexed_id
    assert top == b.agg(F.max("booking_id")).first()[0]


def test_booking_index_prunes_to_touched_ranges(spark, scratch):
    idx = S.BookingIndex(spark, f"{scratch}/bidx", range_size=10)
    docs = spark.createDataFrame([(i, f"booking_{i}", "d") for i in range(1, 51)],
                                 "booking_id long, id string, document string")
    assert idx.add_new(docs) == 50
    late = spark.createDataFrame([(45, "booking_45", "d"), (51, "booking_51", "d")],
                                 "booking_id long, id string, document string")
    plan = idx.not_indexed(late)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_range" in plan and "IN (4,5)" in plan
    assert idx.add_new(late) == 1
    assert idx.read().count() == 51


def test_upsert_keeps_one_row_per_key_and_two_versions(spark, scratch):
    t = S.VersionedTable(spark, f"{scratch}/t")
    for k in range(4):
        t.upsert(spark.createDataFrame([("a", k, k), ("a", k + 10, k), ("b", k, -k)], "id string, at int, v int"), "id",
                 newest="at")
    assert t.versions() == [3, 4]
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 13, 3), ("b", 3, -3)]


def test_index_adds_one_row_per_id(spark, scratch):
    ix = S.BookingIndex(spark, f"{scratch}/ix")
    docs = spark.createDataFrame([(1, "booking_1", "old"), (1, "booking_1", "other"), (2, "booking_2", "x")],
                                 "booking_id long, id string, document string")
    assert ix.add_new(docs) == 2 and ix.add_new(docs) == 0 and ix.read().count() == 2


def test_status_of_an_empty_collection(spark):
    got = S.index_status(spark.createDataFrame([("insights_data", 7)], "collection string, row_count long")).collect()
    assert sorted(tuple(r) for r in got) == [("bookings_data", 0, "empty"), ("insights_data", 7, "empty")]


def test_recent_queries_carry_their_number(spark):
    log = spark.createDataFrame([(i, "q", None, 0.1) for i in range(14)],
                                "query_id long, query_text string, timestamp timestamp, execution_time double")
    rows = S.recent_queries(log, 10).collect()
    assert len(rows) == 10 and {r["returned"] for r in rows} == {10} and rows[0]["query_id"] == 13


def test_shared_folder_is_read_not_replaced(spark):
    from staylens.plans.session import ensure_checkpoint_dir

    before = spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == before == ensure_checkpoint_dir(spark)
