"""The searchable collection: upserts, replays, merges, filtered search; refresh of search and insights."""

import os

import pytest
from pyspark.sql import functions as F

from staylens.operators import incremental, payloads
from staylens.operators import insights as A
from staylens.operators import routing as R
from staylens.operators import retrieval as E
from staylens.operators.collection import Collection
from staylens.operators.documents import booking_documents, insight_documents
from staylens.plans.context import bookings
from staylens.sources.tables import raw_bookings
from staylens.streaming.index_stream import start_search_stream

SCHEMA = "id string, document string, at int"
SCHEMA_NAMES = ("id", "document", "at")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def queries(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")


def test_upsert_replaces_text_and_postings(spark, scratch):
    c = Collection(spark, f"{scratch}/c", buckets=4)
    assert c.documents() is None and c.state() == 0
    docs = [(f"d{i}", f"hotel number w{i}", 1) for i in range(40)]
    assert c.add(spark.createDataFrame(docs, SCHEMA), newest="at") == 40
    assert c.add(spark.createDataFrame(docs, SCHEMA), newest="at") == 0                     # nothing changed
    before = c.live()
    changed = [("d7", "old wording", 2), ("d7", "brand new wording", 3), ("d8", "hotel number w8", 9)]
    assert c.add(spark.createDataFrame(changed, SCHEMA), newest="at") == 1
    new = (set(c.live()) - set(before)).pop()
    assert [d for d in os.listdir(f"{scratch}/c/docs/seg={new}") if d.startswith("bucket=")] and \
        len([d for d in os.listdir(f"{scratch}/c/docs/seg={new}") if d.startswith("bucket=")]) == 1
    assert dict(rows(c.documents(), "id", "document"))["d7"] == "brand new wording" and c.documents().count() == 40
    hit = rows(c.search(queries(spark, "w7", "wording", "w9"), 3), "query_id", "id")
    assert hit == [("w9", "d9"), ("wording", "d7")]                                        # old postings are gone
    assert rows(c.fetch(c.search(queries(spark, "wording"), 1), "document"), "id", "document") == [("d7", "brand new wording")]


def test_replayed_key_and_dead_job_leave_no_trace(spark, scratch, monkeypatch):
    c = Collection(spark, f"{scratch}/c", buckets=4)
    first = spark.createDataFrame([("a", "red fish", 1), ("b", "blue fish", 1)], SCHEMA)
    late = spark.createDataFrame([("b", "green bird", 1), ("x", "red bird", 1)], SCHEMA)
    assert c.add(first, "batch 0") == 2 and c.add(late, "batch 0") == 0
    monkeypatch.setattr(c, "_write_postings", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        c.add(late, "batch 1")
    monkeypatch.undo()
    assert rows(c.documents(), "id", "document") == [("a", "red fish"), ("b", "blue fish")]
    assert c.add(late, "batch 1") == 2 and c.add(late, "batch 1") == 0
    assert rows(c.documents(), "id", "document") == [("a", "red fish"), ("b", "green bird"), ("x", "red bird")]
    assert rows(c.search(queries(spark, "blue", "bird"), 5), "query_id", "id") == [("bird", "b"), ("bird", "x")]


def test_merge_gives_the_search_of_a_fresh_index(spark, scratch):
    c = Collection(spark, f"{scratch}/c", buckets=4, merge_after=3)
    for k in range(6):
        c.add(spark.createDataFrame([(f"d{i}", f"room {'view' if i % 3 else 'sea'} {k if i == k else 'x'} w{i}", k)
                                     for i in range(k, k + 6)], SCHEMA), newest="at")
    c.merge()
    assert len(c.live()) == 1
    qs = queries(spark, "sea room", "view w4", "3", "nothing")
    cols = ("query_id", "id", "score", "rank")
    assert rows(c.search(qs, 4), *cols) == rows(E.tfidf_search(c.documents().select("id", "document"), qs, 4), *cols)
    kept = {int(d[4:]) for d in os.listdir(f"{scratch}/c/docs") if d.startswith("seg=")}
    assert set(c.live()) <= kept and len(kept) < len(c.commits())


def test_filtered_search_by_metadata(spark, scratch, sf_small):
    docs = booking_documents(bookings(spark, sf_small))
    c = Collection(spark, f"{scratch}/c", buckets=4)
    c.add(docs)
    q = queries(spark, "City Hotel canceled BUILDING")
    where = (F.col("metadata.hotel") == "Resort Hotel") & F.col("metadata.is_canceled")
    got = c.fetch(c.search(q, 5, where=where), "metadata").collect()
    assert len(got) == 5 and all(r["metadata"]["hotel"] == "Resort Hotel" and r["metadata"]["is_canceled"] for r in got)
    want = [r["id"] for r in c.search(q, docs.count()).orderBy("rank").join(docs, "id").where(where).orderBy("rank").collect()][:5]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == want


PAIRS = [
    A.revenue_trends, A.cancellation_rates, A.geographical_distribution, A.lead_time_histogram, A.adr_by_hotel_room,
    A.market_segment_analysis, A.day_of_month_distribution, A.room_type_distribution, R.revenue_grid,
    R.cancellation_by_country, R.average_price_by_hotel, R.room_type_popularity, R.country_distribution,
    R.stay_duration_by_hotel, R.lead_time_by_hotel,
]


def near(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()),
                  key=repr)


def test_added_cube_equals_a_full_one_and_reads_new_bookings_alone(spark, scratch, sf_small, monkeypatch):
    b = bookings(spark, sf_small)
    store = incremental.SearchStore(spark, scratch, 4)
    early = b.where("booking_id % 10 <> 0")
    assert incremental.refresh_search(early, store) == early.count()
    made = []
    real = A.InsightCube.__init__
    monkeypatch.setattr(A.InsightCube, "__init__", lambda self, df: (made.append(df.count()), real(self, df))[1])
    late = b.where("booking_id % 10 = 0")
    assert incremental.refresh_search(b, store) == late.count()
    assert made == [late.count()]                                          # the aggregate of the new bookings
    cube, whole = incremental.stored_cube(store.bookings, store.cubes), A.InsightCube(b)
    for fn in PAIRS:
        assert near(fn(cube)) == near(fn(whole)), fn.__name__
    # a changed booking needs all bookings, and its insights follow
    moved = late.orderBy("booking_id").limit(1).withColumn("country", F.lit("ATLANTIS")).withColumn("revenue", F.lit(1e9)) \
        .withColumn("is_canceled", F.lit(0)).withColumn("market_segment", F.lit("SPACE"))
    assert incremental.refresh_search(moved, store) == 1
    assert made[-1] == b.count()
    assert store.insights.documents().where("document LIKE '%SPACE%'").count() > 0
    now = store.bookings.documents().select("booking.*")
    assert rows(store.insights.documents(), "id", "document") == rows(insight_documents(now), "id", "document")
    assert rows(store.bookings.documents().where("booking.country = 'ATLANTIS'"), "id") == rows(booking_documents(moved), "id")
    # and back: the segment that no booking has any more leaves the insights
    assert incremental.refresh_search(late.orderBy("booking_id").limit(1), store) == 1
    assert rows(store.insights.documents(), "id", "document") == rows(insight_documents(b), "id", "document")


def test_stream_killed_between_sinks_ends_like_batch(spark, scratch, sf_small, monkeypatch):
    raw = raw_bookings(spark, sf_small)
    folder, base, ck = f"{scratch}/in", f"{scratch}/store", f"{scratch}/ck"
    raw.where("booking_id % 10 <> 0").coalesce(1).write.parquet(f"{folder}/a")
    start_search_stream(spark, folder + "/*", base, ck, buckets=4).awaitTermination()
    raw.where("booking_id % 10 = 0").coalesce(1).write.parquet(f"{folder}/b")
    real = payloads.generate_all_insights
    monkeypatch.setattr(payloads, "generate_all_insights", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start_search_stream(spark, folder + "/*", base, ck, buckets=4).awaitTermination()
    monkeypatch.setattr(payloads, "generate_all_insights", real)
    start_search_stream(spark, folder + "/*", base, ck, buckets=4).awaitTermination()
    b = bookings(spark, sf_small)
    other = incremental.SearchStore(spark, f"{scratch}/batch", 4)
    incremental.refresh_search(b.where("booking_id % 10 <> 0"), other)
    incremental.refresh_search(b, other)
    store = incremental.SearchStore(spark, base, 4)
    q = queries(spark, "resort hotel july revenue", "cancellation rate", "booking 10")
    for mine, theirs in ((store.bookings, other.bookings), (store.insights, other.insights)):
        assert rows(mine.search(q, 5), "query_id", "id", "score", "rank") == rows(theirs.search(q, 5), "query_id", "id", "score", "rank")
        assert rows(mine.documents(), "id", "document") == rows(theirs.documents(), "id", "document")
    assert rows(store.insights.documents(), "id", "document") == rows(insight_documents(b), "id", "document")
    assert rows(store.payloads.read(), "insight_id", "insight_data") == rows(other.payloads.read(), "insight_id", "insight_data")


def test_insight_metadata_filters_a_search(spark, sf_small, scratch):
    from pyspark.sql import functions as F
    from staylens.operators.documents import metadata_field

    docs = insight_documents(bookings(spark, sf_small))
    c = Collection(spark, f"{scratch}/insights", 4)
    assert c.add(docs, "a") == docs.count()
    assert c.add(docs, "b") == 0                            # equal records are no change
    qs = spark.createDataFrame([("q", "cancellation rate of the hotel")], "query_id string, text string")
    hits = {r["id"] for r in c.search(qs, 50, where=metadata_field("level") == "hotel").collect()}
    hotels = {r["hotel"] for r in bookings(spark, sf_small).select("hotel").distinct().collect()}
    assert hits and hits <= {f"cancellation_rate_{h}" for h in hotels}
    more = c.search(qs, 50).select("id")
    assert more.count() > len(hits)
    changed = docs.withColumn("metadata", F.when(F.col("id") == "room_type_summary", F.parse_json(F.lit('{"level": "hotel"}')))
                              .otherwise(F.col("metadata")))
    assert c.add(changed, "c") == 1                         # a record that differs replaces its row
    found = c.documents().where("id = 'room_type_summary'").select(metadata_field("level").alias("x"), metadata_field("none").alias("y"))
    assert [tuple(r) for r in found.collect()] == [("hotel", None)]


def test_one_row_an_id_is_chosen_in_one_shuffle(spark, scratch):
    from staylens.sources.store import one_per_key

    docs = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("a", "y", 1), (None, "n", 2), (None, "m", 3), ("b", None, 0),
                                  ("b", "", 0), ("c", "only", None), ("c", "only", None)], SCHEMA)
    c = Collection(spark, f"{scratch}/c", 4)
    for newest in (None, "at"):
        chosen = c._one_per_id(docs, newest)
        mine, theirs = (sorted(map(tuple, d.select(*SCHEMA_NAMES).collect()), key=repr) for d in (chosen, one_per_key(docs, ["id"], newest)))
        assert mine == theirs and len(mine) == 4
        before, after = chosen._jdf.queryExecution().executedPlan().toString().rsplit("Exchange", 1)
        assert "Exchange" not in before and "StructsToJson" in before and "StructsToJson" not in after


def test_postings_are_unit_weights_with_little_shuffled(spark, scratch):
    import math
    from collections import Counter

    texts = {f"d{i}": f"Hotel h{i % 3} rare{i} É{i % 2} rare{i}" for i in range(60)} | {"n": None, "e": "", "p": "?!", None: "hotel once"}
    c = Collection(spark, f"{scratch}/c", 4)
    schema = "id string, document string"
    assert c.add(spark.createDataFrame(list(texts.items()), schema)) == len(texts)
    assert c.add(spark.createDataFrame([("d3", "hotel never seen"), ("x", "rare5 seen")], schema)) == 2
    tf = {k: Counter(E.re.findall("[a-z0-9]+", (t or "").lower())) for k, t in texts.items()}
    df = Counter(t for counts in tf.values() for t in counts)
    n, base = len(texts), c.live()[0]
    idf = {t: math.log((n + 1) / (k + 1)) for t, k in df.items()}

    def unit(counts):
        w = {t: k * idf.get(t, math.log(n + 1)) for t, k in counts.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: round(v / norm, 9) for t, v in w.items() if v > 0}

    want = {(base, k, t, w) for k, counts in tf.items() for t, w in unit(counts).items()}
    want |= {(c.live()[1], k, t, w) for k, text in (("d3", "hotel never seen"), ("x", "rare5 seen"))
             for t, w in unit(Counter(text.split())).items()}
    got = [(r["seg"], r["id"], r["term"], round(r["w"], 9)) for r in c._segments("postings", c.live()).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r["term"]: round(r["idf"], 9) for r in c.idf()[0].collect()} == {t: round(w, 9) for t, w in idf.items()}
    files = [f for _, _, names in os.walk(f"{scratch}/c/postings/seg={base}") for f in names if f.endswith(".parquet")]
    assert len(files) <= 4                                  # one task wrote them, each folder once
