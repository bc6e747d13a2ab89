"""Incremental index refresh.

``refresh_search`` keeps a searchable booking collection, the stored insight aggregate, the
insight payloads and the searchable insight documents in step with arriving bookings; each of
them is brought to the booking collection's state by its own check, so a run that died between
two of them is completed by the next.

The original finds new rows by "id greater than the last indexed id".  That
misses gaps and re-numbered rows, so the default here is an anti join of
the clean bookings against the index on the document id (sort-merge or
broadcast, chosen by AQE from runtime sizes); the id watermark is kept as
an option.  Inserting is a keyed upsert, so a replayed batch cannot create
duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators.documents import booking_documents


def last_indexed_id(index: DataFrame) -> DataFrame:
    """Largest numeric suffix of ``booking_<n>`` ids; 0 when there is none."""
    n = F.regexp_extract(F.col("id"), r"^booking_(\d+)$", 1)
    return index.agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)).cast("long")
                     .alias("last_indexed_id"))


def new_bookings(b: DataFrame, index: DataFrame, since_id: int | None = None) -> DataFrame:
    """Bookings not in the index (anti join), or with id > ``since_id``."""
    if since_id is not None:
        return b.where(F.col("booking_id") > F.lit(since_id))
    keys = index.select(F.regexp_extract("id", r"^booking_(\d+)$", 1).cast("long").alias("booking_id"))
    return b.join(keys, "booking_id", "left_anti")


def documents_to_add(b: DataFrame, index: DataFrame) -> DataFrame:
    """U3 (batch part): documents and metadata of the bookings not yet indexed."""
    return booking_documents(new_bookings(b, index))


def indexed_fixture(b: DataFrame) -> DataFrame:
    """Test fixture: every booking except the late batch (booking_id % 10 = 0)
    is already indexed."""
    return booking_documents(b.where(F.col("booking_id") % 10 != 0)).select("id")


def incremental_index_update(b: DataFrame, booking_index, insights_coll, insights_table=None) -> int:
    """Append documents for bookings not yet indexed; if any were added,
    refresh the stored insights and upsert the insight documents.

    ``booking_index`` is a ``BookingIndex`` (append-only); the insight
    collection is a small ``VersionedTable``.  Returns the number of booking
    documents added (0 = no-op).
    """
    from staylens.operators.documents import insight_documents
    from staylens.operators.payloads import generate_all_insights
    from staylens.sources.store import add_documents

    added = booking_index.add_new(booking_documents(b))
    if added == 0:
        return 0
    if insights_table is not None:
        generate_all_insights(b, insights_table)
    add_documents(insights_coll, insight_documents(b))
    return added


def stored_cube(coll, base: str):
    """The insight aggregate of the collection's bookings, stored once for each state of the collection.

    New bookings alone are read and their aggregate is added to the stored one; a changed booking, whose old
    row cannot be taken out of the extremes, or a merge since the last stored state needs all bookings."""
    from staylens.operators.insights import InsightCube
    from staylens.sources.store import _fs

    state, spark = coll.state(), coll.spark
    fs, p, jvm = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    states = [int(n[len("state="):]) for n in names if n.startswith("state=")
              and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))]
    if state not in states:
        live = coll.live()
        last = max((s for s in states if s in live), default=None)
        fresh = [n for n in live if last is not None and n > last]
        added = coll._segments("docs", fresh) if fresh else None
        if added is not None and added.where("replaces IS NOT NULL").isEmpty():
            cube = InsightCube.merged(InsightCube.stored(spark.read.parquet(f"{base}/state={last}")),
                                      InsightCube(added.select("booking.*")))
        else:
            cube = InsightCube(coll.documents().select("booking.*"))
        cube.df.write.mode("overwrite").parquet(f"{base}/state={state}")
    return InsightCube.stored(spark.read.parquet(f"{base}/state={state}"))


class SearchStore:
    """The folders that ``refresh_search`` keeps in step."""

    def __init__(self, spark, base: str, buckets: int | None = None):
        from staylens.operators.collection import BUCKETS, Collection
        from staylens.sources.store import VersionedTable

        base = base.rstrip("/")
        self.bookings = Collection(spark, f"{base}/bookings_data", buckets or BUCKETS)
        self.insights = Collection(spark, f"{base}/insights_data", 4)         # a few hundred rows at any size
        self.payloads = VersionedTable(spark, f"{base}/insights")
        self.cubes = f"{base}/cubes"
        self.stated = VersionedTable(spark, f"{base}/payload_state")


def refresh_search(b: DataFrame, store: SearchStore, key: str | None = None, newest: str | None = None) -> int:
    """Upsert the bookings' documents, then bring the insights to the same state; returns the number of
    new or changed bookings.  A repeated ``key`` adds nothing but completes what an earlier run left undone.
    ``newest``: a column of ``b`` that orders rows of one booking id."""
    docs = booking_documents(b, with_booking=True)
    if newest:
        docs = docs.withColumn(newest, F.col("booking")[newest]).withColumn("booking", F.col("booking").dropFields(newest))
    added = store.bookings.add(docs, key, newest)
    refresh_insights(store)
    return added


def refresh_insights(store: SearchStore) -> None:
    """Aggregate, payloads and insight documents of the booking collection's present state."""
    from staylens.operators import payloads
    from staylens.operators.documents import insight_documents

    state = store.bookings.state()
    key = f"state_{state}"
    stated = store.stated.read()
    if not state or (stated is not None and stated.first()["state"] == state
                     and any(c.key == key for c in store.insights.commits())):
        return
    cube = stored_cube(store.bookings, store.cubes)
    payloads.generate_all_insights(cube, store.payloads)
    store.insights.add(insight_documents(cube), key, complete=True)
    store.stated.write(store.bookings.spark.createDataFrame([(state,)], "state long").coalesce(1))
