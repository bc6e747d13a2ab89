"""Registered queries over the refreshed search store (S13, S14, U3, U4, A14): the early bookings are
indexed, the late ones (booking_id % 10 = 0) and changed ones arrive, and what search and insights then
give is compared with SQL over all bookings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staylens.operators import incremental as U
from staylens.operators import retrieval as E
from staylens.operators.collection import Collection
from staylens.operators.documents import booking_documents
from staylens.plans.context import bookings, raw
from staylens.plans.oracle import with_bookings
from staylens.plans.q_documents import BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE
from staylens.plans.q_insights import BINS_VALUES
from staylens.plans.q_retrieval import QTEXTS_CTE, tfidf_sql
from staylens.plans.registry import register
from staylens.plans.session import checkpoint_path
from staylens.plans.sql_text import QUESTIONS_CTE
from staylens.sources.tables import questions

EARLY, LATE = "booking_id % 10 <> 0", "booking_id % 10 = 0"


def _place(spark, name: str) -> str:
    return checkpoint_path(spark, f"search_store/{name}_{uuid.uuid4().hex}")


def _refreshed(spark, sf_dir, name: str) -> U.SearchStore:
    b = bookings(spark, sf_dir)
    store = U.SearchStore(spark, _place(spark, name))
    U.refresh_search(b.where(EARLY), store, key="early")
    U.refresh_search(b, store, key="late")
    return store


def stored_idf_sql(p: str, docs: str, base: str, queries: str) -> list[str]:
    """TF-IDF top-k over ``docs`` under the idf of the documents ``base``; unknown terms weigh ln(n + 1)."""
    ctes = tfidf_sql(p, docs, queries)
    return [f"""{p}_bt AS (SELECT DISTINCT id, term FROM (
              SELECT id, unnest(string_split_regex(lower(document), '[^a-z0-9]+')) AS term FROM {base}) t WHERE term <> '')""",
            ctes[0], f"{p}_n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM {base})",
            f"{p}_idf AS (SELECT term, ln((MAX(n) + 1.0) / (COUNT(*) + 1.0)) AS idf FROM {p}_bt, {p}_n GROUP BY term)",
            f"""{p}_dw AS (SELECT id, term, tf * COALESCE(idf, ln(n + 1.0)) AS w
                FROM {p}_dt LEFT JOIN {p}_idf USING (term), {p}_n)""", *ctes[4:]]


@register("u3_search_after_update", with_bookings(
    "SELECT query_id AS query_text, id, score, rank FROM s_top", QUESTIONS_CTE, QTEXTS_CTE, BOOKING_DOCS_CTE,
    "early AS (SELECT id, document FROM bdocs WHERE booking_id % 10 <> 0)", *stored_idf_sql("s", "bdocs", "early", "qtexts")))
def u3_search_after_update(spark, sf_dir):
    """Booking search after a refresh: late bookings are found, under the idf of the first commit."""
    qt = E.distinct_question_texts(questions(spark, sf_dir))
    docs = booking_documents(bookings(spark, sf_dir))
    c = Collection(spark, _place(spark, "u3"))
    c.add(docs.where(EARLY), "early")
    c.add(docs, "late")
    return c.search(qt, 5).withColumnRenamed("query_id", "query_text")


@register("a14_insights_after_update", with_bookings(
    "SELECT id, document FROM idocs", BINS_VALUES, BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE))
def a14_insights_after_update(spark, sf_dir):
    """Insight documents after a refresh: the stored aggregate plus that of the late bookings."""
    return _refreshed(spark, sf_dir, "a14").insights.documents().select("id", "document")


@register("s14_keyed_upsert", with_bookings("""
SELECT id, CASE WHEN booking_id % 10 = 1 THEN replace(document, 'Hotel: ', 'Hotel: New ') ELSE document END AS document,
       hotel, is_canceled = 1 AS is_canceled
FROM (SELECT b.*, d.id, d.document FROM bookings b JOIN bdocs d USING (booking_id)) t""", BOOKING_DOCS_CTE))
def s14_keyed_upsert(spark, sf_dir):
    """The collection after new and changed documents were added: one row an id, text with its metadata."""
    docs = booking_documents(bookings(spark, sf_dir))
    c = Collection(spark, _place(spark, "s14"))
    c.add(docs.where(EARLY), "first")
    changed = docs.withColumn("document", F.when(F.col("booking_id") % 10 == 1, F.regexp_replace("document", "Hotel: ", "Hotel: New "))
                              .otherwise(F.col("document")))
    c.add(changed, "second")
    return c.documents().select("id", "document", "metadata.hotel", "metadata.is_canceled")


@register("u4_streamed_search", with_bookings(
    "SELECT query_id AS query_text, id, score, rank FROM s_top", QUESTIONS_CTE, QTEXTS_CTE, BOOKING_DOCS_CTE,
    "early AS (SELECT id, document FROM bdocs WHERE booking_id % 10 <> 0)", *stored_idf_sql("s", "bdocs", "early", "qtexts")))
def u4_streamed_search(spark, sf_dir):
    """The same search from a store that a stream over arriving raw files keeps."""
    from staylens.streaming.index_stream import start_search_stream

    place = _place(spark, "u4")
    for name, part in (("a", EARLY), ("b", LATE)):
        raw(spark, sf_dir).where(part).write.parquet(f"{place}/in/{name}")
        start_search_stream(spark, f"{place}/in/*", f"{place}/store", f"{place}/offsets").awaitTermination()
    qt = E.distinct_question_texts(questions(spark, sf_dir))
    return U.SearchStore(spark, f"{place}/store").bookings.search(qt, 5).withColumnRenamed("query_id", "query_text")
