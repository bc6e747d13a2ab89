"""Registered queries: retrieval (E1-E7), incremental indexing (U1-U3) and
source/store reads (S1, S5, S6, S12, S15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staylens.functions.constants import NO_CONTEXT_TEXT, PROMPT_HEAD
from staylens.operators import dense
from staylens.operators import documents as D
from staylens.operators import incremental as U
from staylens.operators import retrieval as E
from staylens.operators import routing as R
from staylens.plans.context import (
    bookings, collection, collection_counts, collection_documents, insight_cube, raw,
)
from staylens.plans.oracle import with_bookings, with_raw
from staylens.plans.q_documents import BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE
from staylens.plans.q_insights import BINS_VALUES
from staylens.plans.q_routing import GRID_CTE, R5_BODY, ROUTE_TEXTS_CTE
from staylens.plans.registry import register
from staylens.plans.session import checkpoint_path
from staylens.plans.sql_text import QUERY_LOG_CTE, QUESTIONS_CTE, ROUTED_CTE, q
from staylens.sources import store as S
from staylens.sources.files import RAW_SCHEMA
from staylens.sources.tables import query_log, questions, search_queries, search_vectors

QTEXTS_CTE = "qtexts AS (SELECT DISTINCT text AS query_id, text FROM questions)"


def tfidf_sql(p: str, docs: str, queries: str, k: int = 5) -> list[str]:
    """CTEs computing exact TF-IDF cosine top-k; the last one is ``{p}_top``."""
    return [
        f"""{p}_dt AS (SELECT id, term, COUNT(*) AS tf FROM (
              SELECT id, unnest(string_split_regex(lower(document), '[^a-z0-9]+')) AS term FROM {docs}) t
            WHERE term <> '' GROUP BY id, term)""",
        f"{p}_n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM {docs})",
        f"""{p}_idf AS (SELECT term, ln((MAX(n) + 1.0) / (COUNT(*) + 1.0)) AS idf
            FROM {p}_dt, {p}_n GROUP BY term)""",
        f"{p}_dw AS (SELECT id, term, tf * idf AS w FROM {p}_dt JOIN {p}_idf USING (term))",
        f"{p}_dn AS (SELECT id, sqrt(SUM(w * w)) AS norm FROM {p}_dw GROUP BY id)",
        f"""{p}_qt AS (SELECT query_id, term, COUNT(*) AS tf FROM (
              SELECT query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM {queries}) t
            WHERE term <> '' GROUP BY query_id, term)""",
        f"""{p}_qw0 AS (SELECT query_id, term, tf * COALESCE(idf, ln(n + 1.0)) AS w
            FROM {p}_qt LEFT JOIN {p}_idf USING (term), {p}_n)""",
        f"""{p}_qw AS (SELECT query_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY query_id)) AS qw
            FROM {p}_qw0)""",
        f"""{p}_sc AS (SELECT q.query_id, d.id,
                floor(SUM(d.w / n.norm * q.qw) * 1000000.0 + 0.5) / 1000000.0 AS score
            FROM {p}_dw d JOIN {p}_qw q USING (term) JOIN {p}_dn n USING (id)
            GROUP BY q.query_id, d.id HAVING SUM(d.w * q.qw) > 0)""",
        f"""{p}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY score DESC, id) AS rank FROM {p}_sc) r WHERE rank <= {k})""",
    ]


# --- E1-E4 -----------------------------------------------------------------

@register("e1_embed_booking_documents")
def e1_embed_booking_documents(spark, sf_dir):
    docs = collection_documents(spark, sf_dir, "bookings_data")
    _, vecs = E.embed_documents(docs)
    return vecs.select("id", "embedding")


@register("e1_dense_search")
def e1_dense_search(spark, sf_dir):
    """The questions answered by nearest dense vectors of both collections; one model, fitted on the bookings."""
    queries = E.distinct_question_texts(questions(spark, sf_dir))
    model, out = None, None
    for name in ("bookings_data", "insights_data"):
        docs = collection_documents(spark, sf_dir, name)
        model = dense.fit_dense(docs) if model is None else model
        hits = dense.dense_search(dense.store_dense(docs.select("id", "document"), model).drop("document"), queries, model, 5) \
            .select(F.lit(name).alias("collection"), F.col("query_id").alias("query_text"), "id", "distance", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


def _search(spark, sf_dir, insights: bool):
    vec, idf, n, post = collection(spark, sf_dir, "insights_data" if insights else "bookings_data")
    qt = E.distinct_question_texts(questions(spark, sf_dir))
    return E.search_index(vec, idf, n, qt, 5, post=post).withColumnRenamed("query_id", "query_text")


@register("e2_tfidf_search_bookings", with_bookings(
    "SELECT query_id AS query_text, id, score, rank FROM b_top",
    QUESTIONS_CTE, QTEXTS_CTE, BOOKING_DOCS_CTE, *tfidf_sql("b", "bdocs", "qtexts")))
def e2_tfidf_search_bookings(spark, sf_dir):
    return _search(spark, sf_dir, insights=False)


@register("e2_tfidf_search_insights", with_bookings(
    "SELECT query_id AS query_text, id, score, rank FROM i_top",
    QUESTIONS_CTE, QTEXTS_CTE, BINS_VALUES, INSIGHT_DOCS_CTE, *tfidf_sql("i", "idocs", "qtexts")))
def e2_tfidf_search_insights(spark, sf_dir):
    return _search(spark, sf_dir, insights=True)


_KNN_SQL = """
WITH qv AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
vv AS (SELECT vec_id, embedding FROM embeddings),
d AS (SELECT qv.vec_id AS query_id, vv.vec_id AS id,
        floor(list_sum(list_transform(range(1, len(qv.embedding) + 1),
              lambda i: (CAST(qv.embedding[i] AS DOUBLE) - CAST(vv.embedding[i] AS DOUBLE)) ** 2))
              * 1000000.0 + 0.5) / 1000000.0 AS distance
      FROM qv, vv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@register("e3_knn", _KNN_SQL)
def e3_knn(spark, sf_dir):
    return E.knn(search_queries(spark, sf_dir), search_vectors(spark, sf_dir), 5)


_APPROX_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pl AS (SELECT j, list(CASE WHEN substr(md5(j || ':' || i), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS p
    FROM range({E.CODE_BITS}) a(j), range((SELECT max(len(x)) FROM v)) b(i) GROUP BY j),
c AS (SELECT vec_id, CAST(string_agg(CASE WHEN list_inner_product(x, p) > 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS BIT) AS code
    FROM v, pl GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, w.vec_id AS id, floor(list_sum(list_transform(range(1, len(q.x) + 1),
        lambda i: (q.x[i] - w.x[i]) ** 2)) * 1000000.0 + 0.5) / 1000000.0 AS distance,
        bit_count(xor(cq.code, cw.code)) <= {E.RADIUS} AS near
    FROM v q JOIN c cq USING (vec_id), v w JOIN c cw USING (vec_id) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, distance, near, row_number() OVER (PARTITION BY query_id, near ORDER BY distance, id) AS by_near,
        row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS by_all,
        count(*) FILTER (near) OVER (PARTITION BY query_id) AS n FROM d)
SELECT query_id, id, distance, CAST(CASE WHEN n >= 5 THEN by_near ELSE by_all END AS INTEGER) AS rank FROM r
WHERE (n >= 5 AND near AND by_near <= 5) OR (n < 5 AND by_all <= 5)"""


@register("e4_knn_approx", _APPROX_SQL)
def e4_knn_approx(spark, sf_dir):
    return E.knn_approx(search_queries(spark, sf_dir), search_vectors(spark, sf_dir), 5)


MAX_DISTANCE_FIXTURE = 1.3


@register("e5_relevance_filter", f"""
SELECT query_id, id, distance, printf('%.2f', floor((1.0 - distance) * 100.0 + 0.5) / 100.0) AS relevance
FROM ({_KNN_SQL}) k WHERE distance < {MAX_DISTANCE_FIXTURE}""")
def e5_relevance_filter(spark, sf_dir):
    hits = E.knn(search_queries(spark, sf_dir), search_vectors(spark, sf_dir), 5)
    return E.relevance_filter(hits, MAX_DISTANCE_FIXTURE).select("query_id", "id", "distance", "relevance")


def _pieces_sql(p: str, docs: str, tag: str, order: int, max_distance: float) -> str:
    return f"""
SELECT t.query_id, {order} AS source_order, t.rank, t.distance,
       '{tag} (Relevance: ' || printf('%.2f', floor((1.0 - t.distance) * 100.0 + 0.5) / 100.0)
       || '):' || chr(10) || d.document AS piece
FROM (SELECT *, floor((2.0 - 2.0 * score) * 1000000.0 + 0.5) / 1000000.0 AS distance FROM {p}_top) t
JOIN {docs} d USING (id) WHERE t.distance < {max_distance}"""


# TF-IDF cosine between a short question and a document is far lower than
# between sentence embeddings: on the fixture no pair reaches the default
# cut (distance < 1.0, cosine > 0.5), so the registered queries use 1.8
# (cosine > 0.1), which keeps some insight pieces and drops the rest.
MAX_DISTANCE = 1.8
CONTEXT_CTES = (QUESTIONS_CTE, QTEXTS_CTE, BINS_VALUES, BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE,
                *tfidf_sql("b", "bdocs", "qtexts"), *tfidf_sql("i", "idocs", "qtexts"),
                f"ctx AS ({_pieces_sql('b', 'bdocs', 'BOOKING DATA', 0, MAX_DISTANCE)} UNION ALL "
                f"{_pieces_sql('i', 'idocs', 'INSIGHT DATA', 1, MAX_DISTANCE)})")


def _contexts(spark, sf_dir, b):
    qt = E.distinct_question_texts(questions(spark, sf_dir))
    colls = [collection(spark, sf_dir, n) for n in ("bookings_data", "insights_data")]
    return E.retrieve_context(qt, None, None, 5, MAX_DISTANCE, collections=colls)


@register("e6_retrieve_context", with_bookings(
    "SELECT query_id AS query_text, source_order, CAST(rank AS INTEGER) AS rank, distance, piece FROM ctx",
    *CONTEXT_CTES))
def e6_retrieve_context(spark, sf_dir):
    b = bookings(spark, sf_dir)
    return _contexts(spark, sf_dir, b).select(
        F.col("query_id").alias("query_text"), "source_order", "rank", "distance", "piece")


_PROMPT_SQL = f"""
SELECT q.question_id, q.text,
       CAST(COALESCE(c.n, 0) + CASE WHEN a.answer IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS context_count,
       {q(PROMPT_HEAD + chr(10) + chr(10) + 'Context:' + chr(10))} ||
       CASE WHEN c.body IS NULL AND a.answer IS NULL THEN {q(NO_CONTEXT_TEXT)}
            WHEN c.body IS NULL THEN a.answer
            WHEN a.answer IS NULL THEN c.body
            ELSE c.body || chr(10) || chr(10) || a.answer END
       || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || chr(10) || 'Answer:' AS prompt
FROM questions q
LEFT JOIN (SELECT query_id, COUNT(*) AS n,
                  string_agg(piece, chr(10) || chr(10) ORDER BY source_order, rank) AS body
           FROM ctx GROUP BY query_id) c ON c.query_id = q.text
LEFT JOIN answers a ON a.question_id = q.question_id"""


@register("e7_build_prompts", with_bookings(
    _PROMPT_SQL, *CONTEXT_CTES, ROUTED_CTE, GRID_CTE, ROUTE_TEXTS_CTE, f"answers AS ({R5_BODY})"))
def e7_build_prompts(spark, sf_dir):
    b = bookings(spark, sf_dir)
    answered = R.routed_answers(questions(spark, sf_dir), insight_cube(spark, sf_dir))
    return E.build_prompts(answered, _contexts(spark, sf_dir, b)).select(
        "question_id", "text", "context_count", "prompt")


@register("e8_answer_records", with_bookings(f"""
SELECT p.question_id, p.text AS question, COALESCE(a.answer, {q(NO_CONTEXT_TEXT)}) AS answer,
       p.context_count, CAST(NULL AS DOUBLE) AS execution_time
FROM ({_PROMPT_SQL}) p LEFT JOIN answers a ON a.question_id = p.question_id""",
    *CONTEXT_CTES, ROUTED_CTE, GRID_CTE, ROUTE_TEXTS_CTE, f"answers AS ({R5_BODY})"))
def e8_answer_records(spark, sf_dir):
    b = bookings(spark, sf_dir)
    answered = R.routed_answers(questions(spark, sf_dir), insight_cube(spark, sf_dir))
    return E.answer_records(E.build_prompts(answered, _contexts(spark, sf_dir, b)))


@register("e8_answer_log", with_bookings(f"""
SELECT question, answer, context_used, COUNT(*) AS asked, COUNT(*) AS logged, COUNT(*) AS log_ids
FROM (SELECT q.text AS question, COALESCE(a.answer, {q(NO_CONTEXT_TEXT)}) AS answer,
             CASE WHEN c.body IS NULL THEN COALESCE(a.answer, {q(NO_CONTEXT_TEXT)})
                  WHEN a.answer IS NULL THEN c.body
                  ELSE c.body || chr(10) || chr(10) || a.answer END AS context_used
      FROM questions q
      LEFT JOIN (SELECT query_id, string_agg(piece, chr(10) || chr(10) ORDER BY source_order, rank) AS body
                 FROM ctx GROUP BY query_id) c ON c.query_id = q.text
      LEFT JOIN answers a ON a.question_id = q.question_id) r
GROUP BY question, answer, context_used""",
    *CONTEXT_CTES, ROUTED_CTE, GRID_CTE, ROUTE_TEXTS_CTE, f"answers AS ({R5_BODY})"))
def e8_answer_log(spark, sf_dir):
    """All questions answered and logged: each record with its context, against the rows of the log read back."""
    answered = R.routed_answers(questions(spark, sf_dir), insight_cube(spark, sf_dir))
    path = checkpoint_path(spark, f"answer_log_{uuid.uuid4().hex}")
    records = E.log_answers(E.build_prompts(answered, _contexts(spark, sf_dir, bookings(spark, sf_dir))), path)
    log = spark.read.parquet(path).groupBy(F.col("query_text").alias("question"), F.col("response").alias("answer")).agg(
        F.count(F.lit(1)).alias("logged"), F.count_distinct("query_id").alias("log_ids"))
    return records.groupBy("question", "answer", "context_used").agg(F.count(F.lit(1)).alias("asked")) \
        .join(log, ["question", "answer"]).select("question", "answer", "context_used", "asked", "logged", "log_ids")


# --- U1-U3 -----------------------------------------------------------------

_INDEXED = "bookings WHERE booking_id % 10 <> 0"


@register("u1_last_indexed_id", with_bookings(f"""
SELECT CAST(COALESCE(MAX(booking_id), 0) AS BIGINT) AS last_indexed_id FROM {_INDEXED}"""))
def u1_last_indexed_id(spark, sf_dir):
    return U.last_indexed_id(U.indexed_fixture(bookings(spark, sf_dir)))


@register("u2_new_bookings", with_bookings(f"""
SELECT booking_id FROM bookings WHERE booking_id NOT IN (SELECT booking_id FROM {_INDEXED})"""))
def u2_new_bookings(spark, sf_dir):
    b = bookings(spark, sf_dir)
    return U.new_bookings(b, U.indexed_fixture(b)).select("booking_id")


@register("u3_incremental_index_update", with_bookings(
    "SELECT id, document FROM bdocs WHERE booking_id % 10 = 0", BOOKING_DOCS_CTE))
def u3_incremental_index_update(spark, sf_dir):
    b = bookings(spark, sf_dir)
    return U.documents_to_add(b, U.indexed_fixture(b)).select("id", "document")


# --- sources and stores -------------------------------------------------------

RAW_COLS = [f.name for f in RAW_SCHEMA.fields]


@register("s1_raw_bookings", with_raw(f"SELECT {', '.join(RAW_COLS)} FROM raw"))
def s1_raw(spark, sf_dir):
    return raw(spark, sf_dir)


SCAN_COLS = ["booking_id", "hotel", "is_canceled", "lead_time", "arrival_date", "arrival_date_year",
             "arrival_date_month", "country", "market_segment", "reserved_room_type", "adr",
             "revenue", "total_stay_duration"]


@register("s5_table_scan", with_bookings(f"SELECT {', '.join(SCAN_COLS)} FROM bookings"))
def s5_table_scan(spark, sf_dir):
    return bookings(spark, sf_dir).select(*SCAN_COLS)


@register("s6_batched_scan", with_bookings("""
SELECT COUNT(*) AS row_count, CAST(ceil(COUNT(*) / 1000.0) AS BIGINT) AS batches FROM bookings"""))
def s6_batched_scan(spark, sf_dir):
    return bookings(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.ceil(F.count(F.lit(1)) / F.lit(1000.0)).cast("long").alias("batches"))


@register("s12_recent_queries", f"""
WITH {QUERY_LOG_CTE.strip()}
SELECT *, COUNT(*) OVER () AS returned FROM (
  SELECT query_id, query_text, timestamp, execution_time FROM query_log ORDER BY query_id DESC LIMIT 10) t""")
def s12_recent_queries(spark, sf_dir):
    return S.recent_queries(query_log(spark, sf_dir), 10)


@register("s15_index_status", with_bookings("""
SELECT collection, row_count, CASE WHEN MIN(row_count) OVER () = 0 THEN 'empty' ELSE 'ready' END AS status
FROM (SELECT 'bookings_data' AS collection, COUNT(*) AS row_count FROM bdocs
      UNION ALL SELECT 'insights_data', COUNT(*) FROM idocs) c""",
    BINS_VALUES, BOOKING_DOCS_CTE, INSIGHT_DOCS_CTE))
def s15_index_status(spark, sf_dir):
    return S.index_status(collection_counts(spark, sf_dir))
