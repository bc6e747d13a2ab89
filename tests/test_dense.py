"""Dense text vectors: against the singular vectors of the whole matrix, fit apart from use, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from staylens.operators import dense
from staylens.operators.documents import booking_documents
from staylens.plans.context import bookings

DIMS, FEATURES = 12, 512


def _matrix(spark, docs, features):
    """Unit TF-IDF rows of all documents, by loops."""
    rows = docs.select("id", dense.feature_codes(docs["document"], features).alias("codes")).orderBy("id").collect()
    n, df = len(rows), np.zeros(features)
    for r in rows:
        df[sorted({abs(c) - 1 for c in r["codes"]})] += 1
    idf = np.log((n + 1) / (df + 1))
    a = np.zeros((n, features))
    for i, r in enumerate(rows):
        for c in r["codes"]:
            a[i, abs(c) - 1] += np.sign(c) * idf[abs(c) - 1]
        a[i] /= np.linalg.norm(a[i]) or 1.0
    return [r["id"] for r in rows], a, idf


def test_directions_are_the_leading_singular_vectors(spark, sf_small):
    docs = booking_documents(bookings(spark, sf_small)).select("id", "document")
    _, a, idf = _matrix(spark, docs, FEATURES)
    model = dense.fit_dense(docs, DIMS, FEATURES, rounds=12)
    got_idf, got = dense._arrays(model)
    assert np.allclose(got_idf, idf)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(got.T @ got, np.eye(DIMS), atol=1e-4)
    kept = ((a @ got) ** 2).sum()                 # energy in the fitted subspace against the best of its size
    assert kept > 0.99 * (s[:DIMS] ** 2).sum()


def test_search_equals_numpy_and_new_rows_use_the_stored_model(spark, sf_small):
    docs = booking_documents(bookings(spark, sf_small)).select("id", "document")
    early, late = docs.where("crc32(id) % 4 <> 0"), docs.where("crc32(id) % 4 = 0")
    model = dense.fit_dense(early, DIMS, FEATURES)
    vectors = dense.embed_dense(early, model).unionByName(dense.embed_dense(late, model))
    assert vectors.select("id", "document").exceptAll(docs).count() == 0 == docs.exceptAll(vectors.select("id", "document")).count()
    pdf = vectors.toPandas()
    x = np.stack(pdf["embedding"].to_list())
    assert np.allclose((x ** 2).sum(axis=1), 1.0)
    qs = docs.orderBy("id").limit(5).selectExpr("id AS query_id", "document AS text")
    got = dense.dense_search(vectors, qs, model, 3).toPandas()
    by_id = dict(zip(pdf["id"], x))
    for qid, part in got.groupby("query_id"):
        d = np.floor(((x - by_id[qid]) ** 2).sum(axis=1) * 1e6 + 0.5) / 1e6
        want = sorted(zip(d, pdf["id"]))[:3]
        assert list(part.sort_values("rank")["id"]) == [i for _, i in want]
        assert want[0][0] == 0


def test_like_texts_are_near_and_empty_texts_have_no_vector(spark):
    docs = spark.createDataFrame(
        [(f"r{i}", f"hotel revenue month {i}", 1) for i in range(20)] + [(f"c{i}", f"country guests cancel {i}", 2) for i in range(20)]
        + [("n", None, 3), ("e", "", 3), ("p", "?!", 3)], "id string, document string, `a b` int")
    model = dense.fit_dense(docs, 4, 256)
    vecs = dense.embed_dense(docs, model)
    assert vecs.columns == ["id", "document", "a b", "embedding"]
    got = {r["id"]: r["embedding"] for r in vecs.collect()}
    assert got["n"] is None and got["e"] is None and got["p"] is None and len(got) == 43
    qs = spark.createDataFrame([("q", "revenue of the hotel"), ("none", None)], "query_id string, text string")
    hits = dense.dense_search(vecs, qs, model, 10).collect()
    assert len(hits) == 10 and all(h["query_id"] == "q" and h["id"].startswith("r") for h in hits)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "id string, document string")
    model = dense.fit_dense(docs, 4, 64)
    assert model.count() == 64
    assert dense.embed_dense(docs, model).count() == 0
    one = spark.createDataFrame([("x", "hotel")], "id string, document string")
    assert dense.embed_dense(one, model).first()["embedding"] is None


def test_model_is_stored_without_arrow(spark):
    docs = spark.createDataFrame([(f"r{i}", f"hotel {i}") for i in range(5)], "id string, document string")
    was = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        assert dense.fit_dense(docs, 2, 64).count() == 64
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", was)


def test_directions_come_from_all_documents(spark):
    texts = ["alpha beta", "beta gamma gamma", "gamma delta", "delta alpha beta", "epsilon"]
    numbers = np.array([41_000, 17_000, 6_000, 2_500, 400])            # 66,900 documents
    case = " ".join(f"WHEN id < {end} THEN '{text}'" for end, text in zip(np.cumsum(numbers), texts))
    docs = spark.range(int(numbers.sum())).selectExpr("CAST(id AS string) AS id", f"CASE {case} END AS document")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, document string").orderBy("id") \
        .select(dense.feature_codes(F.col("document"), 64).alias("codes")).collect()
    counts = np.zeros((len(texts), 64))
    for i, r in enumerate(rows):
        for c in r["codes"]:
            counts[i, abs(c) - 1] += np.sign(c)
    idf = np.log((numbers.sum() + 1) / (numbers @ (counts != 0) + 1))
    a = counts * idf
    a /= np.linalg.norm(a, axis=1)[:, None]
    want = np.linalg.eigh(a.T @ (a * numbers[:, None]))[1][:, ::-1][:, :3]
    want = want * np.sign(want[np.argmax(np.abs(want), axis=0), range(3)])
    got_idf, got = dense._arrays(dense.fit_dense(docs, 3, 64))
    assert np.allclose(got_idf, idf)
    assert np.abs(got - want).max() < 1e-6
