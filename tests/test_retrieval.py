"""Retrieval against brute force and between exact and approximate search."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from staylens.operators import evaluation as V
from staylens.operators import retrieval as E
from staylens.sources.tables import read_table, search_queries, search_vectors


def test_knn_matches_numpy(spark, sf_small):
    emb = read_table(spark, sf_small, "embeddings", "vec_id", "embedding").toPandas()
    q = emb[emb.vec_id % 20 == 0]
    v = emb
    V_ = np.stack(v.embedding.map(lambda a: np.asarray(a, dtype=np.float64)))
    got = E.knn(search_queries(spark, sf_small), search_vectors(spark, sf_small), 5).toPandas()
    for _, row in q.iterrows():
        d = ((V_ - np.asarray(row.embedding, dtype=np.float64)) ** 2).sum(1)
        d = np.floor(d * 1e6 + 0.5) / 1e6
        order = np.lexsort((v.vec_id.to_numpy(), d))[:5]
        want = list(v.vec_id.to_numpy()[order])
        mine = list(got[got.query_id == row.vec_id].sort_values("rank").id)
        assert mine == want


def test_approx_recall_small(spark, sf_small):
    exact = E.knn(search_queries(spark, sf_small), search_vectors(spark, sf_small), 5)
    approx = E.knn_approx(search_queries(spark, sf_small), search_vectors(spark, sf_small), 5)
    hit = exact.join(approx.select("query_id", "id"), ["query_id", "id"]).count()
    assert hit / exact.count() >= 0.6


def test_tfidf_search_small_corpus(spark):
    docs = spark.createDataFrame([("d1", "hotel revenue july"), ("d2", "room type common"),
                                  ("d3", "cancellation rate country")], "id string, document string")
    qs = spark.createDataFrame([("q", "most common room type")], "query_id string, text string")
    top = E.tfidf_search(docs, qs, 2).orderBy("rank").collect()
    assert top[0].id == "d2" and top[0].score > 0.5


def test_relevance_filter(spark):
    hits = spark.createDataFrame([(1, 1, 0.4), (1, 2, 1.2)], "query_id long, id long, distance double")
    got = E.relevance_filter(hits, 1.0).collect()
    assert [(r.id, r.relevance) for r in got] == [(1, "0.60")]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.2, 0.1]),
                        "v": rng.exponential(2.0, 3000)})
    df = spark.createDataFrame(pdf)
    got = V.exact_quantiles(df, "k", "v", [0.25, 0.5, 0.75], partitions=7).toPandas()
    for k, grp in pdf.groupby("k"):
        for p in (0.25, 0.5, 0.75):
            want = np.quantile(grp.v.to_numpy(), p)
            mine = got[(got.k == k) & (got.p == p)].q.iloc[0]
            assert abs(mine - want) < 1e-9


def test_prompts_without_context(spark):
    qs = spark.createDataFrame([(1, "hello", None)], "question_id long, text string, answer string")
    ctx = spark.createDataFrame([], "query_id string, source_order int, rank int, distance double, piece string")
    r = E.build_prompts(qs, ctx).first()
    assert r.context_count == 0 and "No specific context found in the database." in r.prompt
    rec = E.answer_records(E.build_prompts(qs, ctx)).first()
    assert rec.answer == "No specific context found in the database." and rec.execution_time is None


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "x double")
    counts = [r["count"] for r in V.histogram(df, "x", 4).collect()]
    assert counts == [1, 0, 1, 2]
    assert F is not None


def test_stored_postings_are_pruned_by_term(spark, scratch):
    docs = spark.range(3000).selectExpr("concat('d', id) id", "concat('common word', id % 500, ' term', id) document")
    vec, idf, n = E.tfidf_index(docs)
    E.write_postings(E.postings(vec), f"{scratch}/post")
    post = spark.read.parquet(f"{scratch}/post")
    qs = spark.createDataFrame([(i, f"term{i} word{i}") for i in range(12)], "query_id long, text string")
    found = E.search_index(vec, idf, n, qs, 3, post=post)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [term_bucket" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, E.search_index(vec, idf, n, qs, 3).collect()))
    E.release(vec)


def test_knn_takes_text_ids_and_several_batches(spark):
    rng = np.random.RandomState(1)
    rows = [(f"v{i}", [float(x) for x in rng.randint(0, 4, 3)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id string, e array<double>").coalesce(1)
    q = spark.createDataFrame([("q1", [1.0, 2.0, 3.0]), ("q2", [0.0, 0.0, 0.0])], "id string, e array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = E.knn(q, v, 5, "id", "id", "e").orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, vec in (("q1", [1, 2, 3]), ("q2", [0, 0, 0])):
        want = sorted((sum((a - b) ** 2 for a, b in zip(e, vec)), i) for i, e in rows)[:5]
        assert [(r["distance"], r["id"]) for r in got if r["query_id"] == name] == want


def test_quantiles_of_one_repeated_value_and_outliers(spark):
    rows = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(50)] + [("a", 1e12), ("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {(r["k"], r["p"]): r["q"] for r in V.exact_quantiles(df, "k", "v", [0.0, 0.1, 0.5, 0.99, 1.0], partitions=5).collect()}
    for k in "ab":
        x = [v for name, v in rows if name == k]
        for p in (0.0, 0.1, 0.5, 0.99, 1.0):
            assert abs(got[k, p] - np.quantile(x, p)) <= 1e-9 * max(1, abs(np.quantile(x, p)))
    assert not any(k == "c" for k, _ in got)


def test_quantiles_split_ranges_until_small(spark):
    rng = np.random.default_rng(5)
    x = {"hot": np.round(rng.lognormal(3, 2, 6000), 2), "tiny": np.array([2.0, 2.0, 7.0]), None: rng.normal(size=400)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("hot", None)], "k string, v double").repartition(6)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    # 4 buckets and ranges of 9 values: ranges are split several times over
    got = {(r["k"], r["p"]): r["q"] for r in V.exact_quantiles(df, "k", "v", probs, partitions=4, rows=9).collect()}
    assert len(got) == 3 * len(probs)
    for (k, p), q in got.items():
        assert abs(q - np.quantile(x[k], p)) <= 1e-9 * max(1, abs(q))


def test_quantiles_of_infinite_values_and_no_rows(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", -inf), ("a", 1.0), ("a", inf)], "k string, v double")
    got = {r["p"]: r["q"] for r in V.exact_quantiles(df, "k", "v", [0.0, 0.5, 1.0], partitions=2, rows=1).collect()}
    assert got == {0.0: -inf, 0.5: 1.0, 1.0: inf}
    assert V.exact_quantiles(df.where("v > 9e9 AND v < 1"), "k", "v", [0.5]).collect() == []


def test_knn_deals_queries_into_blocks_without_the_driver(spark, monkeypatch):
    rng = np.random.RandomState(4)
    rows = [(i, [float(x) for x in rng.randint(0, 5, 4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name, size in (("MAX_QUERY_VECTORS", 7), ("BLOCK_VECTORS", 40), ("SMALL_BLOCK", 16)):
        monkeypatch.setattr(E, name, size, raising=False)
    collected = []
    collect = type(v).collect
    monkeypatch.setattr(type(v), "collect", lambda df: collected.append(df.columns) or collect(df))
    found = E.knn(v.where("vec_id % 10 = 0"), v, 5)
    assert not any("embedding" in c or "_qv" in c or "_vec" in c for c in collected)
    got = collect(found)
    assert len(got) == 150
    for i, e in rows[::10]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(e, x)), j) for j, x in rows)[:5]
        assert [(r["distance"], r["id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_approx_always_gives_k_rows(spark):
    """Far queries, vectors without a close neighbour and lists of fewer than k vectors."""
    rng = np.random.RandomState(6)
    rows = [(i, [float(x) * 50 for x in rng.randn(8)]) for i in range(700)] + [(700 + i, [1.0] * 8) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1e4] * 8), (2, [0.0] * 8), (3, [-300.0] + [0.0] * 7), (4, [1.0] * 8)],
                              "vec_id long, embedding array<float>")
    got = E.knn_approx(q, v, 5).toPandas()
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == [1, 2, 3, 4, 5]).to_dict() == dict.fromkeys(range(1, 5), True)
    wide = E.knn_approx(q, v, 200).toPandas()
    assert wide.groupby("query_id").size().to_dict() == dict.fromkeys(range(1, 5), 200)


def test_approx_candidates_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    q, v = search_queries(spark, sf), search_vectors(spark, sf)
    codes = {r["vec_id"]: np.frombuffer(bytes(r["_code"]), np.uint8) for r in E.with_codes(v).collect()}
    every = np.stack(list(codes.values()))
    pairs = sum(int((np.bitwise_count(every ^ code).sum(axis=1) <= E.RADIUS).sum()) for i, code in codes.items() if i % 20 == 0)
    exact = E.knn(q, v, 5).select("query_id", "id").where("query_id <> id")
    found = E.knn_approx(q, v, 5)
    assert found.count() == 5 * q.count() == 500
    hit = exact.join(found, ["query_id", "id"], "left_semi").count()
    print("candidate share", pairs / (q.count() * v.count()), "recall", hit / exact.count())
    assert pairs < 0.1 * q.count() * v.count() and hit >= 0.9 * exact.count()


def test_approx_reads_stored_codes_and_text_ids(spark, scratch):
    rng = np.random.RandomState(9)
    x = rng.randn(300, 16)
    rows = [(f"v{i}", [float(a) for a in e / np.linalg.norm(e)]) for i, e in enumerate(x)]
    v = spark.createDataFrame(rows, "id string, e array<float>")
    E.with_codes(v, "id", "e").write.parquet(f"{scratch}/codes")
    q = v.where("id like 'v1_'")
    cols = ["query_id", "id", "distance", "rank"]
    stored = E.knn_approx(q, spark.read.parquet(f"{scratch}/codes"), 3, qid_col="id", id_col="id", vec_col="e").select(cols)
    fresh = E.knn_approx(q, v, 3, qid_col="id", id_col="id", vec_col="e").select(cols)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fresh.collect())) and fresh.count() == 30
    every = E.knn_approx(q, v, 3, radius=E.CODE_BITS, qid_col="id", id_col="id", vec_col="e").select(cols)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, E.knn(q, v, 3, "id", "id", "e").select(cols).collect()))


def test_index_postings_equal_those_of_the_vectors_and_nothing_stays_cached(spark):
    docs = spark.createDataFrame([("a", "city hotel a1"), ("a", "hotel resort"), ("b", "resort x2 x2"), ("c", None), ("d", "city y3")],
                                 "id string, document string")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    for keep in ((), ("document",)):
        vec, idf, n = E.tfidf_index(docs, keep=keep)
        assert n == 5 and spark.sparkContext._jsc.getPersistentRDDs().size() == cached
        terms = idf.where("term <> 'y3'").select("term")
        whole = E.postings(vec).where("term <> 'y3'")
        got, want = (sorted((r["term"], r["id"], round(r["w"], 12)) for r in df.groupBy("term", "id").sum("w")
                            .withColumnRenamed("sum(w)", "w").collect()) for df in (E.index_postings(vec, idf)(terms), whole))
        assert got == want and len(got) == 7
        E.release(vec)
