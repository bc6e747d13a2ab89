"""Dense text vectors that feed the vector search (E1, E3): a fitted projection of TF-IDF.

``fit_dense`` learns two things from a corpus and stores them as one small table:

* the idf of each of ``features`` hashed terms, counted over all documents;
* for each feature a direction of ``dims`` numbers: the leading right singular vectors of the
  documents' unit TF-IDF rows, by randomised subspace iteration.  One round multiplies the
  current basis by the Gram matrix of the rows: a task adds up ``a (a' V)`` over its documents, the
  tasks' sums are added by feature in Spark, and only a matrix of ``features`` x (``dims`` +
  OVERSAMPLE) numbers, whose size is fixed, is orthonormalised on the driver.  Every round reads
  all documents, as term counts that are stored once.

``embed_dense`` applies a stored model: one scan, no shuffle, no join, so new rows get vectors
that are comparable to those already stored.  Texts without a known term (null, empty) get a
null embedding.  ``dense_search`` is the exact ``knn`` over such vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators.retrieval import knn, tokens
from staylens.plans.session import checkpoint_path

FEATURES = 1 << 14          # hashed terms; with DIMS it fixes the model's size (5 MB)
DIMS = 64
OVERSAMPLE = 16             # further directions kept while iterating
ROUNDS = 4
CHUNK = 1024                # documents projected at once in a task
OFTEN, WIDE = 32, 512       # features in more documents of a chunk are added by matrix products, WIDE at once
MODEL_SCHEMA = "feature int, idf double, direction array<float>"


def feature_codes(text, features: int):
    """array<int>: feature + 1 of each token of a text, negative for half of the terms (signed hashing)."""
    def code(token):
        h = F.xxhash64(token)
        at = F.pmod(h, F.lit(features)).cast("int") + F.lit(1)
        return F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, at).otherwise(-at)
    return F.transform(tokens(F.coalesce(text, F.lit(""))), code)


def _entries(codes: pa.ListArray, features: int):
    """(terms of each document, feature, count): each different feature of a document once, by document and feature."""
    lengths = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    keys, place = np.unique(np.repeat(np.arange(len(lengths)), lengths) * features + np.abs(flat) - 1, return_inverse=True)
    doc, feature = np.divmod(keys, features)
    return np.bincount(doc, minlength=len(lengths)), feature, np.bincount(place, np.sign(flat), len(keys))


def _weighted(size, feature, count, idf: np.ndarray):
    """(document, feature, weight) of the documents' TF-IDF entries that are not 0, sorted by document."""
    weight = count * idf[feature]
    used = weight != 0
    return np.repeat(np.arange(len(size)), size)[used], feature[used], weight[used]


def _sums(group, index, weight, matrix: np.ndarray, n: int) -> np.ndarray:
    """Row g of ``n``: the sum of weight * matrix[index] over the entries of group g; ``group`` is sorted.

    The j-th entries of all groups are added at once, so never more than ``n`` rows are held.
    """
    size = np.bincount(group, minlength=n)
    order = np.argsort(-size, kind="stable")
    first, size = (np.cumsum(size) - size)[order], size[order]
    total = np.zeros((n, matrix.shape[1]))
    for j in range(size[0] if n else 0):
        at = first[:np.searchsorted(-size, -j)] + j
        row = np.take(matrix, index[at], axis=0)
        total[:len(at)] += np.multiply(row, weight[at, None], out=row if row.dtype == total.dtype else None)
    out = np.empty_like(total)
    out[order] = total
    return out


def _add_transposed(total: np.ndarray, doc, feature, weight, rows: np.ndarray) -> None:
    """Adds weight * rows[doc] to the row of each entry's feature."""
    order = np.argsort(feature, kind="stable")
    doc, weight = doc[order], weight[order]
    used, at, size = np.unique(feature[order], return_inverse=True, return_counts=True)
    often = size > OFTEN
    place, common = np.cumsum(often) - 1, np.flatnonzero(often)
    for begin in range(0, len(common), WIDE):
        part = common[begin:begin + WIDE]
        here = often[at] & (place[at] >= begin) & (place[at] < begin + WIDE)
        dense = np.zeros((len(part), len(rows)))
        dense[place[at[here]] - begin, doc[here]] = weight[here]
        total[used[part]] += dense @ rows
    rare = ~often[at]
    if rare.any():
        total[used[~often]] += _sums((np.cumsum(~often) - 1)[at[rare]], doc[rare], weight[rare], rows, int((~often).sum()))


def _counted(features: int):
    """Task: the documents' term counts, from their codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                size, feature, count = _entries(batch.column("codes").slice(at, CHUNK), features)
                ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))
                                                  for v in (feature, count)], ["features", "counts"])
    return run


def _document_counts(features: int):
    """Task: rows (feature, number of its documents) and, as feature -1, the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features + 1, np.int64)
        for batch in batches:
            total[0] += len(batch)
            total[1:] += np.bincount(batch.column("features").flatten().to_numpy(zero_copy_only=False), minlength=features)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used - 1, pa.int32()), pa.array(total[used])], ["feature", "df"])
    return run


def _gram_times(idf: np.ndarray, basis: np.ndarray):
    """Task: sum over its documents of a (a' V), as rows (feature, values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                terms, counts = batch.column("features").slice(at, CHUNK), batch.column("counts").slice(at, CHUNK)
                size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
                doc, feature, weight = _weighted(size, terms.flatten().to_numpy(zero_copy_only=False),
                                                 counts.flatten().to_numpy(zero_copy_only=False), idf)
                norm = np.sqrt(np.bincount(doc, weight ** 2, len(size)))
                weight = weight / np.where(norm > 0, norm, 1.0)[doc]
                _add_transposed(total, doc, feature, weight, _sums(doc, feature, weight, basis, len(size)))
        used = np.flatnonzero(np.any(total != 0, axis=1))
        ends = pa.array(np.arange(len(used) + 1) * basis.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total[used].ravel()))],
                                         ["feature", "values"])
    return run


def fit_dense(docs: DataFrame, dims: int = DIMS, features: int = FEATURES, rounds: int = ROUNDS,
              text_col: str = "document", seed: int = 7) -> DataFrame:
    """The model of a corpus, one row a feature, stored in the shared folder and read back.

    Directions beyond the rank of the corpus are 0; an empty corpus gives directions of 0 and thus null vectors.
    """
    spark = docs.sparkSession
    held = checkpoint_path(spark, f"dense_fit_{uuid.uuid4().hex}")
    docs.select(feature_codes(F.col(text_col), features).alias("codes")) \
        .mapInArrow(_counted(features), "features array<int>, counts array<int>").write.parquet(held)
    coded = spark.read.parquet(held)
    counted = coded.select("features").mapInArrow(_document_counts(features), "feature int, df bigint") \
        .groupBy("feature").agg(F.sum("df").alias("df")).toArrow()                     # at most ``features`` + 1 rows
    df = np.zeros(features + 1)
    df[counted["feature"].to_numpy() + 1] = counted["df"].to_numpy()
    n_docs, df = df[0], df[1:]
    idf = np.log((n_docs + 1.0) / (df + 1.0))

    width = min(dims + OVERSAMPLE, features)
    sums = [F.sum(F.col("values")[i]).alias(f"v{i}") for i in range(width)]
    known = df > 0
    basis = np.random.default_rng(seed).normal(size=(features, width)) * known[:, None]
    basis = np.linalg.qr(basis)[0]
    for _ in range(rounds):
        parts = coded.mapInArrow(_gram_times(idf, basis), "feature int, values array<double>")
        found = parts.groupBy("feature").agg(*sums).toArrow()                         # at most ``features`` rows
        image = np.zeros((features, width))
        at = found["feature"].to_numpy()
        for i in range(width):
            image[at, i] = found[f"v{i}"].to_numpy()
        strength, turn = np.linalg.eigh(basis.T @ image)                              # Rayleigh-Ritz in the basis
        last, basis = basis @ turn[:, ::-1], np.linalg.qr(image)[0]
        strength = strength[::-1]
    top = last[:, :dims] * (strength[:dims] > 1e-9 * max(strength[0], 1e-300))
    signs = np.sign(top[np.argmax(np.abs(top), axis=0), np.arange(top.shape[1])])
    top = top * np.where(signs == 0, 1.0, signs)
    rows = pa.table({"feature": pa.array(np.arange(features), pa.int32()), "idf": pa.array(idf),
                     "direction": pa.FixedSizeListArray.from_arrays(pa.array(top.astype(np.float32).ravel()), top.shape[1])
                     .cast(pa.list_(pa.float32()))})
    path = checkpoint_path(spark, f"dense_model_{uuid.uuid4().hex}")
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def _arrays(model: DataFrame):
    """The model's idf and directions; its size is fixed by its parameters, not by the corpus."""
    rows = model.toArrow().sort_by("feature").combine_chunks()
    idf, direction = rows["idf"].to_numpy(), rows["direction"].combine_chunks()
    return idf, direction.flatten().to_numpy().reshape(len(idf), -1)


def embed_dense(docs: DataFrame, model: DataFrame, text_col: str = "document") -> DataFrame:
    """``docs`` with ``embedding`` (array<double>, unit length; null for a text without a known term)."""
    idf, directions = _arrays(model)
    keep = [c for c in docs.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                doc, feature, weight = _weighted(*_entries(part.column(part.num_columns - 1), len(idf)), idf)
                rows = _sums(doc, feature, weight, directions, len(part))
                norm = np.sqrt((rows ** 2).sum(axis=1))
                known = norm > 1e-9
                unit = rows[known] / norm[known, None]
                ends = pa.array(np.r_[0, np.cumsum(known) * rows.shape[1]], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(unit.ravel()), mask=pa.array(~known))],
                    [*part.schema.names[:-1], "embedding"])

    coded = docs.select(*keep, feature_codes(F.col(text_col), len(idf)).alias("_codes"))
    return coded.mapInArrow(run, ",".join(_quoted(docs.select(*keep))) + ",embedding array<double>")


def store_dense(docs: DataFrame, model: DataFrame, text_col: str = "document") -> DataFrame:
    """``embed_dense`` written to the shared folder and read back: what searches should ask, as they read it twice."""
    path = checkpoint_path(docs.sparkSession, f"dense_vectors_{uuid.uuid4().hex}")
    embed_dense(docs, model, text_col).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


def dense_search(vectors: DataFrame, queries: DataFrame, model: DataFrame, k: int = 5, id_col: str = "id",
                 qid_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest stored vectors of each query text, by exact ``knn``.

    Rows and queries without an embedding take no part.
    """
    q = embed_dense(queries.select(qid_col, text_col), model, text_col).where("embedding IS NOT NULL")
    return knn(q, vectors.where("embedding IS NOT NULL"), k, qid_col, id_col)
