"""A searchable text collection that is refreshed in place.

Layout under one folder, all Parquet, written once and never changed:

* ``docs/seg=N/bucket=B``       rows of commit N (id, document, every further column given, ``replaces``, ``removed``)
* ``postings/seg=N/term_bucket=B``  their inverted index (term, id, w), unit-length TF-IDF weights
* ``idf/seg=N``, ``stats/seg=N``    term weights and document count of a base commit
* ``ledger/N-kind-key``         one empty file a commit; what has no such file does not exist for readers

``add`` is a keyed upsert: rows whose content is unchanged are skipped, new and changed rows
become a segment, and a changed row names the segment that held its id before.  So one changed
row of a large collection writes one row, and readers leave out the (id, seg) pairs that a later
segment replaces: text, metadata and postings change together.  A repeated ``key`` (a replayed
micro-batch) is a no-op; a job that died before its ledger entry is overwritten by the next.

Rule of the weights: a base commit (the first, and each ``merge``) fixes idf and document count;
later segments are weighted by them, a term unknown to the base by ln(N + 1), the same weight
that an unknown query term gets.  ``merge`` rewrites the live rows as a new base.

One writer; any number of readers.  Only the numbers of touched buckets (at most the number of
folders), counts and the ledger's file names reach the driver.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.functions.columns import round_half_up
from staylens.operators.retrieval import TOKEN_SPLIT, common_terms, query_terms, query_vectors, term_bucket, top_k
from staylens.sources.store import _fs

BUCKETS = 64                 # folders of a segment's rows, and of its postings
MERGE_AFTER = 16             # segments beyond the base before ``add`` merges
SEGMENT_TASK = 16 << 20      # bytes of a segment's stored rows whose postings one task writes


@dataclass(frozen=True)
class Commit:
    number: int
    kind: str                # base: a whole collection; add: a segment; none: nothing to add
    key: str


def id_bucket(col, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


class Collection:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER):
        self.spark, self.base = spark, base.rstrip("/")
        self.buckets, self.merge_after = buckets, merge_after

    # -- ledger -----------------------------------------------------------------
    def commits(self) -> list[Commit]:
        fs, p, _ = _fs(self.spark, f"{self.base}/ledger")
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        found = [re.fullmatch(r"(\d+)-(base|add|none)-(.+)", n) for n in names]
        return sorted((Commit(int(m[1]), m[2], m[3]) for m in found if m), key=lambda c: c.number)

    def _commit(self, number: int, kind: str, key: str) -> None:
        fs, p, _ = _fs(self.spark, f"{self.base}/ledger/{number:08d}-{kind}-{key}")
        fs.create(p, False).close()

    def live(self) -> list[int]:
        """Numbers of the segments that readers see: the last base and what was added since."""
        out: list[int] = []
        for c in self.commits():
            if c.kind == "base":
                out = [c.number]
            elif c.kind == "add":
                out.append(c.number)
        return out

    def state(self) -> int:
        """Number of the last commit that changed the content; 0 for an empty collection."""
        return max(self.live(), default=0)

    # -- reading ------------------------------------------------------------------
    def _segments(self, part: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.base}/{part}").parquet(
            *[f"{self.base}/{part}/seg={n}" for n in numbers])

    def replaced(self, live: list[int]) -> DataFrame | None:
        """(id, seg) of the rows that later segments replace; only segments beyond the base can name any."""
        if len(live) < 2:
            return None
        return self._segments("docs", live[1:]).where("replaces IS NOT NULL") \
            .select("id", F.col("replaces").alias("seg"))

    def documents(self, buckets: list[int] | None = None) -> DataFrame | None:
        """Current rows with ``seg`` and ``bucket``; ``buckets`` limits the folders that are read."""
        live = self.live()
        if not live:
            return None
        rows, gone = self._segments("docs", live), self.replaced(live)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return (rows if gone is None else rows.join(gone, ["id", "seg"], "left_anti")).where("NOT removed").drop("removed")

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r[0] for r in ids.select(id_bucket("id", self.buckets)).distinct().collect()]

    def fetch(self, hits: DataFrame, *columns: str) -> DataFrame:
        """``hits`` (with ``id``) joined with columns of their rows, read from the folders of the ids alone."""
        hits = hits.withColumn("bucket", id_bucket("id", self.buckets))
        rows = self.documents(self._touched(hits)).select("bucket", "id", *columns)
        return hits.join(rows, ["bucket", "id"]).drop("bucket")

    def idf(self) -> tuple[DataFrame, int]:
        """(term, idf) and the document count of the base."""
        base = self.live()[0]
        return (self.spark.read.parquet(f"{self.base}/idf/seg={base}"),
                self.spark.read.parquet(f"{self.base}/stats/seg={base}").first()["n_docs"])

    def search(self, queries: DataFrame, k: int = 5, where: Column | None = None,
               qid_col: str = "query_id", qtext_col: str = "text") -> DataFrame:
        """(query_id, id, score, rank): the k best rows of each query by cosine, positive scores only, ties to
        the smaller id.  ``where``, a condition on the rows (say, on their metadata), holds before the cut to k."""
        live = self.live()
        idf, n_docs = self.idf()
        terms = query_terms(queries, qid_col, qtext_col)
        folders = [r[0] for r in terms.select(term_bucket("term", self.buckets)).distinct().collect()]
        found = self._segments("postings", live).where(F.col("term_bucket").isin(folders))
        scored = found.join(query_vectors(terms, idf, n_docs), "term").groupBy("query_id", "id", "seg").agg(
            F.sum(F.col("w") * F.col("qw")).alias("dot"))
        gone = self.replaced(live)
        if gone is not None:
            scored = scored.join(gone, ["id", "seg"], "left_anti")
        if where is not None:
            scored = scored.join(self.documents().where(where).select("id"), "id", "left_semi")
        scored = scored.select("query_id", "id", round_half_up(F.col("dot"), 6).alias("score"))
        return top_k(scored, k, "query_id", [F.desc("score"), F.asc("id")]).select("query_id", "id", "score", "rank")

    # -- writing ----------------------------------------------------------------
    def add(self, docs: DataFrame, key: str | None = None, newest: str | None = None, complete: bool = False) -> int:
        """Upsert rows (id, document, ...); returns how many were new, changed or removed.  Of several rows with
        one id the one with the greatest ``newest`` stays.  ``complete``: ids that ``docs`` lacks are removed."""
        key = re.sub(r"[^A-Za-z0-9_.]", "_", key or uuid.uuid4().hex)
        done = self.commits()
        if any(c.key == key for c in done):
            return 0
        number = (done[-1].number if done else 0) + 1
        content = sorted(c for c in docs.columns if c != newest)
        rows = self._one_per_id(docs, newest).withColumn(
            "digest", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}).cast("binary"), 256))
        live = self.live()
        if live:
            held = self.documents(self._touched(docs.select("id"))).select(
                "bucket", "id", F.col("seg").alias("replaces"), F.col("digest").alias("_held"))
            rows = rows.join(held, ["bucket", "id"], "left").where("_held IS NULL OR _held <> digest").drop("_held") \
                .withColumn("removed", F.lit(False))
            if complete:
                absent = self.documents().select("id", "bucket", F.col("seg").alias("replaces")) \
                    .join(docs.select("id"), "id", "left_anti").withColumn("removed", F.lit(True))
                rows = rows.unionByName(absent, allowMissingColumns=True)
        else:
            rows = rows.withColumn("replaces", F.lit(None).cast("int")).withColumn("removed", F.lit(False))
        n = self._write_rows(rows, number)
        if n and not live:
            self._write_idf(number)
        if n:
            self._write_postings(number, live[0] if live else number)
        self._commit(number, ("add" if live else "base") if n else "none", key)
        if len(self.live()) > self.merge_after:
            self.merge()
        return n

    def _one_per_id(self, docs: DataFrame, newest: str | None) -> DataFrame:
        """The row of each id that ``one_per_key`` would keep, with its ``bucket``.  Rows are shuffled once, by
        bucket and id; the text that orders rows of one id is made after that."""
        several = F.count(F.lit(1)).over(Window.partitionBy("bucket", "id")) > 1
        as_text = F.when(F.col("_several"), F.to_json(F.struct(*docs.columns))).otherwise("")
        order = F.struct(F.col(newest), as_text) if newest else as_text
        return docs.withColumn("bucket", id_bucket("id", self.buckets)).repartition("bucket", "id").withColumn("_several", several) \
            .groupBy("bucket", "id").agg(F.max_by(F.struct(*docs.columns), order).alias("_row")) \
            .select("bucket", "id", *[F.col("_row")[c].alias(c) for c in docs.columns if c != "id"])

    def merge(self) -> None:
        """Rewrite the live rows as one base with idf of its own; older bases' files go, the last one's stay
        for readers that began on it."""
        bases = [c.number for c in self.commits() if c.kind == "base"]
        number = self.commits()[-1].number + 1
        self._write_rows(self.documents().drop("seg").withColumn("replaces", F.lit(None).cast("int"))
                         .withColumn("removed", F.lit(False)).repartition("bucket", "id"), number)
        self._write_idf(number)
        self._write_postings(number, number)
        self._commit(number, "base", f"merge_{number}")
        if len(bases) > 1:
            for part in ("docs", "postings", "idf", "stats"):
                for old in range(bases[-2], bases[-1]):
                    fs, p, _ = _fs(self.spark, f"{self.base}/{part}/seg={old}")
                    fs.delete(p, True)

    def _write_rows(self, rows: DataFrame, number: int) -> int:
        """Rows are written by the tasks that hold them, each folder's in files of its own."""
        path = f"{self.base}/docs/seg={number}"
        rows.sortWithinPartitions("bucket", "id").write.mode("overwrite").option("compression", "zstd") \
            .partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).count()

    def _texts(self, number: int) -> DataFrame:
        """(id, text) of a segment, one row an id."""
        return self._segments("docs", [number]).select("id", F.lower("document").alias("text"))

    def _write_idf(self, number: int) -> None:
        n_docs = self._segments("docs", [number]).count()
        self.spark.createDataFrame([(n_docs,)], "n_docs long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.base}/stats/seg={number}")
        self._texts(number).mapInArrow(_document_counts, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")) \
            .select("term", F.log(F.lit(n_docs + 1.0) / (F.col("df") + F.lit(1.0))).alias("idf")) \
            .write.mode("overwrite").parquet(f"{self.base}/idf/seg={number}")

    def _write_postings(self, number: int, base: int) -> None:
        """A row's common terms travel as numbers in one row; its few rare terms, which meet their idf by a shuffle
        on the term, follow it to the task of the id, where the length is known and postings are written."""
        idf = self.spark.read.parquet(f"{self.base}/idf/seg={base}")
        n_docs = self.spark.read.parquet(f"{self.base}/stats/seg={base}").first()["n_docs"]
        unknown = F.lit(float(np.log(n_docs + 1.0)))
        texts = self._texts(number)
        kind = texts.schema["id"].dataType.simpleString()
        common = common_terms(idf, n_docs).toPandas()                         # at most HOT_TERMS rows
        terms, weights = pa.array(common["term"], pa.string()), common["idf"].to_numpy(np.float64)
        numbered = F.broadcast(self.spark.createDataFrame(
            [(i, t, w) for i, (t, w) in enumerate(zip(common["term"].tolist(), weights.tolist()))],
            "code int, _term string, idf double"))
        hot = texts.mapInArrow(_common_parts(terms, weights), f"id {kind}, squares double, codes array<int>, tfs array<int>")
        cold = texts.mapInArrow(_rare_parts(terms), f"id {kind}, term string, tf int").join(idf, "term", "left") \
            .select("id", "term", (F.col("tf") * F.coalesce("idf", unknown)).alias("w"))
        rows = hot.withColumns({"term": F.lit(None).cast("string"), "w": F.lit(None).cast("double")}).unionByName(
            cold.select("id", (F.col("w") * F.col("w")).alias("squares"), F.array(F.lit(-1)).alias("codes"),
                        F.array(F.lit(0)).alias("tfs"), "term", "w"))
        fs, p, _ = _fs(self.spark, f"{self.base}/docs/seg={number}")
        tasks = max(1, -(-fs.getContentSummary(p).getLength() // SEGMENT_TASK))
        norm = F.sqrt(F.sum("squares").over(Window.partitionBy("id")))
        each = rows.repartition(tasks, "id").withColumn("norm", norm) \
            .select("id", "norm", "term", "w", F.explode(F.arrays_zip("codes", "tfs")).alias("t")) \
            .select("id", "norm", "term", "w", F.col("t.codes").alias("code"), F.col("t.tfs").alias("tf"))
        unit = each.join(numbered, "code", "left") \
            .select(F.coalesce("_term", "term").alias("term"), "id", "norm", F.coalesce("w", F.col("tf") * F.col("idf")).alias("w")) \
            .where("w > 0").select("term", "id", (F.col("w") / F.col("norm")).alias("w"))
        unit.withColumn("term_bucket", term_bucket("term", self.buckets)).sortWithinPartitions("term_bucket", "term") \
            .write.mode("overwrite").option("compression", "zstd").partitionBy("term_bucket") \
            .parquet(f"{self.base}/postings/seg={number}")


def _counted(texts: pa.Array):
    """The distinct terms of some texts, and (row, place among the terms, occurrences) of each text's terms by row."""
    lists = pc.split_pattern_regex(texts, TOKEN_SPLIT)
    found = pc.list_flatten(lists).dictionary_encode()
    places, width = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(found.dictionary))
    keys = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) * width + places
    keys, tf = np.unique(keys[pc.not_equal(found, "").to_numpy(zero_copy_only=False)], return_counts=True)
    row, place = np.divmod(keys, width)
    return found.dictionary, row, place, tf


def _document_counts(batches):
    for b in batches:
        terms, _, place, _ = _counted(b.column("text"))
        df = np.bincount(place, minlength=len(terms))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(used)), pa.array(df[used], pa.int64())], ["term", "df"])


def _places(terms: pa.Array, common: pa.Array) -> np.ndarray:
    """The number of each term among the common ones; -1 for the others."""
    return pc.fill_null(pc.index_in(terms, value_set=common), -1).to_numpy(zero_copy_only=False)


def _common_parts(common: pa.Array, idf: np.ndarray):
    """Task: a row for each text, with the numbers and counts of its common terms of positive idf and their squares' sum."""
    def run(batches):
        for b in batches:
            terms, row, place, tf = _counted(b.column("text"))
            code = _places(terms, common)[place]
            kept = code >= 0
            kept[kept] = idf[code[kept]] > 0
            row, code, tf = row[kept], code[kept], tf[kept]
            squares = np.bincount(row, (tf * idf[code]) ** 2, b.num_rows)
            at = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(squares, pa.float64()), pa.ListArray.from_arrays(at, pa.array(code, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], ["id", "squares", "codes", "tfs"])
    return run


def _rare_parts(common: pa.Array):
    """Task: (id, term, tf) of the other terms."""
    def run(batches):
        for b in batches:
            terms, row, place, tf = _counted(b.column("text"))
            kept = _places(terms, common)[place] < 0
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row[kept])), terms.take(pa.array(place[kept])), pa.array(tf[kept], pa.int32())],
                ["id", "term", "tf"])
    return run
