"""Keyed, versioned Parquet tables: insights, query log, vector collections.

Plain Parquet has no MERGE, so a keyed upsert is written as
``old LEFT ANTI new  UNION  new`` into a new version folder.  A version
becomes visible when its ``_SUCCESS`` marker exists, so a failed or
half-written job never replaces the current data; readers always read the
newest complete version.  Each version is read back from files, so lineage
never grows across upserts.  Single writer per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions.constants import INSIGHT_TYPES

VERSION_PREFIX = "version="


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


KEPT_VERSIONS = 2


def one_per_key(df: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """The newest row of each key (one aggregate with partial aggregation)."""
    as_text = F.to_json(F.struct(*df.columns))
    order = F.struct(F.col(newest), as_text) if newest else as_text
    row = F.max_by(F.struct(*df.columns), order).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("_row.*")


class VersionedTable:
    def __init__(self, spark: SparkSession, base: str, partition_by: tuple[str, ...] = ()):
        self.spark = spark
        self.base = base.rstrip("/")
        self.partition_by = partition_by

    # -- versions ---------------------------------------------------------
    def versions(self) -> list[int]:
        fs, p, jvm = _fs(self.spark, self.base)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith(VERSION_PREFIX):
                marker = jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
                if fs.exists(marker):
                    out.append(int(name[len(VERSION_PREFIX):]))
        return sorted(out)

    def exists(self) -> bool:
        return bool(self.versions())

    def _path(self, v: int) -> str:
        return f"{self.base}/{VERSION_PREFIX}{v:06d}"

    def read(self) -> DataFrame | None:
        vs = self.versions()
        return self.spark.read.parquet(self._path(vs[-1])) if vs else None

    def write(self, df: DataFrame) -> int:
        vs = self.versions()
        v = (vs[-1] + 1) if vs else 1
        w = df.write.mode("overwrite")
        if self.partition_by:
            w = w.partitionBy(*self.partition_by)
        w.parquet(self._path(v))
        self._remove(vs[:1 - KEPT_VERSIONS])
        return v

    def _remove(self, versions: list[int]) -> None:
        """Drop versions that no reader opens any more; the last one before the new stays for jobs
        that began on it."""
        for v in versions:
            fs, p, _ = _fs(self.spark, self._path(v))
            fs.delete(p, True)

    # -- keyed writes -----------------------------------------------------
    def upsert(self, new: DataFrame, key: str | list[str], newest: str | None = None) -> int:
        """Rows of ``new`` replace rows with the same key; others are kept.  Of several new rows
        with one key the one with the greatest ``newest`` stays (without it: the last as text)."""
        keys = [key] if isinstance(key, str) else list(key)
        new = one_per_key(new, keys, newest)
        old = self.read()
        if old is None:
            return self.write(new)
        kept = old.join(new.select(*keys), keys, "left_anti")
        return self.write(kept.unionByName(new.select(*old.columns)))

    def append(self, new: DataFrame) -> int:
        old = self.read()
        return self.write(new if old is None else old.unionByName(new.select(*old.columns)))


# --- insights (S7-S10, S16) ------------------------------------------------

INSIGHT_COLUMNS = ["insight_id", "insight_type", "insight_data", "timestamp", "metadata"]


def upsert_insights(table: VersionedTable, new: DataFrame) -> int:
    """Update data/timestamp/metadata of existing ids (type kept), insert others.

    ``new``: insight_id, insight_type, insight_data (JSON text), metadata
    (JSON text or null -> '{}').
    """
    stamped = new.select("insight_id", "insight_type", "insight_data",
                         F.current_timestamp().alias("timestamp"),
                         F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"))
    old = table.read()
    if old is not None:
        types = old.select("insight_id", F.col("insight_type").alias("_old_type"))
        stamped = (stamped.join(types, "insight_id", "left")
                   .withColumn("insight_type", F.coalesce("_old_type", "insight_type"))
                   .select(*INSIGHT_COLUMNS))
    return table.upsert(stamped, "insight_id")


def get_insight(table: VersionedTable, insight_id: str, schema=None) -> DataFrame:
    """Point lookup; ``payload`` is the parsed JSON when a schema is given."""
    df = table.read()
    if df is None:
        df = table.spark.createDataFrame([], "insight_id string, insight_data string")
    row = df.where(F.col("insight_id") == insight_id).select("insight_id", "insight_data")
    if schema is not None:
        row = row.withColumn("payload", F.from_json("insight_data", schema))
    return row


def insight_ids_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in INSIGHT_TYPES], "insight_id string, expected_type string")


def get_all_insights(table: VersionedTable) -> DataFrame:
    """The five fixed ids with their payload, null where missing."""
    ids = insight_ids_frame(table.spark).select("insight_id")
    df = table.read()
    if df is None:
        return ids.withColumn("insight_data", F.lit(None).cast("string"))
    return ids.join(df.select("insight_id", "insight_data"), "insight_id", "left")


def select_insights(table: VersionedTable, requested: list[str], regenerate) -> DataFrame:
    """Regenerate everything if any requested id is missing; keep the requested ones.

    An empty request means all.  ``regenerate()`` writes a new version.
    Detecting a gap is a bounded anti join plus ``isEmpty`` (one row at most
    reaches the driver).
    """
    spark = table.spark
    want = spark.createDataFrame([(r,) for r in requested], "insight_id string") if requested else None
    current = get_all_insights(table).where(F.col("insight_data").isNotNull())
    probe = want if want is not None else insight_ids_frame(spark).select("insight_id")
    if not probe.join(current, "insight_id", "left_anti").isEmpty():
        regenerate()
        current = get_all_insights(table).where(F.col("insight_data").isNotNull())
    return current if want is None else current.join(want, "insight_id", "left_semi")


def payload_json(struct_col) -> F.Column:
    """Nested struct -> JSON text (``from_json`` with the same schema reverses it)."""
    return F.to_json(struct_col)


# --- query log (S11, S12) ----------------------------------------------------

def _last_query_id(spark: SparkSession, path: str) -> int:
    """Largest id in the log.  Ids grow with time, so it is in the newest
    ``day`` partition: only that folder is read (listing is metadata only)."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return 0
    days = sorted(st.getPath().getName()[len("day="):] for st in fs.listStatus(p)
                  if st.isDirectory() and st.getPath().getName().startswith("day="))
    if not days:
        return 0
    newest = spark.read.parquet(path).where(F.col("day") == F.lit(days[-1]).cast("date"))
    return newest.agg(F.max("query_id")).first()[0] or 0


def append_query_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append rows (query_text, response, execution_time) to the log.

    A plain partitioned append (files become visible when the job commits).
    Ids continue after the current maximum (read from the newest day only), offset by
    ``monotonically_increasing_id`` (unique and increasing, no global
    ``row_number``).  ``feedback`` is always null, as in the original.
    """
    start = _last_query_id(spark, path)
    response = (F.to_json(F.col("response")) if dict(rows.dtypes).get("response") != "string"
                else F.col("response"))
    new = rows.select(
        (F.lit(start + 1) + F.monotonically_increasing_id()).alias("query_id"),
        F.col("query_text"), response.alias("response"),
        F.current_timestamp().alias("timestamp"),
        F.col("execution_time").cast("double").alias("execution_time"),
        F.lit(None).cast("string").alias("feedback"))
    new.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def recent_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    """Newest ids first (TakeOrderedAndProject), with the number of rows returned in ``returned``."""
    top = (log.select("query_id", "query_text", "timestamp", "execution_time")
           .orderBy(F.desc("query_id")).limit(limit))
    return top.withColumn("returned", F.count(F.lit(1)).over(_all()))      # over at most ``limit`` rows


# --- collections (S13-S15) ------------------------------------------------

COLLECTIONS = ("bookings_data", "insights_data")


def collection(spark: SparkSession, base: str, name: str) -> VersionedTable:
    """A collection is a versioned table ``(id, document, embedding, metadata)``."""
    return VersionedTable(spark, f"{base.rstrip('/')}/{name}")


class BookingIndex:
    """The booking-document collection: append-only, partitioned by id range.

    New bookings are, by construction, ids not yet in the index, so adding
    them is an append (files become visible when the job commits), never a
    rewrite of the collection.  The anti join that finds them reads only the
    id ranges the incoming batch touches (static partition pruning on
    ``id_range``), so its cost follows the batch, not the index.  A replayed
    batch finds its ids indexed and appends nothing.
    """

    MAX_PRUNED_RANGES = 10_000

    def __init__(self, spark: SparkSession, base: str, range_size: int = 1_000_000):
        self.spark = spark
        self.base = base.rstrip("/")
        self.range_size = range_size

    def exists(self) -> bool:
        fs, p, jvm = _fs(self.spark, self.base)
        return fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.base) if self.exists() else None

    def _with_range(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("id_range", F.floor(F.col("booking_id") / F.lit(self.range_size)).cast("long"))

    def not_indexed(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` whose id is not in the index yet, one for each id."""
        docs = self._with_range(one_per_key(docs, ["id"]))
        current = self.read()
        if current is None:
            return docs
        touched = docs.select("id_range").distinct()
        if touched.count() <= self.MAX_PRUNED_RANGES:
            current = current.where(F.col("id_range").isin([r.id_range for r in touched.collect()]))
        return docs.join(current.select("id_range", "id"), ["id_range", "id"], "left_anti")

    def add_new(self, docs: DataFrame) -> int:
        """Append the documents whose ids are not indexed yet; returns how many."""
        new = self.not_indexed(docs).persist()
        try:
            n = new.count()
            if n:
                new.write.mode("append").partitionBy("id_range").parquet(self.base)
            return n
        finally:
            new.unpersist()


def add_documents(coll: VersionedTable, docs: DataFrame) -> int:
    """Keyed upsert on ``id`` (a re-added id replaces the stored row)."""
    return coll.upsert(docs, "id")


def index_status(counts: DataFrame) -> DataFrame:
    """``counts(collection, row_count)`` -> both collections (0 rows where there are none)
    plus the overall status."""
    names = counts.sparkSession.createDataFrame([(n,) for n in COLLECTIONS], "collection string")
    counts = F.broadcast(names).join(counts, "collection", "left") \
        .select("collection", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    return counts.select(
        "collection", "row_count",
        F.when(F.min("row_count").over(_all()) == 0, F.lit("empty")).otherwise(F.lit("ready"))
        .alias("status"))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()


def write_summary_json(df: DataFrame, path: str) -> None:
    """The one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
