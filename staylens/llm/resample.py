"""Importance resampling towards a target distribution, with segment deduplication.

Features are runs of 1 to ``order`` words, hashed into buckets.  The log ratio of the target's
and the corpus's smoothed bucket shares is the gain of a bucket; the sum of a document's gains
plus Gumbel noise from a hash of its id is its score, and the highest scores are a sample
without replacement in proportion to the importance weights.

Segment deduplication.  Newlines cut the texts into lines.  Spark groups equal lines (by a
128-bit BLAKE2 digest), the features of a distinct line are counted once, and its counts are
multiplied by its occurrences; runs that cross a line border are counted with their document.
The weight of a document is the sum of its lines' weights, joined by digest, plus that of its
crossing runs.  The lines' join leaves frequent lines to adaptive skew handling; a line that
recurs within a document is one row.

Edge cases.  Null texts are empty.  A document without features has weight 0.  A null id is
'' in the noise and comes last among ties; rows that share an id, repeated rows too, are
separate documents.  An empty table gives no rows, an empty target gives t = T = 0.  Lines
without end are read in pieces (for ``order`` 1).  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Stored, ragged_take
from staylens.llm.terms import ALNUM, as_binary, counted, parts, runs, spaced

ORDER = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


# --- features ------------------------------------------------------------------------

def _add_runs(held, joined, start, end, of, k, ok):
    """Append (text, bucket) of the runs of k words that start at the words ``ok``."""
    at = np.flatnonzero(ok)
    length = end[at + k - 1] - start[at]
    coded = as_binary(ragged_take(joined, start[at], length), np.concatenate([[0], np.cumsum(length)])).dictionary_encode()
    held.append((of[at], _buckets(coded.dictionary)[np.asarray(coded.indices).astype(np.int64)]))


def _buckets(names) -> np.ndarray:
    return np.array([zlib.crc32(x) for x in names.to_pylist()], np.int64)


def _longer_runs(data, off, order: int, lines: bool):
    """(text, crc32) of the runs of 2 to ``order`` words: within texts, or (``lines``) only those across lines."""
    values, offsets, of, low, begin = runs(data, off, ALNUM)
    size = np.diff(offsets)
    joined, start = spaced(values, offsets)
    start = start[:-1]
    line = np.cumsum(low == 0x0A)[begin] if lines else np.zeros(len(of), np.int64)
    held: list = []
    for k in range(2, order + 1):
        same = of[k - 1:] == of[:len(of) - k + 1] if len(of) >= k else np.zeros(0, bool)
        if lines:
            same &= line[k - 1:] != line[:len(of) - k + 1]
        _add_runs(held, joined, start, start + size, of, k, same)
    return held


def line_features(data, off, order: int, buckets: int):
    """(text, bucket, count) sorted by text, and the words of each text."""
    of, code, n, names = counted(data, off, ALNUM) if order == 1 else counted(data, off, ALNUM, int(off[-1] - off[0]) + 1)
    words = np.bincount(of, n, len(off) - 1).astype(np.int64)
    held = [(of, _buckets(names)[code], n)]
    if order > 1:
        held += [(o, b, np.ones(len(o), np.int64)) for o, b in _longer_runs(data, off, order, False)]
    of, bucket, n = (np.concatenate(x) for x in zip(*held))
    return (*_grouped(of, bucket % buckets, n, buckets), words)


def _grouped(of, bucket, n, buckets):
    key, at = np.unique(of * buckets + bucket, return_inverse=True)
    return key // buckets, key % buckets, np.bincount(at, n, len(key)).astype(np.int64)


def _lists(of, rows, values):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


# --- passes ---------------------------------------------------------------------------

LINES = "row long, doc_id long, key binary, n long, line binary, buckets array<long>, counts array<long>"


def _cut(order: int, buckets: int):
    """A head row for each document, with the features across its lines, and a row for each distinct line;
    the bytes of a line stand only in its first row of a part."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, off in parts(batch, rows=1024):
                cross = (np.zeros(0, np.int64),) * 3
                if order > 1:
                    found = [(o, b % buckets, np.ones(len(o), np.int64)) for o, b in _longer_runs(data, off, order, True)]
                    cross = _grouped(*(np.concatenate(x) for x in zip(*found)), buckets)
                m = part.num_rows
                rows = np.arange(row, row + m)
                row += m
                none = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column("doc_id"), none, pa.array(np.zeros(m, np.int64)), none,
                     _lists(cross[0], m, cross[1]), _lists(cross[0], m, cross[2])], names=[c.split()[0] for c in LINES.split(", ")])
                at, keys, lines, counts, seen = [], [], [], [], set()
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    tally: dict[bytes, int] = {}
                    for line in data[a:b].tobytes().split(b"\n"):
                        tally[line] = tally.get(line, 0) + 1
                    tally.pop(b"", None)
                    for line, n in tally.items():
                        key = hashlib.blake2b(line, digest_size=16).digest()
                        at.append(i)
                        counts.append(n)
                        keys.append(key)
                        lines.append(None if key in seen else line)
                        seen.add(key)
                m = len(at)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[at]), pa.nulls(m, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                         pa.array(lines, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))],
                        names=[c.split()[0] for c in LINES.split(", ")])
    return run


def _features(order: int, buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, off in parts(batch, "line"):
                of, bucket, n, words = line_features(data, off, order, buckets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("times"), pa.array(words), _lists(of, part.num_rows, bucket),
                     _lists(of, part.num_rows, n)], names=["key", "times", "words", "buckets", "counts"])
    return run


def _bucket_sums(buckets: int):
    """Occurrences of the features of a task's rows in each bucket."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            times = np.repeat(np.asarray(batch.column("times")), np.diff(np.asarray(lists.offsets)))
            np.add.at(total, np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten()) * times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def _weights(gains: np.ndarray, carried: list[str]):
    """weight and n_features of rows of buckets and counts."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("buckets")
            n = np.asarray(batch.column("counts").flatten())
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            weight, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, of, gains[np.asarray(lists.flatten())] * n)
            np.add.at(size, of, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(weight), pa.array(size)],
                                             names=[*carried, "weight", "n_features"])
    return run


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences in each bucket, from rows of times, buckets and counts; ``buckets`` numbers reach the driver."""
    found = features.select("times", "buckets", "counts").mapInArrow(_bucket_sums(buckets), "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    whole, goal = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * whole / ((s + 1.0) * goal)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def segments(docs: DataFrame, store: Stored, name: str, id_col: str, text_col: str, order: int, buckets: int):
    """(rows of documents and their lines, features of distinct lines), both stored."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = store.write(src.mapInArrow(_cut(order, buckets), LINES), f"{name}-lines")
    distinct = lines.where("key is not null").groupBy("key").agg(F.max("line").alias("line"), F.sum("n").alias("times"))
    return lines, store.write(distinct.mapInArrow(
        _features(order, buckets), "key binary, times long, words long, buckets array<long>, counts array<long>"), f"{name}-features")


def corpus_counts(lines: DataFrame, features: DataFrame, buckets: int, order: int) -> np.ndarray:
    rows = features.select("times", "buckets", "counts")
    if order > 1:
        rows = rows.unionByName(lines.where("key is null").select(F.lit(1).cast("long").alias("times"), "buckets", "counts"))
    return bucket_counts(rows, buckets)


def numbered(df: DataFrame, store: Stored, order) -> DataFrame:
    """``df`` with ``rank``, from 1 in the given order: range partitions, a position in each, and the
    partitions' row counts, of which the driver sees one number a partition."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part, np.int64)), pa.array(np.arange(at + 1, at + m + 1))],
                                             names=[*batch.schema.names, "part", "at"])
            at += m

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    dealt = store.write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, part long, at long"),
                        "numbered")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    bases, total = [], 0
    for part, n in sizes:
        bases.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(bases, "part long, base long")
    return dealt.join(F.broadcast(base), "part").select(*df.columns, (F.col("base") + F.col("at")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, store: Stored, order: int = ORDER, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
             id_col="doc_id", text_col="text", target_text="text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row of ``docs``."""
    lines, features = segments(docs, store, "source", id_col, text_col, order, buckets)
    aim = target.select(F.lit(None).cast("long").alias("_id"), F.col(target_text).alias("_text"))
    goal = segments(aim, store, "target", "_id", "_text", order, buckets)
    gains = gains_of(corpus_counts(lines, features, buckets, order), corpus_counts(*goal, buckets, order))
    store.drop("target-lines", "target-features")
    weights = features.select("key", "words", "buckets", "counts").mapInArrow(
        _weights(gains, ["key", "words"]), "key binary, words long, weight long, n_features long")
    n = F.col("n")
    own = lines.where("key is not null").select("row", "key", "n").join(weights, "key").select(
        "row", F.lit(None).cast("long").alias("doc_id"), *[(n * F.col(c)).alias(c) for c in ("words", "weight", "n_features")])
    heads = lines.where("key is null").select("row", "doc_id", "buckets", "counts").mapInArrow(
        _weights(gains, ["row", "doc_id"]), "row long, doc_id long, weight long, n_features long") \
        .select("row", "doc_id", F.lit(0).cast("long").alias("words"), "weight", "n_features")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                      .cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = own.unionByName(heads).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("words").alias("n_words"), F.sum("n_features").alias("n_features"),
        F.sum("weight").alias("weight")).withColumn("score", F.col("weight") + gumbel)
    scored = store.write(scored, "scored")
    store.drop("source-lines", "source-features")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, store, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")])
    store_rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", store_rank).unionByName(
        scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))).drop("row")


_LOWER = ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(translate(coalesce(text, '')" + _LOWER + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

SQL = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, x: {_STEP}) AS v FROM range(256) r(i)) z),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) x GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) x GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw) u),
b AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2),
        lambda i: 16 * (instr('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INT), 1)) - 1) + instr('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INT), 1)) - 1)),
        lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 AS INT) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(s), 0) FROM s) AS DOUBLE) + {BUCKETS})
    / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) + {BUCKETS})))) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
    FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight FROM d LEFT JOIN w USING (doc_id)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5)
    / 4294967296))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= {MIN_WORDS})
SELECT x.*, CASE WHEN r.rank <= r.n * {PERCENT} // 100 THEN r.rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""
