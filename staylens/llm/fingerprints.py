"""Improbable-feature digests of whole texts.

Every 64-byte window gets its byte entropy in steps of 1/1000 of the largest
possible one.  The windows of all documents are counted by entropy step, and a
window's rarity is the rank of its step among those counts: the fewer windows
share a step, the less probable the feature.  The leftmost least probable
window of each 64 neighbouring windows gains a point; windows with
``MIN_POINTS`` points are the text's features.  Features go, in text order,
into chained Bloom filters of 2048 bits with at most 160 features each, and
the digest is their bits in hex.

Two digests are compared filter by filter: shared bits beyond those expected
by chance, as a share of the most possible; each filter of the shorter digest
counts with its best partner, and the mean is the likeness.

Cases: a text of fewer than 64 bytes is one feature; a null or empty text has
the empty digest, alike (1.0) only to another empty one; equal texts have
equal digests; rows with equal ids follow each other by text; a null id sorts
first; an empty table gives no row; a single document is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import arrow_texts, inverse_powers, mix, prefix_hash, span_hash, _BYTE

WINDOW = 64
STEPS = 1000
LEAST_ENTROPY = 100      # windows of a few repeated bytes are no features
MIN_POINTS = 16
NEIGHBOURS = 64
BITS = 2048
HASHES = 5
FILTER_FEATURES = 160
CHANCE = 0.05

# c * log2(c) in units of 2**-20, so that sums are exact
_GAIN = np.array([0] + [round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 2)], np.int64)


def entropy_steps(buf: np.ndarray) -> np.ndarray:
    """Entropy step of the window that starts at each byte (fewer by 63 than bytes)."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead = np.zeros(len(buf), np.uint8)      # equal bytes among the next 63
    behind = np.zeros(len(buf), np.uint8)     # and among the 63 before
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    count = np.bincount(buf[:WINDOW], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = _GAIN[count].sum()
    if n > 1:
        out, new = ahead[:n - 1].astype(np.int64), behind[WINDOW:].astype(np.int64)
        # the byte that leaves had out + 1 copies, the one that comes in has new others
        total[1:] = _GAIN[out] - _GAIN[out + 1] + _GAIN[new + 1] - _GAIN[new]
        np.cumsum(total, out=total)
    bits = np.log2(WINDOW) - total / (WINDOW * float(1 << 20))
    return np.clip((bits * STEPS / np.log2(WINDOW)).astype(np.int64), 0, STEPS)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n window starts keep the window inside one text."""
    mark = np.zeros(n + WINDOW, np.int32)
    for s, e in zip(offsets[:-1], offsets[1:]):
        if e - s >= WINDOW:
            mark[s] += 1
            mark[e - WINDOW + 1] -= 1
    return np.cumsum(mark[:n]) > 0


def count_steps(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of these texts have each entropy step."""
    steps = entropy_steps(buf)
    return np.bincount(steps[_inside(offsets, len(steps))], minlength=STEPS + 1)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each step, the rarest 0; steps of almost no entropy come after all others."""
    order = np.lexsort((np.arange(len(counts)), counts, np.arange(len(counts)) < LEAST_ENTROPY))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    return rank


def features(text: bytes, rank: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in text order."""
    buf = np.frombuffer(text, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    h = prefix_hash(_BYTE[buf])
    if len(buf) < WINDOW:
        return span_hash(h, np.array([0]), np.array([len(buf)]), inverse_powers(0))
    step = entropy_steps(buf)
    n = len(step)
    key = (rank[step] << 40) | np.arange(n)
    width, span = 1, min(NEIGHBOURS, n)
    low = key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    points = np.bincount(low & ((1 << 40) - 1), minlength=n)
    at = np.flatnonzero(points >= min(MIN_POINTS, max(1, len(low) // 2)))
    at = at[step[at] >= LEAST_ENTROPY]
    if not len(at):
        at = np.array([int(key.argmin())])
    return span_hash(h, at, at + WINDOW, inverse_powers(len(buf)))


def digest(found: np.ndarray) -> np.ndarray:
    """Chained filters (rows of BITS booleans) of features in order; repeated ones count once."""
    _, first = np.unique(found, return_index=True)
    found = found[np.sort(first)]
    count = -(-len(found) // FILTER_FEATURES)
    out = np.zeros((count, BITS), bool)
    row = np.arange(len(found)) // FILTER_FEATURES
    for k in range(HASHES):
        out[row, ((found >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return out


def to_hex(filters: np.ndarray) -> str:
    return np.packbits(filters, axis=1).tobytes().hex() if len(filters) else ""


def from_hex(s: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8).reshape(-1, BITS // 8), axis=1).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(axis=1).astype(float), b.sum(axis=1).astype(float)
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    most = np.minimum.outer(na, nb)
    chance = np.outer(na, nb) / BITS
    floor = chance + CHANCE * (most - chance)
    score = np.where(most > floor, (shared - floor) / np.maximum(most - floor, 1e-9), shared >= most)
    score = np.clip(score, 0, 1)
    if len(a) == len(b):
        return float(max(score.max(axis=1).mean(), score.max(axis=0).mean()))
    return float(score.max(axis=1).mean())


def entropy_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows by entropy step over all texts: one row for each step and task, summed by Spark."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(STEPS + 1, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                data, off = arrow_texts(b.column(0).slice(k, 512))
                total += count_steps(data[off[0]:off[-1]], off - off[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(total)], names=["step", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "step long, n long") \
        .groupBy("step").agg(F.sum("n").alias("n")).collect()          # 1001 rows
    out = np.zeros(STEPS + 1, np.int64)
    for r in rows:
        out[r["step"]] = r["n"]
    return out


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, text, peek): parts are id ranges, each sorted, and a copy of the document that
    follows a part's last one closes the part with peek set.  Whole texts move once."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = src.select("doc_id").where("doc_id is not null")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) or []))
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def part_of(x):
        import pandas as pd

        v = x.to_numpy(dtype="float64", na_value=np.nan) if x.isna().any() else x.to_numpy(dtype="int64")
        if v.dtype == np.int64:
            return pd.Series(np.searchsorted(cuts, v, "right"))
        return pd.Series(np.where(np.isnan(v), 0, np.searchsorted(cuts, np.nan_to_num(v).astype(np.int64), "right")))

    part = src.select("doc_id").withColumn("part", part_of("doc_id"))
    firsts = part.groupBy("part").agg(F.min("doc_id").alias("first"),
                                      F.max(F.col("doc_id").isNull().cast("int")).alias("has_null")) \
        .orderBy("part").collect()                                      # one row a part
    if not firsts:
        return src.selectExpr("0L part", "doc_id", "text", "0 peek").limit(0)
    heads = [None if r["has_null"] else r["first"] for r in firsts]
    # the part that each head also closes: the one before, and the last part for the first head
    closes = spark.createDataFrame(
        [(firsts[i - 1]["part"], heads[i]) for i in range(len(heads))], "peek_part long, head long")
    head_rows = src.join(F.broadcast(closes), src["doc_id"].eqNullSafe(closes["head"]))
    head_rows = head_rows.groupBy("peek_part", "doc_id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    both = src.withColumn("part", part_of("doc_id")).select("part", "doc_id", "text", F.lit(0).alias("peek")) \
        .unionByName(head_rows.select(F.col("peek_part").alias("part"), "doc_id", "text", F.lit(1).alias("peek")))
    return both.repartition("part").sortWithinPartitions(
        "part", "peek", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first ones."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text and of its edited text, and the likeness to both neighbours."""
    rank = rarity_ranks(entropy_counts(docs, text_col))
    schema = ("doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches):
        import pyarrow as pa

        def made(text: str):
            return digest(features(text.encode("utf-8", "surrogatepass"), rank))

        def one(cur, nxt, nxt_print):
            doc, text, own = cur
            new = edited(text, nxt)
            new_print = own if new == text else made(new)
            return (doc, len(text), new, to_hex(own), to_hex(new_print), likeness(own, new_print),
                    likeness(own, nxt_print))

        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        held, part_at, rows = None, None, []
        for b in batches:
            for part, doc, text, peek in zip(*(b.column(k).to_pylist() for k in range(4))):
                text = text or ""
                own = made(text)
                if held is not None and part == part_at:
                    rows.append(one(held, text, own))
                held, part_at = (None if peek else (doc, text, own)), part
                if len(rows) >= 256:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
