"""N-gram Jaccard join with Bayesian candidate pruning.

Texts that share at least ``threshold`` of their five-word shingles are linked.

1. Equal texts form one class, represented by its smallest id; all later work is on
   representatives.  Each has 128 MinHash values of 16 bits.
2. Representatives that agree in one of 32 bands of four values meet in a bucket (a pair
   at the threshold meets nowhere with a chance under 1e-7).  Buckets with equal members
   are kept once, in their first band.  A bucket of more than ``BLOCK_MEMBERS`` members, or
   of many words, is dealt to pairs of blocks.
3. A pair belongs to the first band in which it agrees.  There its MinHash values are
   compared 16 at a time; it is dropped once the posterior probability (uniform prior)
   that its similarity reaches the threshold is below ``TOLERANCE``.  Survivors stay
   lists of partners, one row for each member of a block.
4. Survivors are verified exactly on their shingle sets, block by block.  A block returns
   for each member its number of links and the smallest member it is connected to, so
   neither links nor candidates become rows.
5. Alternating large-star and small-star rounds join the blocks' parts to classes.

Cases: a text of fewer than five words is one shingle of all its words; a text without
words has none and is linked to nothing, but equal ones share a class; a null text is
empty; rows that share an id count once, with the text whose digest is smallest; rows
without an id are returned with null class and no link; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import (
    Stored, arrow_texts, gives_back, inverse_powers, mix, powers, prefix_hash, small_parts, span_hash, word_hashes,
)

WORDS = 5
THRESHOLD = 0.8
VALUES = 128
BAND_VALUES = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK_MEMBERS = 2048
BLOCK_WORDS = 1_500_000      # two blocks meet in a task, which sorts their words

_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in one buffer."""
    return list(_shingles(buf, offsets, words))


def _shingles(buf, offsets, words):
    base = int(offsets[0])
    start, _, h = _word_hashes_of(buf[base:int(offsets[-1])], offsets - base)
    total = prefix_hash(h)
    inv = inverse_powers(len(h))
    first = np.searchsorted(start, offsets - base)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b <= a:
            yield np.zeros(0, np.uint64)
            continue
        s = np.arange(a, max(a + 1, b - words + 1))
        yield np.unique(span_hash(total, s, np.minimum(s + words, b), inv))


def _word_hashes_of(buf, offsets):
    """Word spans and hashes where a text's border also ends a word."""
    if not len(buf):
        return word_hashes(buf)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    if not len(cut):
        return word_hashes(buf)
    # a space between texts, so that no word crosses a border
    spaced = np.insert(buf, cut, 0x20)
    s, e, h = word_hashes(spaced)
    shift = np.searchsorted(cut + np.arange(len(cut)), s, "right")
    return s - shift, e - shift, h


def signature(found: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a set of shingle hashes."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(found), 2048):
        np.minimum(least, (found[k:k + 2048, None] * _SEEDS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Fewest matches among n compared values at which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail beyond t is the chance
    of at most m successes in n + 1 trials of probability t."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (shingles) and sig of every row of doc_id, text, digest."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in small_parts(b, "text"):
                data, off = arrow_texts(part.column("text"))
                sets = shingles(data, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "digest", "n", "sig"])

    return docs.select("doc_id", "digest", "text").mapInArrow(gives_back(run), "doc_id long, digest binary, n long, sig binary")


def _groups(batches, keys):
    """Rows of sorted batches group by group, as one table each."""
    import pyarrow as pa

    held = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edge = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(edge[:-1], edge[1:]):
            now = tuple(c[s] for c in cols)
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


GROUP = ["key", "i", "j"]


def candidates(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Partners of every member of a block pair that survive the pruning; members without any are left out."""
    least = least_matches(threshold, tolerance)

    def run(batches):
        import pyarrow as pa

        for (key, i, j), t in _groups(batches, GROUP):
            rep, block, band = (t.column(c).to_numpy() for c in ("rep", "block", "band"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(rep), VALUES)
            bands = np.ascontiguousarray(sig).view(np.uint64)
            own = int(band[0])
            partners: dict[int, np.ndarray] = {}
            for a in range(len(rep)):
                other = np.arange(a + 1, len(rep)) if i == j else (np.flatnonzero(block == j) if block[a] == i else None)
                if other is None or not len(other):
                    continue
                same = bands[other, :own + 1] == bands[a, :own + 1]
                other = other[same[:, own] & ~same[:, :own].any(axis=1)]
                match = np.zeros(len(other), np.int64)
                for n in range(STEP, VALUES + 1, STEP):
                    if not len(other):
                        break
                    match += (sig[other, n - STEP:n] == sig[a, n - STEP:n]).sum(axis=1)
                    ok = match >= least[n]
                    other, match = other[ok], match[ok]
                if len(other):
                    partners[a] = other
            if partners:
                used = np.unique(np.concatenate([list(partners), *partners.values()])).astype(int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(used), pa.int64()), pa.array([i] * len(used), pa.int64()),
                     pa.array([j] * len(used), pa.int64()), pa.array(rep[used]),
                     pa.array([rep[partners[a]].tolist() if a in partners else [] for a in used.tolist()],
                              pa.list_(pa.int64()))],
                    names=[*GROUP, "rep", "partners"])

    return members.mapInArrow(gives_back(run), "key long, i long, j long, rep long, partners array<long>")


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rep, links and root (the smallest member it is connected to) for each member of each block pair."""
    t = Fraction(str(threshold))

    def run(batches):
        import pyarrow as pa

        for _, table in _groups(batches, GROUP):
            rep = table.column("rep").to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            end = np.cumsum(size)
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            place = {r: a for a, r in enumerate(rep.tolist())}
            mark = np.zeros(int(code.max()) + 1, bool)
            links, left, right = np.zeros(len(rep), np.int64), [], []
            for a, found in enumerate(table.column("partners").to_pylist()):
                if not found:
                    continue
                other = np.array([place[r] for r in found])
                mine = code[end[a] - size[a]:end[a]]
                mark[mine] = True
                n = size[other]
                stop = np.cumsum(n)
                flat = mark[code[np.arange(int(stop[-1])) + np.repeat(end[other] - stop, n)]]
                shared = np.add.reduceat(flat.astype(np.int64), stop - n)
                mark[mine] = False
                other = other[shared * t.denominator >= (size[a] + n - shared) * t.numerator]
                links[a] += len(other)
                links[other] += 1
                left.append(np.full(len(other), a))
                right.append(other)
            root = np.arange(len(rep))
            order = np.argsort(rep, kind="stable")
            rank = np.empty(len(rep), np.int64)
            rank[order] = np.arange(len(rep))
            x, y = (np.concatenate(z).astype(int) if z else np.zeros(0, int) for z in (left, right))
            label = rank.copy()
            while True:                               # smallest connected member, by halving label chains
                low = np.minimum(label[x], label[y])
                new = label.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                new = new[order][new]                 # the label of the member that the label names
                if (new == label).all():
                    break
                label = new
            root = rep[order[label]]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at]), pa.array(root[at])],
                                             names=["rep", "links", "root"])

    return rows.mapInArrow(gives_back(run), "rep long, links long, root long")


def components(edges: DataFrame, store: Stored, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node of each connected part; ``edges`` has u and v.  Alternating
    large-star and small-star rounds, each written to the shared folder."""
    now = store.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                      f"{name}0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        after = store.write(small, f"{name}{k}")
        check = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(f"{name}{k - 1}")
        now = after
        if tuple(check) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(check)


def jaccard_classes(docs: DataFrame, store: Stored, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                    id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, class_id (smallest id of the connected documents), text_id (smallest id with an equal text),
    n_copies (documents with that text), n_links (other texts at the threshold or above)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = store.write(signatures(src), "signatures")
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    found = store.write(rows.select("digest", "n", "sig").distinct().join(
        ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "digest"), "texts")
    banded = found.where("n > 0").select("rep", "n", F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", 8 * b + 1, 8)).alias("key"))
        for b in range(VALUES // BAND_VALUES)])).alias("x")).select("rep", "n", "x.band", "x.key")
    buckets = banded.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n").alias("words"), F.min("band").alias("band"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("f2")) \
        .where("size > 1")
    kept = buckets.groupBy("size", "f1", "f2").agg(F.min(F.struct("band", "key", "words")).alias("b")) \
        .select("b.key", "size", "b.words")
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("words") / BLOCK_WORDS))
    members = banded.select("key", "band", "rep").join(kept, "key").withColumn("blocks", n_blocks) \
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))) \
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "band", "block", "rep")
    members = members.join(found.select("rep", "sig"), "rep").repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")
    survivors = store.write(candidates(members, threshold, tolerance), "survivors")
    wanted = survivors.select("rep").distinct().join(found.select("rep", "digest"), "rep")
    texts = src.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"], "left_semi")
    sets = store.write(shingle_sets(texts).dropDuplicates(["rep"]), "sets")
    checked = store.write(verify(survivors.join(sets, "rep").repartition(*GROUP).sortWithinPartitions(*GROUP, "rep"),
                                 threshold), "checked")
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v")), store)
    texts_out = found.select("digest", "rep", "n_copies").join(links, "rep", "left") \
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    out = ids.join(texts_out, "digest").select(
        "doc_id", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("text_id"), "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nameless = rows.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    result = store.write(out.unionByName(nameless), "classes")
    store.drop("signatures", "texts", "survivors", "sets", "checked")
    return result


def shingle_sets(texts: DataFrame) -> DataFrame:
    """rep and shingles (sorted 64-bit hashes) of each row of doc_id, text."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in small_parts(b, "text"):
                data, off = arrow_texts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.astype("<u8").tobytes() for s in shingles(data, off)], pa.binary())],
                    names=["rep", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(gives_back(run), "rep long, shingles binary")


def keep_one(docs: DataFrame, store: Stored, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the smallest id of every class, with all their columns; rows without an id stay."""
    classes = jaccard_classes(docs, store, threshold)
    gone = store.write(classes.where("doc_id <> class_id").select("doc_id"), "gone")     # by its bytes Spark may broadcast it
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
