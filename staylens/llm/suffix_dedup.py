"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier: in a
document with a smaller id, or earlier in the same one.

1. Every window of ``length`` bytes has an anchor: the leftmost of its ``GRAM``-byte grams
   with the least hash.  Equal windows have equal anchors at equal offsets, so windows can
   only repeat within the group of one anchor gram.  Neighbouring windows of one anchor
   form a segment.  Anchors that occur once end here; whole later copies of a text repeat
   all their windows and end here too.
2. Segments of one anchor are named by 128-bit hashes.  A segment equal to an earlier one
   repeats as a whole.  Groups with several different segments go on, each segment once.
3. Segments of such groups are gathered in batches of bounded size, cut into shards, and each
   shard gets its suffix array and Burrows-Wheeler transform.  All transforms are merged by
   refining their interleave: a stable sort of the merged transform by symbol moves every
   suffix to where one step more puts it (a step is as many symbols as leave 16 bits of different runs).  A block
   border appears where that step or the border before differs, so after ``length`` symbols blocks are the intervals of suffixes
   whose common prefix has ``length`` bytes: repeated windows, without sorting all suffixes.
4. In each interval the earliest window stays; the others go.

A group of more than ``HOT_SEGMENTS`` different segments would not fit a bounded batch; its
windows are named one by one and grouped by Spark (salted by the window itself).

Cases: a null text is empty; a text shorter than ``length`` keeps all its bytes; rows without an
id keep theirs and are no source; rows with one id and different texts count as one document in
which neither text repeats the other's windows unless their starts differ; equal rows of one id
are one; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import _BYTE, Stored, arrow_texts, inverse_powers, mix, prefix_hash, small_parts, span_hash

LENGTH = 100
GRAM = 64
HOT_SEGMENTS = 4096
SHARD_BYTES = 1 << 15
BATCH_SHARDS = 4
STEPS = (20, 10, 5, 4, 2, 1)    # symbols that may make one step of the merge
U = np.uint64
_BASE2 = mix(np.array([14], U))[0] | U(1)
_INV2 = U(pow(int(_BASE2), -1, 1 << 64))


# --- suffix arrays and transforms ------------------------------------------------

def _ranks(key: np.ndarray) -> np.ndarray:
    """Place of each key among the different keys in order."""
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols or more, ties by position: ranks of as many symbols as one
    number holds, then prefix doubling."""
    n = len(text)
    symbols = int(text.max(initial=0)) + 2                # 0: beyond the end
    width = max(1, min(depth, n, int(62 / math.log2(symbols))))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key *= symbols
        key[:n - k] += text[k:].astype(np.int64) + 1
    rank = _ranks(key)
    while n and width < depth and rank.max() < n - 1:
        key = rank * (n + 1)
        key[:max(0, n - width)] += rank[width:] + 1
        rank = _ranks(key)
        width *= 2
    return np.argsort(rank.astype(np.uint16) if n <= 1 << 16 else rank, kind="stable")


def transform(codes: np.ndarray, suffixes: np.ndarray, step: int = 1) -> np.ndarray:
    """The ``step`` symbols before each suffix in order, by the code of the run that starts there; the text is
    taken as a cycle."""
    return codes[suffixes - step].astype(np.uint16)


def run_codes(texts: list[np.ndarray], symbols: int, length: int):
    """(step, codes): for each place of each text a number of the ``step`` symbols from there on, in their order
    and with the text as a cycle.  The step is the longest of STEPS that divides ``length`` and leaves no more
    than 16 bits of different runs."""
    for step in (x for x in STEPS if length % x == 0 and symbols ** x < 1 << 62):
        keys = []
        for t in texts:
            cycle = np.resize(t, len(t) + step - 1).astype(np.int64)
            key = cycle[:len(t)].copy()
            for k in range(1, step):
                key *= symbols
                key += cycle[k:k + len(t)]
            keys.append(key)
        codes = _ranks(np.concatenate(keys))
        if step == 1 or codes.max(initial=0) < 1 << 16:
            return step, np.split(codes, np.cumsum([len(t) for t in texts])[:-1])


def merge(transforms: list[np.ndarray], rounds: int):
    """Interleave of the transforms and the blocks of suffixes with equal first ``rounds`` steps.

    Returns (shard of each place, block of each place): the suffixes of a shard appear in the
    order of its own transform."""
    kind = np.uint8 if len(transforms) <= 1 << 8 else np.uint16
    shard = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    n = len(shard)
    block = np.zeros(n, np.int32)
    flat = np.concatenate(transforms)
    for _ in range(rounds):
        symbol = np.empty(n, np.uint16)              # the next unread symbol of each shard, in place order
        symbol[np.argsort(shard, kind="stable")] = flat
        order = np.argsort(symbol, kind="stable")
        s, b = symbol[order], block[order]
        edge = np.zeros(n, bool)
        np.not_equal(s[1:], s[:-1], out=edge[1:])
        edge[1:] |= b[1:] != b[:-1]
        shard, block = shard[order], np.cumsum(edge, dtype=np.int32)
        if block[-1] == n - 1:
            break
    return shard, block


def window_classes(segments: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, the class of each of its windows of ``length`` bytes; equal windows of any two
    segments have equal classes."""
    shards: list[list[int]] = [[]]
    size = 0
    for i, seg in enumerate(segments):
        if size and size + len(seg) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(seg) + 1
    # symbols in order of their bytes
    used = np.unique(np.frombuffer(b"".join(segments), np.uint8))
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    symbols = len(used) + 1
    texts, firsts = [], []
    for members in shards:
        parts, first, at = [], [], 0
        for i in members:
            first.append(at)
            parts += [code[np.frombuffer(segments[i], np.uint8)], np.zeros(1, np.uint16)]
            at += len(segments[i]) + 1
        texts.append(np.concatenate(parts))
        firsts.append(first)
    arrays = [suffix_array(t, length) for t in texts]
    step, codes = run_codes(texts, symbols, length)
    shard, block = merge([transform(c, a, step) for c, a in zip(codes, arrays)], length // step)
    out: list = [None] * len(segments)
    for k, members in enumerate(shards):
        of = np.empty(len(texts[k]), np.int64)
        of[arrays[k]] = block[shard == k]
        for i, first in zip(members, firsts[k]):
            out[i] = of[first:first + len(segments[i]) - length + 1]
    return out


# --- anchors and segments ----------------------------------------------------------

def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor name, first window, number of windows), windows counted over the buffer."""
    n = len(data)
    windows = n - length + 1
    if windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(U), z, z
    h = prefix_hash(_BYTE[data])
    at = np.arange(n - gram + 1)
    name = span_hash(h, at, at + gram, inverse_powers(n))
    mask = U((1 << 24) - 1)
    key = (name & ~mask) | at.astype(U)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
    anchor = (key & mask).astype(np.int64)
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    long = size >= length
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(ok[:windows]) > 0)
    if not len(s):
        return s, np.zeros(0, U), s, s
    doc = np.searchsorted(off, s, "right") - 1
    a = anchor[s]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)]))
    return doc[new], name[a[new]], s[new], np.diff(np.append(new, len(s)))


def _slices(batch, rows: int = 64, size: int = 12_000_000):
    """Parts of a batch whose texts fit 24-bit positions; one longer text stands alone."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = at + 1
        total = n[at]
        while end < batch.num_rows and end - at < rows and total + n[end] <= size:
            total += n[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _parts(batch):
    """(part, buffer, offsets, segments of it); texts beyond 24-bit positions are cut with an overlap."""
    for part in _slices(batch):
        data, off = arrow_texts(part.column("text"))
        data, off = data[int(off[0]):int(off[-1])], off - off[0]
        limit = 1 << 23
        if len(data) <= limit * 2:
            yield part, data, off, segments(data, off)
            continue
        found = []
        for at in range(0, len(data), limit):           # a single long text: pieces that share length - 1 bytes
            piece = data[at:at + limit + LENGTH - 1]
            doc, name, s, n = segments(piece, np.array([0, len(piece)]))
            found.append((doc, name, s + at, n))
            if at + limit + LENGTH - 1 >= len(data):
                break
        yield part, data, off, tuple(np.concatenate(x) for x in zip(*found))


def _unit_rows(batches):
    import pyarrow as pa

    for b in batches:
        for part, _, _, (doc, name, _, _) in _parts(b):
            if not len(doc):
                continue
            order = np.lexsort((name, doc))
            d, x = doc[order], name[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
            n = np.diff(np.append(new, len(d)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(d[new])), part.column("t").take(pa.array(d[new])),
                 pa.array(x[new].view(np.int64)), pa.array(n > 1)], names=["doc_id", "t", "name", "twice"])


def _chosen(part, doc, name):
    """Which segments have a name in the part's list of their text."""
    ok = np.zeros(len(doc), bool)
    edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
    for i, found in enumerate(part.column("names").to_pylist()):
        a, b = edge[i], edge[i + 1]
        ok[a:b] = np.isin(name[a:b].view(np.int64), np.array(found, np.int64))
    return np.flatnonzero(ok)


def _segment_rows(with_bytes: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, data, off, (doc, name, s, n) in _parts(b):
                at = _chosen(part, doc, name)
                if with_bytes and len(at):               # those that were asked for by their start
                    want = part.column("starts").to_pylist()
                    sets = [set(w) for w in want]
                    at = np.array([i for i in at.tolist() if int(s[i] - off[doc[i]]) in sets[doc[i]]], np.int64)
                if not len(at):
                    continue
                begin, end = s[at], s[at] + n[at] + LENGTH - 1
                if with_bytes:
                    raw = data.tobytes()
                else:
                    h, inv = prefix_hash(_BYTE[data]), inverse_powers(len(data))
                    h1 = span_hash(h, begin, end, inv).view(np.int64)
                    h = prefix_hash(_BYTE[data], _BASE2)
                    h2 = span_hash(h, begin, end, inverse_powers(len(data), _INV2)).view(np.int64)
                for k in range(0, len(at), 20_000):
                    j, cut = at[k:k + 20_000], slice(k, k + 20_000)
                    take = pa.array(doc[j])
                    cols = [part.column("doc_id").take(take), part.column("t").take(take),
                            pa.array(name[j].view(np.int64)), pa.array(s[j] - off[doc[j]]), pa.array(n[j])]
                    names = ["doc_id", "t", "name", "s", "n"]
                    if with_bytes:
                        cols.append(pa.array([raw[x:y] for x, y in zip(begin[cut].tolist(), end[cut].tolist())], pa.binary()))
                        names.append("bytes")
                    else:
                        cols += [pa.array(h1[cut]), pa.array(h2[cut])]
                        names += ["h1", "h2"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _repeat_rows(batches):
    """Runs of windows of the segments in these sorted groups that start later than an equal one."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0

    def flush():
        classes = window_classes([r[4] for r in held])
        n = np.array([len(c) for c in classes])
        which = np.repeat(np.arange(len(held)), n)
        cls = np.concatenate(classes)
        # names of groups are part of the class: equal windows have equal anchors
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.array([r[1] for r in held])[which]
        s = np.array([r[3] for r in held])[which] + inside
        order = np.lexsort((s, doc, cls))
        later = np.concatenate([[False], cls[order][1:] == cls[order][:-1]])
        first_of = np.maximum.accumulate(np.where(~later, np.arange(len(order)), 0))
        gone = order[later & ((doc[order] != doc[order][first_of]) | (s[order] != s[order][first_of]))]
        late = np.zeros(len(which), bool)
        late[gone] = True
        begin = late.copy()                                  # of runs of such windows within a segment
        begin[1:] &= ~late[:-1] | (which[1:] != which[:-1])
        runs = np.flatnonzero(begin)
        rows = [held[i] for i in which[runs].tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array(s[runs]), pa.array(np.bincount(np.cumsum(begin)[late] - 1, minlength=len(runs)))],
            names=["doc_id", "t", "s", "n"])

    last = None
    for b in batches:
        for name, doc, t, s, raw in zip(*(b.column(c).to_pylist() for c in ("name", "doc_id", "t", "s", "bytes"))):
            if held and name != last and size >= SHARD_BYTES * BATCH_SHARDS:
                yield flush()
                held, size = [], 0
            held.append((name, doc, t, s, raw))
            size += len(raw)
            last = name
    if held:
        yield flush()


def _window_rows(batches):
    """Every window of a segment by its digest (groups too large for one batch)."""
    import pyarrow as pa

    for b in batches:
        for doc, t, s, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "s", "bytes"))):
            n = len(raw) - LENGTH + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array([t] * n, pa.int64()), pa.array(np.arange(s, s + n)),
                 pa.array([hashlib.md5(raw[i:i + LENGTH]).digest() for i in range(n)], pa.binary())],
                names=["doc_id", "t", "s", "digest"])


def _kept_rows(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        for part in small_parts(b, "text"):
            data, off = arrow_texts(part.column("text"))
            data, off = data[int(off[0]):int(off[-1])], off - off[0]
            size = np.diff(off)
            copy = np.asarray(pc.fill_null(part.column("copy"), False)) & (size >= LENGTH)
            found = part.column("found")
            of = np.repeat(np.arange(len(size)), np.asarray(pc.fill_null(pc.list_value_length(found), 0)))
            runs = found.flatten()
            s, n = (np.asarray(runs.field(c)) for c in ("s", "n"))
            use = ~copy[of]
            begin = np.concatenate([(off[of] + s)[use], off[:-1][copy]])
            end = np.concatenate([(off[of] + s + n + LENGTH - 1)[use], off[1:][copy]])
            gone = np.cumsum(np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)) > 0
            before = np.concatenate([[0], np.cumsum(gone[:-1])])      # bytes removed before each place
            # the last place is no byte; a run ends at the end of its text
            first, last = gone[:-1].copy(), gone[:-1].copy()
            border = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
            first[1:] &= ~gone[:-2]
            first[border] = gone[border]
            last[:-1] &= ~gone[1:-1]
            last[border - 1] = gone[border - 1]
            x, y = np.flatnonzero(first), np.flatnonzero(last) + 1
            at = np.searchsorted(off, x, "right") - 1                 # the text of each run
            spans = pa.StructArray.from_arrays([pa.array(x - off[at]), pa.array(y - off[at])], names=["start", "end"])
            many = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(size)))])
            kept = pa.Array.from_buffers(pa.binary(), len(size), [
                None, pa.py_buffer((off - before[off]).astype(np.int32)), pa.py_buffer(data[~gone[:-1]])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size), pa.array(np.diff(before[off])),
                 pa.ListArray.from_arrays(pa.array(many, pa.int32()), spans), kept],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, store: Stored, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs) and kept (remaining bytes) of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .withColumn("t", F.xxhash64("text"))
    named = src.where("doc_id is not null")
    digests = named.select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("digest"))
    copies = store.write(digests.join(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
                                      .where("n > 1"), "digest")
                         .where("rep < doc_id").select("doc_id", "t", F.lit(True).alias("copy")).distinct(), "copies")
    rows = store.write(named.mapInArrow(_unit_rows, "doc_id long, t long, name long, twice boolean"), "units")
    shared = store.write(rows.groupBy("name").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("twice").alias("twice"))
                         .where("a <> b or twice").select("name"), "shared")
    asked = store.write(rows.join(shared, "name").groupBy("doc_id", "t").agg(F.collect_set("name").alias("names"))
                        .join(copies, ["doc_id", "t"], "left_anti"), "asked")
    store.drop("units", "shared")
    found = store.write(named.join(asked, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).mapInArrow(
        _segment_rows(False), "doc_id long, t long, name long, s long, n long, h1 long, h2 long"), "segments")
    store.drop("asked")
    kinds = store.write(found.groupBy("name", "h1", "h2").agg(F.min(F.struct("doc_id", "s", "t")).alias("first"),
                                                              F.count("*").alias("rows")), "kinds")
    whole = found.join(kinds.where("rows > 1").select("name", "h1", "h2", "first"), ["name", "h1", "h2"]) \
        .where("doc_id > first.doc_id or (doc_id = first.doc_id and s > first.s)").select("doc_id", "t", "s", "n")
    whole = store.write(whole, "whole")
    groups = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    needed = store.write(kinds.join(groups, "name").select("name", "first.doc_id", "first.t", "first.s", "kinds"), "needed")
    lists = needed.groupBy("doc_id", "t").agg(F.collect_set("name").alias("names"), F.collect_set("s").alias("starts"))
    pieces = store.write(named.join(lists, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).mapInArrow(
        _segment_rows(True), "doc_id long, t long, name long, s long, n long, bytes binary"), "pieces")
    pieces = pieces.join(groups, "name")
    schema = "doc_id long, t long, s long, n long"
    merged = pieces.where(F.col("kinds") <= HOT_SEGMENTS).select("name", "doc_id", "t", "s", "bytes") \
        .repartition("name").sortWithinPartitions("name", "doc_id", "s").mapInArrow(_repeat_rows, schema)
    windows = pieces.where(F.col("kinds") > HOT_SEGMENTS).select("doc_id", "t", "s", "bytes") \
        .mapInArrow(_window_rows, "doc_id long, t long, s long, digest binary")
    first = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count("*").alias("c")).where("c > 1")
    single = windows.join(first, "digest").where(
        "doc_id > first.doc_id or (doc_id = first.doc_id and s > first.s)").select("doc_id", "t", "s", F.lit(1).cast("long").alias("n"))
    marks = whole.unionByName(merged).unionByName(single).groupBy("doc_id", "t").agg(
        F.collect_list(F.struct("s", "n")).alias("found"))
    marks = store.write(marks.join(copies, ["doc_id", "t"], "full_outer"), "marks")
    store.drop("segments", "kinds", "whole", "needed", "pieces")
    return src.join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "copy", "found").mapInArrow(
        _kept_rows, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
