"""Substring dedup by recompression.

A word is removed if it lies in a window of ``window`` words whose word sequence also
starts in a document with a smaller id.

Recompression rewrites every text in rounds.  A run round names each run of one symbol by
(symbol, length); a pair round puts every symbol on the left or the right side by a bit
of its name, and names each left symbol followed by a right one by the pair.  A name is a
64-bit fingerprint of what it stands for, so all tasks give equal strings equal names
without a shuffle of the dictionary.  With each symbol goes the stretch of words that
fixed it: any other text with those words has the same symbol there.  A window that
contains such a stretch can repeat only where the symbol repeats.

1. Every text is rewritten; each symbol whose stretch fits a window becomes a unit, named
   by the symbol and its stretch.  A window without any unit is a unit itself.
2. Spark counts which unit names occur in more than one text.
3. A window is a candidate if all units in it are shared.  Only texts with shared units
   are looked at again, and only their candidate windows are named by 128-bit hashes.
4. Spark finds the smallest document of each candidate window; windows of later documents
   are verified repeats, and their words go.

Later copies of a whole text repeat all their windows and skip steps 2 to 4.

Cases: a null text has no words; a text shorter than the window keeps all its words; rows
without an id keep their words and are no source; rows with one id are one document; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Stored, arrow_texts, inverse_powers, mix, prefix_hash, span_hash, word_hash, word_hashes

WINDOW = 50
ROUNDS = 7
RUN_ROUNDS = (0, 4)
FROZEN = 16              # symbols of so many words are not rewritten further
FAR = 1 << 60
U = np.uint64
_A, _B, _C = (mix(np.array([k], U))[0] | U(1) for k in (11, 12, 13))
_BASE2 = mix(np.array([14], U))[0] | U(1)
_INV2 = U(pow(int(_BASE2), -1, 1 << 64))


def words_of(data: np.ndarray, off: np.ndarray):
    """(start, end, hash of each word, first word of each text) where texts are split by one space."""
    base = int(off[0])
    cut = np.asarray(off[1:-1] - base)
    spaced = np.insert(data[base:int(off[-1])], cut, 0x20)
    s, e, h = word_hashes(spaced)
    first = np.searchsorted(s, np.concatenate([off[:-1] - base + np.arange(len(off) - 1), [len(spaced) + 1]]))
    return spaced, s, e, h, first


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Symbols after all rounds: (name, first word, end word, start and end of the stretch, text number)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.int32)
    n = len(h)
    name, start, end = h, np.arange(n), np.arange(1, n + 1)
    lo, hi = start, end
    for r in range(rounds):
        if len(name) < 2:
            break
        if r in RUN_ROUNDS:
            joint = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]) & ((end - start)[1:] < FROZEN)
            left, right = _neighbours(doc, lo, hi)
            head = np.flatnonzero(np.concatenate([[True], ~joint]))
            tail = np.concatenate([head[1:] - 1, [len(name) - 1]])
            size = (tail - head + 1).astype(U)
            name = np.where(size > 1, mix(name[head] * _A + size), name[head])
            start, end, doc, lo, hi = start[head], end[tail], doc[head], left[head], right[tail]
        bits = mix(name + mix(np.array([100 + r], U))) & U(1)
        free = (end - start) < FROZEN
        is_left, is_right = free & (bits == 1), free & (bits == 0)
        left, right = _neighbours(doc, lo, hi)
        merge = is_left[:-1] & is_right[1:] & (doc[1:] == doc[:-1])
        merged = np.concatenate([merge, [False]])
        taken = np.concatenate([[False], merge])
        lo = np.where(is_right & ~taken, left, lo)
        hi = np.where(is_left & ~merged, right, hi)
        keep = np.flatnonzero(~taken)
        pair = merged[keep]
        nxt = np.minimum(keep + 1, len(name) - 1)
        name = np.where(pair, mix(name[keep] * _A + name[nxt] * _B + U(r)), name[keep])
        end, hi = np.where(pair, end[nxt], end[keep]), np.where(pair, hi[nxt], hi[keep])
        start, lo, doc = start[keep], lo[keep], doc[keep]
    return name, start, end, lo, hi, doc


def _neighbours(doc, lo, hi):
    """Start of the stretch of the symbol before, end of that of the symbol after; beyond a text's ends: far."""
    left, right = np.full(len(doc), -FAR), np.full(len(doc), FAR)
    same = doc[1:] == doc[:-1]
    left[1:][same] = lo[:-1][same]
    right[:-1][same] = hi[1:][same]
    return left, right


def units(h: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """(name, first and last window, text number) of every unit, in text order; windows are counted
    over the words of all texts."""
    total, inv = prefix_hash(h), inverse_powers(len(h))
    name, _, _, lo, hi, doc = recompress(h, first)
    begin, stop = first[:-1][doc], first[1:][doc]
    ok = (hi - lo <= window) & (lo >= begin) & (hi <= stop) & (stop - begin >= window)
    name, lo, hi, doc, begin, stop = (x[ok] for x in (name, lo, hi, doc, begin, stop))
    a, b = np.maximum(hi - window, begin), np.minimum(lo, stop - window)
    fits = a <= b
    name, lo, hi, doc, a, b = (x[fits] for x in (name, lo, hi, doc, a, b))
    name = mix(name * _A + span_hash(total, lo, hi, inv) * _B)
    # windows that contain no unit are units themselves
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, a, 1)
    np.add.at(cover, b + 1, -1)
    bare = np.flatnonzero((np.cumsum(cover[:-1]) == 0) & window_starts(first, window, len(h)))
    if len(bare):
        of = (np.searchsorted(first, bare, "right") - 1).astype(np.int32)
        name = np.concatenate([name, mix(span_hash(total, bare, bare + window, inv) * _C)])
        doc, a, b = np.concatenate([doc, of]), np.concatenate([a, bare]), np.concatenate([b, bare])
        order = np.lexsort((b, a, doc))
        name, doc, a, b = name[order], doc[order], a[order], b[order]
    return name, a, b, doc


def window_starts(first, window, n):
    """Which words begin a whole window of their text."""
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(first)
    long = size >= window
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - window + 1, -1)
    return np.cumsum(ok[:n]) > 0


def _unit_rows(batches):
    import pyarrow as pa

    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            _, _, _, h, first = words_of(*arrow_texts(part.column("text")))
            name, _, _, doc = units(h, first)
            if not len(name):
                continue
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            new, order = _equal_runs(doc, name)
            take = pa.array(doc[order][new])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("t").take(take), _lists(place[order], new),
                 pa.array(name[order][new].view(np.int64))], names=["doc_id", "t", "k", "name"])


def _equal_runs(*keys):
    """(starts of runs of equal keys, order that sorts by them)."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order) - 1, bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1]), order


def _lists(values, starts):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)),
                                    pa.array(values.astype(np.int32)))


def _candidate_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            spaced, begin, stop, h, first = words_of(*arrow_texts(part.column("text")))
            _, a, b, doc = units(h, first)
            fresh = np.ones(len(doc), bool)
            at = np.searchsorted(doc, np.arange(part.num_rows))
            for i, shared in enumerate(part.column("shared").to_pylist()):
                fresh[at[i] + np.array(shared, np.int64)] = False
            spoiled = np.zeros(len(h) + 1, np.int64)
            np.add.at(spoiled, a[fresh], 1)
            np.add.at(spoiled, b[fresh] + 1, -1)
            s = np.flatnonzero((np.cumsum(spoiled[:-1]) == 0) & window_starts(first, WINDOW, len(h)))
            if not len(s):
                continue
            of = np.searchsorted(first, s, "right") - 1
            h1 = span_hash(prefix_hash(h), s, s + WINDOW, inverse_powers(len(h)))
            g = word_hash(spaced, begin, stop, 1)        # independent of the first
            h2 = span_hash(prefix_hash(g, _BASE2), s, s + WINDOW, inverse_powers(len(g), _INV2))
            new, order = _equal_runs(of, h1, h2)         # a window that recurs in its text is one row
            take = pa.array(of[order][new])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("t").take(take), _lists((s - first[of])[order], new),
                 pa.array(h1[order][new].view(np.int64)), pa.array(h2[order][new].view(np.int64))],
                names=["doc_id", "t", "s", "h1", "h2"])


def _kept_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            spaced, s, e, _, first = words_of(*arrow_texts(part.column("text")))
            n = np.diff(first)
            gone = np.zeros(len(s) + 1, np.int64)
            for i, (copy, found) in enumerate(zip(part.column("copy").to_pylist(), part.column("found").to_pylist())):
                if copy and n[i] >= WINDOW:
                    gone[first[i]] += 1
                    gone[first[i + 1]] -= 1
                elif found:
                    at = first[i] + np.array(found, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
            gone = np.cumsum(gone[:-1]) > 0
            raw = spaced.tobytes()
            texts, removed = [], []
            for i in range(part.num_rows):
                keep = first[i] + np.flatnonzero(~gone[first[i]:first[i + 1]])
                removed.append(int(n[i] - len(keep)))
                texts.append(b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())]).decode(
                    "utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, store: Stored, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .withColumn("t", F.xxhash64("text"))
    named = src.where("doc_id is not null")
    digests = named.select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("digest"))
    copies = store.write(digests.join(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
                                      .where("n > 1"), "digest")
                         .where("rep < doc_id").select("doc_id", "t", F.lit(True).alias("copy")).distinct(), "copies")
    rows = store.write(named.mapInArrow(_unit_rows, "doc_id long, t long, k array<int>, name long"), "units")
    shared = store.write(rows.groupBy("name").agg(F.min("t").alias("a"), F.max("t").alias("b"))
                         .where("a <> b").select("name"), "shared")
    per_text = store.write(rows.join(shared, "name").groupBy("doc_id", "t").agg(F.flatten(F.collect_list("k")).alias("shared"))
                           .join(copies, ["doc_id", "t"], "left_anti"), "per_text")
    store.drop("units", "shared")
    windows = store.write(named.join(per_text, ["doc_id", "t"]).mapInArrow(
        _candidate_rows, "doc_id long, t long, s array<int>, h1 long, h2 long"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")) \
        .where("low < high").select("h1", "h2", "low")
    found = store.write(windows.join(first, ["h1", "h2"]).where("low < doc_id")
                        .groupBy("doc_id", "t").agg(F.flatten(F.collect_list("s")).alias("found")), "found")
    store.drop("windows", "per_text")
    marks = found.join(copies, ["doc_id", "t"], "full_outer")
    return src.join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "copy", "found") \
        .mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept_text string")
