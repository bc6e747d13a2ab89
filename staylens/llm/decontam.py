"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased, and every run of signs other than letters and
digits becomes one space.  An item of m characters is found in a text if some stretch of
the text is within k = ``EDIT_SHARE`` * m edits of it.  Such a stretch shares at least
(m + 1 - q) - k * q of the item's q-grams, and they lie on at most 2k + 1 neighbouring
diagonals (text position less item position).  Shared q-grams are counted in overlapping
bands of 2 * (2k + 1) diagonals; bands that reach the bound are verified by alignment
within the band on the real characters.  An item too short for a positive bound gets as many
edits as leave one q-gram; one shorter than q must be contained as it stands, as whole words.

The benchmark goes to all tasks while it has at most ``SLICE_CHARS`` characters; a larger
one is cut into slices by item, and the documents are read once for each slice.

Cases: null texts and items are empty; an empty item is never found; empty tables give no
row; repeated rows are reported each; of the stretches of one item in one document the one
with the fewest edits, then the first, is reported; a null doc_id or item_id stays null;
other columns are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Stored, gives_back, small_parts

Q = 8
EDIT_SHARE = 0.1
SLICE_CHARS = 8_000_000
ALIGN_CELLS = 1 << 16       # characters that one step of the alignment holds
_TABLE_BITS = 22
_SALT = np.uint64(0x9E3779B97F4A7C15)


def normal(col):
    """Lower case, with one space for each run of signs."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def budget(m: int, q: int = Q, share: float = EDIT_SHARE) -> tuple[int, int]:
    """(edits, least shared q-grams) of an item of m >= q characters."""
    k = min(int(m * share), (m - q) // q)
    return k, m + 1 - q - k * q


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """The 8 characters from each position on, folded to a byte each, as one integer."""
    b = (chars ^ (chars >> np.uint32(8)) * np.uint32(37)).astype(np.uint8).astype(np.uint64)
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def _best_ends(jobs: list[tuple], anywhere: bool) -> list:
    """For each job (item, text, low, high, most) the (fewest edits, end) of the item against a stretch of the
    text on the diagonals low..high that starts anywhere, or at the text's first character; None beyond
    ``most``.  Jobs are aligned side by side, those of like size together."""
    out: list = [None] * len(jobs)
    size = [(high - low + 1, len(item)) for item, _, low, high, _ in jobs]
    order = sorted(range(len(jobs)), key=size.__getitem__)
    while order:
        n = cells = 0                                         # the next jobs that fit ALIGN_CELLS, or one
        while n < len(order) and (not n or (n + 1) * (size[order[n]][0] + max(cells, size[order[n]][1])) <= ALIGN_CELLS):
            cells = max(cells, size[order[n]][1])
            n += 1
        now, order = order[:n], order[n:]
        for j, found in zip(now, _side_by_side([jobs[j] for j in now], anywhere)):
            out[j] = found
    return out


def _side_by_side(jobs: list[tuple], anywhere: bool) -> list:
    """``_best_ends`` of some jobs: a column for each, a row for each diagonal."""
    out: list = [None] * len(jobs)
    length = np.array([len(j[0]) for j in jobs])
    low, wide = np.array([j[2] for j in jobs]), np.array([j[3] - j[2] + 1 for j in jobs])
    most, chars = np.array([j[4] for j in jobs], np.int32), np.array([len(j[1]) for j in jobs])
    width, rows = int(wide.max()), int(length.max())
    items = np.zeros((len(jobs), rows), np.uint32)
    pad = np.full((len(jobs), width + rows), np.uint32(0xFFFFFFFF))
    for c, (item, text, first, high, _) in enumerate(jobs):
        items[c, :len(item)] = item
        a, b = max(0, first), min(len(text), high + len(item))
        if b > a:
            pad[c, a - first:b - first] = text[a:b]
    items, pad = np.ascontiguousarray(items.T), np.ascontiguousarray(pad.T)
    where = np.arange(width, dtype=np.int32)[:, None]
    far = np.int32(1 << 29)
    wall = np.where(where < wide, np.int32(0), far)           # beyond a narrower job's diagonals
    at = where + low
    cost = np.where((at >= 0) & (at <= chars), 0 if anywhere else at, most + 1).astype(np.int32)
    np.maximum(cost, wall, out=cost)
    col = np.arange(len(jobs))                                # the jobs still under way
    for i in range(rows):
        stay = cost + (pad[i:i + width] != items[i])          # same diagonal: match or exchange
        np.minimum(stay[:-1], cost[1:] + 1, out=stay[:-1])    # item character without a partner
        stay -= where
        cost = np.minimum.accumulate(stay, axis=0)            # text characters without a partner
        cost += where
        np.maximum(cost, wall, out=cost)
        ends = length[col] == i + 1
        if i % 16 == 15 or ends.any():
            for c in np.flatnonzero(ends).tolist():
                j = col[c]
                end = where[:, 0] + low[j] + length[j]
                last = np.where((end >= 0) & (end <= chars[j]), cost[:, c], most[j] + 1)
                best = int(last.argmin())
                if last[best] <= most[j]:
                    out[j] = int(last[best]), int(end[best])
            on = ~ends & (cost.min(axis=0) <= most[col])
            if not on.all():
                col = col[on]
                if not len(col):
                    break
                cost, wall, pad, items = (np.ascontiguousarray(x[:, on]) for x in (cost, wall, pad, items))
    return out


def aligns(jobs: list[tuple]) -> list:
    """For each job (item, text, low, high, most) the fewest edits between the item and a stretch of the text
    on the diagonals low..high: (edits, start, end), or None beyond ``most``."""
    out: list = [None] * len(jobs)
    found = [(j, *x) for j, x in enumerate(_best_ends(jobs, True)) if x is not None]
    back = _best_ends([(jobs[j][0][::-1], jobs[j][1][:end][::-1], -edits, edits, edits) for j, edits, end in found],
                      False)                                  # from the end, anchored
    for (j, edits, end), x in zip(found, back):
        out[j] = edits, end - x[1], end
    return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int):
    """``aligns`` of one job."""
    return aligns([(item, text, low, high, most)])[0]


class Index:
    """q-grams of a slice of the benchmark: different codes in order, each with its run of items and places."""

    def __init__(self, items: list[str]):
        self.items = [points(t) for t in items]
        self.short = [i for i, t in enumerate(items) if 0 < len(self.items[i]) < Q]
        self.texts = items
        long = [i for i in range(len(items)) if len(self.items[i]) >= Q]
        code = [grams(self.items[i]) for i in long]
        self.code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        self.item = np.repeat(np.array(long, np.int64), [len(c) for c in code])
        self.place = np.concatenate([np.arange(len(c)) for c in code]) if code else np.zeros(0, np.int64)
        order = np.argsort(self.code, kind="stable")
        self.code, self.item, self.place = self.code[order], self.item[order], self.place[order]
        self.code, self.first, self.count = np.unique(self.code, return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.code)] = True
        both = [budget(len(t)) if len(t) >= Q else (0, 1) for t in self.items]
        self.edits = np.array([b[0] for b in both], np.int64)
        self.least = np.array([b[1] for b in both], np.int64)

    @staticmethod
    def _slot(code):
        return ((code * _SALT) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def hits(self, texts: list[str]):
        """(text, item, edits, start, end) of every item found in each text."""
        out = [(d, i, 0, at - 1, at - 1 + len(self.items[i])) for d, t in enumerate(texts) for i in self.short
               for at in [(" " + t + " ").find(" " + self.texts[i] + " ") + 1] if at]
        chars = points("\n".join(texts))
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size + 1) - size - 1
        code = grams(chars)
        maybe = np.flatnonzero(self.table[self._slot(code)]) if len(self.code) else np.zeros(0, np.int64)
        known = np.searchsorted(self.code, code[maybe])
        known[known == len(self.code)] = 0
        true = np.flatnonzero(self.code[known] == code[maybe]) if len(maybe) else maybe
        if not len(true):
            return out
        maybe, known = maybe[true], known[true]
        n = self.count[known]
        stop = np.cumsum(n)
        at = np.arange(int(stop[-1])) + np.repeat(self.first[known] - (stop - n), n)
        pos, item = np.repeat(maybe, n), self.item[at]
        doc = np.searchsorted(first, pos, "right") - 1
        # the bound must hold for the whole text before it can hold for a band
        both = doc * len(self.items) + item
        enough = np.bincount(both, minlength=len(texts) * len(self.items))[both] >= self.least[item]
        pos, item, doc, at = pos[enough], item[enough], doc[enough], at[enough]
        if not len(pos):
            return out
        width = 2 * self.edits[item] + 1
        band = (pos - self.place[at]) // width
        # a band covers two widths, so that every width of diagonals lies in one
        key_doc, key_item = np.concatenate([doc, doc]), np.concatenate([item, item])
        key_band = np.concatenate([band, band - 1])
        order = np.lexsort((key_band, key_item, key_doc))
        key_doc, key_item, key_band = key_doc[order], key_item[order], key_band[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key_doc) != 0) | (np.diff(key_item) != 0)
                                             | (np.diff(key_band) != 0)]))
        count = np.diff(np.append(new, len(key_doc)))
        good = new[count >= self.least[key_item[new]]]
        jobs = []
        pairs = list(zip(key_doc[good].tolist(), key_item[good].tolist()))
        for (d, i), w in zip(pairs, key_band[good].tolist()):
            k = int(self.edits[i])
            low = int(w * (2 * k + 1) - first[d] - k)
            jobs.append((self.items[i], chars[first[d]:first[d] + size[d]], low, low + 2 * (2 * k + 1) + 2 * k, k))
        best: dict[tuple, tuple] = {}
        for pair, found in zip(pairs, aligns(jobs)):
            if found and (pair not in best or found < best[pair]):
                best[pair] = found
        return out + [(d, i, *x) for (d, i), x in best.items()]


def find(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
         item_text="text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end (in the normalised text) of every item in every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), normal(item_text).alias("text")).where("text <> ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_chars))
    out = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()   # at most about a slice
        found = src.mapInArrow(gives_back(_search([r["text"] for r in part], [r["item_id"] for r in part])),
                               "doc_id long, item_id long, edits long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def _search(texts: list[str], ids: list):
    def run(batches):
        import pyarrow as pa

        index = Index(texts)
        for b in batches:
            for part in small_parts(b, "text", 128):
                rows = index.hits(part.column(1).to_pylist())
                if rows:
                    doc = part.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc[r[0]] for r in rows], pa.int64()), pa.array([ids[r[1]] for r in rows], pa.int64()),
                         *(pa.array([int(r[c]) for r in rows], pa.int64()) for c in (2, 3, 4))],
                        names=["doc_id", "item_id", "edits", "start", "end"])
    return run


def remove(docs: DataFrame, benchmark: DataFrame, store: Stored | None = None) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found, with all their columns."""
    store = store or Stored(docs.sparkSession, "leaked")
    leaked = store.write(find(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
