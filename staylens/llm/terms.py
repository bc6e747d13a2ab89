"""Words of many texts at once: runs of member bytes, cut out of Arrow buffers by numpy.

Only A-Z are lower-cased.  Every byte from 0x80 on is a member, so a character of several
bytes is never cut.  A text longer than ``PIECE`` is read in pieces that end between words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import arrow_texts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True
PIECE = 8 << 20
BROADCAST_BYTES = 32 << 20


def runs(data: np.ndarray, off: np.ndarray, member: np.ndarray = LETTERS):
    """(bytes of all words, end to end; their offsets; text of each word; lower-cased data; start of each word).

    ``off`` are the borders of the texts in ``data``; starts count from ``off[0]``."""
    base = int(off[0])
    low = LOWER[data[base:int(off[-1])]]
    inside = member[low]
    first = np.asarray(off[:-1]) - base
    first = first[first < len(low)]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    head[first] = inside[first]
    start = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cut = first[first > 0] - 1
    tail[cut] = inside[cut]
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(tail) + 1 - start)])
    of = np.searchsorted(np.asarray(off[1:]) - base, start, "right")
    return low[inside], offsets, of, low, start


def as_binary(values: np.ndarray, offsets: np.ndarray):
    """Arrow binary array of the pieces of ``values`` between ``offsets``."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def binary_values(column):
    """(buffer, offsets) of an Arrow binary column without copying; nulls are not expected."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def spaced(values: np.ndarray, offsets: np.ndarray):
    """The pieces of ``values`` with a space after each, and their offsets."""
    size = np.diff(offsets)
    out = np.full(int(offsets[-1] - offsets[0]) + len(size), 0x20, np.uint8)
    new = offsets - offsets[0] + np.arange(len(offsets))
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = values[int(offsets[0]):int(offsets[-1])]
    return out, new


def parts(batch, column: str = "text", piece: int | None = None, rows: int = 4096):
    """(slice of the batch, buffer, offsets) of about ``piece`` bytes of text at most; one longer text stands alone."""
    piece = PIECE if piece is None else piece
    if not batch.num_rows:
        return
    data, off = arrow_texts(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(off, off[at] + piece, "right")) - 1), at + rows, n)
        yield batch.slice(at, end - at), data, off[at:end + 1]
        at = end


def word_pieces(data: np.ndarray, off: np.ndarray, member: np.ndarray, piece: int | None = None):
    """The texts themselves, or pieces of a single long one that end before a byte outside words."""
    piece = PIECE if piece is None else piece
    a, b = int(off[0]), int(off[-1])
    if len(off) > 2 or b - a <= 2 * piece:
        yield off
        return
    while a < b:
        end = min(a + piece, b)
        while end < b:
            gap = np.flatnonzero(~member[LOWER[data[end:min(end + piece, b)]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + piece, b)
        yield np.array([a, end])
        a = end


def counted(data: np.ndarray, off: np.ndarray, member: np.ndarray, piece: int | None = None):
    """(text, code, count) of the distinct words of each text, in that order, and the words by code (Arrow binary)."""
    import pyarrow as pa

    held = []
    for o in word_pieces(data, off, member, piece):
        values, offsets, of, _, _ = runs(data, o, member)
        words = as_binary(values, offsets).dictionary_encode()
        codes, names = np.asarray(words.indices).astype(np.int64), words.dictionary
        pair, n = np.unique(of * max(len(names), 1) + codes, return_counts=True)
        held.append((pair // max(len(names), 1), names, pair % max(len(names), 1), n))
    if len(held) == 1:
        of, names, code, n = held[0]
        return of, code, n, names
    joint = pa.concat_arrays([names.take(pa.array(code)) for _, names, code, _ in held]).dictionary_encode()
    code = np.asarray(joint.indices).astype(np.int64)             # pieces of one text
    n = np.bincount(code, np.concatenate([x[3] for x in held]), len(joint.dictionary)).astype(np.int64)
    return np.zeros(len(n), np.int64), np.arange(len(n)), n, joint.dictionary


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if all its values take at most ``limit`` bytes."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(0)) + 16
               for c, t in df.dtypes)
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
