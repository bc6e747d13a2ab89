"""Packing by vector bin packing with the dot-product heuristic.

Every example has three demands: tokens, segments (one for each piece) and
loss-bearing tokens; every sequence limits all three at once.  Each task keeps
a bounded pool of waiting examples.  The open sequence takes, among those that
fit, the example whose demand vector has the largest dot product with what
the sequence has left (both as shares of the limits).  When none fits, the
example with the largest product is cut to fill what is left, if cutting is
allowed; otherwise the sequence closes.  Tasks pack on their own, so there is
no shuffle and memory is the pool.

What is left when a task's input ends is cut into sequences whose lengths are
powers of two (which need no padding).

Cases: a null text is empty and has its end id alone; an empty table gives no
piece; repeated rows are packed each on their own; a null id stays null;
other columns are ignored; an example beyond a limit is cut (or, uncut,
raises ValueError, as it fits nowhere).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import gives_back
from staylens.llm.tokens import encode_batches

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 256
POOL_EXAMPLES = 2048
POOL_TOKENS = 4_000_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, segment long, sequence_tokens long, loss_tokens long")


class Packer:
    """Places examples offered one by one; ``done`` collects closed sequences as
    lists of (example, start, length, loss)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool = True):
        self.caps = np.asarray(limits, float)
        self.cut = cut
        self.at: dict[int, int] = {}               # waiting example -> first id not yet placed
        self.totals: dict[int, np.ndarray] = {}    # example -> prefix sums of its loss-bearing ids
        self.need = np.zeros((0, 3))
        self.ramp = np.arange(1)                   # prefix sums where every id bears loss
        self.keys: list[int] = []
        self.closed: list[list[tuple]] = []
        self._open()

    def _open(self):
        self.bin, self.left = [], self.caps.copy()

    def _close(self):
        if self.bin:
            self.closed.append(self.bin)
        self._open()

    def offer(self, key: int, loss: np.ndarray | int) -> None:
        """``loss`` has a 0/1 for each token, or is the number of tokens that all bear loss."""
        if isinstance(loss, int):
            n = loss
            if n >= len(self.ramp):
                self.ramp = np.arange(2 * n + 1)
            total = self.ramp[:n + 1]
        else:
            n = len(loss)
            total = np.concatenate([[0], np.cumsum(loss)])
        at = 0
        tokens = int(self.caps[0])
        if self.cut:
            while n - at >= tokens and total[at + tokens] - total[at] <= self.caps[2]:
                self.closed.append([(key, at, tokens, int(total[at + tokens] - total[at]))])
                at += tokens
        elif n > tokens or total[-1] > self.caps[2]:
            raise ValueError(f"an example of {n} tokens does not fit a sequence")
        if n > at:
            self.at[key], self.totals[key] = at, total
            self.keys.append(key)
            self.need = np.vstack([self.need, [[n - at, 1, total[n] - total[at]]]])

    def _place(self, i: int, length: int) -> None:
        key = self.keys[i]
        at, total = self.at[key], self.totals[key]
        loss = int(total[at + length] - total[at])
        self.bin.append((key, at, length, loss))
        self.left -= (length, 1, loss)
        self.at[key] = at + length
        self.need[i] = (self.need[i, 0] - length, 1, self.need[i, 2] - loss)

    def pack(self, down_to: int) -> None:
        """Place examples until at most ``down_to`` wait."""
        alive = np.ones(len(self.keys), bool)
        live = len(self.keys)
        share = self.need / self.caps
        tokens, segments, loss = (self.need[:, k].copy() for k in range(3))     # tokens: infinite once placed
        while live > down_to:
            if self.left[0] < 1 or self.left[1] < 1:
                self._close()
            gain = share @ (self.left / self.caps)
            fits = np.where((tokens <= self.left[0]) & (segments <= self.left[1]) & (loss <= self.left[2]), gain, -1)
            i = int(fits.argmax())
            if fits[i] >= 0:
                self._place(i, int(self.need[i, 0]))
                alive[i], tokens[i] = False, np.inf
                live -= 1
                continue
            gain[~alive] = -1
            i = int(gain.argmax())
            at, total = self.at[self.keys[i]], self.totals[self.keys[i]]
            # the longest prefix within the tokens and the loss-bearing tokens left
            most = int(np.searchsorted(total, total[at] + self.left[2], "right")) - 1 - at
            length = min(int(self.left[0]), most, int(self.need[i, 0]))
            if self.cut and length > 0:
                self._place(i, length)
                tokens[i], segments[i], loss[i] = self.need[i]
                share[i] = self.need[i] / self.caps
                if self.need[i, 0] == 0:
                    alive[i], tokens[i] = False, np.inf
                    live -= 1
            self._close()
        keep = np.flatnonzero(alive)
        self.need, self.keys = self.need[keep], [self.keys[i] for i in keep]

    def forget(self, key: int) -> None:
        """All pieces of the example are out."""
        self.at.pop(key, None)
        self.totals.pop(key, None)

    def finish(self) -> None:
        """Pack all that waits; cut the last open sequence into powers of two."""
        self.pack(0)
        rest, self.bin = self.bin, []
        if not self.cut:
            if rest:
                self.closed.append(rest)
            return
        room = 0
        todo = sum(p[2] for p in rest)
        for key, at, length, _ in rest:
            total = self.totals[key]
            while length:
                if not room:
                    room = 1 << (todo.bit_length() - 1)
                    self.closed.append([])
                n = min(length, room)
                self.closed[-1].append((key, at, n, int(total[at + n] - total[at])))
                at, length, room, todo = at + n, length - n, room - n, todo - n


def pack_batches(examples: Iterator[tuple], limits, cut: bool = True):
    """``examples`` yields (id, token ids, loss 0/1 per token or None: all bear loss).  Yields one list of
    pieces (id, start, length, crc32, tokens, sequence, offset, segment, sequence
    tokens, loss tokens) at a time."""
    packer = Packer(limits, cut)
    held: dict[int, tuple] = {}
    sequence = waiting = 0

    def closed():
        nonlocal sequence
        rows = []
        for pieces in packer.closed:
            offset, used = 0, sum(p[2] for p in pieces)
            for segment, (key, at, n, loss) in enumerate(pieces):
                doc, ids = held[key]
                crc = zlib.crc32(ids[at:at + n].astype("<u4").tobytes())
                rows.append((doc, at, n, crc, len(ids), sequence, offset, segment, used, loss))
                offset += n
            sequence += 1
        packer.closed = []
        still = set(packer.keys) | {p[0] for p in packer.bin}
        for key in list(held):
            if key not in still:
                del held[key]
                packer.forget(key)
        return rows

    for number, (doc, ids, loss) in enumerate(examples):
        held[number] = (doc, ids)
        packer.offer(number, len(ids) if loss is None else loss)
        waiting += len(ids)
        if len(packer.keys) >= POOL_EXAMPLES or waiting >= POOL_TOKENS:
            packer.pack(len(packer.keys) // 2)
            waiting = int(packer.need[:, 0].sum())
            yield closed()
    packer.finish()
    yield closed()


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE_TOKENS,
                   segments: int = MAX_SEGMENTS, loss_tokens: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts: every id of every text (and its end id) lies in one piece.

    In plain text every id bears loss, so ``loss_tokens`` defaults to ``tokens``.
    ``sequence_id`` is the task's number and the sequence's within it.
    """
    limits = (tokens, segments, loss_tokens or tokens)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def examples():
            for part, ids in encode_batches(batches, tokenizer):
                for doc, x in zip(part.column("doc_id").to_pylist(), ids):
                    yield doc, x, None

        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        for rows in pack_batches(examples(), limits):
            if rows:
                cols = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
                cols[5] = pa.array(np.asarray(cols[5]) + base)
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(gives_back(run), PIECES)


def pack_examples(examples: DataFrame, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS,
                  loss_tokens: int | None = None, cut: bool = True) -> DataFrame:
    """Instruction data: ``examples`` has doc_id, ids array<int> and loss array<int> (0/1 for
    each id; null: all bear loss)."""
    limits = (tokens, segments, loss_tokens or tokens)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def rows_in():
            for b in batches:
                for doc, ids, loss in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "loss"))):
                    x = np.asarray(ids or [], np.uint32)
                    yield doc, x, None if loss is None else np.asarray(loss, np.int8)

        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        for rows in pack_batches(rows_in(), limits, cut):
            if rows:
                cols = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
                cols[5] = pa.array(np.asarray(cols[5]) + base)
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    src = examples.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"),
                          F.col("loss").cast("array<int>"))
    return src.mapInArrow(run, PIECES)
