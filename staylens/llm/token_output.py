"""Token-id files coded by a static range asymmetric numeral system (rANS).

``write_tokens`` sorts documents by id across range partitions, encodes them
with a tokenizers file, counts every id over the whole corpus, and turns the
counts into one shared table of frequencies (sum 2**20).  Ids are then coded
in independent blocks of whole documents: ``LANES`` interleaved 64-bit states
advance together, each giving 32-bit words.

The format is a folder of two Parquet tables:

* ``freq``: symbol, freq (the shared table);
* ``blocks``: start (ids before the block), n_tokens, lanes, doc_ids and
  doc_tokens (little-endian int64), states (uint64: the lanes' states at each
  checkpoint), word_at (first payload word after each checkpoint), payload
  (uint32 words), payload_crc32, ids_crc32.

A reader needs the shared table and one block; within a block each checkpoint
opens a segment of ``CHECK_STEPS`` steps that decodes alone.

Cases: null text is empty (its end id alone); null ids sort first; equal ids
are ordered by text; an empty table gives empty files and no row; other
columns are ignored.  A block never ends inside a document, so a very long
text makes a longer block.  A damaged block raises ValueError when read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import Stored, gives_back
from staylens.llm.tokens import encode_batches

SCALE = 20
LANES = 1024
CHECK_STEPS = 128
BLOCK_TOKENS = 1 << 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

BLOCKS = ("start long, n_tokens long, lanes int, doc_ids binary, doc_nulls binary, doc_tokens binary, "
          "states binary, word_at array<long>, payload binary, payload_crc32 long, ids_crc32 long")


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum 2**scale, at least 1 wherever a count is positive."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    present = counts > 0
    if present.sum() > room:
        raise ValueError(f"more than {room} symbols")
    freq = np.where(present, np.maximum(1, (counts.astype(float) * room / total).astype(np.int64)), 0)
    rest = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest >= 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(int(freq[i]) - 1, -rest)
        freq[i] -= take
        rest += take
    return freq


class Coder:
    """Codes and decodes blocks under one shared table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        size = int(symbols.max()) + 1 if len(symbols) else 0
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = freq
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if size else self.freq
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECK_STEPS):
        """(states at the checkpoints, first word of each segment, words)."""
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words, states = [], []
        low = np.uint64((1 << 32) - 1)
        shift, top = np.uint64(SCALE), np.uint64(63 - SCALE)
        for t in range(steps - 1, -1, -1):
            sym = ids[t * lanes:(t + 1) * lanes]
            f, c, y = self.freq[sym], self.cum[sym], x[:len(sym)]
            over = y >= (f << top)
            words.append((y[over] & low).astype(np.uint32))
            y = np.where(over, y >> WORD, y)
            q = y // f
            x[:len(sym)] = (q << shift) + (y - q * f) + c
            if t % every == 0:
                states.append(x.copy())
        words.reverse()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return (np.array(states[::-1], np.uint64).reshape(-1, lanes), at[:-1][::every].tolist(),
                np.concatenate(words) if words else np.zeros(0, np.uint32))

    def decode(self, n: int, states: np.ndarray, word_at, words: np.ndarray, segment: int | None = None,
               every: int = CHECK_STEPS) -> np.ndarray:
        """All ids of a block, or those of one segment."""
        lanes = states.shape[1]
        steps = -(-n // lanes)
        which = range(len(states)) if segment is None else [segment]
        out = []
        shift, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
        for s in which:
            x, at = states[s].copy(), word_at[s]
            for t in range(s * every, min((s + 1) * every, steps)):
                k = min(lanes, n - t * lanes)
                y = x[:k]
                slot = y & mask
                sym = self.symbol[slot]
                out.append(sym)
                y = self.freq[sym] * (y >> shift) + slot - self.cum[sym]
                need = np.flatnonzero(y < LOW)
                y[need] = (y[need] << WORD) | words[at:at + len(need)]
                at += len(need)
                x[:k] = y
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _token_rows(tokenizer: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for rows, ids in encode_batches(batches, tokenizer):
            n = np.array([len(x) for x in ids], np.int64)
            start = at + np.concatenate([[0], np.cumsum(n)[:-1]])
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(start.astype(np.int64)),
                 pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                names=["doc_id", "part", "at", "n", "ids"])
    return run


def _count(batches):
    import pyarrow as pa

    counts = np.zeros(0, np.int64)
    for b in batches:
        for k in range(0, b.num_rows, 256):               # many texts at once: a count is as long as the vocabulary
            c = np.bincount(np.frombuffer(b"".join(b.column(0).slice(k, 256).to_pylist()), "<u4"))
            if len(c) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(c) - len(counts), np.int64)])
            counts[:len(c)] += c
    sym = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(sym), pa.array(counts[sym])], names=["symbol", "count"])


def _block_rows(symbols, freq, base: dict, block_tokens: int):
    def run(batches):
        import pyarrow as pa

        coder = Coder(symbols, freq)
        open_rows, size, expect = [], 0, None

        def block():
            doc, start = [r[0] for r in open_rows], open_rows[0][1]
            ids = np.concatenate([r[2] for r in open_rows])
            states, word_at, words = coder.encode(ids)
            payload = words.astype("<u4").tobytes()
            null = np.array([d is None for d in doc], np.int8)
            return pa.RecordBatch.from_arrays([
                pa.array([start]), pa.array([len(ids)]), pa.array([LANES], pa.int32()),
                pa.array([np.array([d or 0 for d in doc], "<i8").tobytes()], pa.binary()),
                pa.array([null.tobytes()], pa.binary()),
                pa.array([np.array([len(r[2]) for r in open_rows], "<i8").tobytes()], pa.binary()),
                pa.array([states.astype("<u8").tobytes()], pa.binary()),
                pa.array([word_at], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                pa.array([zlib.crc32(payload)]), pa.array([zlib.crc32(ids.astype("<u4").tobytes())]),
            ], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for doc, part, at, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "at", "n", "ids"))):
                start = base[part] + at
                if open_rows and (start != expect or size >= block_tokens):
                    yield block()
                    open_rows, size = [], 0
                open_rows.append((doc, start, np.frombuffer(raw, "<u4")))
                size, expect = size + n, start + n
        if open_rows:
            yield block()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, store: Stored, block_tokens: int = BLOCK_TOKENS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with the end id, in ascending id order."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # whole texts move once, to range partitions that equal ids cannot pile up in
    src = src.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    tokens = store.write(src.mapInArrow(gives_back(_token_rows(tokenizer)), "doc_id long, part long, at long, n long, ids binary"),
                         "tokens")
    counts = (tokens.select("ids").mapInArrow(_count, "symbol long, count long")
              .groupBy("symbol").agg(F.sum("count").alias("count")).orderBy("symbol").toPandas())  # one row a symbol
    freq = quantise(counts["count"].to_numpy(np.int64))
    sizes = tokens.groupBy("part").agg(F.sum("n")).orderBy("part").collect()  # one row a partition
    base, at = {}, 0
    for part, n in sizes:
        base[part], at = at, at + n
    symbols = counts["symbol"].to_numpy(np.int64)
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(symbols, freq)], "symbol long, freq long") \
        .coalesce(1).write.parquet(f"{path}/freq")
    tokens.mapInArrow(_block_rows(symbols, freq, base, block_tokens), BLOCKS) \
        .write.option("compression", "none").parquet(f"{path}/blocks")
    store.drop("tokens")


def _decode_rows(symbols, freq):
    def run(batches):
        import pyarrow as pa

        coder = Coder(symbols, freq)
        for b in batches:
            for r in b.to_pylist():
                if zlib.crc32(r["payload"]) != r["payload_crc32"]:
                    raise ValueError(f"the payload of the block at {r['start']} is damaged")
                states = np.frombuffer(r["states"], "<u8").reshape(-1, r["lanes"])
                ids = coder.decode(r["n_tokens"], states, r["word_at"], np.frombuffer(r["payload"], "<u4"))
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["ids_crc32"]:
                    raise ValueError(f"the ids of the block at {r['start']} are damaged")
                n = np.frombuffer(r["doc_tokens"], "<i8")
                end = np.cumsum(n)
                null = np.frombuffer(r["doc_nulls"], np.int8).astype(bool)
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null)
                for k in range(0, len(n), 512):
                    e, m = end[k:k + 512], n[k:k + 512]
                    yield pa.RecordBatch.from_arrays([
                        doc.slice(k, 512), pa.array(r["start"] + e - m), pa.array(m),
                        pa.array([raw[4 * (y - z):4 * y] for y, z in zip(e.tolist(), m.tolist())], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document in the files."""
    table = spark.read.schema("symbol long, freq long").parquet(f"{path}/freq").orderBy("symbol").toPandas()
    run = _decode_rows(table["symbol"].to_numpy(np.int64), table["freq"].to_numpy(np.int64))
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
