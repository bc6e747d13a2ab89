"""Helpers shared by the text operators: inputs, stored intermediate tables, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder only where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) \
        or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="staylens-llm-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _size(setting: str) -> int:
    digits = setting.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits.rstrip("kmg")) << unit


class Stored:
    """Intermediate tables of one operator call, under the shared folder.

    ``write`` cuts lineage by writing Parquet and reading it back; ``drop``
    deletes a table that no later step reads.  Files that the returned frame
    still reads are left for the owner of the shared folder to clean.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
        if _size(spark.conf.get(_BATCH, "64m")) > BATCH_BYTES:      # whole texts: keep Python's batches small
            spark.conf.set(_BATCH, str(BATCH_BYTES))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        del df
        release_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now rather
    than at some later collection of the driver's heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit("")).cast("string")


# --- hashing of words and windows -------------------------------------------

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_BASE = U(0x9FB21C651E98DF25 | 1)
_WORD_SPACE = np.zeros(256, bool)
_WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _MULT)


def powers(n: int, base=_BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.ones(n + 1, U)
    if n:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out



def prefix_hash(values: np.ndarray, base=_BASE) -> np.ndarray:
    """H with H[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), base)[:-1], out=out[1:])
    return out


def _inverse(base=_BASE) -> np.ndarray:
    return U(pow(int(base), -1, 1 << 64))


_INV = _inverse()


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Position-free hash of the spans [start, end); ``inv`` are the powers of the inverse base."""
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U) * _MULT)


def inverse_powers(n: int, inv=_INV) -> np.ndarray:
    return powers(n, inv)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and 0x09-0x0D."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z
    word = ~_WORD_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the words [s, e) of a buffer.  A word is read eight bytes at a time; each part is
    mixed with its place before the parts are added, so that no pattern of bytes cancels out (as
    polynomials modulo 2**64 do).  One part alone is hashed without collisions among equal lengths."""
    size = e - s
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    mask = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.arange(8, -1, -1, dtype=U)[1:])           # of 1 to 8 bytes
    seed = mix(np.array([salt + 1], U) * _MULT)[0]

    def parts(at, left, place):
        return mix((eight[at] & mask[np.minimum(left, 8) - 1]) ^ mix(place * _BASE + seed))

    h = parts(s, size, np.zeros(len(s), U))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8                                    # parts beyond the first
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        word = np.repeat(long, more)
        h[long] += np.add.reduceat(parts(s[word] + 8 * place, size[word] - 8 * place, place.astype(U)), first)
    return mix(h + size.astype(U) * _MULT)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes of one UTF-8 buffer."""
    s, e = word_spans(buf)
    return s, e, word_hash(buf, s, e) if len(s) else np.zeros(0, U)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def arrow_texts(column):
    """(buffer, offsets) of an Arrow string column without copying each text; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if off else \
        np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def small_parts(batch, column: str, rows: int = 256, size: int = 1 << 20):
    """Slices of an Arrow batch of at most ``rows`` rows and about ``size`` bytes of text, so that arrays made for
    each byte or word stay small where many long texts stand together; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    long = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(np.cumsum(long[at:at + rows]), size, "right"))
        n = max(1, fits)
        yield batch.slice(at, n)
        at += n


def gives_back(run):
    """A function of Arrow batches after which the worker, which Spark keeps for later tasks, gives its free
    memory back to the system."""
    def tidy(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU library only
        if trim:
            trim(0)
    return tidy


def ragged_take(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate flat[start_i : start_i + length_i]."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    idx = np.arange(total) + np.repeat(start - (ends - length), length)
    return flat[idx]
