"""Helpers shared by the training-data operators.

Texts move through ``mapInArrow`` in Arrow batches.  ``slices`` cuts a batch into pieces of a bounded
number of text bytes, so that the numpy arrays built beside the text stay small whatever the batch holds;
a single text longer than the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1_000_000

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new one where that is unset."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_strataflow_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="strataflow-")
            spark._strataflow_shared = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads don't compute it again and survive a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strataflow_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._strataflow_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; what its task has freed goes back to the system at its end, since a worker lives on for other tasks."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def release() -> None:
    """Gives freed memory of this process back, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with empty texts for nulls, as large_string, without an offset."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    return col.cast(pa.large_string())


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large_string column."""
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, int]:
    out = np.full(n + 1, _P, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64), pow(pow(_P, -1, 1 << 64), n, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, int]:
    """(P**0 .. P**m, P**-m) for one m of at least n."""
    return _powers(max(SLICE_BYTES, 1 << int(n - 1).bit_length() if n > SLICE_BYTES else 0))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def words(raw: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of several texts laid end to end.

    raw: the bytes; offsets: where each text starts, and the end; lut: 256 entries, 0 for bytes between
    words, else the byte to take in its place.  Returns (start, end, text number, 64-bit hash) per word.
    A word ends where its text ends.
    """
    low = lut[raw]
    inside = low != 0
    n = len(low)
    if not n or not inside.any():
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, U64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw, back = powers(n)
    m = len(pw) - 1
    total = np.zeros(n + 1, U64)
    np.cumsum(low * pw[:n], out=total[1:], dtype=U64)
    h = (total[end] - total[start]) * pw[m - start] * U64(back)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, text, mix(h ^ (end - start).astype(U64))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (len(h) - k + 1 of them; text borders are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, q = h[:n].copy(), 1
    for t in range(1, k):
        q = q * _Q & _MASK
        out += h[t : t + n] * U64(q)
    return mix(out ^ U64(k * 0x9E37 & _MASK))


def lut_of(keep: str) -> np.ndarray:
    """'alnum': a-z, 0-9 and all bytes from 0x80; 'graph': everything but ASCII white space. A-Z turn to a-z."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    if keep == "alnum":
        lut[:0x30] = lut[0x3A:0x41] = lut[0x5B:0x61] = lut[0x7B:0x80] = 0
    else:
        lut[9:14] = lut[32] = 0
        # byte 0 is part of a word there; 255 never occurs in UTF-8
        lut[0] = 255
    return lut
