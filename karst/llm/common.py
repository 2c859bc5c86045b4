"""What the operators of this subpackage share: staging in the cluster's shared folder, array blobs and hashing.

Every operator reads with Spark alone and keeps intermediate tables in the folder that ``spark.checkpoint.dir`` names, so that a
lost executor never takes with it the only copy of anything.
"""

from __future__ import annotations

import ctypes
import gc
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from karst.plans.fixpoint import shared_dir, written  # noqa: F401

#: Bytes of text that one Arrow batch carries to Python, at most (a single row may be longer).
BATCH_BYTES = 4 << 20


#: What operators keep in a worker between its tasks, by operator.
KEPT: dict[str, dict] = {}


def release(own: str = "") -> None:
    """Gives a worker's unused memory back, with what other operators kept in it: workers live on from stage to stage."""
    for name, cache in KEPT.items():
        if name != own:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(function, own: str = ""):
    """A function over the Arrow batches of a partition that releases memory before and after."""

    def run(batches):
        release(own)
        try:
            yield from function(batches)
        finally:
            release(own)

    return run


def session_of(df: DataFrame) -> SparkSession:
    """The session of a DataFrame, with Arrow batches bounded by bytes so that long texts cannot fill a worker."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return spark


#: The rows written as Parquet to the shared folder and read again.
staged = written


def collected(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: files of shuffles that nothing refers to any more stay on the executors' disks until it does."""
    for _ in range(2):  # what the first round lets go of holds files of its own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def scalar(df: DataFrame):
    """The one value of a one-row aggregate."""
    return df.first()[0]


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes under zstd: the high bytes of small numbers cost almost nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    """The inverse of pack()."""
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit hashes (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def large(column: pa.ChunkedArray | pa.Array, empty: bool = True) -> pa.Array:
    """One string array with 64-bit offsets; null becomes empty text where asked."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string())
    return a.fill_null("") if empty else a


def gathered(batches, limit: int, column: str = "text"):
    """Arrow batches of a partition put together until their text passes a number of bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def by_groups(batches, keys: list[str]):
    """Rows that come sorted by keys, as tables of whole groups; with each the first row of every group, and the end."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        whole = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t]) if held else t
        starts = _starts(whole, keys) - (1 if held else 0)
        starts = starts[starts >= 0] if held else starts[1:]
        if len(starts):
            done = pa.concat_tables([*held, t.slice(0, starts[-1])]).combine_chunks()
            yield done, np.append(_starts(done, keys), done.num_rows)
            held = [t.slice(starts[-1])]
        else:
            held.append(t)
    if held:
        done = pa.concat_tables(held).combine_chunks()
        yield done, np.append(_starts(done, keys), done.num_rows)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = t[k].combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)
