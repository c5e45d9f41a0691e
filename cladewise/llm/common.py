"""Shared helpers: the folder that all executors share, and byte-level views of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; temporaries are about 100 times as large.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's; where neither is set, a folder in the warehouse, which they share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cladewise-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage; Spark removes its files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids for each partition of a small intermediate result.
ROWS = 100_000


def partitions(rows: int) -> int:
    """Partitions for so many rows of ids: results that have shrunk don't keep a large table's partitions."""
    return max(6, -(-rows // ROWS))


def cut_small(df: DataFrame) -> DataFrame:
    """cut(), with as many partitions as the rows need."""
    df = cut(df)
    return df.coalesce(partitions(df.count()))


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Results that are written within it get their kernels' rows in Arrow batches of about so many bytes, instead of up to 64 MB for each task in the JVM and again in Python. A limit that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


class Scratch:
    """Large intermediate results of one operator: written once in the shared folder, read several times, and given back when their last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        out, path = _written(df, label)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *held: DataFrame) -> None:
        """Deletes the folders of these results, or of all that are left."""
        for key in [id(df) for df in held] or list(self.paths):
            _, path = self.paths.pop(key)
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _written(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/cladewise-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back. The folder stays: the caller may read the result at any time."""
    return _written(df, label, compression)[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Powers:
    """Prefix hashes of byte strings, modulo 2**64: any substring's hash takes two look-ups."""

    def __init__(self, seed: int) -> None:
        self.table = random_words(seed, 256)
        self.base = random_words(seed + 1, 1)[0] | np.uint64(1)
        inverse = 1
        for _ in range(6):  # Newton's iteration for the inverse of an odd number
            inverse = inverse * (2 - int(self.base) * inverse) % 2**64
        self.inverse = np.uint64(inverse)
        self._up, self._down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, below n at least."""
        if len(self._up) < n:
            n = 1 << max(10, (n - 1).bit_length())
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                np.multiply.accumulate(out, out=out)
                setattr(self, name, out)
        return self._up, self._down

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        up, _ = self.grown(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * up[: len(raw)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of raw[start:end]; the length is part of the hash."""
        _, down = self.grown(len(prefix))
        return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
