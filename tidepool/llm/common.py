"""Shared parts of the training-data operators: inputs, written tables, text kernels.

Conventions that hold for every operator of this subpackage

* Only ``doc_id`` and ``text`` of an input are read, so further columns may have any name.
* A null text counts as the empty text.  One row comes out for each row that goes in,
  repeated rows included, unless the operator says otherwise.
* Work happens on Arrow batches in blocks of bounded bytes; a single longer text is its own block.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once.
BLOCK_BYTES = 1 << 20

U64 = np.uint64


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a data folder, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


# ---------------------------------------------------------------- written tables


class Workspace:
    """Tables written below the folder that the cluster shares, deleted when the program ends.

    A lost executor takes no written table with it, and a table cuts the lineage.  While a table
    is written, Spark is told to drop the shuffle files of that query as soon as it has ended,
    so that the disk holds one phase of a job at a time.  That is a setting of the session: other
    queries that end in this time lose their shuffle files too, and would run their maps again if
    they were read anew.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.gettempdir()  # one process, one machine: a test
        self.root = f"{root.rstrip('/')}/tidepool-{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return it read again."""
        before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(self._CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder belongs to the cluster then
            pass


# ---------------------------------------------------------------- text kernels


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts in them, one place more than rows; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held, at


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # no such call in this C library
        return None


def release() -> None:
    """Give freed memory back: workers wait between tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of batches with a column ``text``, in blocks of about size bytes: rows, bytes, places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held, at = buffers(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            yield batch.slice(row, end - row), held[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
    release()


#: [\x20\x09-\x0D], the characters between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ in data, and at which word each row starts (one more than rows)."""
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]  # a word never crosses from one row into the next
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _mixed(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base to the 0th ... n-th power modulo 2 to the 64th."""
    out = np.ones(n + 1, U64)
    if n:
        out[1] = base
        have = 1
        while have < n:
            more = min(have, n - have)
            out[have + 1 : have + 1 + more] = out[1 : 1 + more] * out[have]
            have += more
    return out


class RollingHash:
    """64-bit fingerprints of any slices of a sequence of 64-bit units, from prefix sums."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(units * powers(n)[:n], out=self.sums[1:])
        self.down = powers(n, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of units start (inclusive) to end (exclusive); they depend on the units alone."""
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Fingerprints of all windows of size units."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + U64(size))


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


#: Words of more bytes are told apart by XXH64, so that memory does not follow the longest word.
LONG_WORD = 1 << 12


def word_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    out = np.empty(len(starts), U64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    short = np.setdiff1d(np.arange(len(starts)), long) if len(long) else np.arange(len(starts))
    a = 0
    while a < len(short):
        first = int(starts[short[a]])
        b = max(a + 1, int(np.searchsorted(ends[short], first + BLOCK_BYTES, "right"))) if len(data) > BLOCK_BYTES else len(short)
        own = short[a:b]
        out[own] = RollingHash(_BYTE[data[first : ends[own[-1]]]]).of(starts[own] - first, ends[own] - first)
        a += len(own)
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def row_of(counts: np.ndarray) -> np.ndarray:
    """For items in rows of the given counts: the row of each item."""
    return np.repeat(np.arange(len(counts)), counts)
