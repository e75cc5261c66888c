"""Shared helpers of the training-data operators: lineage cuts, column hygiene and byte-level text arrays."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step handles at a time; bounds a worker's memory whatever the batch or document size.
SLICE_BYTES = 4 << 20
#: Spark's setting under which a finished query deletes its shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a fresh local one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_collected: ContextVar[list["Scratch"] | None] = ContextVar("collected", default=None)


class Scratch:
    """The tables that one call of an operator writes into a folder of its own below the shared one.

    What a result still reads stays until the caller deletes it: `freed` does so for all calls inside it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if (calls := _collected.get()) is not None:
            calls.append(self)

    def cut(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df as Parquet and read it back: lineage ends here, a lost executor loses nothing, and the shuffles behind df go."""
        self.tables += 1
        path = f"{self.path}/{name}-{self.tables}"
        before = self.spark.conf.get(CLEANUP, None)
        if before is not None:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(compression="zstd", **options).parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of earlier cuts that nothing reads any more."""
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                if folder.rpartition("/")[0].endswith(self.path.rpartition("/")[2]):
                    self._delete(folder)

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freed():
    """At its end the scratch tables of all operator calls inside are deleted; their results must have been stored by then."""
    before, calls = _collected.get(), []
    _collected.set(calls)
    try:
        yield
    finally:
        _collected.set(before)
        for call in calls:
            call.close()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and row offsets, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (i, j) of at most `most` bytes each, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15 | 1, np.uint64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of rows data[at[i]:at[i+1]], and the words per row."""
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    per_row = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros(0, np.uint64), per_row
    chars = LOWER[data[inside]]
    first = np.cumsum(inside)[starts] - 1
    lengths = np.diff(np.append(first, len(chars)))
    within = np.arange(len(chars)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _POWERS[0], np.uint64))
    terms = (chars.astype(np.uint64) + np.uint64(1)) * powers[within]
    return mix64(np.add.reduceat(terms, first)), per_row


def shingle_hashes(words: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles of each row (with fewer words: the whole sequence as one), and shingles per row."""
    n = len(words)
    first = np.cumsum(per_row) - per_row
    position = np.arange(n) - np.repeat(first, per_row)
    left = np.repeat(per_row, per_row) - position
    keep = (left >= width) | (position == 0)
    total = np.minimum(left, width).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: n - k] = words[k:] if k else words
        part[left <= k] = 0
        total += part * _POWERS[3 * k + 1]
    counts = np.where(per_row >= width, per_row - width + 1, np.minimum(per_row, 1))
    return mix64(total[keep]), counts
