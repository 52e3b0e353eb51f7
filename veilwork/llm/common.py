"""What the operators of this subpackage share: Arrow plumbing, the shared folder, and bounded blocks of text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy code works on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 21
#: Bytes and rows of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a temporary one does for a
    local session (tests); on a cluster other machines would not see it, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(at)
        return at
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilwork-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: For rows that may be very long: Spark's reader holds a whole row group (or 4096 rows of it) at once, so these are kept small,
#: and their size is looked at after each few rows.
SMALL_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def stash(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again. What is read has a known size and no partitioning, so a
    join with it may be broadcast or split where a key is hot."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(SMALL_GROUPS if long_rows else {})).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Removes the files of a stash that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as by rows, so that long texts don't pile up in a worker. Spark
    reads these two settings when it plans, which may be at any later time, so they are only ever lowered for the session."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(_released(f), schema)


def _released(f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which after a partition gives what it no longer holds back to the system: Spark keeps workers for later tasks, and
    several idle ones would else keep their peaks beside those at work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid_utf8(column: pa.Array) -> pa.Array:
    """A string column whose bytes are UTF-8: rows that hold others get U+FFFD for them."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], column.type)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    """data with A-Z in lower case; other bytes stay, so UTF-8 stays UTF-8."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes within its row, and the number of runs before each row.

    is_word has one flag for each byte; offsets are those of the rows in it.
    """
    n = len(is_word)
    cuts = offsets[1:-1]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    opens, closes = cuts[cuts < n], cuts[cuts > 0] - 1
    first[opens], last[closes] = is_word[opens], is_word[closes]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, "left")


_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_UP: list[np.ndarray] = []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over the bytes before each place, and the inverse powers that bring a difference of sums to
    one place: (sums[b] - sums[a]) * down[a] depends on the bytes from a to b alone."""
    n = len(part) + 1
    if not _UP or len(_UP[0]) < n:
        _UP[:] = [_powers(_B, max(n, BLOCK_BYTES)), _powers(_B_INVERSE, max(n, BLOCK_BYTES))]
    sums = np.zeros(n, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[0][: n - 1], out=sums[1:])
    return sums, _UP[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """Results of make by short key, in two generations of at most so many entries each; what is in use stays."""

    def __init__(self, make: Callable, entries: int, chars: int) -> None:
        super().__init__()
        self._make, self._entries, self._chars, self._older = make, entries, chars, {}

    def __missing__(self, key: str):
        value = self._older.pop(key, None)
        if value is None:
            value = self._make(key)
        if len(key) <= self._chars:
            if len(self) >= self._entries:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


def many_small_objects() -> None:
    """For workers that keep large tables of tuples and strings: look for garbage cycles more seldom."""
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)
