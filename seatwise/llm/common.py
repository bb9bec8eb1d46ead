"""What several operators share: the shared folder, cut lineage, Arrow text blocks and vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='seatwise-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and returns it as read from there: computed once, safe when executors are lost.

    rows: of a table with large rows, so many are read at a time, whatever the size of a file.
    """
    path = new_path(df.sparkSession, name)
    (df.write.option("parquet.block.row.count.limit", rows) if rows else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within it hands at most so many rows to Python at a time; for large rows, of which Spark's usual 10,000 don't fit in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables made by cut that nothing reads any more, and lets Spark remove the shuffle files of plans no longer held."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["_cut_path"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # what Python has let go of, the JVM can only then
        gc.collect()
        spark._jvm.System.gc()


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system, for the tasks that come after."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each (one more than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return raw, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = text_buffers(batch.column(text))[1]
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


#: The contract's white space: space and U+0009 to U+000D. Bytes of other characters never fall in it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        got = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place on a fresh uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial modulo 2**64 and a final mix."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    spans = (sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data) + 1)[start]
    return mix64(spans + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
