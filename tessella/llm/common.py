"""What the operators of this subpackage share: places for written tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its counted rows times their width stay below this; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes that one Arrow batch sends to Python at most, so that very long texts don't meet in one batch.
BATCH_BYTES = 4 << 20
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 19
#: Stands for a null id inside the operators; results carry null again.
NULL_ID = -(2**63)
INT_MIN = NULL_ID


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of Arrow batches in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset, which only
    a local master may leave so, as executors elsewhere can't see this machine's folders."""
    if conf := spark.conf.get("spark.checkpoint.dir", ""):
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-", dir="/tmp"))
    return jsc.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    _written[df.sparkSession.sparkContext.applicationId].add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Tables that stage() has written and nothing has deleted, by application.
_written: dict[str, set[str]] = defaultdict(set)


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that the operators have written for this application: once no result is read any more."""
    drop(spark, *_written[spark.sparkContext.applicationId])


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing will read again."""
    _written[spark.sparkContext.applicationId].difference_update(paths)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(hadoop).delete(at, True)


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size is below BROADCAST_BYTES, else as it is, to be joined by a shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column (in upper or lower case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def id_in(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_out(column):
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NULL_ID), c)


_libc = None


def lean(done: bool = False) -> None:
    """Sets how this worker keeps memory, as it lives for many tasks, beside others in one executor: large arrays reuse
    what freed ones leave (new pages are dear), and when a task is done, what it has freed goes back to the system."""
    global _libc
    if _libc is None:
        import ctypes

        try:
            _libc = ctypes.CDLL(None)
            _libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: smaller blocks come from the heap
            _libc.mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD: which isn't given back on the way
        except (OSError, AttributeError):
            _libc = False
    if done:
        if _libc and hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)
        pa.default_memory_pool().release_unused()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about limit bytes of text (one long text alone may have more): batch, bytes, offsets."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = utf8(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    lean(done=True)


def int64(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array: row i is data[cuts[i]:cuts[i+1]] as bytes."""
    raw = np.ascontiguousarray(data)
    off = (cuts.astype(np.int64) * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw.view(np.uint8).ravel() if raw.size else b"")]).cast(pa.binary())


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
