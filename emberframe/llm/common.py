"""Shared plumbing: the shared checkpoint folder, written tables, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds expanded at once (one longer text is still whole).
CHUNK_BYTES = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir.  A folder of this machine only where this machine is all there is (tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="emberframe-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Written tables that are still there, in the order they were written.
_there: list[Written] = []


class Written:
    """A table in the shared folder.  It cuts lineage: a lost executor costs a re-read only.

    What is not dropped before goes when the driver's Python ends.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_root(self.spark)}/emberframe/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if not _there:
            atexit.register(release)
        _there.append(self)

    def drop(self) -> None:
        """Delete the files; only once nothing lazy still reads them."""
        if self in _there:
            _there.remove(self)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    return Written(df, label).df


def mark() -> int:
    """A point for `release`."""
    return len(_there)


def release(since: int = 0, but: tuple = ()) -> None:
    """Delete tables written since the mark, once all that reads them has been written itself."""
    for table in _there[since:]:
        if table not in but:
            with contextlib.suppress(Exception):  # the session may have ended
                table.drop()


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of frames that are no longer held."""
    gc.collect()
    spark._jvm.System.gc()


_forget = None


def claim(forget=None) -> None:
    """Called as a task starts: what another operator's tasks left in this worker's memory goes."""
    global _forget
    if _forget is not None and _forget != forget:
        _forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _forget = forget


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) under names of our own, so that other columns cannot clash; null text is empty."""
    return df.select(
        df[id_col].cast("long").alias("id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row starts and the last one ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Split Arrow batches so that each piece has about `limit` bytes of text, or one text.

    Yields (record batch, bytes, row offsets).
    """
    claim()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


#: Rows and bytes of what may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size=None) -> DataFrame:
    """Marked for broadcast if it has at most so many rows and, by the column `size`, BROADCAST_BYTES (both measured here); else as it is, to be joined by a shuffle."""
    few = df.limit(rows + 1)
    n, held = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df
