"""Flat column files: one column, a 24-byte header, raw little-endian values.

The header is an 8-byte magic, u32 type (0 whole numbers, 1 doubles), u32
flags and u64 count.  The magic is an option, so that files of other writers
can be read.  A file, or each file of a folder, is cut into byte ranges that are
read side by side; paths may be in any store that pyarrow opens by URI.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..types import F64, I64, EngineError

MAGIC, HEADER = b"EMBCOL01", struct.Struct("<8sIIQ")
_TYPES = {0: ("<i8", "bigint"), 1: ("<f8", "double")}
RANGE_VALUES, BATCH_VALUES = 8 << 20, 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise EngineError(f"no file {path}")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _header(path: str, magic: bytes) -> list[tuple[str, int, int]]:
    """(file, type, count) of each file, checked against its size."""
    system, _ = _open(path)
    out = []
    for name, size in _files(path):
        with system.open_input_file(name) as f:
            head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise EngineError(f"{name} is too short for a header")
        got, kind, _, count = HEADER.unpack(head)
        if got != magic:
            raise EngineError(f"{name} does not begin with {magic!r}")
        if kind not in _TYPES:
            raise EngineError(f"{name} has values of an unknown type {kind}")
        if size < HEADER.size + 8 * count:
            raise EngineError(f"{name} is truncated: {count} values do not fit in {size} bytes")
        out.append((name, kind, count))
    if not out:
        raise EngineError(f"no files in {path}")
    if len({k for _, k, _ in out}) > 1:
        raise EngineError(f"{path} mixes types")
    return out


class _Range(InputPartition):
    def __init__(self, file: str, kind: int, first: int, count: int):
        self.file, self.kind, self.first, self.count = file, kind, first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, magic: bytes):
        self.path, self.magic = path, magic

    def partitions(self):
        return [_Range(f, k, at, min(RANGE_VALUES, n - at)) for f, k, n in _header(self.path, self.magic) for at in range(0, n, RANGE_VALUES)] or [_Range("", 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.file) as f:
            for at in range(part.first, part.first + part.count, BATCH_VALUES):
                n = min(BATCH_VALUES, part.first + part.count - at)
                raw = f.read_at(8 * n, HEADER.size + 8 * at)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, _TYPES[part.kind][0]))], names=["v"])


class _Message(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    """A file a task, each whole in itself; a failed task leaves none under its final name."""

    def __init__(self, path: str, magic: bytes, kind: int):
        self.path, self.magic, self.kind = path, magic, kind

    def write(self, batches):
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        name = f"{at}/part-{uuid.uuid4().hex}"
        parts = [b.column(0) for b in batches if b.num_rows]
        values = [np.asarray(p.fill_null(0) if p.null_count else p).astype(_TYPES[self.kind][0]) for p in parts]
        count = sum(map(len, values))
        if count:
            with system.open_output_stream(f"{at}/_{name.rpartition('/')[2]}") as f:
                f.write(HEADER.pack(self.magic, self.kind, 0, count))
                for v in values:
                    f.write(v.tobytes())
            system.move(f"{at}/_{name.rpartition('/')[2]}", name)
        return _Message()


class FlatColumnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatcolumn"

    def _magic(self) -> bytes:
        return self.options.get("magic", MAGIC.decode()).encode("latin-1")

    def schema(self):
        return f"v {_TYPES[_header(self.options['path'], self._magic())[0][1]][1]}"

    def reader(self, schema):
        return _Reader(self.options["path"], self._magic())

    def writer(self, schema, overwrite):
        kind = {"bigint": 0, "double": 1}[schema[0].dataType.simpleString()]
        return _Writer(self.options["path"], self._magic(), kind)


def read_flat(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """One column, v."""
    spark.dataSource.register(FlatColumnSource)
    return spark.read.format("flatcolumn").option("magic", magic.decode("latin-1")).load(path)


def write_flat(df: DataFrame, path: str, dtype: str = I64, magic: bytes = MAGIC) -> None:
    """Writes the first column's values, nulls left out, to a folder of flat files."""
    if dtype not in (I64, F64):
        raise EngineError(f"unknown type {dtype!r}")
    df.sparkSession.dataSource.register(FlatColumnSource)
    c = df.columns[0]
    rows = df.select(df[c].cast("bigint" if dtype == I64 else "double").alias("v")).where("v IS NOT NULL")
    rows.write.format("flatcolumn").mode("append").option("magic", magic.decode("latin-1")).save(path)
