"""Named columns that stay in Spark's storage layer.

A column is uploaded once and read often.  A pair shares one frame under two
names, so key and payload of a row belong together.  Columns hold no nulls.
Uploads are eager; an upload under a known name replaces it.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.decisions import Decision, Reason, choose_reduce
from ..types import I64, EngineError, normalised, wrapping_sum

DEFAULT_CAP_BYTES = 4 << 30
#: Columns that one grouped upload may register: their names are held by the driver.
GROUPED_NAMES = 10_000
_DEFAULT = object()


@dataclass
class ResidentColumn:
    name: str
    dtype: str
    rows: int
    frame: DataFrame  # persisted; shared by the two names of a pair
    column: str
    indexed: bool = False  # the frame has idx, the place in upload order from 0
    keyed: DataFrame | None = field(default=None, repr=False)  # as a build side: each key and how often
    base: DataFrame | None = field(default=None, repr=False)  # what is persisted, where `frame` is a part of it
    builds: int = 0  # how often it was a build side

    @property
    def held(self) -> DataFrame:
        return self.frame if self.base is None else self.base

    def select(self, alias: str, *more: str) -> DataFrame:
        return self.frame.select(F.col(self.column).alias(alias), *more)

    def counts(self) -> DataFrame:
        """key, m: each key and how often; what is kept, if it is."""
        return self.keyed if self.keyed is not None else self.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("m"))


class Store:
    def __init__(self, spark: SparkSession, cap_bytes: int = DEFAULT_CAP_BYTES, partitions: int | None = None):
        self.spark, self.cap_bytes, self.partitions = spark, cap_bytes, partitions
        self._columns: dict[str, ResidentColumn] = {}
        self._lock = threading.RLock()
        self.last_decision: Decision | None = None

    # --- uploads

    def _admit(self, rows: DataFrame, width: int, order_by: Column | str | None) -> tuple[DataFrame, int]:
        """Index where asked for, persist and count; over the cap nothing stays."""
        if order_by is not None:
            rows = self._with_index(rows)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        n = rows.count()
        if n * 8 * width > self.cap_bytes:
            rows.unpersist()
            raise EngineError(f"the upload of {n * 8 * width} bytes is over the cap of {self.cap_bytes}")
        return rows, n

    @staticmethod
    def _with_index(rows: DataFrame) -> DataFrame:
        """idx from 0 in the order of __order, then of the values: rows that tie on all are alike, so idx is the same when computed anew."""
        from ..functions.windows import numbered

        order = ["__order", *(c for c in rows.columns if c != "__order")]
        return numbered(rows, order, "idx").withColumn("idx", F.col("idx") - 1).drop("__order")

    def _put(self, column: ResidentColumn) -> None:
        old = self._columns.get(column.name)
        self._columns[column.name] = column
        if old is not None:
            self._release(old)

    def _release(self, old: ResidentColumn) -> None:
        """Give back what only a replaced or dropped column holds."""
        if not any(c.held is old.held for c in self._columns.values()):
            old.held.unpersist()
        if old.keyed is not None:
            old.keyed.unpersist()

    @staticmethod
    def _named(name: str | None) -> str:
        if name is None:
            raise EngineError("a column needs a name")
        return name

    def upload(self, name: str, df: DataFrame, value: str | Column, order_by: Column | str | None = None) -> int | None:
        """Rows uploaded; None, and nothing registered, if no value is left."""
        name = self._named(name)
        v, kind = normalised(df, value)
        order = [] if order_by is None else [(F.col(order_by) if isinstance(order_by, str) else order_by).alias("__order")]
        rows = df.select(v.alias("v"), *order).where("v IS NOT NULL")
        with self._lock:
            frame, n = self._admit(rows, 1, order_by)
            if not n:
                frame.unpersist()
                return None
            self._put(ResidentColumn(name, kind, n, frame, "v", order_by is not None))
            return n

    def upload_pair(self, name: str, df: DataFrame, key: str | Column, value: str | Column, order_by: Column | str | None = None) -> int | None:
        """Registers name.k and name.v over one frame; a row with a null half is left out."""
        name = self._named(name)
        k, key_kind = normalised(df, key)
        if key_kind != I64:
            raise EngineError("a key must be a whole number")
        v, kind = normalised(df, value)
        order = [] if order_by is None else [(F.col(order_by) if isinstance(order_by, str) else order_by).alias("__order")]
        rows = df.select(k.alias("k"), v.alias("v"), *order).where("k IS NOT NULL AND v IS NOT NULL")
        with self._lock:
            frame, n = self._admit(rows, 2, order_by)
            if not n:
                frame.unpersist()
                return None
            self._put(ResidentColumn(f"{name}.k", I64, n, frame, "k", order_by is not None))
            self._put(ResidentColumn(f"{name}.v", kind, n, frame, "v", order_by is not None))
            return n

    def upload_grouped(self, df: DataFrame, name: str, value: str) -> dict[str, int]:
        """One column for each distinct name; a null name of a row with a value is an error."""
        v, kind = normalised(df, value)
        rows = df.select(F.col(name).cast("string").alias("name"), v.alias("v")).where("v IS NOT NULL")
        with self._lock:
            # one frame for all names; sorted, so that a name's batches are found by their statistics
            base = rows.sortWithinPartitions("name").persist(StorageLevel.MEMORY_AND_DISK)
            found = base.groupBy("name").count().limit(GROUPED_NAMES + 1).collect()
            over = sum(r["count"] for r in found) * 8 > self.cap_bytes
            if over or len(found) > GROUPED_NAMES or any(r["name"] is None for r in found):
                base.unpersist()
                if over:
                    raise EngineError(f"the upload is over the cap of {self.cap_bytes} bytes")
                raise EngineError("a column needs a name" if len(found) <= GROUPED_NAMES else f"over {GROUPED_NAMES} names in one upload")
            if not found:
                base.unpersist()
            for r in found:
                self._put(ResidentColumn(r["name"], kind, r["count"], base.where(F.col("name") == r["name"]).select("v"), "v", base=base))
        return {r["name"]: r["count"] for r in sorted(found)}

    # --- reads

    def lookup(self, name: str, dtype: str | None = None) -> ResidentColumn:
        with self._lock:
            column = self._columns.get(name)
        if column is None:
            raise EngineError(f"no resident column is named {name!r}")
        if dtype is not None and column.dtype != dtype:
            raise EngineError(f"resident column {name!r} is {column.dtype}, not {dtype}")
        return column

    def names(self) -> list[str]:
        return sorted(self._columns)

    def reduce_frame(self, name: str, what: str, dtype: str | None = None) -> DataFrame:
        """One row, one column `value`."""
        column = self.lookup(name, dtype)
        v = F.col(column.column)
        agg = {"sum": wrapping_sum(v) if column.dtype == I64 else F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "avg": F.avg(v)}[what]
        return column.frame.agg(agg.alias("value"))

    def _reduce(self, name: str | None, what: str, dtype: str | None):
        if name is None:
            return None
        began = time.perf_counter()
        value = self.reduce_frame(name, what, dtype).first()["value"]
        self.note(f"resident_{what}", choose_reduce(True), began, rows=self.lookup(name).rows)
        return value

    def reduce_cold(self, df: DataFrame, value: str | Column, what: str):
        """The same of a column that is not resident: a scan."""
        began = time.perf_counter()
        v, kind = normalised(df, value)
        agg = {"sum": wrapping_sum(v) if kind == I64 else F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "avg": F.avg(v)}[what]
        row = df.agg(agg.alias("value"), F.count(v).alias("rows")).first()
        self.note(f"cold_{what}", choose_reduce(False), began, rows=row["rows"])
        return row["value"]

    def sum(self, name: str | None):
        return self._reduce(name, "sum", I64)

    def sum_f64(self, name: str | None):
        return self._reduce(name, "sum", "F64")

    def min(self, name: str | None):
        return self._reduce(name, "min", None)

    def max(self, name: str | None):
        return self._reduce(name, "max", None)

    def avg(self, name: str | None):
        return self._reduce(name, "avg", None)

    def agg_all(self, name: str) -> dict[str, int]:
        from ..functions.aggregates import agg_all

        column = self.lookup(name, I64)
        began = time.perf_counter()
        out = agg_all(column.frame, column.column)
        self.note("resident_all", choose_reduce(True), began, rows=column.rows)
        return out

    def multiplicities(self, name: str) -> DataFrame:
        """key, m: the build side's keys and how often each occurs; from the second use on kept with the column, hash-partitioned by key."""
        column = self.lookup(name, I64)
        column.builds += 1
        if column.keyed is None and column.builds > 1:
            column.keyed = column.counts().persist(StorageLevel.MEMORY_AND_DISK)
        return column.counts()

    def clear(self) -> None:
        """Drop every column."""
        for name in self.names():
            self.drop(name)

    # --- housekeeping

    def drop(self, name: str | None) -> bool | None:
        if name is None:
            return None
        with self._lock:
            column = self._columns.pop(name, None)
            if column is None:
                return False
            self._release(column)
            return True

    def info(self, name: str | None) -> str | None:
        if name is None:
            return None
        c = self.lookup(name)
        return f"dtype={c.dtype} rows={c.rows} device=spark"

    def note(self, op: str, reason: Reason, began: float, **counts: int) -> None:
        self.last_decision = Decision(op, reason, (time.perf_counter() - began) * 1000, counts)

    def last_stats(self) -> str | None:
        return None if self.last_decision is None else str(self.last_decision)

    def build_info(self) -> str:
        return f"compiled=spark-{self.spark.version} runtime={self.spark.sparkContext.master}"
