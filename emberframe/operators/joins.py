"""Joins fused with aggregation, and joins that return rows.

Fused joins never make the joined rows: each kind multiplies a probe row by a
function of how often its key occurs in the build side.  RIGHT and FULL add the
build rows that no probe row matches, which only counts see.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.decisions import Reason, choose_join
from ..types import F64, I64, EngineError, wrapping_sum
from .store import ResidentColumn, Store

JOIN_KINDS = ("inner", "left", "semi", "anti", "right", "full")
_HINTS = {Reason.BROADCAST_BUILD: "broadcast", Reason.SORTED_BUILD: "merge", Reason.SHUFFLE_HASH: "shuffle_hash"}
#: Rows of a key, of each side, that meet in one cell of a large row join; a cell is in one task.
CELL = 3000
#: Partitions of a large row join at most.
MOST_PARTITIONS = 10_000


def _times(kind: str) -> Column:
    m = F.coalesce(F.col("m"), F.lit(0).cast("bigint"))
    return {
        "inner": m, "right": m, "left": F.greatest(m, F.lit(1).cast("bigint")), "full": F.greatest(m, F.lit(1).cast("bigint")),
        "semi": F.when(m > 0, 1).otherwise(0).cast("bigint"), "anti": F.when(m == 0, 1).otherwise(0).cast("bigint"),
    }[kind]


def multiplied(probe: DataFrame, build: DataFrame, kind: str, strategy: Reason = Reason.CATALYST) -> DataFrame:
    """probe (key, ...) with `times`; build is (key, m)."""
    if kind not in JOIN_KINDS:
        raise EngineError(f"unknown kind of join {kind!r}; one of {', '.join(JOIN_KINDS)}")
    hint = _HINTS.get(strategy)
    side = build.hint(hint) if hint else build
    how = "inner" if kind in ("inner", "right", "semi") else "left"
    return probe.join(side, "key", how).withColumn("times", _times(kind)).where("times > 0")


def _unmatched(probe: DataFrame, build: DataFrame) -> DataFrame:
    """One row, `n`: build rows without a probe row."""
    return build.join(probe.select("key").distinct(), "key", "left_anti").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def join_frame(probe: DataFrame, build: DataFrame, kind: str, dtype: str | None, strategy: Reason = Reason.CATALYST) -> DataFrame:
    """One row: sum (null without a payload or matches) and matched."""
    kind = kind.lower()
    rows = multiplied(probe, build, kind, strategy)
    times, v = F.col("times"), F.col("value")
    if dtype is None:
        total = F.lit(None).cast("bigint")
    elif dtype == I64:
        total = wrapping_sum(v, times)
    else:
        total = F.sum(v * times)
    out = rows.agg(total.alias("sum"), F.coalesce(F.sum("times"), F.lit(0)).cast("bigint").alias("matched"))
    if kind in ("right", "full"):
        out = out.crossJoin(_unmatched(probe, build)).select("sum", (F.col("matched") + F.col("n")).alias("matched"))  # one row each
    return out


def _sides(store: Store, probe_key: str, payload: str | None, build_key: str, dtype: str | None):
    pk, bk = store.lookup(probe_key, I64), store.lookup(build_key, I64)
    if payload is None:
        return pk.select("key"), pk, bk
    pv = store.lookup(payload, dtype)
    if pv.frame is not pk.frame:
        raise EngineError(f"{probe_key!r} and {payload!r} were not uploaded as a pair")
    return pk.frame.select(F.col(pk.column).alias("key"), F.col(pv.column).alias("value")), pk, bk


def _run(store: Store, kind: str, probe_key, payload, build_key, dtype, hint: str | None):
    if probe_key is None or build_key is None:
        return None
    began = time.perf_counter()
    probe, pk, bk = _sides(store, probe_key, payload, build_key, dtype)
    strategy = choose_join(bk.rows, hint)
    row = join_frame(probe, store.multiplicities(build_key), kind, dtype, strategy).first()
    store.note(f"join_{kind}", strategy, began, rows_probe=pk.rows, rows_build=bk.rows, matched=row["matched"])
    return row


def join_sum(store: Store, kind: str, probe_key: str | None, payload: str | None, build_key: str | None, dtype: str = I64, hint: str | None = None):
    """The payload's sum over the join; None over no rows or for a null name.  dtype F64 for doubles."""
    if payload is None:
        return None
    row = _run(store, kind, probe_key, payload, build_key, dtype, hint)
    return None if row is None else row["sum"]


def join_count(store: Store, kind: str, probe_key: str | None, build_key: str | None, hint: str | None = None) -> int | None:
    row = _run(store, kind, probe_key, None, build_key, None, hint)
    return None if row is None else row["matched"]


def _in_cells(p: ResidentColumn, b: ResidentColumn, kind: str, rows: int, cell: int) -> DataFrame:
    """probe_idx, build_idx of an inner or left join with many rows.

    The pairs of a key are a grid: its probe rows are dealt into bands and its
    build rows into columns of about `cell` rows each, and a row is copied to
    every cell that it crosses.  So no task makes all pairs of a key, and some
    2 * rows / cell rows are copied, however skewed the keys are.  A left join
    keeps a probe row without a pair only where its key has one column, as a
    cell of more could be empty.
    """
    counts = p.counts().withColumnRenamed("m", "pm").join(b.counts().withColumnRenamed("m", "bm"), "key", "full")
    cuts = [F.greatest(F.ceil(F.col(m) / cell), F.lit(1)).alias(name) for m, name in (("pm", "bands"), ("bm", "columns"))]
    large = counts.where(F.greatest("pm", "bm") > cell).select("key", *cuts)  # so many at most: both sides' rows / cell
    large = large.hint(_HINTS[choose_join((p.rows + b.rows) // cell)])
    bands, columns = (F.coalesce(c, F.lit(1)).cast("int") for c in ("bands", "columns"))

    def dealt(side: ResidentColumn, name: str, own: Column, other: Column, at: list[str], *more: Column) -> DataFrame:
        cells = [F.pmod(F.xxhash64("idx"), own).cast("int").alias(at[0]), F.explode(F.sequence(F.lit(0), other - 1)).alias(at[1])]
        return side.select("key", "idx").join(large, "key", "left").select("key", F.col("idx").alias(name), *cells, *more)

    at = ["key", "band", "column"]
    parts = max(int(p.frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows // cell**2 + 1, MOST_PARTITIONS))
    left = dealt(p, "probe_idx", bands, columns, at[1:], (columns == 1).alias("whole")).repartition(parts, *at)
    right = dealt(b, "build_idx", columns, bands, at[:0:-1]).repartition(parts, *at)
    return left.join(right.hint("merge"), at, kind).where("whole OR build_idx IS NOT NULL").select("probe_idx", "build_idx")


def join_rows(store: Store, probe: str, build: str, kind: str, cap: int | None = None, cell: int = CELL) -> DataFrame:
    """probe_idx, build_idx: places in upload order.  Semi and anti have no build_idx.  All rows, however many; over a cap that is given: an error that says how many."""
    kind = kind.lower()
    if kind not in JOIN_KINDS[:4]:
        raise EngineError(f"unknown kind of join {kind!r}; one of inner, left, semi, anti")
    p, b = store.lookup(probe, I64), store.lookup(build, I64)
    for c in (p, b):
        if not c.indexed:
            raise EngineError(f"{c.name!r} was uploaded without an order")
    n = join_count(store, kind, probe, build)
    if cap is not None and n > cap:
        raise EngineError(f"the join has {n} rows, over the cap of {cap}")
    if kind in ("inner", "left") and n > cell**2:
        return _in_cells(p, b, kind, n, cell)
    left = p.select("key", F.col("idx").alias("probe_idx"))
    right = b.select("key", F.col("idx").alias("build_idx"))
    how = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[kind]
    out = left.join(right, "key", how)
    return out.select("probe_idx", "build_idx" if kind in ("inner", "left") else F.lit(None).cast("bigint").alias("build_idx"))


def first_match_join(build: DataFrame, probe: DataFrame) -> DataFrame:
    """build, probe: (key, idx).  At most one match a probe row, with the build row of the smallest idx."""
    first = build.groupBy("key").agg(F.min("idx").alias("build_idx"))
    return probe.select("key", F.col("idx").alias("probe_idx")).join(first, "key").select("probe_idx", "build_idx")


def list_join(spark, build: list[int], probe: list[int]) -> DataFrame:
    """The same over two lists."""

    def frame(values):
        return spark.createDataFrame([(list(values),)], "a array<bigint>").select(F.posexplode("a").alias("pos", "key")).select("key", F.col("pos").cast("bigint").alias("idx"))

    return first_match_join(frame(build), frame(probe))
