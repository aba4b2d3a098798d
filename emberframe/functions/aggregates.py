"""Sum, minimum, maximum and count; built-in aggregates after normalising types.

Nulls are skipped and an aggregate over no values is null.  NaN is the greatest
double.  Whole-number sums wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import F64, I64, EngineError, normalised, wrapping_sum

INT64_MAX, INT64_MIN = 2**63 - 1, -(2**63)


def hot_sum(df: DataFrame, value: str | Column) -> Column:
    v, kind = normalised(df, value)
    return wrapping_sum(v) if kind == I64 else F.sum(v)


def hot_min(df: DataFrame, value: str | Column) -> Column:
    return F.min(normalised(df, value)[0])


def hot_max(df: DataFrame, value: str | Column) -> Column:
    return F.max(normalised(df, value)[0])


def hot_count(df: DataFrame, value: str | Column) -> Column:
    return F.count(normalised(df, value)[0])


def summary(df: DataFrame, value: str | Column, by: Sequence[str] = (), where: Column | None = None, having: Column | str | None = None) -> DataFrame:
    """sum, min, max, count in one pass, optionally by keys of any type, of rows that pass `where`, of groups that pass `having`.

    `where` acts like FILTER: groups without passing rows stay, with nulls.
    """
    v, kind = normalised(df, value)
    v = v if where is None else F.when(where, v)
    total = wrapping_sum(v) if kind == I64 else F.sum(v)
    out = df.groupBy(*by).agg(total.alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))
    return out if having is None else out.where(having)


def agg_all(df: DataFrame, value: str | Column) -> dict[str, int]:
    """Operator-level fused aggregate over whole numbers: over none, sum 0 and the extremes of 64 bits."""
    if normalised(df, value)[1] == F64:
        raise EngineError("the fused aggregate takes whole numbers")
    r = summary(df, value).first()
    if not r["count"]:
        return {"sum": 0, "min": INT64_MAX, "max": INT64_MIN, "count": 0}
    return {k: r[k] for k in ("sum", "min", "max", "count")}


def group_sum(df: DataFrame, key: str, value: str, expected_groups: int = 0) -> DataFrame:
    """key, sum.  A large expected number of groups asks for as many more partitions up front."""
    k, kind = normalised(df, key)
    if kind == F64:
        raise EngineError("the key must be a whole number")
    v, kind = normalised(df, value)
    rows = df.select(k.alias("key"), v.alias("value")).where(F.col("key").isNotNull())
    per_partition = 2_000_000
    if expected_groups > per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(-(-expected_groups // per_partition), "key")
    total = wrapping_sum(F.col("value")) if kind == I64 else F.sum("value")
    return rows.groupBy("key").agg(total.alias("sum"))
