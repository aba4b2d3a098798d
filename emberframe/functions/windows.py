"""Window functions.  Every order ends in a unique column, so results do not depend on the input's order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import I64, normalised, wrapping_add, wrapping_sum, wrapping_sum_over


#: Rows that splitters are taken from, for each range.
SPLIT_SAMPLE = 50


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds __range: rows dealt into ranges of the columns `order` by splitters from a sample.

    The sample is a share of the rows by a hash of their order, as large as the
    ranges need and no larger with more rows.  The splitters are collected once
    and are literals: a range that is computed anew, after an executor is lost,
    has the same rows.
    """
    spark = df.sparkSession
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, df.count() // (parts * SPLIT_SAMPLE))
    sample = df.select(at.alias("at")).where(F.pmod(F.xxhash64("at"), F.lit(share)) == 0)
    every = F.greatest(F.ceil(F.size("m") / parts), F.lit(1)).cast("int")
    marks = sample.agg(F.sort_array(F.collect_list("at")).alias("m")).select(F.filter("m", lambda _, i: (i > 0) & (i % every == 0)).alias("m"))
    text = marks.select(F.to_json("m")).first()[0]
    return _search(df, F.from_json(F.lit(text), marks.schema["m"].dataType), at, parts)


def _search(df: DataFrame, marks: Column, at: Column, most: int) -> DataFrame:
    """Adds __range, how many of the sorted marks do not come after the row, by halving: a column for each step.  Nulls come first."""
    out, step = df.withColumn("__range", F.lit(0)), 1 << (most.bit_length() - 1)
    while step:
        out = out.withColumn("__range", F.col("__range") + F.when(F.get(marks, F.col("__range") + (step - 1)) <= at, step).otherwise(0))
        step >>= 1
    return out


def _before(ranged: DataFrame, total: Column) -> Column:
    """What the ranges before a row's own add up to, modulo 2 ** 64.  A row for each range is collected."""
    totals = {r["__range"]: r["t"] or 0 for r in ranged.groupBy("__range").agg(total.alias("t")).collect()}
    starts, before = [], 0
    for i in range(max(totals, default=0) + 1):
        starts.append(str(before))
        before = (before + totals.get(i, 0) + 2**63) % 2**64 - 2**63
    return F.element_at(F.split(F.lit(",".join(starts)), ",").cast("array<bigint>"), F.col("__range") + 1)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds `name`, places from 1 in the order of the columns `order`, of all rows.

    A count for each range and a row_number inside it give the places, so no
    task sees all rows.
    """
    ranged = _ranged(df, order)
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__at", inside).withColumn(name, _before(ranged, F.count(F.lit(1))) + F.col("__at")).drop("__range", "__at")


def row_number(df: DataFrame, key: str, position: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds row_number, from 1, ascending by key, ties by the unique `position`; global without `by`."""
    if by:
        return df.withColumn("row_number", F.row_number().over(W.partitionBy(*by).orderBy(key, position)).cast("bigint"))
    return numbered(df, [key, position], "row_number")


def over_all(df: DataFrame, value: str, name: str, what: str = "sum") -> DataFrame:
    """Adds `name`, an aggregate over all rows: computed once and attached, so that no task sees all rows."""
    v, kind = normalised(df, value)
    agg = {"min": F.min, "max": F.max, "count": F.count, "sum": wrapping_sum if kind == I64 else F.sum}[what](v)
    return df.withColumn(name, df.agg(agg).scalar())


def running_all(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Adds `name`, the running sum of whole numbers over all rows by a unique `order`: a total for each range and a running sum inside it."""
    v, _ = normalised(df, value)
    ranged = _ranged(df, [order])
    out = ranged.withColumn("__own", wrapping_sum_over(v, W.partitionBy("__range").orderBy(order))).withColumn("__before", _before(ranged, wrapping_sum(v)))
    both = F.when(F.col("__own").isNull() & (F.col("__before") == 0), None).otherwise(wrapping_add(F.coalesce("__own", F.lit(0).cast("bigint")), F.col("__before")))
    return out.withColumn(name, both).drop("__range", "__own", "__before")


def over(df: DataFrame, value: str, window: WindowSpec, what: str = "sum") -> Column:
    v, kind = normalised(df, value)
    if what == "sum":
        return wrapping_sum_over(v, window) if kind == I64 else F.sum(v).over(window)
    return {"min": F.min, "max": F.max, "count": F.count}[what](v).over(window)


def running(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), what: str = "sum") -> Column:
    """The default frame: from the first row to the current one and its peers."""
    return over(df, value, W.partitionBy(*by).orderBy(*order), what)


def sliding(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), preceding: int = 2, what: str = "sum") -> Column:
    return over(df, value, W.partitionBy(*by).orderBy(*order).rowsBetween(-preceding, 0), what)


def ranks(order: Sequence[str], by: Sequence[str]) -> dict[str, Column]:
    w = W.partitionBy(*by).orderBy(*order)
    return {"rank": F.rank().over(w).cast("bigint"), "dense_rank": F.dense_rank().over(w).cast("bigint"), "ntile": F.ntile(4).over(w).cast("bigint")}


def lag_lead(value: str, order: Sequence[str], by: Sequence[str], distance: int = 1) -> dict[str, Column]:
    w = W.partitionBy(*by).orderBy(*order)
    return {"lag": F.lag(value, distance).over(w), "lead": F.lead(value, distance).over(w)}
