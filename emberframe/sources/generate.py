"""Series, seeded random columns, join fixtures, and CSV conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import F64, I64, EngineError
from .flat import write_flat


def series(spark: SparkSession, start: int, end: int | None = None) -> DataFrame:
    """range(n) or range(a, b) as column v."""
    return (spark.range(start) if end is None else spark.range(start, end)).withColumnRenamed("id", "v")


def generated(spark: SparkSession, rows: int, dtype: str = I64, seed: int = 42, spread: int = 1000, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Uniform whole numbers in [-spread, spread], or doubles in [lo, hi)."""
    u = F.rand(seed)
    if dtype == I64:
        v = F.floor(u * (2 * spread + 1)).cast("bigint") - spread
    elif dtype == F64:
        v = u * (hi - lo) + lo
    else:
        raise EngineError(f"unknown type {dtype!r}")
    return spark.range(rows).select(v.alias("v"))


def join_fixture(spark: SparkSession, build_rows: int, probe_rows: int, seed: int = 7, skew: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Sparse build keys (multiples of 1024); about one probe row in 32 misses; skew over 0 favours low keys."""
    build = spark.range(build_rows).select((1024 * (F.col("id") + 1)).alias("k"))
    u = F.pow(F.rand(seed), F.lit(1.0 + skew))
    key = 1024 * (F.floor(u * build_rows).cast("bigint") + 1)
    key = F.when(F.rand(seed + 1) < 1 / 32, key + 1).otherwise(key)
    return build, spark.range(probe_rows).select(key.alias("k"), (F.col("id") % 1000).alias("v"))


def csv_to_flat(spark: SparkSession, source: str, target: str, dtype: str = I64) -> None:
    """One number a line; blank lines are left out."""
    kind = "bigint" if dtype == I64 else "double"
    rows = spark.read.text(source).where(F.trim("value") != "").select(F.trim("value").cast(kind).alias("v"))
    write_flat(rows, target, dtype)
