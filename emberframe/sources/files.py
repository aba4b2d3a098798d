"""Copies of results to Parquet and CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..types import EngineError

KINDS = ("parquet", "csv")
_CSV = {"header": True, "nullValue": "\\N", "escape": '"'}


def copy_to(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes one file a partition; CSV files have a header, and null is \\\\N."""
    if kind not in KINDS:
        raise EngineError(f"unknown kind of file {kind!r}; one of {', '.join(KINDS)}")
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.options(**_CSV, emptyValue='""')
    writer.format(kind).save(path)


def copy_from(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Reads what copy_to has written; CSV needs the schema."""
    if kind not in KINDS:
        raise EngineError(f"unknown kind of file {kind!r}; one of {', '.join(KINDS)}")
    if kind == "csv":
        if schema is None:
            raise EngineError("CSV files have no types: give a schema")
        return spark.read.options(**_CSV, emptyValue="").schema(schema).csv(path)
    return spark.read.parquet(path)
