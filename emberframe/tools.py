"""python -m emberframe.tools reduce|groupby|window|join|gen|convert: timings over generated rows, and flat files.

A timing is a line of tab-separated fields, the best of the runs in seconds.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import group_sum, hot_max, hot_min, hot_sum, numbered, running_all, summary
from .operators import JOIN_KINDS, Store, join_sum
from .sources import csv_to_flat, generated, join_fixture, read_flat, write_flat
from .types import F64, I64

#: Rows by groups of the sweep of `groupby`.
SWEEP_ROWS, SWEEP_GROUPS = (100_000, 1_000_000, 10_000_000, 100_000_000), (10, 1_000, 100_000, 1_000_000)


def _best(run, runs: int) -> float:
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def _write(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _say(*fields) -> None:
    print("\t".join(f"{f:.4f}" if isinstance(f, float) else str(f) for f in fields))


def reduce(spark: SparkSession, o) -> None:
    """Cold over a scan, hot over a resident column."""
    df = read_flat(spark, o.input) if o.input else generated(spark, o.rows, o.dtype)
    df = df.select(F.col(df.columns[0]).alias("v"))
    if o.mode != "hot":
        run = (lambda: summary(df, "v").collect()) if o.op == "all" else lambda: df.agg({"sum": hot_sum, "min": hot_min, "max": hot_max}[o.op](df, "v")).collect()
        _say("reduce", o.op, "cold", _best(run, o.runs))
    if o.mode != "cold":
        store = Store(spark)
        store.upload("v", df, "v")
        total = store.sum_f64 if store.lookup("v").dtype == F64 else store.sum
        one = {"sum": total, "min": store.min, "max": store.max}
        if o.op == "all":
            one["all"] = store.agg_all if total == store.sum else lambda name: [f(name) for f in (total, store.min, store.max)]
        _say("reduce", o.op, "hot", _best(lambda: one[o.op]("v"), o.runs))


def groupby(spark: SparkSession, o) -> None:
    for rows in SWEEP_ROWS if o.sweep else (o.rows,):
        for groups in SWEEP_GROUPS if o.sweep else (o.groups,):
            df = spark.range(rows).select((F.hash("id") % groups).cast("bigint").alias("k"), F.col("id").alias("v"))
            _say("groupby", rows, groups, _best(lambda df=df, groups=groups: _write(group_sum(df, "k", "v", groups)), o.runs))


def window(spark: SparkSession, o) -> None:
    df = spark.range(o.rows).select(F.col("id").alias("i"), F.xxhash64("id").alias("v"))
    _say("window", "row_number", o.rows, _best(lambda: _write(numbered(df, ["v", "i"], "n")), o.runs))
    _say("window", "running_sum", o.rows, _best(lambda: _write(running_all(df, "v", "i", "t")), o.runs))


def join(spark: SparkSession, o) -> None:
    build, probe = join_fixture(spark, o.build, o.probe, skew=o.skew)
    store = Store(spark)
    store.upload("b", build, "k")
    store.upload_pair("p", probe, "k", "v")
    for kind in JOIN_KINDS[:4]:
        _say("join", kind, o.build, o.probe, o.skew, _best(lambda kind=kind: join_sum(store, kind, "p.k", "p.v", "b"), o.runs))


def gen(spark: SparkSession, o) -> None:
    write_flat(generated(spark, o.rows, o.dtype, o.seed), o.out, o.dtype)


def convert(spark: SparkSession, o) -> None:
    csv_to_flat(spark, o.source, o.out, o.dtype)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="emberframe.tools")
    tools = parser.add_subparsers(dest="tool", required=True)

    def tool(run, *options: tuple) -> None:
        p = tools.add_parser(run.__name__)
        p.set_defaults(run=run)
        for name, default in options:
            if isinstance(default, list):
                p.add_argument(name, choices=default, default=default[0])
            elif default is False:
                p.add_argument(name, action="store_true")
            elif default is str:
                p.add_argument(name, required=True)
            else:
                p.add_argument(name, type=str if default is None else type(default), default=default)

    rows, runs, dtype = ("--rows", 1_000_000), ("--runs", 3), ("--dtype", [I64, F64])
    tool(reduce, rows, runs, dtype, ("--input", None), ("--mode", ["both", "cold", "hot"]), ("--op", ["sum", "min", "max", "all"]))
    tool(groupby, rows, runs, ("--groups", 1000), ("--sweep", False))
    tool(window, rows, runs)
    tool(join, runs, ("--build", 100_000), ("--probe", 1_000_000), ("--skew", 0.0))
    tool(gen, rows, dtype, ("--seed", 42), ("--out", str))
    tool(convert, dtype, ("--source", str), ("--out", str))
    options = parser.parse_args(args)
    options.run(SparkSession.builder.getOrCreate(), options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
