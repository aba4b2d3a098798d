"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "sum_i64", "agg_all_fused", "groupby_high", "groupby_low", "q1_shape", "q6_shape", "join_inner_sum", "join_semi_sum_f64", "join_multiplicity",
    "join_filtered_q3", "row_number_global", "window_partition_running",
]


def timed(f, runs: int = 3) -> float:
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        out.append(time.perf_counter() - began)
    return round(min(out), 4)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from emberframe import queries
    from emberframe.operators import Store, join_sum

    took = {}
    for name in HEADLINE:
        took[name] = timed(lambda n=name: queries.QUERIES[n](spark, d).write.format("noop").mode("overwrite").save())
        spark.catalog.clearCache()
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    store = Store(spark)
    store.upload_pair("l", lines, "l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    store.upload("o", orders, "o_orderkey")
    store.multiplicities("o").count()
    took["hot_sum"] = timed(lambda: store.sum("l.v"))
    took["hot_agg_all"] = timed(lambda: store.agg_all("l.v"))
    took["hot_join_sum"] = timed(lambda: join_sum(store, "inner", "l.k", "l.v", "o"))
    took["hot_semi_join_sum"] = timed(lambda: join_sum(store, "semi", "l.k", "l.v", "o"))
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({"metric": "headline queries, total of best of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
