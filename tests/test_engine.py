
import math

import pytest

from emberframe import functions as fn
from emberframe.operators import JOIN_KINDS, Store, join_count, join_rows, join_sum, list_join
from emberframe.sources import csv_to_flat, generated, join_fixture, read_flat, series, write_flat
from emberframe.sqlsurface import SqlSurface, rewrite
from emberframe.types import F64, EngineError


@pytest.fixture
def joined(spark):
    store = Store(spark)
    store.upload_pair("p", spark.createDataFrame([(1, 10), (2, 20), (3, 30), (2, 25)], "k bigint, v bigint"), "k", "v", order_by="v")
    store.upload("b", spark.createDataFrame([(2,), (2,), (5,)], "k int"), "k", order_by="k")
    return store


def test_sums(spark):
    assert fn.summary(series(spark, 1_000_000), "v").first()["sum"] == 499_999_500_000
    assert fn.summary(spark.sql("SELECT bigint(id) AS v FROM range(0)"), "v").first()[:] == (None, None, None, 0)
    wrapped = spark.createDataFrame([(2**63 - 1,), (1,)], "v bigint")
    assert fn.summary(wrapped, "v").first()["sum"] == -(2**63)
    mixed = spark.sql("SELECT (id * 7919 + 13) % 1000003 - 500000 AS v FROM range(100000)")
    assert fn.summary(mixed, "v").first()[1:3] == (-499_999, 499_972)
    nan = spark.createDataFrame([(float("nan"),), (5.0,), (-2.5,)], "v double")
    row = fn.summary(nan, "v").first()
    assert row["min"] == -2.5 and math.isnan(row["max"])
    with pytest.raises(EngineError):
        fn.summary(spark.createDataFrame([("x",)], "v string"), "v")
    assert dict(fn.summary(spark.createDataFrame([(1,)], "v int"), "v").dtypes)["min"] == "bigint"


def test_row_number(spark):
    df = spark.createDataFrame([(40, 0), (10, 1), (30, 2), (10, 3), (20, 4)], "key bigint, pos bigint")
    assert [r["row_number"] for r in fn.row_number(df, "key", "pos").orderBy("pos").collect()] == [5, 1, 4, 2, 3]
    assert fn.row_number(df.where("false"), "key", "pos").collect() == []


def test_joins(joined):
    want = {"inner": (90, 4), "left": (130, 6), "semi": (45, 2), "anti": (40, 2), "right": (90, 5), "full": (130, 7)}
    for kind in JOIN_KINDS:
        for hint in (None, "broadcast", "merge", "shuffle_hash"):
            assert (join_sum(joined, kind, "p.k", "p.v", "b", hint=hint), join_count(joined, kind, "p.k", "b")) == want[kind]
    assert sorted(map(tuple, join_rows(joined, "p.k", "b", "INNER").collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    with pytest.raises(EngineError, match="4 rows"):
        join_rows(joined, "p.k", "b", "inner", cap=3)
    with pytest.raises(EngineError):
        join_rows(joined, "p.k", "b", "cross")


def test_list_join(spark):
    assert list_join(spark, [10, 20, 30], [20, 40, 99]).collect() == [(0, 1)]
    assert list_join(spark, [7, 7], [7]).collect() == [(0, 0)]


def test_store(spark, joined):
    assert joined.sum("p.v") == 85 and joined.info("p.v") == "dtype=I64 rows=4 device=spark"
    assert "reason=Hot_Cached" in joined.last_stats()
    assert joined.upload("none", spark.createDataFrame([(None,)], "v bigint"), "v") is None and "none" not in joined.names()
    with pytest.raises(EngineError):
        joined.sum_f64("p.v")
    with pytest.raises(EngineError):
        joined.lookup("none")
    assert joined.sum(None) is None and joined.drop(None) is None
    assert joined.drop("b") is True and joined.drop("b") is False
    with pytest.raises(EngineError, match="cap"):
        Store(spark, cap_bytes=10).upload("x", series(spark, 10), "v")


def test_sql(joined):
    sql = SqlSurface(joined)
    row = sql.run("SELECT hot_left_join_sum_resident('p.k', 'p.v', 'b'), hot_anti_join_count_resident('p.k', 'b'), hot_sum_resident(NULL)").first()
    assert row[:] == (130, 2, None)
    assert sql.run("UPLOAD q AS SELECT id FROM range(5)").first()[0] == 5
    assert sql.run("SELECT hot_sum_resident('q')").first()[0] == 10
    assert sql.run("SELECT hot_sum(v) FILTER (WHERE v > 1) FROM VALUES (1), (2), (3) t(v)").first()[0] == 5
    with pytest.raises(Exception, match="no resident column"):
        sql.run("SELECT hot_sum_resident('zz')").collect()
    assert rewrite("SELECT hot_max(')') FROM t") == "SELECT max(')') FROM t"


def test_flat_files(spark, tmp_path):
    write_flat(generated(spark, 1000), str(tmp_path / "i"))
    assert read_flat(spark, str(tmp_path / "i")).count() == 1000
    write_flat(generated(spark, 10, F64), str(tmp_path / "f"), F64)
    assert read_flat(spark, str(tmp_path / "f")).dtypes == [("v", "double")]
    (tmp_path / "c.csv").write_text("1\n\n2\n3\n")
    csv_to_flat(spark, str(tmp_path / "c.csv"), str(tmp_path / "c"))
    assert read_flat(spark, str(tmp_path / "c")).agg({"v": "sum"}).first()[0] == 6
    part = next((tmp_path / "c").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-4])
    with pytest.raises(Exception, match="truncated"):
        read_flat(spark, str(tmp_path / "c")).collect()
    build, probe = join_fixture(spark, 10, 100)
    assert build.count() == 10 and probe.count() == 100


def test_row_joins_over_whole_tables(spark):
    from emberframe.queries import QUERIES

    d = "/root/testdata/sf0.001"
    side = lambda t, k, i: [r[0] for r in spark.read.parquet(f"{d}/{t}.parquet").orderBy(i).select(k).collect()]
    p, b = side("supplier", "s_nationkey", "s_suppkey"), side("customer", "c_nationkey", "c_custkey")
    inner = {(i, j) for i, x in enumerate(p) for j, y in enumerate(b) if x == y}
    alone = {(i, None) for i, x in enumerate(p) if x not in b}
    want = {"inner": inner, "left": inner | alone, "semi": {(i, None) for i, x in enumerate(p) if x in b}, "anti": alone}
    for kind, rows in want.items():
        got = [tuple(r) for r in QUERIES[f"join_rows_{kind}"](spark, d).select("probe_idx", "build_idx").collect()]
        assert len(got) == len(rows) and set(got) == rows


def test_running_over_whole_events(spark):
    from collections import Counter

    from emberframe.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want, totals = [], Counter()
    for e, kind in sorted((r[0], r[1]) for r in spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type").collect()):
        totals[kind] += e
        want.append((e, totals[kind]))
    assert sorted(tuple(r) for r in QUERIES["window_running"](spark, d).collect()) == want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_wrapping_sums(spark, ansi):
    from pyspark.sql import functions as F

    from emberframe.types import wrapping_sum, wrapping_sum_sql

    wrap = lambda n: (n + 2**63) % 2**64 - 2**63
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for values in ([2**63 - 1, 1], [-(2**63), -1], [5, -7, 3], [2**63 - 1] * 5, [-(2**63)] * 3 + [17]):
            df = spark.createDataFrame([(v,) for v in values], "v bigint")
            times = 3_000_000_000
            assert df.agg(wrapping_sum(F.col("v")), wrapping_sum(F.col("v"), F.lit(times)), F.expr(wrapping_sum_sql("v"))).first()[:] == (wrap(sum(values)), wrap(times * sum(values)), wrap(sum(values)))
        if ansi == "false":
            return
        rows = spark.range(2_200_000_000).select(F.lit(4_294_967_295).alias("v"))  # over 2 ** 31 rows
        assert fn.summary(rows, "v").first()["sum"] == wrap(2_200_000_000 * 4_294_967_295)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def test_windows_without_partitions(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11 - 5) for i in range(2000)], "i bigint, v bigint").repartition(5)
    total = 0
    for r in fn.running_all(df, "v", "i", "t").orderBy("i").collect():
        total += r["v"]
        assert r["t"] == total
    assert {r["t"] for r in fn.over_all(df, "v", "t").collect()} == {total}
    assert [r["n"] for r in fn.numbered(df, ["v", "i"], "n").orderBy("v", "i").collect()] == list(range(1, 2001))
    assert fn.running_all(df.where("false"), "v", "i", "t").collect() == []


def test_numbers_by_any_type(spark):
    from datetime import date, datetime, timedelta
    from decimal import Decimal

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def row(i):
        real = [None, float("nan"), float("-inf"), i * 0.37 % 1][i % 4]
        return i, [None, date(2000, 1, 1) + timedelta(i % 900)][i % 2], [None, 'a"\\é' + str(i % 50)][i % 3 > 0], real, datetime(2020, 1, 1, microsecond=i), Decimal(i % 300) / 100, bytes([i % 256]), i % 2 == 0

    df = spark.createDataFrame([row(i) for i in range(1500)], "i bigint, d date, t string, f double, ts timestamp, dc decimal(10,2), b binary, o boolean").repartition(6)
    for c in df.columns[1:]:
        places = fn.numbered(df, [c, "i"], "n").withColumn("all", F.row_number().over(Window.orderBy(c, "i")))
        assert places.where("n <> `all`").count() == 0, c


SCENARIOS = {
    "many copies": ([i % 97 for i in range(900)], [i % 53 for i in range(400)]),
    "scattered": ([(i * 2654435761) % 2**32 for i in range(500)], [(i * 2654435761) % 2**32 for i in range(0, 500, 3)]),
    "one hot key": ([7 if i % 10 else i for i in range(800)], [7] * 90 + list(range(10))),
    "boundaries": ([2**63 - 1, -(2**63), 0, -1] * 3, [2**63 - 1, -(2**63)]),
    "negative": ([-i for i in range(200)], [-i for i in range(0, 300, 2)]),
    "none": (list(range(50)), list(range(100, 150))),
    "all": (list(range(50)), list(range(50))),
    "one probe row": ([3], [3, 3, 4]),
    "one build row": ([3, 3, 4], [3]),
    "large build": ([5, 9], list(range(3000))),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_join_scenarios(spark, name):
    from collections import Counter

    probe, build = SCENARIOS[name]
    times = Counter(build)
    many = {"inner": lambda m: m, "left": lambda m: max(m, 1), "semi": lambda m: int(m > 0), "anti": lambda m: int(m == 0)}
    for payload, dtype in (([i % 1000 for i in range(len(probe))], "I64"), ([i / 4 for i in range(len(probe))], F64)):
        store = Store(spark)
        store.upload_pair("p", spark.createDataFrame(list(zip(probe, payload, strict=True)), f"k bigint, v {'bigint' if dtype == 'I64' else 'double'}"), "k", "v")
        store.upload("b", spark.createDataFrame([(k,) for k in build], "k bigint"), "k")
        for kind, f in many.items():
            used = [(v, f(times[k])) for k, v in zip(probe, payload, strict=True) if f(times[k])]
            want = sum(v * n for v, n in used) if used else None
            for hint in (None, "merge"):
                assert join_sum(store, kind, "p.k", "p.v", "b", dtype, hint) == want
            assert join_count(store, kind, "p.k", "b") == sum(n for _, n in used)
        store.clear()


def test_grouped_upload(spark):
    store = Store(spark)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", None)], "n string, v bigint")
    assert store.upload_grouped(rows, "n", "v") == {"a": 2, "b": 1}
    assert store.sum("a") == 4 and store.drop("a") and store.sum("b") == 2
    with pytest.raises(EngineError, match="name"):
        store.upload_grouped(rows.union(spark.sql("SELECT CAST(NULL AS STRING), 5L")), "n", "v")
    with pytest.raises(EngineError, match="cap"):
        Store(spark, cap_bytes=10).upload_grouped(rows, "n", "v")
    assert store.upload_grouped(rows.where("false"), "n", "v") == {}


@pytest.mark.parametrize("append", [False, True])
def test_stream(spark, tmp_path, append):
    from emberframe.streaming import refresh_from_stream

    source, store = tmp_path / "in", Store(spark)
    source.mkdir()
    for i in range(3):
        (source / f"{i}.csv").write_text(f"{10**i}\n")
    stream = spark.readStream.schema("v bigint").option("maxFilesPerTrigger", 1).csv(str(source))
    query = refresh_from_stream(store, "s", stream, "v", str(tmp_path / "checkpoint"), append)
    query.processAllAvailable()
    query.stop()
    assert store.sum("s") == (111 if append else store.max("s"))
    assert store.lookup("s").rows == (3 if append else 1)


def test_sql_rows_and_runner(joined, spark, tmp_path, monkeypatch, capsys):
    from emberframe import sqlsurface

    sql = SqlSurface(joined, row_cap=3)
    with pytest.raises(EngineError, match="4 rows"):
        sql.run("SELECT * FROM hot_join_rows_resident('p.k', 'b', 'inner')")
    with pytest.raises(EngineError, match="'zz'"):
        sql.run("SELECT * FROM hot_join_rows_resident('p.k', 'zz', 'semi')")
    with pytest.raises(EngineError, match="cross"):
        sql.run("SELECT * FROM hot_join_rows_resident('p.k', 'b', 'cross')")
    assert sql.run("SELECT count(*) FROM hot_join_rows_resident('p.k', 'b', 'SEMI') r").first()[0] == 2
    sql.run("SELECT hot_sum_resident('p.v')").collect()
    assert "op=sql_sum" in sql.run("SELECT hot_last_stats()").first()[0]
    assert sqlsurface.statements("SELECT ';' AS a; -- x; y\nSELECT 2;\n") == ["SELECT ';' AS a", " -- x; y\nSELECT 2"]
    spark.range(3).write.parquet(str(tmp_path / "db" / "t.parquet"))
    out = tmp_path / "out.tsv"
    assert sqlsurface.main(["--db", str(tmp_path / "db"), "--multi", "--out", str(out), "--sql", "SELECT ';' AS a, NULL AS b; SELECT hot_sum(id) AS s FROM t"]) == 0
    assert out.read_text() == "a\tb\n;\tNULL\ns\n3\n"
    assert sqlsurface.main(["--sql", "SELECT * FROM nowhere"]) == 3


def test_forced_backend_is_ignored(spark, monkeypatch):
    """Another engine's switch changes nothing."""
    monkeypatch.setenv("EMBERFRAME_FORCE_BACKEND", "nothing")
    store = Store(spark)
    store.upload("x", series(spark, 10), "v")
    assert store.sum("x") == 45 and store.reduce_cold(series(spark, 10), "v", "sum") == 45
    assert "reason=Cold_Scan" in store.last_stats()


def test_copies(spark, tmp_path):
    from emberframe.sources import copy_from, copy_to

    rows = spark.createDataFrame([(1, "a,\"b\""), (2, ""), (3, None)], "i bigint, s string")
    for kind in ("parquet", "csv"):
        copy_to(rows, str(tmp_path / kind), kind)
        assert sorted(map(tuple, copy_from(spark, str(tmp_path / kind), kind, "i bigint, s string").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(EngineError):
        copy_to(rows, str(tmp_path / "x"), "orc")


def test_tools(spark, tmp_path, capsys):
    from emberframe.tools import main

    few = ["--runs", "1", "--rows", "500"]
    flat, source = str(tmp_path / "flat"), tmp_path / "numbers.csv"
    main(["gen", "--rows", "500", "--out", flat])
    assert read_flat(spark, flat).count() == 500
    source.write_text("1\n\n-2\n")
    main(["convert", "--source", str(source), "--out", str(tmp_path / "from_csv")])
    assert sorted(r[0] for r in read_flat(spark, str(tmp_path / "from_csv")).collect()) == [-2, 1]
    main(["reduce", *few, "--input", flat, "--op", "all"])
    main(["reduce", *few, "--dtype", "F64", "--op", "all", "--mode", "hot"])
    main(["groupby", *few, "--groups", "7"])
    main(["window", *few])
    main(["join", "--runs", "1", "--build", "50", "--probe", "400", "--skew", "2"])
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert [x[0] for x in lines] == ["reduce"] * 3 + ["groupby"] + ["window"] * 2 + ["join"] * 4
    assert all(float(x[-1]) > 0 for x in lines)


def _row_sides(spark, probe, build):
    """A store with the keys of the two lists as p and b, in the lists' order."""
    store = Store(spark)
    for name, keys in (("p", probe), ("b", build)):
        store.upload(name, spark.createDataFrame(list(enumerate(keys)), "i bigint, k bigint"), "k", order_by="i")
    return store


def _one_key(spark, probe, build):
    """A store with so many rows of one key on each side."""
    store = Store(spark)
    for name, rows in (("p", probe), ("b", build)):
        store.upload(name, spark.range(rows).selectExpr("7 AS k", "id"), "k", order_by="id")
    return store


def _row_sums(rows):
    """Rows, both sums, rows without a build row; and the most rows of a partition."""
    from pyspark.sql import functions as F

    parts = rows.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("probe_idx"), F.sum("build_idx"), F.expr("count_if(build_idx IS NULL)")).collect()
    return tuple(sum(r[i] for r in parts) for i in range(1, 5)), max(r[1] for r in parts)


#: Keys with many rows on both sides, on one, or without a match on the other.
ROW_PROBE, ROW_BUILD = [1] * 9 + [2, 3, 3, 4] + [5] * 8 + [-6] + [8] * 2, [1] * 7 + [2] * 10 + [3, 8] + [9] * 11 + [-6]


def test_inner_row_join_is_whole_at_every_size(spark):
    sums, most = _row_sums(join_rows(_one_key(spark, 10_001, 10_000), "p", "b", "inner"))
    assert sums == (100_010_000, 10_000 * sum(range(10_001)), 10_001 * sum(range(10_000)), 0)
    assert most < 50_000_000  # no task makes all pairs of the key
    store = _row_sides(spark, ROW_PROBE, ROW_BUILD)
    want = sorted((i, j) for i, x in enumerate(ROW_PROBE) for j, y in enumerate(ROW_BUILD) if x == y)
    for cell in (1, 3):
        assert sorted(map(tuple, join_rows(store, "p", "b", "inner", cell=cell).collect())) == want


def test_left_row_join_is_whole_at_every_size(spark):
    store = _one_key(spark, 10_001, 10_000)
    store.upload("p", spark.range(10_003).selectExpr("if(id < 10001, 7, 8) AS k", "id"), "k", order_by="id")
    sums, most = _row_sums(join_rows(store, "p", "b", "left"))
    assert sums == (100_010_002, 10_000 * sum(range(10_001)) + 10_001 + 10_002, 10_001 * sum(range(10_000)), 2)
    assert most < 50_000_000
    store = _row_sides(spark, ROW_PROBE, ROW_BUILD)
    want = {(i, j) for i, x in enumerate(ROW_PROBE) for j, y in enumerate(ROW_BUILD) if x == y} | {(i, None) for i, x in enumerate(ROW_PROBE) if x not in ROW_BUILD}
    for cell in (1, 3):
        got = list(map(tuple, join_rows(store, "p", "b", "left", cell=cell).collect()))
        assert len(got) == len(want) and set(got) == want


def test_sql_inner_row_join_is_whole_at_every_size(spark):
    sql = SqlSurface(_one_key(spark, 10_001, 10_000))
    sums, most = _row_sums(sql.run("SELECT probe_idx, build_idx FROM hot_join_rows_resident('p', 'b', 'Inner')"))
    assert sums == (100_010_000, 10_000 * sum(range(10_001)), 10_001 * sum(range(10_000)), 0) and most < 50_000_000


def test_sql_left_row_join_is_whole_at_every_size(spark):
    sql = SqlSurface(_one_key(spark, 10_001, 10_000))
    assert sql.run("UPLOAD p AS SELECT if(id < 10001, 7, 8), id FROM range(10003)").first()[0] == 10_003
    sums, most = _row_sums(sql.run("SELECT probe_idx, build_idx FROM hot_join_rows_resident('p', 'b', 'Left')"))
    assert sums == (100_010_002, 10_000 * sum(range(10_001)) + 10_001 + 10_002, 10_001 * sum(range(10_000)), 2) and most < 50_000_000
