"""The engine's registered queries over the test tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import agg_all, group_sum, lag_lead, over, over_all, ranks, row_number, running, running_all, sliding, summary
from .operators import Store, first_match_join, join_rows, list_join
from .operators.joins import join_frame
from .sources import copy_from, copy_to
from .sqlsurface import SqlSurface, rewrite
from .types import I64

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


# --- aggregates

for _what in ("sum", "min", "max"):
    _add(f"{_what}_i64", lambda s, d, w=_what: summary(_t(s, d, "lineitem"), "l_orderkey").select(w), f"SELECT {_what}(l_orderkey)::BIGINT AS {_what} FROM lineitem")
_add("sum_f64", lambda s, d: summary(_t(s, d, "lineitem"), "l_quantity").select(F.round("sum", 2).alias("sum")), "SELECT round(sum(l_quantity), 2) AS sum FROM lineitem")
for _what in ("min", "max"):
    _add(f"{_what}_f64", lambda s, d, w=_what: summary(_t(s, d, "lineitem"), F.col("l_tax") + 0.0).select(w), f"SELECT {_what}(l_tax + 0.0) AS {_what} FROM lineitem")
_add("agg_widen_int", lambda s, d: summary(_t(s, d, "lineitem"), "l_linenumber"), "SELECT sum(l_linenumber)::BIGINT AS sum, min(l_linenumber)::BIGINT AS min, max(l_linenumber)::BIGINT AS max, count(l_linenumber) AS count FROM lineitem")
_add("agg_nulls", lambda s, d: summary(_t(s, d, "lineitem"), F.when(F.col("l_orderkey") % 2 == 1, F.col("l_orderkey"))), "SELECT sum(v)::BIGINT AS sum, min(v) AS min, max(v) AS max, count(v) AS count FROM (SELECT CASE WHEN l_orderkey % 2 = 1 THEN l_orderkey END AS v FROM lineitem)")
_add("agg_all_null", lambda s, d: summary(_t(s, d, "lineitem"), F.lit(None).cast("bigint"), ["l_returnflag"]), "SELECT l_returnflag, sum(v)::BIGINT AS sum, min(v) AS min, max(v) AS max, count(v) AS count FROM (SELECT l_returnflag, NULL::BIGINT AS v FROM lineitem) GROUP BY 1")
_add("agg_empty", lambda s, d: summary(_t(s, d, "lineitem").where("l_orderkey < 0"), "l_orderkey"), "SELECT sum(l_orderkey)::BIGINT AS sum, min(l_orderkey) AS min, max(l_orderkey) AS max, count(l_orderkey) AS count FROM lineitem WHERE l_orderkey < 0")
_add("agg_nan", lambda s, d: summary(_t(s, d, "lineitem"), F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax") + 0.0), ["l_returnflag"]).select("l_returnflag", "min", F.isnan("max").alias("max_is_nan")), "SELECT l_returnflag, min(v) AS min, isnan(max(v)) AS max_is_nan FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_tax + 0.0 END AS v FROM lineitem) GROUP BY 1")
_add("agg_filter_clause", lambda s, d: summary(_t(s, d, "lineitem"), "l_orderkey", ["l_linestatus"], where=F.col("l_returnflag") == "R").select("l_linestatus", "sum", "count"), "SELECT l_linestatus, sum(l_orderkey) FILTER (WHERE l_returnflag = 'R')::BIGINT AS sum, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS count FROM lineitem GROUP BY 1")
_add("agg_having", lambda s, d: summary(_t(s, d, "lineitem"), "l_linenumber", ["l_orderkey"], having="sum > 20").select("l_orderkey", "sum"), "SELECT l_orderkey, sum(l_linenumber)::BIGINT AS sum FROM lineitem GROUP BY 1 HAVING sum(l_linenumber) > 20")
_add("agg_all_fused", lambda s, d: summary(_t(s, d, "orders"), "o_orderkey"), "SELECT sum(o_orderkey)::BIGINT AS sum, min(o_orderkey) AS min, max(o_orderkey) AS max, count(*) AS count FROM orders")
_add("groupby_low", lambda s, d: summary(_t(s, d, "lineitem").withColumn("c", _cents("l_extendedprice")), "c", ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, sum(c)::BIGINT AS sum, min(c) AS min, max(c) AS max, count(c) AS count FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem) GROUP BY 1, 2")
_add("groupby_high", lambda s, d: group_sum(_t(s, d, "lineitem"), "l_orderkey", "l_linenumber", expected_groups=20_000), "SELECT l_orderkey AS key, sum(l_linenumber)::BIGINT AS sum FROM lineitem GROUP BY 1")
_add("groupby_text", lambda s, d: summary(_t(s, d, "events"), "user_id", ["event_type"]), "SELECT event_type, sum(user_id)::BIGINT AS sum, min(user_id) AS min, max(user_id) AS max, count(user_id) AS count FROM events GROUP BY 1")
_add("groupby_checksum", lambda s, d: group_sum(_t(s, d, "lineitem"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("groups"), F.max("sum").alias("top")), "SELECT count(*) AS groups, max(s)::BIGINT AS top FROM (SELECT sum(l_linenumber) AS s FROM lineitem GROUP BY l_orderkey)")
_add("avg_by_flag", lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("avg_qty")), "SELECT l_returnflag, round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY 1")
_add("q1_shape", lambda s, d: _t(s, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum(_cents("l_quantity")).alias("qty"), F.sum(_cents("l_extendedprice")).alias("price"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
_Q6 = "l_shipdate >= {0} '1996-01-01' AND l_shipdate < {0} '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
_add("q6_shape", lambda s, d: summary(_t(s, d, "lineitem").where(_Q6.format("TIMESTAMP_NTZ")), _cents("l_extendedprice")).select("sum", "count"), f"SELECT sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum, count(*) AS count FROM lineitem WHERE {_Q6.format('TIMESTAMP')}")
_add("sum_wrap", lambda s, d: summary(_t(s, d, "lineitem"), F.lit(9223372036854775807) - F.col("l_linenumber")).select("sum"), "SELECT (CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END)::BIGINT AS sum FROM (SELECT ((s % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS m FROM (SELECT sum(9223372036854775807::HUGEINT - l_linenumber) AS s FROM lineitem))")

# --- the resident store


def _resident(what: str, column, dtype=None) -> Query:
    def run(s, d):
        store = Store(s)
        store.upload("c", _t(s, d, "lineitem"), column)
        return store.reduce_frame("c", what, dtype).withColumnRenamed("value", what)

    return run


for _what in ("sum", "min", "max"):
    _add(f"resident_{_what}", _resident(_what, "l_partkey"), f"SELECT {_what}(l_partkey)::BIGINT AS {_what} FROM lineitem")
_add("resident_sum_f64", lambda s, d: _resident("sum", "l_quantity")(s, d).select(F.round("sum", 2).alias("sum")), "SELECT round(sum(l_quantity), 2) AS sum FROM lineitem")
def _minmax_f64(s, d):
    store = Store(s)
    store.upload("c", _t(s, d, "lineitem"), "l_quantity")
    return store.reduce_frame("c", "min").withColumnRenamed("value", "min").withColumn("max", store.reduce_frame("c", "max").scalar())


_add("resident_minmax_f64", _minmax_f64, "SELECT min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem")


def _replace(s, d):
    store = Store(s)
    store.upload("c", _t(s, d, "lineitem"), "l_orderkey")
    store.upload("c", _t(s, d, "orders"), "o_custkey")
    return store.reduce_frame("c", "sum").withColumnRenamed("value", "sum")


_add("resident_replace", _replace, "SELECT sum(o_custkey)::BIGINT AS sum FROM orders")


def _grouped(s, d):
    store = Store(s)
    names = store.upload_grouped(_t(s, d, "events"), "event_type", "user_id")
    parts = [store.reduce_frame(n, "sum").select(F.lit(n).alias("event_type"), F.col("value").alias("sum")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_add("resident_group_upload", _grouped, "SELECT event_type, sum(user_id)::BIGINT AS sum FROM events GROUP BY 1")

# --- joins: probe orders, build line items, and the other way round for right and full


def _fused(kind: str, what: str, swap: bool = False, shift: int = 0) -> Query:
    def run(s, d):
        o = _t(s, d, "orders").select((F.col("o_orderkey") + shift).alias("k"), _cents("o_totalprice").alias("c"))
        l = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), _cents("l_extendedprice").alias("c"))
        probe, build = (l, o) if swap else (o, l)
        store = Store(s)
        store.upload_pair("p", probe, "k", F.col("c") / 4.0 if what == "sum_f64" else "c")
        store.upload("b", build, "k")
        p = store.lookup("p.k").frame.select(F.col("k").alias("key"), F.col("v").alias("value"))
        dtype = {"sum": I64, "count": None, "sum_f64": "F64"}[what]
        out = join_frame(p, store.multiplicities("b"), kind, dtype)
        if what == "sum_f64":
            return out.select(F.round("sum", 1).alias("sum_f64"))
        return out.select(F.col("sum") if what == "sum" else F.col("matched").alias("count"))

    return run


def _fused_sql(kind: str, what: str, swap: bool = False, shift: int = 0) -> str:
    o = f"SELECT o_orderkey + {shift} AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders"
    l = "SELECT l_orderkey AS k, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem"  # noqa: E741
    p, b = (l, o) if swap else (o, l)
    value = {"sum": "sum(p.c)::BIGINT AS sum", "count": "count(*) AS count", "sum_f64": "round(sum(p.c / 4.0), 1) AS sum_f64"}[what]
    if kind in ("semi", "anti"):
        return f"SELECT {value} FROM ({p}) p WHERE {'NOT ' * (kind == 'anti')}EXISTS (SELECT 1 FROM ({b}) b WHERE b.k = p.k)"
    return f"SELECT {value} FROM ({p}) p {kind.upper()} JOIN ({b}) b ON p.k = b.k"


for _kind in ("inner", "left", "semi", "anti"):
    for _what in ("sum", "count", "sum_f64"):
        _add(f"join_{_kind}_{_what}", _fused(_kind, _what), _fused_sql(_kind, _what))
for _kind in ("right", "full"):
    for _what in ("sum", "count"):
        _add(f"join_{_kind}_{_what}", _fused(_kind, _what, swap=True), _fused_sql(_kind, _what, swap=True))
_add("join_multiplicity", _fused("inner", "sum", swap=True), _fused_sql("inner", "sum", swap=True))
_add("join_nomatch", _fused("inner", "sum", shift=100_000_000), _fused_sql("inner", "sum", shift=100_000_000))
_add("join_nomatch_count", _fused("inner", "count", shift=100_000_000), _fused_sql("inner", "count", shift=100_000_000))


def _filtered(s, d):
    build = _t(s, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'").groupBy(F.col("o_orderkey").alias("key")).agg(F.count("*").alias("m"))
    probe = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), _cents("l_extendedprice").alias("value"))
    return join_frame(probe, build, "inner", I64).select("sum", "matched")


_add("join_filtered_q3", _filtered, "SELECT sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum, count(*) AS matched FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01'")


def _membership(s, d):
    few = _t(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey")).distinct()
    return _t(s, d, "orders").join(few, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum(_cents("o_totalprice")).alias("cents"))


_add("join_membership", _membership, "SELECT count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)")


_P = "(SELECT s_nationkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) p"
def _rows(kind: str) -> Query:
    def run(s, d):
        store = Store(s)
        store.upload("p", _t(s, d, "supplier"), "s_nationkey", order_by="s_suppkey")
        store.upload("b", _t(s, d, "customer"), "c_nationkey", order_by="c_custkey")
        return join_rows(store, "p", "b", kind)

    return run


_B = "(SELECT c_nationkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) b"
for _kind in ("inner", "left"):
    _add(f"join_rows_{_kind}", _rows(_kind), f"SELECT p.i AS probe_idx, b.i AS build_idx FROM {_P} {_kind.upper()} JOIN {_B} ON p.k = b.k")
for _kind in ("semi", "anti"):
    _add(f"join_rows_{_kind}", _rows(_kind), f"SELECT p.i AS probe_idx, NULL::BIGINT AS build_idx FROM {_P} WHERE {'NOT ' * (_kind == 'anti')}EXISTS (SELECT 1 FROM {_B} WHERE b.k = p.k)")


def _first_match(s, d):
    b = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("idx"))
    p = _t(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("idx"))
    return first_match_join(b, p)


_add("list_join_first_match", _first_match, "SELECT o_orderkey AS probe_idx, min(l_partkey) AS build_idx FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")

def _lists(s, d):
    """Two small columns as arrays, as the list join takes them."""
    b = [r[0] for r in _t(s, d, "nation").orderBy("n_nationkey").select("n_regionkey").collect()]
    return list_join(s, b, [r[0] for r in _t(s, d, "region").orderBy("r_regionkey").select("r_regionkey").collect()])


_add("list_join_arrays", _lists, "SELECT p.i AS probe_idx, min(b.i) AS build_idx FROM (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) p JOIN (SELECT n_regionkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) b ON p.k = b.k GROUP BY 1")

# --- the SQL surface: every function by name, over resident columns


def _statement(text: str) -> Query:
    """p: orders, indexed pair; f: the same with doubles; b: line items; n, m: nations of suppliers and customers; q: a double."""

    def run(s, d):
        store = Store(s)
        o = _t(s, d, "orders")
        if "'p." in text:
            store.upload_pair("p", o, "o_orderkey", _cents("o_totalprice"))
        if "'f." in text:
            store.upload_pair("f", o, "o_orderkey", _cents("o_totalprice") / 4.0)
        if "'b'" in text:
            store.upload("b", _t(s, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")
        if "'n'" in text:
            store.upload("n", _t(s, d, "supplier"), "s_nationkey", order_by="s_suppkey")
            store.upload("m", _t(s, d, "customer"), "c_nationkey", order_by="c_custkey")
        if "'q'" in text:
            store.upload("q", _t(s, d, "lineitem"), "l_quantity")
        surface = SqlSurface(store)
        out = None
        for one in text.split(";"):
            out = surface.run(one)
        return out

    return run


for _what in ("sum", "min", "max"):
    _add(f"sql_{_what}_resident", _statement(f"SELECT hot_{_what}_resident('p.v') AS v"), f"SELECT {_what}(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM orders")
    _add(f"sql_{_what}_resident_f64", _statement(f"SELECT round(hot_{_what}_resident_f64('q'), 2) AS v"), f"SELECT round({_what}(l_quantity), 2) AS v FROM lineitem")
_SIDE = "(SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') b"
for _kind, _name in (("inner", "join"), ("left", "left_join"), ("semi", "semi_join"), ("anti", "anti_join")):
    _from = f"orders {_kind.upper()} JOIN {_SIDE} ON o_orderkey = b.k" if _kind in ("inner", "left") else f"orders WHERE {'NOT ' * (_kind == 'anti')}EXISTS (SELECT 1 FROM {_SIDE} WHERE b.k = o_orderkey)"
    _add(f"sql_{_name}_sum", _statement(f"SELECT hot_{_name}_sum_resident('p.k', 'p.v', 'b') AS v"), f"SELECT sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM {_from}")
    _add(f"sql_{_name}_sum_f64", _statement(f"SELECT round(hot_{_name}_sum_resident_f64('f.k', 'f.v', 'b'), 1) AS v"), f"SELECT round(sum(round(o_totalprice * 100)::BIGINT / 4.0), 1) AS v FROM {_from}")
    _add(f"sql_{_name}_count", _statement(f"SELECT hot_{_name}_count_resident('p.k', 'b') AS v"), f"SELECT count(*) AS v FROM {_from}")
    _add(f"sql_join_rows_{_kind}", _statement(f"SELECT probe_idx, build_idx FROM hot_join_rows_resident('n', 'm', '{_kind.title()}')"), SQL[f"join_rows_{_kind}"])
_add("sql_list_join", _statement("SELECT * FROM hot_inner_join(array(10, 20, 30, 20), array(20, 40, 99, 20, 10))"), "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (3, 1), (4, 0)) t(probe_idx, build_idx)")
_add("sql_resident_info", _statement("SELECT hot_resident_info('b') AS info, hot_resident_info(NULL) AS none"), "SELECT 'dtype=I64 rows=' || count(*) || ' device=spark' AS info, NULL::VARCHAR AS none FROM lineitem WHERE l_returnflag = 'R'")
_add("sql_drop_resident", _statement("SELECT 'b'; DROP RESIDENT 'b'; DROP RESIDENT 'b'"), "SELECT false AS dropped")
_add("sql_last_stats", _statement("SELECT hot_sum_resident('p.v'); SELECT regexp_extract(hot_last_stats(), 'op=(\\\\w+)', 1) AS op, regexp_extract(hot_last_stats(), 'reason=(\\\\w+)', 1) AS reason"), "SELECT 'sql_sum' AS op, 'Hot_Cached' AS reason")
_add("sql_build_info", _statement("SELECT hot_build_info() LIKE 'compiled=spark-%runtime=%' AS ok"), "SELECT true AS ok")
_add("agg_all_empty", lambda s, d: s.createDataFrame([tuple(agg_all(_t(s, d, "orders").where("o_orderkey < 0"), "o_orderkey").values())], "sum bigint, min bigint, max bigint, count bigint"), "SELECT 0::BIGINT AS sum, 9223372036854775807 AS min, (-9223372036854775807 - 1)::BIGINT AS max, 0::BIGINT AS count")


def _cold_reduce(s, d):
    store = Store(s)
    value = store.reduce_cold(_t(s, d, "lineitem"), "l_partkey", "sum")
    return s.createDataFrame([(value, store.last_decision.reason.value)], "sum bigint, reason string")


_add("plan_cold_reduce", _cold_reduce, "SELECT sum(l_partkey)::BIGINT AS sum, 'Cold_Scan' AS reason FROM lineitem")


def _copied(kind: str) -> Query:
    """Orders written to files of the kind and read again."""

    def run(s, d):
        import tempfile

        path = f"{s.sparkContext.getConf().get('spark.checkpoint.dir', None) or 'file://' + tempfile.gettempdir()}/emberframe-copy-{uuid.uuid4().hex}"
        rows = _t(s, d, "orders").select("o_orderkey", "o_orderpriority", _cents("o_totalprice").alias("cents"))
        copy_to(rows, path, kind)
        return copy_from(s, path, kind, "o_orderkey bigint, o_orderpriority string, cents bigint")

    return run


for _kind in ("parquet", "csv"):
    _add(f"copy_{_kind}", _copied(_kind), "SELECT o_orderkey, o_orderpriority, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
_add("series_values", lambda s, d: s.sql("SELECT (SELECT bigint(sum(id)) FROM range(3, 1000)) AS series, (SELECT bigint(sum(x)) FROM VALUES (1), (NULL), (5) t(x)) AS listed"), "SELECT (SELECT sum(range)::BIGINT FROM range(3, 1000)) AS series, (SELECT sum(x)::BIGINT FROM (VALUES (1), (NULL), (5)) t(x)) AS listed")

# --- windows

_E = ["user_id", "event_id"]
_add("window_unbounded", lambda s, d: (e := _t(s, d, "events")).select("event_id", over(e, "user_id", W.partitionBy("event_type")).alias("total")), "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type)::BIGINT AS total FROM events")
_add("window_over_all", lambda s, d: over_all(over_all(over_all(_t(s, d, "events"), "user_id", "total"), "value", "lo", "min"), "value", "hi", "max").select("event_id", "total", "lo", "hi"), "SELECT event_id, sum(user_id) OVER ()::BIGINT AS total, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events")
_add("window_running_all", lambda s, d: running_all(_t(s, d, "events"), "user_id", "event_id", "total").select("event_id", "total"), "SELECT event_id, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS total FROM events")
_add("window_ntile", lambda s, d: _t(s, d, "events").select("event_id", ranks(["event_id"], ["user_id"])["ntile"].alias("ntile")), "SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS ntile FROM events")
_add("window_running", lambda s, d: (e := _t(s, d, "events")).select("event_id", running(e, "event_id", ["event_id"], ["event_type"]).alias("total")), "SELECT event_id, sum(event_id) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS total FROM events")
_add("window_partition_running", lambda s, d: (e := _t(s, d, "events")).select("event_id", running(e, "event_id", ["event_id"], ["user_id"]).alias("total")), "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events")
_add("window_minmax", lambda s, d: (e := _t(s, d, "events")).select("event_id", running(e, "value", ["event_id"], ["user_id"], "min").alias("lo"), running(e, "value", ["event_id"], ["user_id"], "max").alias("hi")), "SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
_add("row_number_global", lambda s, d: row_number(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_number"), "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders")
_add("rank_family", lambda s, d: _t(s, d, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey").distinct().withColumns(ranks(["l_linenumber"], ["l_orderkey"])).select("l_orderkey", "l_returnflag", "l_linenumber", "rank", "dense_rank"), "SELECT l_orderkey, l_returnflag, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_orderkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
_add("lag_lead", lambda s, d: _t(s, d, "events").select("event_id", *[c.alias(k) for k, c in lag_lead("event_id", ["event_id"], ["user_id"]).items()]), "SELECT event_id, lag(event_id) OVER w AS lag, lead(event_id) OVER w AS lead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
_add("sliding_sum", lambda s, d: (e := _t(s, d, "events")).select("event_id", sliding(e, "event_id", ["event_id"], ["user_id"], 3).alias("total")), "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING)::BIGINT AS total FROM events")
_add("top_k", lambda s, d: _t(s, d, "orders").select("o_orderkey", _cents("o_totalprice").alias("cents")).orderBy(F.desc("cents"), "o_orderkey").limit(10), "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders ORDER BY cents DESC, o_orderkey LIMIT 10")

# --- SQL that the engine passes to its host


def _sql(text: str, tables: str) -> Query:
    def run(s, d):
        for t in tables.split():
            _t(s, d, t).createOrReplaceTempView(t)
        return s.sql(rewrite(text))

    return run


for _name, _tables, _text, _duck in (
    ("host_case_cte_union", "orders", "WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS g, o_custkey AS v FROM orders), u AS (SELECT * FROM o UNION ALL SELECT 'c', -1) SELECT g, {sum} AS s FROM u GROUP BY g", "sum(v)::BIGINT"),
    ("host_exists", "orders lineitem", "SELECT {sum} AS s FROM (SELECT o_custkey AS v FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')) t", "sum(v)::BIGINT"),
    ("host_like_isdistinct", "customer", "SELECT {sum} AS s, count(*) AS n FROM (SELECT c_custkey AS v FROM customer WHERE c_mktsegment LIKE 'A%' OR (c_name NOT LIKE '%1%' AND c_nationkey IS NOT DISTINCT FROM 3)) t", "sum(v)::BIGINT"),
    ("host_scalar_subquery", "orders", "SELECT {sum} AS s, coalesce(max(abs(greatest(v, 5))), 0) AS g FROM (SELECT o_custkey AS v FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) t", "sum(v)::BIGINT"),
    ("host_typeof_concat", "orders", "SELECT {type} AS t, o_orderstatus || '-' || o_orderpriority AS k, {sum} AS s FROM (SELECT *, o_custkey AS v FROM orders) t GROUP BY 2", "sum(v)::BIGINT"),
    ("host_literals", "orders", "SELECT {sum} AS s, min(v) = -9223372036854775807 - 1 AS low, max(d) = CAST('inf' AS DOUBLE) AS up, min(d) = CAST('-inf' AS DOUBLE) AS down FROM (SELECT -9223372036854775807 - 1 AS v, CAST('inf' AS DOUBLE) AS d UNION ALL SELECT 9223372036854775807, CAST('-inf' AS DOUBLE) UNION ALL SELECT o_orderkey, 1.5 FROM orders) t", "(sum(v::HUGEINT))::BIGINT"),
    ("host_error_gate", "orders lineitem", "SELECT CASE WHEN (SELECT count(*) FROM lineitem) < (SELECT count(*) FROM orders) THEN {error}('parity') ELSE 'ok' END AS gate, {sum} AS s FROM (SELECT o_custkey AS v FROM orders) t", "sum(v)::BIGINT"),
    ("host_window", "events", "SELECT event_id, {sum} OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT *, event_id AS v FROM events) t", "sum(v)"),
):
    _duck_text = _text.replace("{type}", "lower(typeof(count(*)))").replace("{error}", "error").format(sum=_duck).replace("sum(v) OVER (PARTITION BY user_id ORDER BY event_id)", "sum(v) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT")
    _spark_text = _text.replace("{type}", "typeof(count(*))").replace("{error}", "raise_error")
    _add(_name, _sql(_spark_text.format(sum="hot_sum(v)"), _tables), _duck_text)


def _created(s, d):
    """A table made from a query, then read by a second statement."""
    surface = SqlSurface(Store(s))
    _t(s, d, "orders").createOrReplaceTempView("orders")
    surface.run("CREATE OR REPLACE TEMPORARY VIEW made AS SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1")
    return surface.run("SELECT bigint(sum(k)) AS s, max(n) AS top FROM made")


_add("host_multi_statement", _created, "SELECT sum(k)::BIGINT AS s, max(n) AS top FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)")
