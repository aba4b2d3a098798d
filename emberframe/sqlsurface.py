"""SQL over the store: scalar and table functions over views of the registry, and a statement runner.

Functions read views, so re-registering after an upload or drop is enough for
them to see it.  Uploads and drops are calls, not functions, since SQL functions
have no side effects; the runner takes them as statements of their own.
"""

from __future__ import annotations

import re
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import join_rows
from .operators.store import Store
from .plans.decisions import Reason
from .types import I64, EngineError, wrapping_sum_sql

def _wrap(v: str, times: str = "1L") -> str:
    return wrapping_sum_sql(v, times)


_KINDS = {
    "join": "coalesce(b.m, 0L)",
    "left_join": "greatest(coalesce(b.m, 0L), 1L)",
    "semi_join": "if(coalesce(b.m, 0L) > 0L, 1L, 0L)",
    "anti_join": "if(coalesce(b.m, 0L) = 0L, 1L, 0L)",
}


class SqlSurface:
    def __init__(self, store: Store, row_cap: int | None = None):
        self.store, self.spark, self.row_cap = store, store.spark, row_cap
        self.refresh()
        self._functions()

    def refresh(self) -> None:
        """Views: one row a value, one row a pair, one row a column, the last statistics."""
        spark, store = self.spark, self.store
        none = "CAST(NULL AS {}) AS {}"
        values = spark.sql(f"SELECT {none.format('STRING', 'name')}, {none.format('BIGINT', 'idx')}, {none.format('BIGINT', 'i64')}, {none.format('DOUBLE', 'f64')} WHERE false")
        pairs = spark.sql(f"SELECT {none.format('STRING', 'kname')}, {none.format('STRING', 'vname')}, {none.format('BIGINT', 'k')}, {none.format('BIGINT', 'i64')}, {none.format('DOUBLE', 'f64')} WHERE false")
        facts = [("", "", 0)][:0]
        for name in store.names():
            c = store.lookup(name)
            v, idx = F.col(c.column), F.col("idx") if c.indexed else F.lit(None).cast("bigint")
            i64, f64 = (v, F.lit(None).cast("double")) if c.dtype == I64 else (F.lit(None).cast("bigint"), v)
            values = values.unionByName(c.frame.select(F.lit(name).alias("name"), idx.alias("idx"), i64.alias("i64"), f64.alias("f64")))
            facts.append((name, c.dtype, c.rows))
            if c.column == "v" and name.endswith(".v"):
                pairs = pairs.unionByName(c.frame.select(F.lit(name[:-2] + ".k").alias("kname"), F.lit(name).alias("vname"), "k", i64.alias("i64"), f64.alias("f64")))
        values.createOrReplaceTempView("resident_values")
        pairs.createOrReplaceTempView("resident_pairs")
        keys = spark.sql(f"SELECT {none.format('STRING', 'name')}, {none.format('BIGINT', 'key')}, {none.format('BIGINT', 'm')} WHERE false")
        for name in store.names():
            if (c := store.lookup(name)).dtype == I64:
                keys = keys.unionByName(c.counts().select(F.lit(name).alias("name"), "key", "m"))
        keys.createOrReplaceTempView("resident_keys")
        spark.createDataFrame(facts, "name string, dtype string, rows bigint").createOrReplaceTempView("resident_columns")
        spark.createDataFrame([(store.last_stats(), store.build_info())], "stats string, build string").createOrReplaceTempView("resident_stats")

    def _functions(self) -> None:
        def known(name: str, dtype: str | None) -> str:
            check = "" if dtype is None else f" AND dtype = '{dtype}'"
            said = "concat('no resident column ', {0}" + ("" if dtype is None else f", ' of type {dtype}'") + ")"
            return f"coalesce((SELECT max(true) FROM resident_columns c WHERE c.name = {name}{check}), raise_error({said.format(name)}))"

        def define(signature: str, body: str) -> None:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

        for what, dtype, returns, agg in (("sum", "I64", "BIGINT", _wrap("i64")), ("min", "I64", "BIGINT", "min(i64)"), ("max", "I64", "BIGINT", "max(i64)"), ("sum", "F64", "DOUBLE", "sum(f64)"), ("min", "F64", "DOUBLE", "min(f64)"), ("max", "F64", "DOUBLE", "max(f64)")):
            tail = "_f64" if dtype == "F64" else ""
            define(f"hot_{what}_resident{tail}(n STRING) RETURNS {returns}", f"CASE WHEN n IS NULL THEN NULL WHEN {known('n', dtype)} THEN (SELECT {agg} FROM resident_values r WHERE r.name = n) END")
        # parameters may only stand in a subquery's WHERE: the build's name comes in as a column, and the optimiser pushes it down
        side = "JOIN resident_columns c LEFT JOIN resident_keys b ON b.name = c.name AND b.key = p.{} WHERE c.name = b_name"
        for kind, times in _KINDS.items():
            def fused(agg: str) -> str:
                return f"(SELECT {agg} FROM resident_pairs p {side.format('k')} AND p.kname = pk AND p.vname = pv)"

            given = "pk IS NULL OR pv IS NULL OR b_name IS NULL"
            keys = f"{known('pk', 'I64')} AND {known('b_name', 'I64')}"
            define(f"hot_{kind}_sum_resident(pk STRING, pv STRING, b_name STRING) RETURNS BIGINT", f"CASE WHEN {given} THEN NULL WHEN {keys} AND {known('pv', 'I64')} THEN {fused(_wrap(f'if({times} = 0L, NULL, p.i64)', times))} END")
            define(f"hot_{kind}_sum_resident_f64(pk STRING, pv STRING, b_name STRING) RETURNS DOUBLE", f"CASE WHEN {given} THEN NULL WHEN {keys} AND {known('pv', 'F64')} THEN {fused(f'sum({times} * if({times} = 0L, NULL, p.f64))')} END")
            define(f"hot_{kind}_count_resident(pk STRING, b_name STRING) RETURNS BIGINT", f"CASE WHEN pk IS NULL OR b_name IS NULL THEN NULL WHEN {keys} THEN (SELECT coalesce(sum({times}), 0L) FROM resident_values p {side.format('i64')} AND p.name = pk) END")
        define("hot_resident_info(n STRING) RETURNS STRING", f"CASE WHEN n IS NULL THEN NULL WHEN {known('n', None)} THEN (SELECT max(concat('dtype=', dtype, ' rows=', rows, ' device=spark')) FROM resident_columns c WHERE c.name = n) END")
        define("hot_last_stats() RETURNS STRING", "(SELECT max(stats) FROM resident_stats)")
        define("hot_build_info() RETURNS STRING", "(SELECT max(build) FROM resident_stats)")
        define(
            "hot_inner_join(build ARRAY<BIGINT>, probe ARRAY<BIGINT>) RETURNS TABLE(probe_idx BIGINT, build_idx BIGINT)",
            """SELECT CAST(p.pos AS BIGINT), CAST(b.pos AS BIGINT) FROM posexplode(probe) AS p(pos, k)
               JOIN (SELECT k, min(pos) AS pos FROM posexplode(build) AS t(pos, k) GROUP BY k) b ON p.k = b.k""",
        )

    # --- statements

    def run(self, statement: str) -> DataFrame | None:
        """One statement.  Besides SQL: UPLOAD name AS query, UPLOAD PAIR name AS query, DROP RESIDENT name."""
        s = statement.strip().rstrip(";")
        if m := re.match(r"(?is)upload\s+(pair\s+)?'?([\w.]*)'?\s+as\s+(.*)", s):
            df = self.spark.sql(rewrite(m[3]))
            if m[1]:
                n = self.store.upload_pair(m[2], df, df.columns[0], df.columns[1], df.columns[2] if len(df.columns) > 2 else None)
            else:
                n = self.store.upload(m[2], df, df.columns[0], df.columns[1] if len(df.columns) > 1 else None)
            self.refresh()
            return self.spark.createDataFrame([(n,)], "rows bigint")
        if m := re.match(r"(?is)drop\s+resident\s+'?([\w.]+)'?$", s):
            dropped = self.store.drop(m[1])
            self.refresh()
            return self.spark.createDataFrame([(dropped,)], "dropped boolean")
        return self.spark.sql(rewrite(self._resident(s)))

    def _resident(self, sql: str) -> str:
        """Row joins become views of the engine's own, with the cap if there is one and its errors; statistics are those of the last statement."""
        while m := _ROWS.search(sql):
            p, b, kind = (x.replace("''", "'") for x in m.groups())
            view = f"resident_rows_{uuid.uuid4().hex}"
            join_rows(self.store, p, b, kind, self.row_cap).createOrReplaceTempView(view)
            sql = sql[: m.start()] + view + sql[m.end() :]
        if re.search(r"\bhot_join_rows_resident\s*\(", sql, re.IGNORECASE):
            raise EngineError("hot_join_rows_resident takes three strings")
        sql = re.sub(r"\bhot_last_stats\s*\(\s*\)", lambda _: _literal(self.store.last_stats()), sql, flags=re.IGNORECASE)
        if m := re.search(r"\bhot_(\w+?)_resident(?:_f64)?\s*\(", sql, re.IGNORECASE):
            self.store.note(f"sql_{m[1].lower()}", Reason.CATALYST if "join" in m[1].lower() else Reason.HOT_CACHED, time.perf_counter())
        return sql


_TEXT = r"\s*'((?:[^']|'')*)'\s*"
_ROWS = re.compile(rf"\bhot_join_rows_resident\s*\({_TEXT},{_TEXT},{_TEXT}\)", re.IGNORECASE)


def _literal(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes and comments."""
    out, begin, at, quote = [], 0, 0, ""
    while at < len(text):
        ch = text[at]
        if quote:
            at += ch == "\\" and quote != "`"
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif text.startswith("--", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif ch == ";":
            out.append(text[begin:at])
            begin = at + 1
        at += 1
    return [s for s in [*out, text[begin:]] if s.strip()]


def _argument(sql: str, at: int) -> int:
    """Where the bracket that opens at `at` closes."""
    depth, quote = 0, ""
    for i in range(at, len(sql)):
        ch = sql[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if not depth:
                return i
    raise EngineError("a bracket is not closed")


def rewrite(sql: str) -> str:
    """hot_sum, hot_sum_f64, hot_min and hot_max as built-in aggregates; FILTER and OVER go along."""
    while m := re.search(r"\bhot_(sum_f64|sum|min|max)\s*\(", sql, re.IGNORECASE):
        end = _argument(sql, m.end() - 1)
        arg, tail = sql[m.end() : end], end + 1
        while t := re.match(r"\s*(filter|over)\s*\(", sql[tail:], re.IGNORECASE):
            tail = _argument(sql, tail + t.end() - 1) + 1
        rest, what = sql[end + 1 : tail], m[1].lower()
        if what == "sum":
            new = wrapping_sum_sql(f"bigint({arg})", None, rest)
        else:
            new = f"{'sum' if what == 'sum_f64' else what}({f'double({arg})' if what == 'sum_f64' else arg}){rest}"
        sql = sql[: m.start()] + new + sql[tail:]
    return sql


def main(args: list[str] | None = None) -> int:
    """python -m emberframe.sqlsurface [--db FOLDER] [--sql TEXT] [--multi] [--out FILE]: SQL from the option or standard input; tab-separated rows.

    Parquet files and folders in the database folder are views under their names.
    """
    import argparse
    import contextlib

    parser = argparse.ArgumentParser()
    parser.add_argument("--db")
    parser.add_argument("--sql")
    parser.add_argument("--multi", action="store_true")
    parser.add_argument("--out")
    options = parser.parse_args(args)
    text = options.sql if options.sql is not None else sys.stdin.read()
    spark = SparkSession.builder.getOrCreate()
    if options.db:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(options.db)
        for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
            if (name := f.getPath().getName()).endswith(".parquet"):
                spark.read.parquet(f.getPath().toString()).createOrReplaceTempView(name.removesuffix(".parquet"))
    surface = SqlSurface(Store(spark))
    with open(options.out, "w", encoding="utf-8") if options.out else contextlib.nullcontext(sys.stdout) as out:
        for statement in statements(text) if options.multi else [text]:
            began = time.perf_counter()
            try:
                df = surface.run(statement)
                print("\t".join(df.columns), file=out)
                for row in df.toLocalIterator():
                    print("\t".join("NULL" if v is None else str(v) for v in row), file=out)
            except Exception as e:  # noqa: BLE001  the first error ends the run
                print(f"error: {e}", file=sys.stderr)
                return 3
            print(f"{(time.perf_counter() - began) * 1000:.1f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
