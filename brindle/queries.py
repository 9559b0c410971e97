"""The query of each operator, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backup, kv, mvcc, scratch, stats, txn
from .plans.compiler import compile_request, merge_partials
from .plans.ir import Agg, AggType, IndexSpec, KeyRange, OrderBy, Request, RequestType, TypeCode, call, case, col, const
from .service import Service
from .sources import scans
from .sources.catalog import Catalog
from .streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Tables with their handles and indexes.
TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {}),
    "customer": ("c_custkey", {"by_segment": ("c_mktsegment",)}),
    "supplier": ("s_suppkey", {}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"by_customer": ("o_custkey",), "by_status": ("o_orderstatus", "o_custkey")}),
    "lineitem": (None, {}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(spark)
    for name, (handle, indexes) in TABLES.items():
        out.read(name, f"{sf_dir}/{name}.parquet", handle, indexes)
    return out


def _request(name: str, request: Request, sql: str | None = None, casts: dict[str, str] | None = None) -> None:
    """A query that is one request; casts name the types in which decimals are shown."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compile_request(request, catalog(spark, sf_dir))
        for c, t in (casts or {}).items():
            df = df.withColumn(c, F.col(c).cast(t))
        return df

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _query(sql: str | None = None, name: str | None = None):
    def add(run):
        QUERIES[name or run.__name__] = run
        if sql:
            ORACLE[name or run.__name__] = sql
        return run

    return add


def _project(name: str, table: str, sql_columns: str, *named, where: tuple = (), sql_where: str = "", casts: dict[str, str] | None = None) -> None:
    """A projection of a table's handle and expressions."""
    handle = TABLES[table][0]
    keys = (handle,) if handle else ()
    request = Request(table, projections=(*(col(k).named(k) for k in keys), *named), conditions=where)
    _request(name, request, f"SELECT {', '.join((*(f'{k}::BIGINT AS {k}' for k in keys), sql_columns))} FROM {table} {sql_where}", casts)


def _day(text: str):
    return const(datetime.fromisoformat(text))


FLAGSHIP = Request(
    "lineitem",
    conditions=(col("l_shipdate") <= _day("1998-09-02"),),
    group_by=(col("l_returnflag").named("l_returnflag"), col("l_linestatus").named("l_linestatus")),
    aggregates=(
        Agg(AggType.COUNT, name="n"),
        Agg(AggType.SUM, col("l_quantity"), name="sum_qty"),
        Agg(AggType.SUM, col("l_extendedprice"), name="sum_price"),
        Agg(AggType.AVG, col("l_discount"), name="avg_discount"),
    ),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pricing_summary"](spark, sf_dir)


D4 = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"
_request(
    "pricing_summary",
    FLAGSHIP,
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {D4.format("l_quantity")} AS sum_qty, {D4.format("l_extendedprice")} AS sum_price,
    CAST(round(sum(CAST(l_discount AS DECIMAL(18,4))) / count(l_discount), 4) AS DOUBLE) AS avg_discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    {"sum_qty": "double", "sum_price": "double", "avg_discount": "double"},
)

# scans

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_O = ", ".join(ORDER_COLUMNS)
_request("table_scan", Request("orders", columns=ORDER_COLUMNS), f"SELECT {_O} FROM orders")
_request("handle_range_scan", Request("orders", columns=ORDER_COLUMNS, ranges=(KeyRange(1000, 2000),)), f"SELECT {_O} FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000")
_request(
    "multi_range_scan",
    Request("orders", columns=ORDER_COLUMNS, ranges=(KeyRange(None, 50), KeyRange(40, 90), KeyRange(1200, 1300))),
    f"SELECT {_O} FROM orders WHERE o_orderkey < 90 OR (o_orderkey >= 1200 AND o_orderkey < 1300)",
)
_request("desc_scan_limit", Request("orders", columns=ORDER_COLUMNS, desc_scan=True, limit=20), f"SELECT {_O} FROM orders ORDER BY o_orderkey DESC LIMIT 20")
_request("limit_scan", Request("orders", columns=ORDER_COLUMNS, limit=25), f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 25")
_request("limit_paging", Request("orders", columns=ORDER_COLUMNS, paging_size=30, resume_after=100), f"SELECT {_O} FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 30")

# filters


def _filter(name: str, table: str, sql: str, *conditions) -> None:
    handle = TABLES[table][0]
    _request(name, Request(table, columns=(handle,), conditions=conditions), f"SELECT {handle} FROM {table} WHERE {sql}")


_filter("filter_cmp", "orders", "o_totalprice > 200000 AND o_orderstatus <> 'F' AND o_custkey <= 700", col("o_totalprice") > 200000, col("o_orderstatus").ne("F"), col("o_custkey") <= 700)
_filter("filter_and_or_not", "orders", "(o_orderstatus = 'O' OR o_totalprice < 50000) AND NOT o_custkey % 2 = 0", (col("o_orderstatus").eq("O") | (col("o_totalprice") < 50000)) & ~(col("o_custkey") % 2).eq(0))
_filter("filter_like", "orders", "o_orderpriority ILIKE '%urg_nt%'", col("o_orderpriority").like("%URG_nt%"))
_filter("filter_like_escape", "customer", "c_name ILIKE 'customer#%' ESCAPE '\\'", col("c_name").like("cust\\omer#%"))
_filter("filter_not_like", "orders", "o_orderpriority NOT ILIKE '1-%'", col("o_orderpriority").like("1-%", negated=True))
_filter("filter_in", "orders", "o_custkey IN (1, 5, 9, 77) OR o_orderpriority IN ('2-HIGH')", col("o_custkey").isin(1, 5, 9, 77) | col("o_orderpriority").isin("2-HIGH"))
_filter("filter_not_in_null", "orders", "o_custkey NOT IN (1, NULL)", col("o_custkey").isin(1, None, negated=True))
_filter("filter_between", "orders", "o_totalprice BETWEEN 1000 AND 60000", col("o_totalprice").between(1000, 60000))
_filter("filter_not_between", "orders", "o_totalprice NOT BETWEEN 1000 AND 300000", col("o_totalprice").between(1000, 300000, negated=True))
_project(
    "filter_between_null",
    "events",
    "CASE WHEN nullif(event_type, 'click') IS NULL THEN NULL WHEN event_id BETWEEN 10 AND 500 THEN 1::BIGINT ELSE 0::BIGINT END AS inside",
    case((call("NULLIF", col("event_type"), "click").is_null(), const(None)), otherwise=col("event_id").between(10, 500)).named("inside"),
)
_filter("filter_is_null", "events", "nullif(event_type, 'view') IS NULL", call("NULLIF", col("event_type"), "view").is_null())
_filter("filter_is_not_null", "events", "nullif(event_type, 'view') IS NOT NULL", call("NULLIF", col("event_type"), "view").is_not_null())
_filter("filter_case_searched", "orders", "CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_custkey < 100 THEN 1 ELSE 0 END = 1", case((col("o_totalprice") > 300000, 1), (col("o_custkey") < 100, 1), otherwise=0).eq(1))
_filter("filter_case_simple", "orders", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END >= 1", case(("F", 1), ("P", 2), otherwise=0, operand=col("o_orderstatus")) >= 1)
_filter("filter_truthy_string", "orders", "CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '0' ELSE '0.0' END NOT IN ('', '0')", case(((col("o_custkey") % 3).eq(0), ""), ((col("o_custkey") % 3).eq(1), "0"), otherwise="0.0"))
_filter("filter_mixed_types", "orders", "CAST(o_custkey AS VARCHAR) < '5'", col("o_custkey") < "5")

# projections

_project("proj_arith", "orders", "o_custkey + 7 AS a, o_custkey - o_orderkey AS b, o_custkey * 3 AS c, o_totalprice * 0.5 AS d", (col("o_custkey") + 7).named("a"), (col("o_custkey") - col("o_orderkey")).named("b"), (col("o_custkey") * 3).named("c"), (col("o_totalprice") * 0.5).named("d"))
_project("proj_int_div_mod", "orders", "o_orderkey // 7 AS a, -o_orderkey // 7 AS a2, o_orderkey % 7 AS b, -o_orderkey % 7 AS b2, CAST(o_orderkey AS DOUBLE) / 7 AS c", (col("o_orderkey") // 7).named("a"), (-col("o_orderkey") // 7).named("a2"), (col("o_orderkey") % 7).named("b"), (-col("o_orderkey") % 7).named("b2"), (col("o_orderkey") / 7).named("c"))
_project("proj_div_zero_null", "orders", "CAST(o_orderkey AS DOUBLE) / nullif(o_custkey % 3, 0) AS a, o_orderkey % nullif(o_custkey % 3, 0) AS b, o_orderkey // nullif(o_custkey % 3, 0) AS c", (col("o_orderkey") / (col("o_custkey") % 3)).named("a"), (col("o_orderkey") % (col("o_custkey") % 3)).named("b"), (col("o_orderkey") // (col("o_custkey") % 3)).named("c"))
_project("proj_neg", "orders", "-o_custkey AS a, -o_totalprice AS b", (-col("o_custkey")).named("a"), (-col("o_totalprice")).named("b"))
_project("proj_predicate", "orders", "CAST(o_totalprice > 100000 AS BIGINT) AS a, CAST(nullif(o_orderstatus, 'F') = 'O' AS BIGINT) AS b", (col("o_totalprice") > 100000).named("a"), call("NULLIF", col("o_orderstatus"), "F").eq("O").named("b"))
_project("proj_cast_int", "orders", "CAST(trunc(o_totalprice) AS BIGINT) AS a, 0::BIGINT AS b, 42::BIGINT AS c", col("o_totalprice").cast(TypeCode.BIGINT).named("a"), col("o_orderpriority").cast(TypeCode.INT).named("b"), const(" 42 ").cast(TypeCode.BIGINT).named("c"))
_project("proj_cast_double", "orders", "CAST(o_custkey AS DOUBLE) AS a, 0.0::DOUBLE AS b", col("o_custkey").cast(TypeCode.DOUBLE).named("a"), col("o_orderstatus").cast(TypeCode.DOUBLE).named("b"))
_project("proj_cast_decimal", "orders", "CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b", col("o_totalprice").cast(TypeCode.DECIMAL).named("a"), col("o_orderstatus").cast(TypeCode.DECIMAL).named("b"), casts={"a": "double", "b": "double"})
_project("proj_cast_string", "orders", "CAST(o_custkey AS VARCHAR) AS a, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS b", col("o_custkey").cast(TypeCode.VARCHAR).named("a"), col("o_orderdate").cast(TypeCode.TEXT).named("b"))
_project("proj_cast_datetime", "orders", "TIMESTAMP '1999-12-31 23:59:58' AS a, CAST(NULL AS TIMESTAMP) AS b", const(" 1999-12-31 23:59:58 ").cast(TypeCode.DATETIME).named("a"), col("o_orderstatus").cast(TypeCode.DATETIME).named("b"))

# control functions

_project("fn_if", "events", "CASE WHEN value > 50 THEN 'high' ELSE event_type END AS a, CASE WHEN nullif(event_type, 'click') <> 'view' THEN 1::BIGINT ELSE 2::BIGINT END AS b", call("IF", col("value") > 50, "high", col("event_type")).named("a"), call("IF", call("NULLIF", col("event_type"), "click").ne("view"), 1, 2).named("b"))
_project("fn_ifnull", "events", "ifnull(nullif(event_type, 'click'), 'none') AS a", call("IFNULL", call("NULLIF", col("event_type"), "click"), "none").named("a"))
_project("fn_nullif", "events", "nullif(event_type, 'error') AS a, nullif(user_id, 3) AS b", call("NULLIF", col("event_type"), "error").named("a"), call("NULLIF", col("user_id"), 3).named("b"))
_project("fn_coalesce", "events", "coalesce(nullif(event_type, 'click'), nullif(event_type, 'view'), 'x') AS a", call("COALESCE", call("NULLIF", col("event_type"), "click"), call("NULLIF", col("event_type"), "view"), "x").named("a"))

# text functions

_project("fn_concat", "customer", "c_name || '/' || CAST(c_custkey AS VARCHAR) AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b", call("CONCAT", col("c_name"), "/", col("c_custkey")).named("a"), call("CONCAT", col("c_name"), call("NULLIF", col("c_mktsegment"), "BUILDING")).named("b"))
_project("fn_concat_ws", "customer", "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), CAST(c_custkey AS VARCHAR)) AS a", call("CONCAT_WS", "-", col("c_name"), call("NULLIF", col("c_mktsegment"), "BUILDING"), col("c_custkey")).named("a"))
_project("fn_length", "part", "length(p_name) AS a, length(p_type) AS b, length(CAST(p_size AS VARCHAR)) AS c", call("LENGTH", col("p_name")).named("a"), call("CHAR_LENGTH", col("p_type")).named("b"), call("CHARACTER_LENGTH", col("p_size")).named("c"))
_project("fn_case", "part", "upper(p_name) AS a, lower(p_brand) AS b", call("UPPER", col("p_name")).named("a"), call("LCASE", col("p_brand")).named("b"))
_project("fn_trim", "part", "p_name AS a, p_name || '  ' AS b, '  ' || p_name AS c", call("TRIM", call("CONCAT", "\t ", col("p_name"), " \n")).named("a"), call("LTRIM", call("CONCAT", "  ", col("p_name"), "  ")).named("b"), call("RTRIM", call("CONCAT", "  ", col("p_name"), "  ")).named("c"))
_project("fn_reverse", "part", "reverse(p_name) AS a", call("REVERSE", col("p_name")).named("a"))
_project("fn_space_repeat", "part", "repeat(' ', p_size % 5) AS a, repeat(p_brand, p_size % 4 - 1) AS b", call("SPACE", col("p_size") % 5).named("a"), call("REPEAT", col("p_brand"), col("p_size") % 4 - 1).named("b"))
_project("fn_substr", "part", "substr(p_name, 2, 3) AS a, substr(p_type, length(p_type) - 3, 2) AS b, '' AS c, substr(p_name, 4) AS d, substr(p_brand, 1, 3) AS e", call("SUBSTR", col("p_name"), 2, 3).named("a"), call("SUBSTRING", col("p_type"), -4, 2).named("b"), call("MID", col("p_name"), 0, 3).named("c"), call("SUBSTR", col("p_name"), 4).named("d"), call("SUBSTR", col("p_brand"), -100, 3).named("e"))
_project("fn_left_right", "part", "left(p_name, 3) AS a, right(p_name, 4) AS b, '' AS c", call("LEFT", col("p_name"), 3).named("a"), call("RIGHT", col("p_name"), 4).named("b"), call("LEFT", col("p_name"), -1).named("c"))
_project("fn_replace", "part", "replace(p_name, 'a', 'AA') AS a", call("REPLACE", col("p_name"), "a", "AA").named("a"))
_project("fn_pad", "part", "lpad(p_brand, 12, '*-') AS a, rpad(p_brand, 4, 'x') AS b, CAST(NULL AS VARCHAR) AS c", call("LPAD", col("p_brand"), 12, "*-").named("a"), call("RPAD", col("p_brand"), 4, "x").named("b"), call("LPAD", col("p_brand"), 5, "").named("c"))
_project("fn_locate", "part", "instr(p_name, 'a')::BIGINT AS a, CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e')::BIGINT + 2 ELSE 0::BIGINT END AS b", call("LOCATE", "a", col("p_name")).named("a"), call("INSTR", "e", col("p_name"), 3).named("b"))
_project("fn_hex", "part", "hex(p_brand) AS a, hex(p_partkey) AS b", call("HEX", col("p_brand")).named("a"), call("HEX", col("p_partkey")).named("b"))
_project("fn_unhex", "part", "p_brand AS a, CAST(NULL AS VARCHAR) AS b", call("UNHEX", call("HEX", col("p_brand"))).named("a"), call("UNHEX", "abc").named("b"))

# numeric functions

_BAL = "c_acctbal"
_project("fn_abs", "customer", "abs(c_acctbal) AS a, abs(-c_custkey) AS b", call("ABS", col(_BAL)).named("a"), call("ABS", -col("c_custkey")).named("b"))
_project("fn_ceil_floor", "customer", "CAST(ceil(c_acctbal) AS BIGINT) AS a, CAST(floor(c_acctbal) AS BIGINT) AS b", call("CEIL", col(_BAL)).named("a"), call("FLOOR", col(_BAL)).named("b"))
_project("fn_round", "customer", "CAST(round(CAST(c_acctbal AS DECIMAL(18,4))) AS BIGINT) AS a, CAST(round(CAST(c_acctbal AS DECIMAL(18,4)), 1) AS DOUBLE) AS b", call("ROUND", col(_BAL)).named("a"), call("ROUND", col(_BAL), 1).named("b"))
_project("fn_truncate", "customer", "CAST(trunc(c_acctbal) AS BIGINT) AS a, CAST(trunc(CAST(c_acctbal AS DECIMAL(18,4)) * 10) AS DOUBLE) / 10 AS b", call("TRUNCATE", col(_BAL), 0).named("a"), call("TRUNCATE", col(_BAL), 1).named("b"))
_project("fn_mod", "customer", "c_custkey % nullif(c_nationkey, 0)::BIGINT AS a", call("MOD", col("c_custkey"), col("c_nationkey")).named("a"))
_project("fn_sqrt", "customer", "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS a", call("SQRT", col(_BAL)).named("a"))
_project("fn_pow", "customer", "pow(CAST(c_nationkey AS DOUBLE), 2) AS a", call("POW", col("c_nationkey"), 2).named("a"))
_project("fn_log", "customer", "round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9) AS a, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) / ln(3) END, 9) AS b", call("LOG", col(_BAL)).named("a"), call("LOG", 3, col(_BAL)).named("b"))
_project("fn_log2_log10", "customer", "round(CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END, 9) AS a, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 9) AS b", call("LOG2", col(_BAL)).named("a"), call("LOG10", col(_BAL)).named("b"))
for _n, _cols in {"fn_log": ("a", "b"), "fn_log2_log10": ("a", "b"), "fn_exp": ("a",)}.items():
    if _n == "fn_exp":
        _project("fn_exp", "customer", "round(exp(CAST(c_nationkey AS DOUBLE) / 10), 9) AS a", call("EXP", col("c_nationkey") / 10).named("a"))
    QUERIES[_n] = lambda spark, sf_dir, run=QUERIES[_n], cols=_cols: run(spark, sf_dir).withColumns({c: F.round(c, 9) for c in cols})
_project("fn_sign", "customer", "CAST(sign(c_acctbal) AS BIGINT) AS a", call("SIGN", col(_BAL)).named("a"))
_project("fn_pi", "region", "pi() AS a", call("PI").named("a"))
_project("fn_greatest_least", "customer", "CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE greatest(c_custkey, c_nationkey) END AS a, least(c_custkey, c_nationkey)::BIGINT AS b", call("GREATEST", col("c_custkey"), call("NULLIF", col("c_nationkey"), 3)).named("a"), call("LEAST", col("c_custkey"), col("c_nationkey")).named("b"))
_request("fn_rand", Request("region", projections=(col("r_regionkey").named("r_regionkey"), ((call("RAND") >= 0) & (call("RAND") < 1)).named("inside"))), "SELECT r_regionkey::BIGINT AS r_regionkey, 1::BIGINT AS inside FROM region")
_request("fn_crc32", Request("region", projections=(col("r_regionkey").named("r_regionkey"), call("CRC32", col("r_name")).named("a"))))

# date functions

_project("fn_date_parts", "events", "year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, 2000::BIGINT AS bad", *(call(f, col("ts")).named(n) for f, n in (("YEAR", "y"), ("MONTH", "mo"), ("DAYOFMONTH", "d"), ("HOUR", "h"), ("MINUTE", "mi"), ("SECOND", "s"))), call("YEAR", col("event_type")).named("bad"))
_project("fn_dayofweek", "events", "dayofweek(ts) + 1 AS a", call("DAYOFWEEK", col("ts")).named("a"))
_project("fn_dayofyear", "events", "dayofyear(ts) AS a", call("DAYOFYEAR", col("ts")).named("a"))
_project("fn_datediff", "orders", "date_diff('day', DATE '1996-02-29', CAST(o_orderdate AS DATE)) AS a", call("DATEDIFF", col("o_orderdate"), "1996-02-29").named("a"))
_project("fn_date_add_sub", "events", "ts + to_days(CAST(user_id % 40 AS INTEGER)) AS a, ts - INTERVAL 31 DAY AS b", call("DATE_ADD", col("ts"), col("user_id") % 40).named("a"), call("SUBDATE", col("ts"), 31).named("b"))
_project("fn_unix_timestamp", "events", "CAST(floor(epoch(ts)) AS BIGINT) AS a", call("UNIX_TIMESTAMP", col("ts")).named("a"))
_project("fn_from_unixtime", "events", "TIMESTAMP '1970-01-01' + to_seconds(1700000000 + event_id) AS a", call("FROM_UNIXTIME", col("event_id") + 1700000000).named("a"))
_project("fn_date_format", "events", "strftime(ts, '%Y/%m/%d %H-%M-%S') AS a, strftime(ts, '%A %B %j') AS b", call("DATE_FORMAT", col("ts"), "%Y/%m/%d %H-%i-%s").named("a"), call("DATE_FORMAT", col("ts"), "%W %M %j").named("b"))
_request("fn_now", Request("region", projections=(col("r_regionkey").named("r_regionkey"), call("DATEDIFF", call("NOW"), call("CURDATE")).named("a"), (call("LENGTH", call("CURTIME")) > 7).named("b"))), "SELECT r_regionkey::BIGINT AS r_regionkey, 0::BIGINT AS a, 1::BIGINT AS b FROM region")
_project("fn_info", "region", "'8.0.30-x-db' AS a, CAST(NULL AS VARCHAR) AS b, 'root@localhost' AS c, 0::BIGINT AS d", call("VERSION").named("a"), call("DATABASE").named("b"), call("USER").named("c"), call("CONNECTION_ID").named("d"))

# aggregates

_BY_FLAG = (col("l_returnflag").named("f"),)


def _agg(name: str, table: str, sql: str, *aggs: Agg, by: tuple = (), where: tuple = (), casts: dict[str, str] | None = None, **more) -> None:
    _request(name, Request(table, group_by=by, aggregates=aggs, conditions=where, **more), sql, casts)


_agg("agg_count_star", "lineitem", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1", Agg(AggType.COUNT, name="n"), by=_BY_FLAG)
_agg("agg_count_expr", "events", "SELECT user_id, count(nullif(event_type, 'click')) AS n FROM events GROUP BY 1", Agg(AggType.COUNT, call("NULLIF", col("event_type"), "click"), name="n"), by=(col("user_id").named("user_id"),))
_agg("agg_count_distinct", "orders", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", Agg(AggType.COUNT, col("o_custkey"), True, "n"), by=(col("o_orderstatus").named("s"),))
_agg("agg_sum", "lineitem", f"SELECT l_returnflag AS f, {D4.format('l_extendedprice')} AS s, CAST(sum(l_orderkey) AS BIGINT) AS k FROM lineitem GROUP BY 1", Agg(AggType.SUM, col("l_extendedprice"), name="s"), Agg(AggType.SUM, col("l_orderkey"), name="k"), by=_BY_FLAG, casts={"s": "double", "k": "bigint"})
_agg("agg_sum_distinct", "lineitem", "SELECT l_returnflag AS f, CAST(sum(DISTINCT CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS s FROM lineitem GROUP BY 1", Agg(AggType.SUM, col("l_quantity"), True, "s"), by=_BY_FLAG, casts={"s": "double"})
_agg("agg_avg_scale4", "lineitem", "SELECT l_returnflag AS f, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,4))) / count(*), 4) AS DOUBLE) AS a FROM lineitem GROUP BY 1", Agg(AggType.AVG, col("l_quantity"), name="a"), by=_BY_FLAG, casts={"a": "double"})
_agg("agg_avg_distinct", "lineitem", "SELECT l_returnflag AS f, CAST(round(sum(DISTINCT CAST(l_discount AS DECIMAL(18,4))) / count(DISTINCT l_discount), 4) AS DOUBLE) AS a FROM lineitem GROUP BY 1", Agg(AggType.AVG, col("l_discount"), True, "a"), by=_BY_FLAG, casts={"a": "double"})
_agg("agg_min_max", "lineitem", "SELECT l_returnflag AS f, min(l_shipdate) AS a, max(l_extendedprice) AS b, min(l_linestatus) AS c FROM lineitem GROUP BY 1", Agg(AggType.MIN, col("l_shipdate"), name="a"), Agg(AggType.MAX, col("l_extendedprice"), name="b"), Agg(AggType.MIN, col("l_linestatus"), name="c"), by=_BY_FLAG)
_agg("agg_group_concat", "events", "SELECT user_id, string_agg(nullif(event_type, 'click'), ',' ORDER BY event_id) AS g FROM events GROUP BY 1", Agg(AggType.GROUP_CONCAT, call("NULLIF", col("event_type"), "click"), name="g"), by=(col("user_id").named("user_id"),))
_agg("agg_group_concat_distinct", "events", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS g FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1", Agg(AggType.GROUP_CONCAT, col("event_type"), True, "g"), by=(col("user_id").named("user_id"),))
_agg("agg_group_by_expr", "orders", "SELECT year(o_orderdate) AS y, CAST(o_totalprice > 250000 AS BIGINT) AS big, count(*) AS n FROM orders GROUP BY ALL", Agg(AggType.COUNT, name="n"), by=(call("YEAR", col("o_orderdate")).named("y"), (col("o_totalprice") > 250000).named("big")))
_agg("agg_group_by_null", "events", "SELECT nullif(event_type, 'click') AS t, count(*) AS n FROM events GROUP BY 1", Agg(AggType.COUNT, name="n"), by=(call("NULLIF", col("event_type"), "click").named("t"),))
_agg("agg_empty_global", "orders", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0", Agg(AggType.COUNT, name="n"), Agg(AggType.SUM, col("o_custkey"), name="s"), where=(col("o_orderkey") < 0,), casts={"s": "bigint"})
_agg("agg_empty_grouped", "orders", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY 1", Agg(AggType.COUNT, name="n"), by=(col("o_orderstatus").named("s"),), where=(col("o_orderkey") < 0,))

_PARTIAL = Request("orders", group_by=(col("o_orderstatus").named("s"),), aggregates=(Agg(AggType.COUNT, name="n"), Agg(AggType.SUM, col("o_totalprice"), name="t"), Agg(AggType.AVG, col("o_totalprice"), name="a"), Agg(AggType.MIN, col("o_custkey"), name="lo"), Agg(AggType.MAX, col("o_custkey"), name="hi")), partial=True)


@_query(
    """SELECT o_orderstatus AS s, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS t,
    CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))) / count(*), 4) AS DOUBLE) AS a, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1"""
)
def agg_partial_final(spark, sf_dir):
    """States of four key ranges, merged."""
    from dataclasses import replace

    c = catalog(spark, sf_dir)
    cuts = [None, 4000, 8000, 12000, None]
    parts = [compile_request(replace(_PARTIAL, ranges=(KeyRange(a, b),)), c) for a, b in zip(cuts, cuts[1:])]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    return merge_partials(states, _PARTIAL, c).withColumns({"t": F.col("t").cast("double"), "a": F.col("a").cast("double")})


# top-n


def _top(name: str, sql: str, *by: OrderBy, table: str = "orders", columns: tuple = ("o_orderkey", "o_totalprice"), **more) -> None:
    _request(name, Request(table, columns=columns, order_by=by, **more), sql)


_top("topn_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10", OrderBy(col("o_totalprice")), limit=10)
_top("topn_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", OrderBy(col("o_totalprice"), True), limit=10)
_top("topn_multi_key", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 40", OrderBy(col("o_orderstatus"), True), OrderBy(col("o_custkey")), columns=("o_orderkey", "o_orderstatus", "o_custkey"), limit=40)
_top("topn_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25", OrderBy(col("o_totalprice"), True), limit=10, offset=25)
_top("topn_expr_key", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice / nullif(o_custkey, 0) NULLS FIRST, o_orderkey LIMIT 12", OrderBy(col("o_totalprice") / col("o_custkey")), columns=("o_orderkey", "o_totalprice", "o_custkey"), limit=12)
_top("topn_nulls", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY nullif(o_orderstatus, 'F') NULLS FIRST, o_orderkey LIMIT 20", OrderBy(call("NULLIF", col("o_orderstatus"), "F")), columns=("o_orderkey", "o_orderstatus"), limit=20)
_request("topn_projected", Request("orders", projections=(col("o_orderkey").named("o_orderkey"), (col("o_totalprice") * -1.0).named("m")), order_by=(OrderBy(col("m")),), limit=7), "SELECT o_orderkey, o_totalprice * -1.0::DOUBLE AS m FROM orders ORDER BY m, o_orderkey LIMIT 7")

# indexes

_request("index_covering", Request("orders", index=IndexSpec("by_customer"), columns=("o_custkey", "o_orderkey"), ranges=(KeyRange(100, 200),)), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200")
_request("index_point", Request("orders", index=IndexSpec("by_customer"), columns=("o_custkey", "o_orderkey"), conditions=(col("o_custkey").eq(7),)), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = 7")
_request("index_lookup", Request("orders", index=IndexSpec("by_customer", True), columns=ORDER_COLUMNS, ranges=(KeyRange(50, 60),)), f"SELECT {_O} FROM orders WHERE o_custkey >= 50 AND o_custkey < 60")
_request("index_lookup_filter", Request("orders", index=IndexSpec("by_customer", True), columns=ORDER_COLUMNS, ranges=(KeyRange(None, 300),), conditions=(col("o_totalprice") > 100000,), limit=50), f"SELECT {_O} FROM orders WHERE o_custkey < 300 AND o_totalprice > 100000 ORDER BY o_custkey, o_orderkey LIMIT 50")
_request("index_desc", Request("orders", index=IndexSpec("by_customer"), columns=("o_custkey", "o_orderkey"), desc_scan=True, limit=30), "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 30")


def _stored(spark, sf_dir, index: str) -> Catalog:
    """A catalog in which an index of orders is a table of its own."""
    c = catalog(spark, sf_dir)
    scans.store_index(c["orders"], index, scratch.new_folder(spark, "index"))
    return c


@_query(f"SELECT {_O} FROM orders WHERE o_custkey >= 20 AND o_custkey < 40")
def index_double_read(spark, sf_dir):
    """A stored index's entries, joined back to their rows."""
    return compile_request(Request("orders", index=IndexSpec("by_customer", True), columns=ORDER_COLUMNS, ranges=(KeyRange(20, 40),)), _stored(spark, sf_dir, "by_customer"))


_PREFIX = (KeyRange(("F", 100), ("O", 50)), KeyRange("P", ("P", 30)))
_PREFIX_SQL = "(o_orderstatus = 'F' AND o_custkey >= 100 OR o_orderstatus > 'F' AND o_orderstatus < 'O' OR o_orderstatus = 'O' AND o_custkey < 50 OR o_orderstatus = 'P' AND o_custkey < 30)"


@_query(f"SELECT o_orderstatus, o_custkey, o_orderkey FROM orders WHERE {_PREFIX_SQL}")
def index_prefix(spark, sf_dir):
    """Ranges over two columns of a stored index, which is read alone."""
    return compile_request(Request("orders", index=IndexSpec("by_status"), columns=("o_orderstatus", "o_custkey", "o_orderkey"), ranges=_PREFIX), _stored(spark, sf_dir, "by_status"))


@_query(f"SELECT {_O} FROM orders WHERE {_PREFIX_SQL} ORDER BY o_orderstatus, o_custkey, o_orderkey LIMIT 60")
def index_prefix_lookup(spark, sf_dir):
    """The first rows, in index order, of ranges over two columns."""
    return compile_request(Request("orders", index=IndexSpec("by_status", True), columns=ORDER_COLUMNS, ranges=_PREFIX, limit=60), _stored(spark, sf_dir, "by_status"))


# collation

_MIXED = case(((col("c_custkey") % 2).eq(0), call("LOWER", col("c_mktsegment"))), otherwise=col("c_mktsegment"))
_MIXED_SQL = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"
_request("coll_ci_filter", Request("customer", columns=("c_custkey",), conditions=(_MIXED.eq("BuilDing"),), collation=1), "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
_request("coll_binary", Request("customer", columns=("c_custkey",), conditions=(_MIXED.eq("BUILDING"),)), f"SELECT c_custkey FROM customer WHERE {_MIXED_SQL} = 'BUILDING'")
_request("coll_ci_order", Request("customer", columns=("c_custkey", "c_mktsegment"), order_by=(OrderBy(_MIXED),), limit=100, collation=2), "SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment), c_custkey LIMIT 100")


@_query("SELECT lower(c_mktsegment) AS g, count(*) AS n FROM customer GROUP BY 1")
def coll_ci_group(spark, sf_dir):
    r = Request("customer", group_by=(_MIXED.named("g"),), aggregates=(Agg(AggType.COUNT, name="n"),), collation=1)
    return compile_request(r, catalog(spark, sf_dir)).select(F.lower(F.col("g").cast("string")).alias("g"), "n")


# statistics

_ANALYZED = ("c_custkey", "c_mktsegment", "c_nationkey", "c_name")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS ndv, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer" for c in _ANALYZED))
def analyze_columns(spark, sf_dir):
    return Service(catalog(spark, sf_dir)).plan(RequestType.ANALYZE, Request("customer", columns=_ANALYZED))


@_query()
def analyze_sample(spark, sf_dir):
    return stats.sample(catalog(spark, sf_dir)["customer"].df, "c_acctbal", "c_custkey", 100)


def _pairs(spark, sf_dir):
    """Customers as keys and values."""
    return catalog(spark, sf_dir)["customer"].df.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


@_query("SELECT count(*) AS total_kvs, CAST(sum(strlen(c_name) + strlen(c_mktsegment)) AS BIGINT) AS total_bytes FROM customer")
def checksum_totals(spark, sf_dir):
    return stats.checksum(_pairs(spark, sf_dir)).select("total_kvs", "total_bytes")


@_query()
def checksum_crc(spark, sf_dir):
    return stats.checksum(_pairs(spark, sf_dir))


@_query(
    """WITH r AS (SELECT c_name AS key, strlen(c_name) + strlen(c_mktsegment) AS size FROM customer),
    s AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS run, CAST(sum(size) OVER () AS BIGINT) // 8 AS chunk FROM r)
    SELECT least(run // chunk, 7) AS split_no, key FROM s
    WHERE least(run // chunk, 7) > least((run - size) // chunk, 7) AND key <> (SELECT min(key) FROM r)"""
)
def split_keys(spark, sf_dir):
    sized = _pairs(spark, sf_dir).select("key", (F.octet_length("key") + F.octet_length("value")).cast("long").alias("size"))
    return stats.split_keys(sized, 8)


# versions


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version log from events: users are keys, event ids are time, errors are deletions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("user_key"), (F.col("event_id") + 1).alias("commit_ts"), F.col("event_id").alias("start_ts"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.col("value"))


_V = "(SELECT user_id AS user_key, event_id + 1 AS commit_ts, event_id AS start_ts, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, value FROM events)"
_LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY commit_ts DESC) AS n FROM {_V} WHERE commit_ts <= {{ts}} AND commit_ts > {{after}}) WHERE n = 1)"
_HALF, _ALL, _QUARTER = (f"(SELECT max(event_id) * {n} // 4 FROM events)" for n in (2, 4, 1))
_SNAP = f"SELECT user_key, value FROM {_LATEST.format(ts=_HALF, after=-1)} WHERE op = 'PUT'"


def _time(spark, sf_dir, quarters: int = 2) -> int:
    """A timestamp so many quarters into the log."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] * quarters // 4


_query(_SNAP, "mvcc_snapshot_scan")(lambda spark, sf_dir: mvcc.snapshot(versions(spark, sf_dir), _time(spark, sf_dir)))
_query(f"{_SNAP} AND user_key IN (3, 14, 77, 100000)", "mvcc_snapshot_get")(lambda spark, sf_dir: mvcc.batch_get(versions(spark, sf_dir), [3, 14, 77, 100000], _time(spark, sf_dir)))
_query(f"{_SNAP} AND user_key >= 10 AND user_key < 90 ORDER BY user_key DESC LIMIT 15", "mvcc_reverse_scan")(lambda spark, sf_dir: mvcc.scan(versions(spark, sf_dir), _time(spark, sf_dir), 10, 90, 15, reverse=True))
_query(f"SELECT * FROM {_V} WHERE user_key = 14", "mvcc_history")(lambda spark, sf_dir: mvcc.history(versions(spark, sf_dir), 14))
_query(f"SELECT user_key, commit_ts, start_ts, op, value FROM {_V} WHERE commit_ts > {_HALF} UNION ALL SELECT user_key, commit_ts, start_ts, op, value FROM {_LATEST.format(ts=_HALF, after=-1)}", "mvcc_gc")(lambda spark, sf_dir: mvcc.collect_garbage(versions(spark, sf_dir), _time(spark, sf_dir)))
_query(f"SELECT * FROM {_V} WHERE NOT (user_key >= 20 AND user_key < 60)", "mvcc_delete_range")(lambda spark, sf_dir: mvcc.delete_range(versions(spark, sf_dir), 20, 60))


@_query(f"SELECT CAST(value > 50 AS BIGINT) AS high, count(*) AS n FROM ({_SNAP}) WHERE user_key >= 5 AND user_key < 120 GROUP BY 1")
def select_at_timestamp(spark, sf_dir):
    """A request with ranges and groups over a versioned table, as of a timestamp."""
    c = Catalog(spark)
    c.register_versions("accounts", versions(spark, sf_dir), "user_key")
    r = Request("accounts", ranges=(KeyRange(5, 120),), read_ts=_time(spark, sf_dir), group_by=((col("value") > 50).named("high"),), aggregates=(Agg(AggType.COUNT, name="n"),))
    return compile_request(r, c)


def _locks(spark, sf_dir):
    """A lock for each event: those of errors don't block."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("user_key"), F.when(F.col("event_type") == "error", "LOCK").otherwise("PUT").alias("type"), F.col("event_id").alias("start_ts"), F.lit(3000).alias("ttl_ms"))


@_query(f"SELECT user_id AS user_key, event_id AS start_ts, 'KeyLocked' AS raised FROM events WHERE event_type <> 'error' AND event_id <= {_HALF}")
def mvcc_lock_blocked(spark, sf_dir):
    """Locks that a read in the middle of the log waits for, and what the read raises."""
    ts, locks = _time(spark, sf_dir), _locks(spark, sf_dir)
    try:
        mvcc.snapshot(versions(spark, sf_dir), ts, locks)
        raised = None
    except mvcc.KeyLocked as e:
        raised = type(e).__name__
    return mvcc.blocking(locks, ts).select("user_key", "start_ts", F.lit(raised).alias("raised"))


# raw keys


def _kv(spark, sf_dir):
    return kv.KeyValueTable(_pairs(spark, sf_dir))


def _text(df):
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


_KV = "SELECT c_name AS key, c_mktsegment AS value FROM customer"
_A, _B = "Customer#000000020", "Customer#000000090"
_query(f"{_KV} WHERE c_name >= '{_A}' AND c_name < '{_B}' ORDER BY 1 LIMIT 40", "raw_scan")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).scan(_A, _B, 40)))
_query(f"{_KV} WHERE c_name >= '{_A}' AND c_name < '{_B}' ORDER BY 1 DESC LIMIT 40", "raw_reverse_scan")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).reverse_scan(_B, _A, 40)))
_query(f"SELECT c_name AS key FROM customer WHERE c_name >= '{_A}'", "raw_key_only")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).scan(_A, key_only=True)))
_query(f"{_KV} WHERE c_name IN ('{_A}', '{_B}')", "raw_batch_get")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).batch_get([_A, _B, "nobody"])))
_query(f"{_KV} WHERE NOT (c_name >= '{_A}' AND c_name < '{_B}')", "raw_delete_range")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).delete_range(_A, _B).df))
_query(f"SELECT c_name AS key, CASE WHEN c_name = '{_A}' THEN 'changed' ELSE c_mktsegment END AS value FROM customer WHERE c_name <> '{_B}' UNION ALL SELECT 'new', 'n'", "raw_put_delete")(lambda spark, sf_dir: _text(_kv(spark, sf_dir).batch_put({_A: "changed", "new": "n"}).delete(_B).df))


@_query("SELECT 1::BIGINT AS step, 1::BIGINT AS done, CAST(NULL AS VARCHAR) AS before UNION ALL SELECT 2, 0, 'one' UNION ALL SELECT 3, 1, 'one'")
def raw_cas(spark, sf_dir):
    """Put if absent; a swap that expects the wrong value; one that expects the right one."""
    t, out = kv.KeyValueTable.empty(spark), []
    for i, (expected, value) in enumerate(((None, "one"), ("two", "three"), ("one", "two")), 1):
        done, before, t = t.compare_and_swap("k", expected, value)
        out.append((i, int(done), before.decode() if before is not None else None))
    return spark.createDataFrame(out, "step long, done long, before string")


# transactions


def _store(spark, sf_dir):
    """A log of two commits: all nations, then one more name for each of the first ten."""
    s = txn.VersionStore(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.lpad(F.col("n_nationkey").cast("string"), 4, "0").cast("binary")
    rows = lambda df, ts, v: df.select(key.alias("user_key"), F.lit(ts).alias("commit_ts"), F.lit(ts - 1).alias("start_ts"), F.lit("PUT").alias("op"), v.cast("binary").alias("value"))
    first, second = s.clock.next(), s.clock.next() + 1
    s.append(rows(n, first, F.col("n_name")), first)
    s.append(rows(n.where("n_nationkey < 10"), second, F.lower("n_name")), second)
    s.clock.last = max(s.clock.last, second)
    return s


def _shown(df):
    return df.select(F.col("user_key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@_query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, CASE WHEN n_nationkey = 3 THEN 'mine' WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT '9999', 'new' ORDER BY 1 LIMIT 20")
def txn_ryow_scan(spark, sf_dir):
    """A scan sees the transaction's own writes, and the limit counts after them."""
    t = _store(spark, sf_dir).begin()
    t.put("0003", "mine")
    t.delete("0005")
    t.insert("9999", "new")
    return _shown(t.scan(limit=20))


@_query("SELECT 'second' AS who, 'conflict' AS outcome, 'a' AS v")
def txn_conflict(spark, sf_dir):
    """Of two transactions on a key the first to commit wins."""
    s = _store(spark, sf_dir)
    a, b = s.begin(), s.begin()
    a.put("0001", "a")
    b.put("0001", "b")
    a.commit()
    try:
        b.commit()
        outcome = "committed"
    except txn.WriteConflict:
        outcome = "conflict"
    return _shown(mvcc.get(s.versions(), b"0001", s.clock.next())).select(F.lit("second").alias("who"), F.lit(outcome).alias("outcome"), "v")


@_query("SELECT 'exists' AS outcome, lower(n_name) AS v FROM nation WHERE n_nationkey = 1")
def txn_insert_exists(spark, sf_dir):
    s = _store(spark, sf_dir)
    t = s.begin()
    t.insert("0001", "x")
    try:
        t.commit()
        outcome = "committed"
    except txn.AlreadyExists:
        outcome = "exists"
    return _shown(s.snapshot().where(F.col("user_key") == F.lit(bytearray(b"0001")))).select(F.lit(outcome).alias("outcome"), "v")


@_query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, 'ROLLBACK' AS op, 'rolled back' AS outcome FROM nation WHERE n_nationkey IN (3, 7)")
def txn_rollback_record(spark, sf_dir):
    """A transaction whose locks expire is rolled back by whoever finds them, and can't commit after that."""
    s = _store(spark, sf_dir)
    t = s.begin()
    t.put("0003", "x")
    t.delete("0007")
    t.prewrite()
    s.resolve_expired(s.clock.now_ms() + 10 * s.TTL_MS)
    try:
        t.commit()
    except txn.RolledBack:
        pass
    return mvcc.history(s.versions(), start_ts=t.start_ts).select(F.col("user_key").cast("string").alias("k"), "op", F.lit(t.outcome.value).alias("outcome"))


@_query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, CASE WHEN n_nationkey = 3 THEN 'new' WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey <> 12")
def txn_lock_resolve(spark, sf_dir):
    """Locks that a dead driver has left are committed at its timestamp, and then read."""
    s = _store(spark, sf_dir)
    t = s.begin()
    t.put("0003", "new")
    t.delete("0012")
    t.prewrite()
    s.resolve(t.start_ts, s.clock.next())
    return _shown(s.snapshot())


@_query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, CASE WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS v FROM nation")
def txn_store_gc(spark, sf_dir):
    """What garbage collection leaves of a log: the last version of each key, and nothing else."""
    s = _store(spark, sf_dir)
    s.collect_garbage(s.clock.next())
    return _shown(s.versions())


# the change feed

_query(f"SELECT user_key, commit_ts, start_ts, op, value FROM {_LATEST.format(ts=_ALL, after=_QUARTER)}", "cdc_incremental")(lambda spark, sf_dir: cdc.incremental(versions(spark, sf_dir), _time(spark, sf_dir, 1), _time(spark, sf_dir, 4)))
_query(f"SELECT user_key, commit_ts, start_ts, op, value FROM {_LATEST.format(ts=_ALL, after=_QUARTER)} WHERE user_key >= 30 AND user_key < 70", "cdc_key_range")(lambda spark, sf_dir: cdc.incremental(versions(spark, sf_dir), _time(spark, sf_dir, 1), _time(spark, sf_dir, 4), 30, 70))
_query(f"SELECT min(event_id) - 1 AS resolved_ts FROM events", "cdc_resolved_ts")(lambda spark, sf_dir: cdc.resolved_ts(versions(spark, sf_dir), _locks(spark, sf_dir)))
_query(f"SELECT user_key, value FROM {_LATEST.format(ts=_ALL, after=-1)} WHERE op = 'PUT'", "cdc_apply")(lambda spark, sf_dir: cdc.apply(mvcc.snapshot(versions(spark, sf_dir), _time(spark, sf_dir)), cdc.incremental(versions(spark, sf_dir), _time(spark, sf_dir), _time(spark, sf_dir, 4))))


@_query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, CASE WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS v FROM nation")
def cdc_stream_replay(spark, sf_dir):
    """The feed's rows, kept by a stream that stops at the log's end, give the latest state."""
    s = _store(spark, sf_dir)
    out = scratch.new_folder(spark, "feed")
    cdc.materialize(s, f"{out}/rows", f"{out}/checkpoint", once=True).awaitTermination()
    return _shown(mvcc.latest(spark.read.schema(mvcc.VERSIONS).parquet(f"{out}/rows")).where("op = 'PUT'"))


# backup, service


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def backup_restore_roundtrip(spark, sf_dir):
    pairs = catalog(spark, sf_dir)["orders"].df.select(F.col("o_orderkey").cast("string").alias("key"), F.concat_ws("|", "o_custkey", "o_totalprice").alias("value"))
    folder = scratch.new_folder(spark, "backup")
    backup.backup(pairs, folder)
    back = F.split("value", r"\|")
    return backup.restore(spark, folder).select(F.col("key").cast("long").alias("o_orderkey"), back[0].cast("long").alias("o_custkey"), back[1].cast("double").alias("o_totalprice"))


@_query("SELECT 1::BIGINT AS no, 3::BIGINT AS n, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT 2, 0, 'UnsupportedRequest' UNION ALL SELECT 3, 5, NULL")
def service_batch(spark, sf_dir):
    """Three requests at once: a scan, one of an unknown type, a selection."""
    s = Service(catalog(spark, sf_dir))
    out = s.batch([(0, Request("orders", limit=3)), (9, Request("orders")), (1, Request("nation", limit=5))])
    rows = [(i, len(o.rows or []), o.error.split(":")[0] if o.error else None) for i, o in enumerate(out, 1)]
    return spark.createDataFrame(rows, "no long, n long, error string")


@_query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM (SELECT o_orderkey FROM orders WHERE o_custkey < 100)")
def service_stream(spark, sf_dir):
    """A streamed answer, chunk by chunk."""
    s = Service(catalog(spark, sf_dir))
    n = total = 0
    for chunk in s.stream(1, Request("orders", columns=("o_orderkey",), conditions=(col("o_custkey") < 100,)), 100):
        n += len(chunk)
        total += sum(r[0] for r in chunk)
    return spark.createDataFrame([(n, total)], "n long, s long")
