"""Outcomes of expressions and functions, one row each."""

from datetime import datetime
from decimal import Decimal

import pytest

from brindle.functions.types import RequestError
from brindle.plans.expressions import Scope
from brindle.plans.ir import Between, Cast, Const, In, Like, call, case, col, const

NULL = const(None)


@pytest.fixture(scope="module")
def value(spark):
    row = spark.sql("SELECT 5L AS i, 2.5D AS d, 'abc' AS s, CAST(NULL AS STRING) AS n, CAST(1.50 AS DECIMAL(10,2)) AS m, X'0AFF' AS b, TIMESTAMP_NTZ'2024-02-29 13:14:15' AS t, -9223372036854775808L AS low")
    scope = Scope(row.schema)

    def run(e, collation=0):
        s = Scope(row.schema, collation) if collation else scope
        return row.select(s.compile(e).shown().col.alias("x")).first()[0]

    return run


@pytest.mark.parametrize(
    "e, want",
    [
        (const(2) + 3, 5),
        (const(2) - 3, -1),
        (const(7) * 6, 42),
        (const(1) + 2.5, 3.5),
        (col("m") + 1, 2.5),
        (const(7) / 2, 3.5),
        (const(7) / 0, None),
        (const(7) % 0, None),
        (const(-7) % 3, -1),
        (const(7.5) % 2, 1.5),
        (const(-7) // 2, -3),
        (const(7) // 0, None),
        (-col("i"), -5),
        (-col("m"), -1.5),
        (-const(-(2**63)), 2.0**63),
        (const("3.7") + 1, 4.7),
        (const("x") + 1, 1.0),
        (const(1).eq(1), 1),
        (const(1).ne(1), 0),
        (const(1) < NULL, None),
        (const("b") > "a", 1),
        (const(10) < "9", 1),
        (const(1).eq(1.0), 1),
        (col("t").eq("2024-02-29 13:14:15"), 1),
        (NULL & const(0), 0),
        (NULL & const(1), None),
        (NULL | const(1), 1),
        (~NULL, None),
        (~const(0), 1),
        (const("0.0") & const(1), 1),
        (const("0") | const(""), 0),
        (NULL.is_null(), 1),
        (const(1).is_not_null(), 1),
        (Like(const("Hello"), const("hello")), 1),
        (Like(const("Hello"), const("h_l%")), 1),
        (Like(const("100%"), const("100\\%")), 1),
        (Like(const("100x"), const("100\\%")), 0),
        (Like(const("a\nb"), const("a%b")), 1),
        (Like(NULL, const("%")), None),
        (Like(const("ab"), const("a"), True), 1),
        (Like(const("a\\"), const("a\\")), 1),
        (In(const(4), (const(1), NULL)), None),
        (In(const(1), (const(1), NULL)), 1),
        (In(const(4), (const(1), const(2))), 0),
        (In(const(4), ()), 0),
        (In(const(4), (const(1), NULL), True), None),
        (In(const("5"), (const(5),)), 1),
        (Between(const(5), const(1), const(10)), 1),
        (Between(const(5), NULL, const(3)), None),
        (Between(const(5), const(6), const(10), True), 1),
        (Cast(const(3.7), 3), 3),
        (Cast(const("3.7"), 3), 0),
        (Cast(const(" 42 "), 3), 42),
        (Cast(const("123.45"), 6), Decimal("123.4500000000")),
        (Cast(const("not_a_number"), 6), None),
        (Cast(const("2024-01-02 03:04:05"), 13), datetime(2024, 1, 2, 3, 4, 5)),
        (Cast(const("not-a-date"), 13), None),
        (Cast(col("t"), 8), "2024-02-29 13:14:15"),
        (Cast(col("b"), 8), "0x0aff"),
        (Cast(col("b"), 3), 0),
        (Cast(const("x"), 12), "x"),
        (case((NULL, "a"), (const(1), "b")), "b"),
        (case((const(0), "a")), None),
        (case((1, "one"), (2, "two"), operand=const(2)), "two"),
        (case((NULL, "one"), otherwise="none", operand=NULL), "none"),
        (case((const(1), 1), otherwise="x"), "1"),
    ],
)
def test_expression(value, e, want):
    assert value(e) == want


@pytest.mark.parametrize(
    "e, want",
    [
        (call("IF", NULL, 1, 2), 2),
        (call("ifnull", NULL, "x"), "x"),
        (call("NULLIF", 1, 1), None),
        (call("NULLIF", 1, 2), 1),
        (call("COALESCE", NULL, NULL, 3), 3),
        (call("CONCAT", "hello", NULL), None),
        (call("CONCAT", "a", 1, col("t")), "a12024-02-29 13:14:15"),
        (call("CONCAT_WS", ",", "a", NULL, "b"), "a,b"),
        (call("CONCAT_WS", NULL, "a"), None),
        (call("CONCAT_WS", ",", NULL), ""),
        (call("LENGTH", "héllo"), 5),
        (call("UCASE", "aß"), "ASS"),
        (call("TRIM", "\x01 a b\t\n"), "a b"),
        (call("LTRIM", "  a "), "a "),
        (call("RTRIM", " a  "), " a"),
        (call("REVERSE", "abc"), "cba"),
        (call("SPACE", -1), ""),
        (call("SPACE", 70000), " " * 65535),
        (call("REPEAT", "ab", 2), "abab"),
        (call("REPEAT", "ab", -2), ""),
        (call("SUBSTR", "abc", 0, 2), ""),
        (call("SUBSTR", "abc", -5, 3), "abc"),
        (call("SUBSTR", "abc", -2), "bc"),
        (call("SUBSTR", "abc", 9, 2), ""),
        (call("LEFT", "abc", -1), ""),
        (call("LEFT", "abc", 9), "abc"),
        (call("RIGHT", "abc", 2), "bc"),
        (call("REPLACE", "NULLs", NULL, "x"), "xs"),
        (call("REPLACE", "ab", "", "-"), "-a-b-"),
        (call("LPAD", "a", 5, "xy"), "xyxya"),
        (call("LPAD", "abc", 2, "x"), "ab"),
        (call("RPAD", "a", 4, "xy"), "axyx"),
        (call("RPAD", "a", 4, ""), None),
        (call("RPAD", "a", -1, "x"), None),
        (call("LOCATE", "b", "abcb"), 2),
        (call("INSTR", "b", "abcb", 3), 4),
        (call("POSITION", "z", "abc"), 0),
        (call("LOCATE", "", "abc", 9), 4),
        (call("HEX", 255), "FF"),
        (call("HEX", -1), "FFFFFFFFFFFFFFFF"),
        (call("HEX", "az"), "617A"),
        (call("UNHEX", "617A"), "az"),
        (call("UNHEX", "617"), None),
        (call("UNHEX", "zz"), None),
        (call("ABS", -3), 3),
        (call("ABS", const(-(2**63))), 2.0**63),
        (call("ABS", -2.5), 2.5),
        (call("CEIL", 1.2), 2),
        (call("FLOOR", -1.2), -2),
        (call("ROUND", 3.5), 4),
        (call("ROUND", -2.5), -3),
        (call("ROUND", 3.456, 2), 3.46),
        (call("ROUND", 1250, -2), 1300.0),
        (call("TRUNCATE", -3.99, 0), -3),
        (call("TRUNCATE", 3.999, 2), 3.99),
        (call("TRUNCATE", 1299, -2), 1200.0),
        (call("MOD", 10, 0), None),
        (call("MOD", -10, 3), -1),
        (call("MOD", 10.9, 3), 1),
        (call("SQRT", -1), None),
        (call("SQRT", 9), 3.0),
        (call("POWER", 2, 10), 1024.0),
        (call("LOG", 0), None),
        (call("LOG", 1, 5), None),
        (call("LOG", 2, 8), 3.0),
        (call("LOG2", -1), None),
        (call("LOG_10", 1000), 3.0),
        (call("EXP", 0), 1.0),
        (call("SIGN", -0.5), -1),
        (call("CRC32", "123456789"), 0xCBF43926),
        (call("GREATEST", 1, NULL), None),
        (call("GREATEST", 1, 2.5), 2.5),
        (call("LEAST", "b", "a"), "a"),
        (call("YEAR", "nonsense"), 2000),
        (call("YEAR", "1999-05-06"), 1999),
        (call("DAYOFWEEK", "2024-02-25"), 1),
        (call("DAYOFYEAR", col("t")), 60),
        (call("DATEDIFF", "2024-03-01 23:59:59", "2024-02-28"), 2),
        (call("DATE_ADD", "2024-02-28 10:11:12", 2), datetime(2024, 3, 1, 10, 11, 12)),
        (call("SUBDATE", "2024-03-01", 1), datetime(2024, 2, 29)),
        (call("UNIX_TIMESTAMP", "1970-01-02"), 86400),
        (call("FROM_UNIXTIME", 86400), datetime(1970, 1, 2)),
        (call("DATE_FORMAT", col("t"), "%Y|%y|%m|%d|%T|%j|%W|%a|%b"), "2024|24|02|29|13:14:15|060|Thursday|Thu|Feb"),
        (call("DATABASE"), None),
        (call("CONNECTION_ID"), 0),
        (call("LENGTH"), None),
        (call("LPAD", "a", 3), None),
        (call("YEAR", NULL), None),
    ],
)
def test_function(value, e, want):
    got = value(e)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_errors(value):
    for e in (call("NO_SUCH"), col("zz"), Cast(call("NO_SUCH"), 3)):
        with pytest.raises(RequestError):
            value(e)
    for e in (col("low") - 1, const(2**62) * 4, call("SUBSTR", "abc", 1, -1), call("RIGHT", "abc", -1)):
        with pytest.raises(Exception, match="OVERFLOW|negative"):
            value(e)


def test_column_beyond_row_is_null(value):
    assert value(col(99)) is None
    assert value(col(0)) == 5


def test_collation(value):
    assert value(const("ABC").eq(col("s")), 1) == 1
    assert value(const("ABC").eq(col("s"))) == 0
    assert value(In(const("ABC"), (col("s"),)), 2) == 1


def test_patterns_from_columns(spark):
    rows = spark.createDataFrame([("100%", "100\\%"), ("abc", "A_C"), ("a\\", "a\\"), ("xz", "x\\z")], "v string, p string")
    out = rows.select(Scope(rows.schema).compile(Like(col("v"), col("p"))).col.alias("x")).collect()
    assert [r.x for r in out] == [True, True, True, True]


def test_constants_of_all_kinds(value):
    assert value(Const(b"\x01")) == bytearray(b"\x01")
    assert value(const(Decimal("1.25"))) == Decimal("1.25")
    assert value(const(datetime(2020, 1, 2, 3))) == datetime(2020, 1, 2, 3)
    with pytest.raises(RequestError):
        value(const(2**63))
