"""Kinds of values and the coercions between them.

The request language types values; we type columns. Kinds: int (64 bits), double, decimal,
string, bytes, datetime, null, and bool for predicates, which become int 1/0 when they are
shown.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP = "yyyy-MM-dd HH:mm:ss"
NUMERIC = ("int", "double", "decimal")
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class RequestError(ValueError):
    """A request that can't be compiled."""


@dataclass(frozen=True)
class Typed:
    """A column with its kind; literal holds the Python value of a constant."""

    col: Column
    kind: str
    literal: Any = None

    def shown(self) -> Typed:
        return Typed(self.col.cast("bigint"), "int") if self.kind == "bool" else self


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.NullType):
        return "null"
    raise RequestError(f"no kind for {t.simpleString()}")


def of_column(c: Column, t: T.DataType) -> Typed:
    kind = kind_of(t)
    to = {"int": "bigint", "double": "double", "datetime": "timestamp_ntz"}.get(kind)
    return Typed(c.cast(to) if to and t.simpleString() != to else c, kind)


def of_literal(v: Any) -> Typed:
    if v is None:
        return Typed(F.lit(None).cast("string"), "null")
    if isinstance(v, bool):
        return Typed(F.lit(int(v)).cast("bigint"), "int", int(v))
    if isinstance(v, int):
        if not LONG_MIN <= v <= LONG_MAX:
            raise RequestError(f"{v} doesn't fit 64 bits")
        return Typed(F.lit(v).cast("bigint"), "int", v)
    if isinstance(v, float):
        return Typed(F.lit(v), "double", v)
    if isinstance(v, Decimal):
        return Typed(F.lit(v), "decimal", v)
    if isinstance(v, str):
        return Typed(F.lit(v), "string", v)
    if isinstance(v, (bytes, bytearray)):
        return Typed(F.lit(bytearray(v)), "bytes", bytes(v))
    if isinstance(v, datetime):
        return Typed(F.lit(v.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"), "datetime", v)
    if isinstance(v, date):
        return Typed(F.lit(v.isoformat()).cast("timestamp_ntz"), "datetime", v)
    raise RequestError(f"no constant of {type(v).__name__}")


def null(kind: str = "string") -> Typed:
    return Typed(F.lit(None).cast({"int": "bigint", "double": "double", "datetime": "timestamp_ntz"}.get(kind, "string")), kind)


def truthy(x: Typed) -> Column:
    """BOOLEAN: numbers unlike 0, strings unlike '' and '0', all bytes and datetimes; null stays null."""
    if x.kind == "bool":
        return x.col
    if x.kind in NUMERIC:
        return x.col != 0
    if x.kind == "string":
        return (x.col != "") & (x.col != "0")
    if x.kind == "null":
        return F.lit(None).cast("boolean")
    return F.when(x.col.isNotNull(), F.lit(True))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def to_long(x: Typed) -> Column:
    x = x.shown()
    if x.kind == "int":
        return x.col
    if x.kind == "double":  # truncates, and stays within 64 bits
        whole = F.when(F.isnan(x.col), F.lit(0).cast("bigint")).when(x.col >= 2.0**63, F.lit(LONG_MAX)).when(x.col <= -(2.0**63), F.lit(LONG_MIN))
        return whole.otherwise(x.col.try_cast("bigint"))
    if x.kind == "decimal":
        return x.col.try_cast("bigint")
    if x.kind == "string":
        t = trimmed(x.col)
        parsed = F.when(t.rlike("^[+-]?[0-9]+$"), F.coalesce(t.try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
        return F.when(x.col.isNotNull(), parsed)
    return F.when(x.col.isNotNull(), F.lit(0).cast("bigint"))


def to_double(x: Typed) -> Column:
    x = x.shown()
    if x.kind in NUMERIC:
        return x.col.cast("double")
    if x.kind == "string":
        return F.when(x.col.isNotNull(), F.coalesce(trimmed(x.col).try_cast("double"), F.lit(0.0)))
    return F.when(x.col.isNotNull(), F.lit(0.0))


def to_str(x: Typed) -> Column:
    x = x.shown()
    if x.kind == "datetime":
        return F.date_format(x.col, STAMP)
    if x.kind == "bytes":
        return F.concat(F.lit("0x"), F.lower(F.hex(x.col)))
    return x.col if x.kind in ("string", "null") else x.col.cast("string")


def parsed_datetime(c: Column) -> Column:
    """A datetime or a date in text; null if it is neither."""
    t = F.trim(c)
    stamp = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t.try_cast("timestamp_ntz"))
    return F.coalesce(stamp, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("timestamp_ntz")))


def to_datetime(x: Typed) -> Column:
    """As date functions read it: what can't be read is the start of 2000."""
    if x.kind == "datetime":
        return x.col
    return F.when(x.col.isNotNull(), F.coalesce(parsed_datetime(to_str(x)), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")))


def common(values: list[Typed]) -> tuple[str, list[Column]]:
    """One kind for several values: the same, else the wider number, else text."""
    values = [v.shown() for v in values]
    kinds = {v.kind for v in values} - {"null"}
    if not kinds:
        return "null", [v.col for v in values]
    if len(kinds) == 1:
        kind = kinds.pop()
        to = {"int": "bigint", "double": "double", "datetime": "timestamp_ntz", "decimal": "decimal(38,10)", "bytes": "binary"}.get(kind, "string")
        return kind, [v.col.cast(to) if v.kind == "null" else v.col for v in values]
    if kinds <= set(NUMERIC):
        if "double" in kinds:
            return "double", [v.col.cast("double") for v in values]
        return "decimal", [v.col.cast("decimal(38,10)") for v in values]
    return "string", [to_str(v) for v in values]


def comparable(a: Typed, b: Typed, collation: int = 0) -> tuple[Column, Column]:
    """Both sides as values that compare by value if numbers or of one kind, else as text."""
    a, b = a.shown(), b.shown()
    if a.kind in NUMERIC and b.kind in NUMERIC:
        if a.kind != b.kind and "double" in (a.kind, b.kind):
            return a.col.cast("double"), b.col.cast("double")
        return a.col, b.col
    if "null" in (a.kind, b.kind):
        return to_str(a), to_str(b)
    if a.kind == b.kind and a.kind in ("datetime", "bytes"):
        return a.col, b.col
    return collated(to_str(a), "string", collation), collated(to_str(b), "string", collation)


def collated(c: Column, kind: str, collation: int) -> Column:
    """Text under a request's collation: 0 by bytes, 1 and 2 without case."""
    return F.collate(c, "UTF8_LCASE") if collation in (1, 2) and kind == "string" else c
