"""The request language: expression trees, aggregates, sort keys, key ranges, requests."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

# The wire numbers of the request language.


class BinaryOp(IntEnum):
    ADD = 0
    SUB = 1
    MUL = 2
    DIV = 3
    MOD = 4
    INT_DIV = 5
    EQ = 6
    NE = 7
    LT = 8
    LE = 9
    GT = 10
    GE = 11
    AND = 12
    OR = 13


class UnaryOp(IntEnum):
    NOT = 0
    NEG = 1
    IS_NULL = 2
    IS_NOT_NULL = 3


class AggType(IntEnum):
    COUNT = 0
    SUM = 1
    AVG = 2
    MIN = 3
    MAX = 4
    GROUP_CONCAT = 5


class TypeCode(IntEnum):
    TINYINT = 0
    SMALLINT = 1
    INT = 2
    BIGINT = 3
    FLOAT = 4
    DOUBLE = 5
    DECIMAL = 6
    CHAR = 7
    VARCHAR = 8
    TEXT = 9
    DATETIME = 13
    TIMESTAMP = 14


class RequestType(IntEnum):
    TABLE_SCAN = 0
    SELECT = 1
    ANALYZE = 2
    INDEX_SCAN = 3
    SPLIT_KEYS = 4
    CHECKSUM = 5


class Expr:
    """Base of all expressions; operators build trees: (col("a") + 1) > col("b")."""

    def _bin(self, op: BinaryOp, other: Any, flip: bool = False) -> Binary:
        other = wrap(other)
        return Binary(op, other, self) if flip else Binary(op, self, other)

    def __add__(self, o):
        return self._bin(BinaryOp.ADD, o)

    def __radd__(self, o):
        return self._bin(BinaryOp.ADD, o, True)

    def __sub__(self, o):
        return self._bin(BinaryOp.SUB, o)

    def __rsub__(self, o):
        return self._bin(BinaryOp.SUB, o, True)

    def __mul__(self, o):
        return self._bin(BinaryOp.MUL, o)

    def __rmul__(self, o):
        return self._bin(BinaryOp.MUL, o, True)

    def __truediv__(self, o):
        return self._bin(BinaryOp.DIV, o)

    def __mod__(self, o):
        return self._bin(BinaryOp.MOD, o)

    def __floordiv__(self, o):
        return self._bin(BinaryOp.INT_DIV, o)

    def __lt__(self, o):
        return self._bin(BinaryOp.LT, o)

    def __le__(self, o):
        return self._bin(BinaryOp.LE, o)

    def __gt__(self, o):
        return self._bin(BinaryOp.GT, o)

    def __ge__(self, o):
        return self._bin(BinaryOp.GE, o)

    def __and__(self, o):
        return self._bin(BinaryOp.AND, o)

    def __or__(self, o):
        return self._bin(BinaryOp.OR, o)

    def __invert__(self):
        return Unary(UnaryOp.NOT, self)

    def __neg__(self):
        return Unary(UnaryOp.NEG, self)

    def eq(self, o):
        return self._bin(BinaryOp.EQ, o)

    def ne(self, o):
        return self._bin(BinaryOp.NE, o)

    def is_null(self):
        return Unary(UnaryOp.IS_NULL, self)

    def is_not_null(self):
        return Unary(UnaryOp.IS_NOT_NULL, self)

    def like(self, pattern, negated=False):
        return Like(self, wrap(pattern), negated)

    def isin(self, *items, negated=False):
        return In(self, tuple(map(wrap, items)), negated)

    def between(self, low, high, negated=False):
        return Between(self, wrap(low), wrap(high), negated)

    def cast(self, code: int):
        return Cast(self, code)

    def named(self, name: str) -> Named:
        return Named(self, name)


@dataclass(frozen=True)
class Const(Expr):
    """A Python int, float, Decimal, str, bytes, datetime or None."""

    value: Any


@dataclass(frozen=True)
class ColumnRef(Expr):
    """A column by name, or by place among the visible columns."""

    ref: str | int


@dataclass(frozen=True)
class Binary(Expr):
    op: int
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: int
    arg: Expr


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class Cast(Expr):
    value: Expr
    code: int


@dataclass(frozen=True)
class Case(Expr):
    """branches of (when, then); with operand, when is compared with it."""

    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None
    operand: Expr | None = None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Named:
    expr: Expr
    name: str


def wrap(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Const(x)


def col(ref: str | int) -> ColumnRef:
    return ColumnRef(ref)


def const(value: Any) -> Const:
    return Const(value)


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(map(wrap, args)))


def case(*branches: tuple[Any, Any], otherwise: Any = None, operand: Any = None) -> Case:
    pairs = tuple((wrap(a), wrap(b)) for a, b in branches)
    return Case(pairs, None if otherwise is None else wrap(otherwise), None if operand is None else wrap(operand))


@dataclass(frozen=True)
class Agg:
    """An aggregate; without an argument COUNT counts rows."""

    kind: int
    arg: Expr | None = None
    distinct: bool = False
    name: str | None = None


@dataclass(frozen=True)
class OrderBy:
    expr: Expr
    desc: bool = False


@dataclass(frozen=True)
class KeyRange:
    """[low, high) of handles, or of an index's first columns, as a value or a tuple; None is open."""

    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class IndexSpec:
    """A scan of an index of the table; lookup fetches whole rows by handle."""

    name: str
    lookup: bool = False


@dataclass(frozen=True)
class Request:
    """A push-down query: scan, then conditions, then projections, then aggregates or top-n or limit."""

    table: str
    columns: tuple[str, ...] | None = None
    ranges: tuple[KeyRange, ...] = ()
    conditions: tuple[Expr, ...] = ()
    projections: tuple[Named, ...] = ()
    group_by: tuple[Named, ...] = ()
    aggregates: tuple[Agg, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int = 0
    desc_scan: bool = False
    paging_size: int | None = None
    resume_after: Any = None
    collation: int = 0
    index: IndexSpec | None = None
    read_ts: int | None = None
    partial: bool = False
    max_groups: int | None = None
    options: dict = field(default_factory=dict, hash=False, compare=False)
