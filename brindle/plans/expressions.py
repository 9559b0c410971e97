"""Expression trees to columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalar
from ..functions.types import LONG_MIN, RequestError, Typed, common, comparable, null, of_column, of_literal, parsed_datetime, to_double, to_long, to_str, truthy
from . import ir
from .ir import BinaryOp, UnaryOp

_COMPARE = {BinaryOp.EQ: "__eq__", BinaryOp.NE: "__ne__", BinaryOp.LT: "__lt__", BinaryOp.LE: "__le__", BinaryOp.GT: "__gt__", BinaryOp.GE: "__ge__"}
_ARITHMETIC = {BinaryOp.ADD: "__add__", BinaryOp.SUB: "__sub__", BinaryOp.MUL: "__mul__"}


class Scope:
    """The visible columns of a plan stage, by name and by place."""

    def __init__(self, schema: StructType, collation: int = 0):
        self.schema, self.collation = schema, collation

    def column(self, ref: str | int) -> Typed:
        names = self.schema.names
        if isinstance(ref, int):
            if not 0 <= ref < len(names):
                return null()  # beyond the row: null
            ref = names[ref]
        if ref not in names:
            raise RequestError(f"no column {ref}")
        return of_column(F.col(f"`{ref}`"), self.schema[ref].dataType)

    def compile(self, e: ir.Expr) -> Typed:
        for kind, method in _NODES.items():
            if isinstance(e, kind):
                return method(self, e)
        raise RequestError(f"unknown expression {e!r}")

    def predicate(self, e: ir.Expr) -> Column:
        return truthy(self.compile(e))

    def _binary(self, e: ir.Binary) -> Typed:
        a, b = self.compile(e.left), self.compile(e.right)
        try:
            op = BinaryOp(e.op)
        except ValueError:
            raise RequestError(f"unknown operator {e.op}") from None
        if op == BinaryOp.AND:
            return Typed(truthy(a) & truthy(b), "bool")
        if op == BinaryOp.OR:
            return Typed(truthy(a) | truthy(b), "bool")
        if op in _COMPARE:
            x, y = comparable(a, b, self.collation)
            return Typed(getattr(x, _COMPARE[op])(y), "bool")
        a, b = a.shown(), b.shown()
        ints = a.kind == b.kind == "int"
        if op in _ARITHMETIC:  # whole numbers overflow with an error; all else is double, decimals too
            x, y = (a.col, b.col) if ints else (to_double(a), to_double(b))
            return Typed(getattr(x, _ARITHMETIC[op])(y), "int" if ints else "double")
        if op == BinaryOp.DIV:
            return Typed(F.try_divide(to_double(a), to_double(b)), "double")
        if op == BinaryOp.MOD:
            return Typed(F.try_mod(a.col, b.col) if ints else F.try_mod(to_double(a), to_double(b)), "int" if ints else "double")
        y = to_long(b)
        return Typed(F.call_function("div", to_long(a), F.when(y != 0, y)), "int")

    def _unary(self, e: ir.Unary) -> Typed:
        a = self.compile(e.arg)
        if e.op == UnaryOp.NOT:
            return Typed(~truthy(a), "bool")
        if e.op == UnaryOp.IS_NULL:
            return Typed(a.col.isNull(), "bool")
        if e.op == UnaryOp.IS_NOT_NULL:
            return Typed(a.col.isNotNull(), "bool")
        if e.op != UnaryOp.NEG:
            raise RequestError(f"unknown operator {e.op}")
        a = a.shown()
        if a.kind == "int" and a.literal != LONG_MIN:
            return Typed(-a.col, "int")
        return Typed(-to_double(a), "double")

    def _like(self, e: ir.Like) -> Typed:
        v, p = self.compile(e.value), self.compile(e.pattern)
        out = _like(to_str(v), to_str(p), p.literal)
        return Typed(~out if e.negated else out, "bool")

    def _in(self, e: ir.In) -> Typed:
        v = self.compile(e.value)
        items = [self.compile(i) for i in e.items]
        if not items:
            out = F.when(v.col.isNotNull(), F.lit(False))
        elif all(i.literal is not None and (i.kind == v.kind or {i.kind, v.kind} <= {"int", "double"}) for i in items) and not (self.collation and v.kind == "string"):
            out = v.shown().col.isin(*(i.literal for i in items)) if v.kind in ("int", "double", "string") else reduce(Column.__or__, (comparable(v, i)[0] == comparable(v, i)[1] for i in items))
        else:  # three-valued: true wins, then null
            out = reduce(Column.__or__, (x == y for x, y in (comparable(v, i, self.collation) for i in items)))
        return Typed(~out if e.negated else out, "bool")

    def _between(self, e: ir.Between) -> Typed:
        v, low, high = (self.compile(x) for x in (e.value, e.low, e.high))
        (x, y), (x2, z) = comparable(v, low, self.collation), comparable(v, high, self.collation)
        inside = (x >= y) & (x2 <= z)
        # plain if the bounds can't be null, so that it reaches the scan; else any null gives null
        if low.literal is None or high.literal is None:
            inside = F.when(v.col.isNotNull() & low.col.isNotNull() & high.col.isNotNull(), inside)
        return Typed(~inside if e.negated else inside, "bool")

    def _cast(self, e: ir.Cast) -> Typed:
        a = self.compile(e.value).shown()
        c = e.code
        if c in (0, 1, 2, 3):
            return Typed(to_long(a), "int")
        if c in (4, 5):
            return Typed(to_double(a), "double")
        if c == 6:
            if a.kind == "decimal":
                return a
            source = a.col if a.kind == "int" else to_str(a) if a.kind != "string" else F.trim(a.col)
            return Typed(source.try_cast("decimal(38,10)"), "decimal")
        if c in (7, 8, 9):
            return Typed(to_str(a), "string")
        if c in (13, 14):
            if a.kind == "datetime":
                return a
            t = F.trim(to_str(a))
            return Typed(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), parsed_datetime(t)), "datetime")
        return a  # other codes leave values as they are

    def _case(self, e: ir.Case) -> Typed:
        values = [self.compile(v) for _, v in e.branches] + ([self.compile(e.otherwise)] if e.otherwise is not None else [])
        if not e.branches:
            return values[0] if values else null()
        kind, cols = common(values)
        out = F
        for (when, _), then in zip(e.branches, cols):
            if e.operand is None:
                test = self.predicate(when)
            else:
                x, y = comparable(self.compile(e.operand), self.compile(when), self.collation)
                test = x == y
            out = out.when(test, then)
        return Typed(out.otherwise(cols[-1]) if e.otherwise is not None else out, kind)

    def _call(self, e: ir.Call) -> Typed:
        return scalar.build(e.name, [self.compile(a) for a in e.args], self.collation)


_NODES = {
    ir.Const: lambda s, e: of_literal(e.value),
    ir.ColumnRef: lambda s, e: s.column(e.ref),
    ir.Binary: Scope._binary,
    ir.Unary: Scope._unary,
    ir.Like: Scope._like,
    ir.In: Scope._in,
    ir.Between: Scope._between,
    ir.Cast: Scope._cast,
    ir.Case: Scope._case,
    ir.Call: Scope._call,
}


def _like(value: Column, pattern: Column, literal: str | None) -> Column:
    """Never minds case. Constant patterns become the engine's own LIKE, a plain start, end or middle at best."""
    if literal is not None:
        # only escapes of %, _ and backslash are legal; others stand for the character itself
        clean = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], literal, flags=re.S)
        if re.sub(r"\\.", "", clean, flags=re.S).endswith("\\"):
            clean += "\\"
        return F.lower(value).like(clean.lower())
    fixed = F.regexp_replace(F.lower(pattern), r"\\([^%_\\])", "$1")
    lone = F.regexp_extract(fixed, r"(\\*)$", 1)
    fixed = F.when(F.length(lone) % 2 == 1, F.concat(fixed, F.lit("\\"))).otherwise(fixed)
    return F.like(F.lower(value), fixed)

