"""Aggregates in one step, and as partial states that are merged later.

SUM and AVG are exact: whole numbers and decimals are added as decimals, doubles by their
shortest decimal text to ten places. AVG has four places, half up. GROUP_CONCAT joins in
scan order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import RequestError, Typed, collated, to_double, to_str

COUNT, SUM, AVG, MIN, MAX, GROUP_CONCAT = range(6)
SEPARATOR = ","


@dataclass(frozen=True)
class Call:
    """One aggregate over arg, a column that was projected under a name of its own; name is the result's."""

    kind: int
    arg: str | None
    value: Typed | None
    distinct: bool
    name: str


def exact(x: Typed) -> Column:
    """A value as a decimal that sums without loss."""
    x = x.shown()
    if x.kind == "int":
        return x.col.cast("decimal(20,0)")
    if x.kind == "decimal":
        return x.col
    return to_double(x).cast("decimal(28,10)")


def average(total: Column, n: Column) -> Column:
    """total / n to four places, half up, by whole-number division."""
    t = total.cast("decimal(33,10)")
    ten_thousandths = F.call_function("div", F.abs(t) * F.lit(20000).cast("decimal(5,0)") + n.cast("decimal(20,0)"), (n * 2).cast("decimal(20,0)"))
    return F.when(n > 0, (F.when(t < 0, -ten_thousandths).otherwise(ten_thousandths).cast("decimal(19,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(24,4)"))


def _extreme(f, a: Call, collation: int) -> Column:
    c = F.col(a.arg)
    return f(collated(c, a.value.kind, collation))


def _ordered(a: Call, order: list[str]) -> Column:
    """The texts of a group, none of them null, in scan order."""
    rows = F.collect_list(F.when(F.col(a.arg).isNotNull(), F.struct(*order, F.col(a.arg).alias("_v"))))
    return F.transform(F.array_sort(rows), lambda r: r["_v"])


def column(a: Call, order: list[str], collation: int = 0) -> Column:
    c = F.lit(1) if a.arg is None else F.col(a.arg)
    if a.kind == COUNT:
        return (F.count_distinct(c) if a.distinct else F.count(c)).alias(a.name)
    if a.arg is None:
        raise RequestError("only COUNT goes without an argument")
    if a.kind == SUM:
        return (F.sum_distinct(c) if a.distinct else F.sum(c)).alias(a.name)
    if a.kind == AVG:
        return average(*((F.sum_distinct(c), F.count_distinct(c)) if a.distinct else (F.sum(c), F.count(c)))).alias(a.name)
    if a.kind == MIN:
        return _extreme(F.min, a, collation).alias(a.name)
    if a.kind == MAX:
        return _extreme(F.max, a, collation).alias(a.name)
    if a.kind == GROUP_CONCAT:
        texts = _ordered(a, order)
        texts = F.array_distinct(texts) if a.distinct else texts
        return F.when(F.size(texts) > 0, F.array_join(texts, SEPARATOR)).alias(a.name)
    raise RequestError(f"unknown aggregate {a.kind}")


def argument(kind: int, value: Typed) -> Column:
    """What an aggregate's argument is projected to."""
    if kind in (SUM, AVG):
        return exact(value)
    return to_str(value) if kind == GROUP_CONCAT else value.shown().col


def partial(df: DataFrame, groups: list[str], calls: list[Call], order: list[str], collation: int = 0) -> DataFrame:
    """States of each group: name_count, name_sum or name_value columns, as each aggregate needs."""
    out = []
    for a in calls:
        if a.distinct and a.kind not in (MIN, MAX):
            raise RequestError("distinct aggregates have no states that can be merged")
        if a.kind in (COUNT, AVG):
            out.append(F.count(F.lit(1) if a.arg is None else F.col(a.arg)).alias(f"{a.name}_count"))
        if a.kind in (SUM, AVG):
            out.append(F.sum(a.arg).alias(f"{a.name}_sum"))
        if a.kind in (MIN, MAX, GROUP_CONCAT):
            out.append(column(a, order, collation).alias(f"{a.name}_value"))
    return df.groupBy(*groups).agg(*out)


def final(states: DataFrame, groups: list[str], calls: list[Call], order: list[str]) -> DataFrame:
    """Merges states of any number of partial results; order ranks them for GROUP_CONCAT."""
    out = []
    for a in calls:
        n, total, value = f"{a.name}_count", f"{a.name}_sum", f"{a.name}_value"
        if a.kind == COUNT:
            out.append(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(a.name))
        elif a.kind == SUM:
            out.append(F.sum(total).alias(a.name))
        elif a.kind == AVG:
            out.append(average(F.sum(total), F.coalesce(F.sum(n), F.lit(0))).alias(a.name))
        elif a.kind == MIN:
            out.append(F.min(value).alias(a.name))
        elif a.kind == MAX:
            out.append(F.max(value).alias(a.name))
        else:
            out.append(column(Call(GROUP_CONCAT, value, a.value, False, a.name), order))
    return states.groupBy(*groups).agg(*out)
