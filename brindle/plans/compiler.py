"""Requests to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.types import RequestError, collated
from ..sources import scans
from ..sources.catalog import Catalog, Table
from . import ir
from .expressions import Scope


def compile_request(request: ir.Request, catalog: Catalog) -> DataFrame:
    """The lazy result of a request.

    The order is scan, conditions, projections, then aggregates or top-n or limit. Columns
    are the projections if there are any, else the request's columns, else the table's.
    """
    table = catalog[request.table]
    df, order = _scan(request, table)
    scope = Scope(df.schema, request.collation)
    for condition in request.conditions:
        df = df.where(scope.predicate(condition))
    order_cols = [f"_o{i}" for i in range(len(order))]
    if request.projections:
        shown = [scope.compile(p.expr).shown().col.alias(p.name) for p in request.projections]
        df = df.select(*shown, *(F.col(f"`{c}`").alias(o) for c, o in zip(order, order_cols)))
        names = [p.name for p in request.projections]
    else:
        names = list(request.columns or [c for c in df.columns])
        df = df.select(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{c}`").alias(o) for c, o in zip(order, order_cols)))
    scope = Scope(df.select(*(F.col(f"`{n}`") for n in names)).schema, request.collation)
    if request.aggregates or request.group_by:
        if request.order_by or request.limit is not None:
            raise RequestError("aggregates don't go with order or limit; sort their result instead")
        return _aggregate(df, scope, request, order_cols)
    limit = min((x for x in (request.limit, request.paging_size) if x is not None), default=None)
    if limit is not None and limit < 0 or request.offset < 0:
        raise RequestError("limit and offset must be 0 or more")
    if request.order_by:
        keys = []
        for by in request.order_by:
            t = scope.compile(by.expr).shown()
            c = collated(t.col, t.kind, request.collation)
            keys.append(c.desc_nulls_last() if by.desc else c.asc_nulls_first())
        df = df.orderBy(*keys, *scans.sort_keys(order_cols))
    elif limit is not None or request.offset or request.desc_scan or request.index:
        df = df.orderBy(*scans.sort_keys(order_cols, request.desc_scan))
    if request.offset:
        df = df.offset(request.offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*(F.col(f"`{n}`") for n in names))


def _scan(request: ir.Request, table: Table) -> tuple[DataFrame, list[str]]:
    if not request.index:
        return scans.table_scan(table, request.ranges, request.resume_after, request.desc_scan, request.read_ts), table.order
    name = request.index.name
    read = scans.index_lookup if request.index.lookup else scans.index_scan
    return read(table, name, request.ranges, request.read_ts), [*table.index_columns(name), table.handle]


def _calls(scope: Scope, request: ir.Request) -> list[agg.Call]:
    calls = []
    for i, a in enumerate(request.aggregates):
        value = None if a.arg is None else scope.compile(a.arg)
        calls.append(agg.Call(int(a.kind), None if value is None else f"_a{i}", value, a.distinct, a.name or f"agg{i}"))
    return calls


def _aggregate(df: DataFrame, scope: Scope, request: ir.Request, order: list[str]) -> DataFrame:
    calls = _calls(scope, request)
    groups = [g.name for g in request.group_by]
    keys = []
    for g in request.group_by:
        t = scope.compile(g.expr).shown()
        keys.append(collated(t.col, t.kind, request.collation).alias(g.name))
    arguments = [agg.argument(c.kind, c.value).alias(c.arg) for c in calls if c.arg is not None]
    in_order = any(c.kind == agg.GROUP_CONCAT for c in calls)
    flat = df.select(*keys, *arguments, *(order if in_order else []))
    if request.partial:
        return agg.partial(flat, groups, calls, order, request.collation)
    out = flat.groupBy(*groups).agg(*(agg.column(c, order, request.collation) for c in calls)) if calls else flat.groupBy(*groups).agg(F.count("*").alias("_n")).drop("_n")
    if request.max_groups is not None and groups:
        # one row more than allowed shows an excess, and no more than that are ever put together
        some = out.limit(request.max_groups + 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
        excess = F.raise_error(F.lit(f"more than {request.max_groups} groups")).cast("boolean")
        out = some.where(F.when(F.col("_n") <= request.max_groups, F.lit(True)).otherwise(excess)).drop("_n")
    return out


def merge_partials(states: DataFrame, request: ir.Request, catalog: Catalog, order: list[str] | None = None) -> DataFrame:
    """The final result of states that partial requests gave, from any number of parts; order ranks the parts."""
    df = catalog[request.table].rows()
    scope = Scope(df.schema, request.collation)
    if request.projections:
        scope = Scope(df.select(*(scope.compile(p.expr).shown().col.alias(p.name) for p in request.projections)).schema, request.collation)
    return agg.final(states, [g.name for g in request.group_by], _calls(scope, request), order or [])
