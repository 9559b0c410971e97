"""Scans by key ranges, index scans, index lookups."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import RequestError
from ..plans.ir import KeyRange
from .catalog import Table


def in_ranges(keys: str | tuple[str, ...], ranges: tuple[KeyRange, ...]) -> Column | None:
    """[low, high) of any range; rows in ranges that overlap come once.

    Of several columns, a bound is a value of the first or a tuple of values of the first
    few, and compares in their order. The first column's own bounds come as plain
    comparisons, so they reach the files.
    """
    keys = (keys,) if isinstance(keys, str) else keys
    tests = []
    for r in ranges:
        low, high = (() if x is None else x if isinstance(x, tuple) else (x,) for x in (r.low, r.high))
        if max(len(low), len(high)) > len(keys):
            raise RequestError("a bound has more values than its index has columns")
        parts = []
        if low:
            parts += [F.col(keys[0]) >= _value(low[0])] + ([_before(keys, low, False)] if len(low) > 1 else [])
        if high:
            first = F.col(keys[0])
            parts += [first <= _value(high[0]), _before(keys, high, True)] if len(high) > 1 else [first < _value(high[0])]
        if not parts:
            return None
        tests.append(reduce(Column.__and__, parts))
    return reduce(Column.__or__, tests) if tests else None


def _before(keys: tuple[str, ...], bound: tuple, before: bool) -> Column:
    """Whether a row's keys come before a bound, or else not before it."""
    out = F.lit(not before)
    for key, x in reversed(list(zip(keys, bound))):
        c, v = F.col(key), _value(x)
        out = ((c < v) if before else (c > v)) | ((c == v) & out)
    return out


def _value(x: Any) -> Column:
    return F.lit(bytearray(x)) if isinstance(x, bytes) else F.lit(x)


def sort_keys(order: list[str], desc: bool = False) -> list[Column]:
    """Nulls come first going up and last going down."""
    return [F.col(f"`{c}`").desc_nulls_last() if desc else F.col(f"`{c}`").asc_nulls_first() for c in order]


def table_scan(table: Table, ranges: tuple[KeyRange, ...] = (), after: Any = None, desc: bool = False, read_ts: int | None = None) -> DataFrame:
    """Rows by handle ranges, unordered; after resumes behind a handle in scan direction; read_ts reads the past of a versioned table."""
    if (ranges or after is not None) and not table.handle:
        raise RequestError(f"{table.name} has no handle")
    test = in_ranges(table.handle, ranges) if ranges else None
    if after is not None:
        behind = F.col(table.handle) < after if desc else F.col(table.handle) > after
        test = behind if test is None else test & behind
    return table.rows(read_ts, test)


def store_index(table: Table, index: str, folder: str) -> DataFrame:
    """Writes an index as a table of its own, sorted by its columns and the handle, so that ranges skip files and row groups."""
    if table.versioned:
        raise RequestError("the index of a versioned table can't be stored")
    order = [*table.index_columns(index), table.handle]
    entries = table.df.select(*order)
    entries.repartitionByRange(*sort_keys(order)).sortWithinPartitions(*sort_keys(order)).write.parquet(folder)
    table.stored[index] = table.df.sparkSession.read.schema(entries.schema).parquet(folder)
    return table.stored[index]


def _entries(table: Table, index: str, ranges: tuple[KeyRange, ...], read_ts: int | None) -> DataFrame:
    """Rows of the stored index, if there is one, or of the table."""
    test = in_ranges(table.index_columns(index), ranges) if ranges else None
    df = table.rows(read_ts) if read_ts is not None or index not in table.stored else table.stored[index]
    return df if test is None else df.where(test)


def index_scan(table: Table, index: str, ranges: tuple[KeyRange, ...] = (), read_ts: int | None = None) -> DataFrame:
    """Index columns and the handle, by ranges of the index's columns; a stored index is read alone."""
    return _entries(table, index, ranges, read_ts).select(*table.index_columns(index), table.handle)


def index_lookup(table: Table, index: str, ranges: tuple[KeyRange, ...] = (), read_ts: int | None = None) -> DataFrame:
    """Whole rows by index ranges: a stored index's entries joined to their rows by handle, else one filtered read."""
    found = _entries(table, index, ranges, read_ts)
    return lookup(found, table.rows(read_ts), table.handle) if index in table.stored and read_ts is None else found


def lookup(index: DataFrame, table: DataFrame, handle: str) -> DataFrame:
    """Rows of table whose handles an index frame holds; handles without a row are skipped. Spark picks the join by size."""
    return index.select(F.col(handle).alias("_handle")).join(table, F.col("_handle") == table[handle]).drop("_handle")
