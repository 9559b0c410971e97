"""Requests by type number: dispatch, batches, streams, result cache, deadlines, priorities."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from .functions.types import RequestError
from .operators import stats
from .plans.compiler import compile_request
from .plans.ir import Request, RequestType
from .sources import scans
from .sources.catalog import Catalog


class UnsupportedRequest(RequestError):
    """A type number that no handler has."""


class DeadlineExceeded(RuntimeError):
    """A request ran longer than it may."""


class ServerIsBusy(RuntimeError):
    """Too many requests wait."""


@dataclass
class Counters:
    requests: int = 0
    errors: int = 0
    cache_hits: int = 0
    cache_misses: int = 0
    deadlines: int = 0
    seconds: float = 0.0
    slow: list[tuple[int, float]] = field(default_factory=list)


@dataclass(frozen=True)
class Outcome:
    """A batch's answer to one request: rows or an error."""

    rows: list[Row] | None = None
    error: str | None = None


class Service:
    """Handles requests against a catalog.

    High, normal and low requests run in scheduler pools of these names. The cache keeps the
    results of requests that are asked for with cached=True, by the whole request and the
    table's version, so a limit is part of the key.
    """

    CACHE_ENTRIES, CACHE_SECONDS, MOST_PENDING, SLOW_SECONDS = 256, 30.0, 1024, 0.1
    PRIORITIES = ("high", "normal", "low")

    def __init__(self, catalog: Catalog):
        self.catalog, self.counters = catalog, Counters()
        self._cache: OrderedDict[Any, tuple[float, DataFrame]] = OrderedDict()
        self._lock, self._pending = threading.Lock(), threading.BoundedSemaphore(self.MOST_PENDING)

    def plan(self, kind: int, request: Request) -> DataFrame:
        """The lazy result of a request of a type."""
        try:
            kind = RequestType(kind)
        except ValueError:
            raise UnsupportedRequest(f"unsupported request type {kind}") from None
        table = self.catalog[request.table]
        if kind == RequestType.TABLE_SCAN:
            df = scans.table_scan(table, request.ranges, request.resume_after, request.desc_scan, request.read_ts).orderBy(*scans.sort_keys(table.order, request.desc_scan))
            limit = min((x for x in (request.limit, request.paging_size) if x is not None), default=None)
            return df if limit is None else df.limit(limit)
        if kind == RequestType.SELECT:
            return compile_request(request, self.catalog)
        if kind == RequestType.INDEX_SCAN:
            if not request.index:
                raise RequestError("an index scan needs an index")
            return compile_request(request, self.catalog)
        df = scans.table_scan(table, request.ranges, read_ts=request.read_ts)
        if kind == RequestType.ANALYZE and "sample" in request.options:
            if len(request.columns or ()) != 1 or not table.handle:
                raise RequestError("a sample is of one column of a table with a handle")
            return stats.sample(df, request.columns[0], table.handle, request.options["sample"])
        if kind == RequestType.ANALYZE:
            return stats.analyze(df, list(request.columns or df.columns), request.options.get("ndv_cap"), request.options.get("approximate", False))
        key, value = request.options.get("key", table.handle), request.options.get("value")
        if kind == RequestType.CHECKSUM:
            return stats.checksum(df, key, value)
        if "size" not in request.options:
            raise RequestError("split keys need a column of sizes")
        return stats.split_keys(df.select(key, request.options["size"]), request.paging_size or 2, key, request.options["size"])

    def handle(self, kind: int, request: Request, priority: str = "normal", deadline_s: float | None = None, cached: bool = False) -> list[Row]:
        """The rows of a request."""
        with self._admitted(kind, priority, deadline_s):
            df = self._cached(kind, request) if cached else self.plan(kind, request)
            return df.collect()

    def stream(self, kind: int, request: Request, chunk: int = 256) -> Iterator[list[Row]]:
        """The rows in chunks, as partitions become ready; none is left out."""
        rows: list[Row] = []
        for row in self.plan(kind, request).toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) == chunk:
                yield rows
                rows = []
        if rows:
            yield rows

    def batch(self, requests: list[tuple[int, Request]]) -> list[Outcome]:
        """Answers in order; one that fails leaves the others alone."""
        out = []
        for kind, request in requests:
            try:
                out.append(Outcome(self.handle(kind, request)))
            except Exception as e:  # an answer to the one who asked
                out.append(Outcome(error=f"{type(e).__name__}: {e}"))
        return out

    def _cached(self, kind: int, request: Request) -> DataFrame:
        key = (kind, request, tuple(sorted(request.options.items())), self.catalog[request.table].version)
        now = time.monotonic()
        with self._lock:
            hit = self._cache.get(key)
            if hit and now - hit[0] < self.CACHE_SECONDS:
                self._cache.move_to_end(key)
                self.counters.cache_hits += 1
                return hit[1]
            self.counters.cache_misses += 1
            df = self.plan(kind, request).persist()
            if hit:
                hit[1].unpersist()
            self._cache[key] = (now, df)
            while len(self._cache) > self.CACHE_ENTRIES:
                self._cache.popitem(last=False)[1][1].unpersist()
            return df

    @contextmanager
    def _admitted(self, kind: int, priority: str, deadline_s: float | None):
        if priority not in self.PRIORITIES:
            raise RequestError(f"no priority {priority}")
        if not self._pending.acquire(blocking=False):
            raise ServerIsBusy("too many requests wait")
        sc, began, late = self.catalog.spark.sparkContext, time.monotonic(), threading.Event()
        group = f"request-{uuid.uuid4().hex}"
        timer = None
        with self._lock:
            self.counters.requests += 1
        try:
            sc.setLocalProperty("spark.scheduler.pool", priority)
            if deadline_s is not None:
                sc.setJobGroup(group, "request with a deadline", interruptOnCancel=True)

                def stop():
                    late.set()
                    sc.cancelJobGroup(group)

                timer = threading.Timer(max(0.0, deadline_s), stop)
                timer.start()
            yield
            if late.is_set():
                raise DeadlineExceeded(f"longer than {deadline_s} s")
        except Exception as e:
            with self._lock:
                self.counters.errors += 1
                self.counters.deadlines += late.is_set()
            if late.is_set():
                raise DeadlineExceeded(f"longer than {deadline_s} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.scheduler.pool", None)
            took = time.monotonic() - began
            with self._lock:
                self.counters.seconds += took
                if took >= self.SLOW_SECONDS:
                    self.counters.slow = [*self.counters.slow[-99:], (int(kind), took)]
            self._pending.release()
