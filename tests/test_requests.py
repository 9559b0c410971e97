"""Requests over a small table of people."""

from decimal import Decimal

import pytest

from brindle.functions.types import RequestError
from brindle.plans.compiler import compile_request, merge_partials
from brindle.plans.ir import Agg, AggType, IndexSpec, KeyRange, OrderBy, Request, call, col, const
from brindle.service import DeadlineExceeded, Service, UnsupportedRequest
from brindle.sources import scans
from brindle.sources.catalog import Catalog

PEOPLE = [(1, "Alice", 30), (2, "Bob", 10), (3, "Charlie", 50), (4, "Diana", 20), (5, "bob", 40), (6, None, None)]


@pytest.fixture(scope="module")
def people(spark):
    c = Catalog(spark)
    c.register("people", spark.createDataFrame(PEOPLE, "handle long, name string, age long"), "handle", {"by_age": ("age",)})
    c.register("nobody", spark.createDataFrame([], "handle long, name string, age long"), "handle")
    return c


def rows(people, **request):
    table = request.pop("table", "people")
    return [tuple(r) for r in compile_request(Request(table, **request), people).collect()]


def test_scan_filter_project(people):
    assert len(rows(people)) == 6
    assert rows(people, conditions=(col("age") > 28,), projections=(col("name").named("n"), (col("age") * 2).named("a")), limit=9) == [("Alice", 60), ("Charlie", 100), ("bob", 80)]
    assert rows(people, columns=("age",), conditions=(col("age") > 28, const(1)), limit=1) == [(30,)]


def test_scan_order_and_pages(people):
    assert [r[0] for r in rows(people, desc_scan=True, limit=2)] == [6, 5]
    assert [r[0] for r in rows(people, limit=2, offset=1)] == [2, 3]
    assert [r[0] for r in rows(people, paging_size=2, resume_after=3)] == [4, 5]
    assert [r[0] for r in rows(people, paging_size=2, resume_after=3, desc_scan=True)] == [2, 1]
    assert sorted(r[0] for r in rows(people, ranges=(KeyRange(None, 2), KeyRange(1, 3), KeyRange(6, None)))) == [1, 2, 6]
    assert rows(people, limit=0) == []


def test_top_n(people):
    assert [r[0] for r in rows(people, order_by=(OrderBy(col("age")),), limit=3)] == [6, 2, 4]
    assert [r[0] for r in rows(people, order_by=(OrderBy(col("age"), True),), limit=2, offset=1)] == [5, 1]
    assert [r[0] for r in rows(people, order_by=(OrderBy(col("name")),), limit=3, collation=1)] == [6, 1, 2]


def test_aggregates(people):
    by_name = rows(people, group_by=(col("name").named("n"),), aggregates=(Agg(AggType.COUNT, name="c"),), collation=1)
    assert {(n.lower() if n else n, c) for n, c in by_name} == {("alice", 1), ("bob", 2), ("charlie", 1), ("diana", 1), (None, 1)}
    every = (Agg(AggType.COUNT), Agg(AggType.COUNT, col("age")), Agg(AggType.SUM, col("age")), Agg(AggType.AVG, col("age")), Agg(AggType.MIN, col("age")), Agg(AggType.MAX, col("name")), Agg(AggType.GROUP_CONCAT, col("age")))
    assert rows(people, aggregates=every) == [(6, 5, Decimal(150), Decimal("30.0000"), 10, "bob", "30,10,50,20,40")]
    assert rows(people, table="nobody", aggregates=every) == [(0, 0, None, None, None, None, None)]
    assert rows(people, table="nobody", group_by=(col("name").named("n"),), aggregates=every[:1]) == []


def test_average_rounds_half_up(spark):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(1, 0.0001), (2, 0.0)], "h long, x double"), "h")
    c.register("m", spark.createDataFrame([(1, -0.0001), (2, 0.0)], "h long, x double"), "h")
    for t, want in (("t", "0.0001"), ("m", "-0.0001")):
        assert rows(c, table=t, aggregates=(Agg(AggType.AVG, col("x")),)) == [(Decimal(want),)]


def test_partials_merge_to_the_whole(people):
    aggs = (Agg(AggType.COUNT, name="c"), Agg(AggType.SUM, col("age"), name="s"), Agg(AggType.AVG, col("age"), name="a"), Agg(AggType.MIN, col("age"), name="lo"), Agg(AggType.MAX, col("age"), name="hi"))
    parts = [compile_request(Request("people", aggregates=aggs, partial=True, ranges=(r,)), people) for r in (KeyRange(None, 3), KeyRange(3, None))]
    whole = Request("people", aggregates=aggs)
    merged = merge_partials(parts[0].unionByName(parts[1]), whole, people).collect()
    assert [tuple(r) for r in merged] == rows(people, aggregates=aggs)
    with pytest.raises(RequestError):
        compile_request(Request("people", aggregates=(Agg(AggType.COUNT, col("age"), True),), partial=True), people)


def test_indexes(people):
    assert rows(people, index=IndexSpec("by_age"), columns=("age", "handle"), ranges=(KeyRange(20, 50),)) == [(20, 4), (30, 1), (40, 5)]
    assert [r[1] for r in rows(people, index=IndexSpec("by_age", True), desc_scan=True, limit=2)] == ["Charlie", "bob"]
    entries = scans.index_scan(people["people"], "by_age", (KeyRange(20, 31),)).unionByName(people.spark.sql("SELECT 25L AS age, 99L AS handle"))
    assert {r.name for r in scans.lookup(entries, people["people"].df, "handle").collect()} == {"Alice", "Diana"}
    with pytest.raises(RequestError):
        rows(people, index=IndexSpec("none"))


def test_reads_at_a_timestamp(spark):
    c = Catalog(spark)
    log = [(1, "a", 10, "PUT"), (1, "b", 20, "PUT"), (2, "x", 15, "PUT"), (2, None, 30, "DELETE"), (3, "y", 40, "ROLLBACK"), (4, "z", 5, "PUT")]
    c.register_versions("t", spark.createDataFrame(log, "h long, v string, commit_ts long, op string"), "h", {"by_v": ("v",)})
    assert rows(c, table="t", read_ts=4) == []
    assert sorted(rows(c, table="t", read_ts=16)) == [(1, "a"), (2, "x"), (4, "z")]
    assert sorted(rows(c, table="t")) == [(1, "b"), (4, "z")]
    assert rows(c, table="t", read_ts=16, ranges=(KeyRange(2, 4),), conditions=(col("v").eq("x"),)) == [(2, "x")]
    assert rows(c, table="t", read_ts=25, index=IndexSpec("by_v"), ranges=(KeyRange("b", "y"),)) == [("b", 1), ("x", 2)]
    with pytest.raises(RequestError):
        c.register_versions("u", spark.createDataFrame([(1,)], "h long"), "h")


def test_bad_requests(people):
    for bad in (dict(aggregates=(Agg(AggType.COUNT),), limit=1), dict(aggregates=(Agg(AggType.SUM),)), dict(aggregates=(Agg(77, col("age")),)), dict(limit=-1), dict(table="none"), dict(read_ts=5)):
        with pytest.raises(RequestError):
            rows(people, **bad)


def test_filters_reach_the_scan(spark, tmp_path):
    c = Catalog(spark)
    spark.createDataFrame(PEOPLE, "handle long, name string, age long").write.parquet(f"{tmp_path}/p")
    c.read("p", f"{tmp_path}/p", "handle")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = compile_request(Request("p", columns=("age",), ranges=(KeyRange(2, 5),), conditions=(col("age").between(1, 9), col("name").eq("x"))), c)._jdf.queryExecution().executedPlan().toString()
    for piece in ("GreaterThanOrEqual(handle,2)", "LessThan(handle,5)", "GreaterThanOrEqual(age,1)", "EqualTo(name,x)"):
        assert piece in plan
    assert "Python" not in plan


def test_service(people):
    s = Service(people)
    assert len(s.handle(0, Request("people", limit=2), priority="high")) == 2
    q = Request("people", columns=("age",), limit=3)
    assert s.handle(1, q, cached=True) == s.handle(1, q, cached=True)
    assert (s.counters.cache_misses, s.counters.cache_hits) == (1, 1)
    s.handle(1, Request("people", columns=("age",), limit=2), cached=True)
    assert s.counters.cache_misses == 2
    assert [len(c) for c in s.stream(1, Request("people"), 4)] == [4, 2]
    out = s.batch([(1, Request("people")), (42, Request("people")), (1, Request("none"))])
    assert [o.error is None for o in out] == [True, False, False]
    with pytest.raises(UnsupportedRequest):
        s.plan(42, Request("people"))
    with pytest.raises(RequestError):
        s.handle(1, q, priority="urgent")


def test_deadline(people):
    slow = people.spark.range(1 << 40).selectExpr("id AS handle", "id % 7 AS age")
    people.register("slow", slow, "handle")
    with pytest.raises(DeadlineExceeded):
        Service(people).handle(1, Request("slow", aggregates=(Agg(AggType.SUM, col("age")),)), deadline_s=1.0)


def test_group_bound(spark):
    c = Catalog(spark)
    c.register("t", spark.range(20).selectExpr("id", "id % 5 AS g"), "id")
    r = lambda most: compile_request(Request("t", group_by=(col("g").named("g"),), aggregates=(Agg(AggType.COUNT, name="n"),), max_groups=most), c)
    assert sorted(tuple(x) for x in r(5).collect()) == [(i, 4) for i in range(5)]
    with pytest.raises(Exception, match="more than 4 groups"):
        r(4).collect()


def test_date_format_by_column(spark):
    c = Catalog(spark)
    c.register("t", spark.sql("SELECT 1 AS id, timestamp'2024-03-05 06:07:08' AS d, '%Y/%m' AS f UNION ALL SELECT 2, timestamp'2024-03-05 06:07:08', '%H:%i'"), "id")
    out = compile_request(Request("t", projections=(call("DATE_FORMAT", col("d"), col("f")).named("x"),)), c).collect()
    assert sorted(r.x for r in out) == ["06:07", "2024/03"]


def test_stored_indexes(spark, tmp_path):
    c = Catalog(spark)
    rows = [(i, i % 3, i % 7 if i % 10 else None, f"v{i}") for i in range(60)]
    t = c.register("t", spark.createDataFrame(rows, "id long, a long, b long, v string"), "id", {"ab": ("a", "b")})
    ask = lambda lookup, *ranges, **more: [tuple(r) for r in compile_request(Request("t", index=IndexSpec("ab", lookup), columns=("a", "b", "id", *(("v",) if lookup else ())), ranges=ranges, **more), c).collect()]
    ranges = [(), (KeyRange((0, 3), (1, 2)),), (KeyRange((1,), (2,)),), (KeyRange((2, 5), None), KeyRange(None, (0, 1))), (KeyRange(1, (1, 4)),)]
    by = lambda r: (r[1], r[2] is not None, r[2] or 0, r[0])

    def inside(r, ranges):
        def fits(k):
            low, high = (x if isinstance(x, tuple) or x is None else (x,) for x in (k.low, k.high))
            own = (r[1], r[2])
            if low and (own[0] < low[0] or len(low) > 1 and own[0] == low[0] and (own[1] is None or own[1] < low[1])):
                return False
            if high and (own[0] > high[0] or own[0] == high[0] and (len(high) == 1 or own[1] is None or own[1] >= high[1])):
                return False
            return True

        return not ranges or any(fits(k) for k in ranges)

    wants = [[(a, b, i, v) for i, a, b, v in sorted(rows, key=by) if inside((i, a, b), r)] for r in ranges]
    for stored in (False, True):
        if stored:
            scans.store_index(t, "ab", f"{tmp_path}/ab")
        for r, want in zip(ranges, wants):
            assert ask(True, *r) == want
            assert ask(False, *r) == [w[:3] for w in want]
            assert ask(True, *r, limit=3) == want[:3]
    plan = compile_request(Request("t", index=IndexSpec("ab"), columns=("a", "b"), ranges=(KeyRange(1, 2),)), c)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThanOrEqual(a,1), LessThan(a,2)]" in plan
    with pytest.raises(RequestError):
        ask(False, KeyRange((1, 2, 3), None))
