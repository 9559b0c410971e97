"""Snapshots, collection, transactions, the change feed, raw keys, backup, statistics."""

import random
import threading
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import backup, kv, mvcc, stats, txn
from brindle.streaming import cdc

COLUMNS = "user_key string, commit_ts long, start_ts long, op string, value string"


def log(spark, *rows):
    return spark.createDataFrame([(k, ts, ts - 5, op, v) for k, ts, op, v in rows], COLUMNS)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_visibility(spark):
    v = log(spark, ("k", 100, "PUT", "v100"), ("k", 200, "PUT", "v200"), ("k", 300, "PUT", "v300"))
    assert [pairs(mvcc.snapshot(v, ts)) for ts in (99, 250, 300)] == [{}, {"k": "v200"}, {"k": "v300"}]


def test_delete_rollback_lock_records(spark):
    v = log(spark, ("k", 20, "PUT", "v"), ("k", 40, "DELETE", None), ("r", 100, "PUT", "x"), ("r", 150, "ROLLBACK", None), ("r", 160, "LOCK", None))
    assert pairs(mvcc.snapshot(v, 25)) == {"k": "v"}
    assert pairs(mvcc.snapshot(v, 200)) == {"r": "x"}
    assert pairs(mvcc.get(v, "k", 50)) == {}


def test_locks(spark):
    v = log(spark, ("k", 20, "PUT", "v"))
    locks = lambda kind, ts, key="k": spark.createDataFrame([(key, kind, ts)], "user_key string, type string, start_ts long")
    with pytest.raises(mvcc.KeyLocked):
        mvcc.snapshot(v, 50, locks("PUT", 40))
    with pytest.raises(mvcc.KeyLocked):
        mvcc.snapshot(v, 50, locks("PUT", 40, "fresh"))
    for harmless in (locks("LOCK", 40), locks("PESSIMISTIC", 40), locks("PUT", 60)):
        assert pairs(mvcc.snapshot(v, 50, harmless)) == {"k": "v"}
    assert pairs(mvcc.snapshot(v, 50, locks("PUT", 40, "z"), None, "m")) == {"k": "v"}


def test_scans(spark):
    v = log(spark, *((f"k{i:03d}", 10, "PUT", str(i)) for i in range(20)))
    assert [r[0] for r in mvcc.scan(v, 20, "k003", "k006").collect()] == ["k003", "k004", "k005"]
    assert [r[0] for r in mvcc.scan(v, 20, "k003", "k006", 2, reverse=True, key_only=True).collect()] == ["k005", "k004"]
    assert [r.commit_ts for r in mvcc.history(log(spark, ("a", 1, "PUT", "x"), ("a", 9, "DELETE", None)), "a").collect()] == [9, 1]


OPS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["PUT", "DELETE", "ROLLBACK", "LOCK"])), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=OPS, data=st.data())
def test_snapshots_survive_collection_and_changes(spark, ops, data):
    v = log(spark, *((k, 10 * i + 10, op, str(i) if op == "PUT" else None) for i, (k, op) in enumerate(ops)))
    top = 10 * len(ops)
    a, b = sorted((data.draw(st.integers(1, top + 5)), data.draw(st.integers(1, top + 5))))
    replay: dict = {}
    for i, (k, op) in enumerate(ops):
        if 10 * i + 10 <= b:
            replay = {**replay, k: str(i)} if op == "PUT" else {x: y for x, y in replay.items() if x != k} if op == "DELETE" else replay
    want = pairs(mvcc.snapshot(v, b))
    assert want == replay
    assert pairs(mvcc.snapshot(mvcc.collect_garbage(v, a), b)) == want
    assert pairs(cdc.apply(mvcc.snapshot(v, a), cdc.incremental(v, a, b))) == want


def test_garbage_keeps_tombstones_and_refuses_zero(spark):
    v = log(spark, ("a", 10, "PUT", "1"), ("a", 20, "DELETE", None), ("a", 30, "ROLLBACK", None), ("a", 90, "LOCK", None), ("b", 10, "PUT", "1"), ("b", 15, "PUT", "2"))
    assert {(r.user_key, r.commit_ts) for r in mvcc.collect_garbage(v, 50).collect()} == {("a", 20), ("a", 90), ("b", 15)}
    with pytest.raises(ValueError):
        mvcc.collect_garbage(v, 0)
    with pytest.raises(ValueError):
        mvcc.delete_range(v, "a", None)
    assert {r.user_key for r in mvcc.delete_range(v, "a", "b").collect()} == {"b"}


def test_safe_point():
    s = mvcc.SafePoint()
    now = 10**9
    assert s.get(now) == (now - s.DELAY_MS) << 18
    s.set_service("backup", 5, 1000, now)
    assert s.get(now + 1) == (now - s.DELAY_MS) << 18  # never goes back
    s2 = mvcc.SafePoint()
    assert s2.set_service("backup", 5, 1000, now) == 5
    assert s2.get(now + 2000) > 5


def test_change_feed_windows(spark):
    v = log(spark, ("a", 100, "PUT", "1"), ("b", 200, "PUT", "2"), ("c", 300, "PUT", "3"), ("x", 100, "PUT", "o"), ("x", 200, "DELETE", None))
    assert {r.user_key for r in cdc.incremental(v.where("user_key < 'x'"), 50, 250).collect()} == {"a", "b"}
    assert [(r.op, r.commit_ts) for r in cdc.incremental(v, 0, 250, "x", None).collect()] == [("DELETE", 200)]
    assert [r.user_key for r in cdc.incremental(v, 0, 999, "b", "c").collect()] == ["b"]
    assert cdc.resolved_ts(v).first()[0] == 300
    locks = spark.createDataFrame([("q", "PUT", 40)], "user_key string, type string, start_ts long")
    assert cdc.resolved_ts(v, locks).first()[0] == 39
    assert cdc.resolved_ts(v, locks.limit(0)).first()[0] == 300
    assert cdc.resolved_ts(v.limit(0)).first()[0] == 0


@pytest.fixture
def store(spark, tmp_path):
    return txn.VersionStore(spark, f"file://{tmp_path}/store")


def test_transaction_reads_its_own_writes(store):
    t = store.begin()
    for i in range(5):
        t.put(f"k{i}", str(i))
    t.commit()
    t = store.begin()
    t.delete("k1")
    t.put("k3", "three")
    t.put("k0a", "new")
    assert t.get("k1") is None and t.get("k3") == b"three" and t.get("k2") == b"2" and t.get("zz") is None
    assert [(bytes(r[0]), bytes(r[1])) for r in t.scan(limit=3).collect()] == [(b"k0", b"0"), (b"k0a", b"new"), (b"k2", b"2")]
    assert [bytes(r[0]) for r in t.scan(reverse=True, limit=2).collect()] == [b"k4", b"k3"]
    t.rollback()
    assert len(store.snapshot().collect()) == 5
    with pytest.raises(RuntimeError):
        t.put("a", "b")


def test_conflicts_inserts_and_locks(store):
    store.begin().commit()
    a, b = store.begin(), store.begin()
    a.put("k", "a")
    b.put("k", "b")
    assert store.resolved_ts() == a.start_ts - 1
    assert a.commit() > a.start_ts
    with pytest.raises(txn.WriteConflict):
        b.commit()
    t = store.begin()
    t.insert("k", "x")
    with pytest.raises(txn.AlreadyExists):
        t.commit()
    a, b, c = store.begin(), store.begin(), store.begin()
    a.lock_for_update("k")
    b.put("k", "b")
    with pytest.raises(mvcc.KeyLocked):
        b.commit()
    with pytest.raises(mvcc.KeyLocked):
        c.lock_for_update("k")
    assert a.commit() is None and store.locks().count() == 0
    a, b = store.begin(), store.begin()
    b.put("k", "b")
    b.commit()
    with pytest.raises(txn.WriteConflict):
        a.lock_for_update("k")
    a.rollback()
    t = store.begin()  # a later write replaces an insert
    t.insert("k", "x")
    t.delete("k")
    t.put("k", "a")
    t.commit()
    assert pairs(store.snapshot().select(F.col("user_key").cast("string"), F.col("value").cast("string"))) == {"k": "a"}


def test_locks_and_rollback_records(store):
    t = store.begin()
    t.put("a", "1")
    t.put("b", "2")
    t.delete("c")
    t.prewrite()
    assert sorted((bytes(r.user_key), r.type, bytes(r.primary)) for r in store.scan_locks(t.start_ts).collect()) == [(b"a", "PUT", b"a"), (b"b", "PUT", b"a"), (b"c", "DELETE", b"a")]
    assert store.resolved_ts() == t.start_ts - 1 and store.scan_locks(t.start_ts, b"b", b"c").count() == 1 and store.scan_locks(t.start_ts - 1).count() == 0
    with pytest.raises(mvcc.KeyLocked):
        store.snapshot()
    with pytest.raises(mvcc.KeyLocked):
        store.begin().get("a")
    now = t.start_ts >> 18
    assert store.status(t.start_ts, now) == (txn.Outcome.UNKNOWN, None) and store.cleanup(t.start_ts, now) == txn.Outcome.UNKNOWN
    assert store.heartbeat(t.start_ts, 50_000) and store.status(t.start_ts, now + 40_000)[0] == txn.Outcome.UNKNOWN
    assert store.resolve_expired(now) == 0 and store.resolve_expired(now + 60_000) == 1
    assert store.status(t.start_ts) == (txn.Outcome.ROLLED_BACK, None) and store.locks().count() == 0
    assert {(bytes(r.user_key), r.op, r.commit_ts) for r in mvcc.history(store.versions(), start_ts=t.start_ts).collect()} == {(k, "ROLLBACK", t.start_ts) for k in (b"a", b"b", b"c")}
    store.resolve(t.start_ts, None)  # again: nothing happens
    with pytest.raises(txn.RolledBack):
        t.commit()
    assert t.outcome == txn.Outcome.ROLLED_BACK and store.snapshot().count() == 0 and not store.heartbeat(t.start_ts, 1)

    # a transaction whose driver died after its locks is committed by whoever knows its timestamp
    t = store.begin()
    t.put("a", "3")
    t.prewrite()
    ts = store.clock.next()
    store.resolve(t.start_ts, ts)
    store.resolve(t.start_ts, ts)
    assert store.status(t.start_ts) == (txn.Outcome.COMMITTED, ts) and mvcc.history(store.versions(), start_ts=t.start_ts).count() == 1
    with pytest.raises(txn.WriteConflict):
        store.resolve(t.start_ts, None)
    t = store.begin()
    t.put("z", "1")
    t.prewrite()
    t.rollback()
    assert store.status(t.start_ts)[0] == txn.Outcome.ROLLED_BACK and store.locks().count() == 0


def test_garbage_collection_of_a_store(store):
    def put(**kv_):
        t = store.begin()
        for k, v in kv_.items():
            t.put(k, v) if v is not None else t.delete(k)
        return t.commit()

    put(a="1", b="1")
    put(a="2", b=None)
    safe = put(a="3", c="1")
    last = put(a="4")
    shown = lambda ts: pairs(store.snapshot(ts).select(F.col("user_key").cast("string"), F.col("value").cast("string")))
    before = shown(safe), shown(last)
    open_one = store.begin()
    store.collect_garbage(safe)
    assert (shown(safe), shown(last)) == before == ({"a": "3", "c": "1"}, {"a": "4", "c": "1"})
    assert store.versions().count() == 4 and len(store.files.names(f"{store.path}/log")) == 1
    with pytest.raises(mvcc.KeyLocked):
        store.collect_garbage(store.clock.next())
    open_one.rollback()
    later = store.clock.next()
    store.collect_garbage(later)
    assert store.versions().count() == 3 and shown(later) == before[1]
    put(a="5")
    assert shown(store.clock.next()) == {"a": "5", "c": "1"}


def test_concurrent_transfers_keep_the_total(store):
    accounts = [f"acc{i}" for i in range(6)]
    txn.with_retry(store, lambda t: [t.put(a, "1000") for a in accounts] and None)
    done, errors = [], []

    def worker(seed):
        rng = random.Random(seed)
        try:
            for _ in range(2):
                x, y = rng.sample(accounts, 2)

                def move(t):
                    a, b = int(t.get(x)), int(t.get(y))
                    t.put(x, str(a - 10))
                    t.put(y, str(b + 10))

                txn.with_retry(store, move, tries=50, first_wait_s=0.01)
                done.append(seed)
        except Exception as e:  # noqa: BLE001, shown below
            errors.append(e)

    threads = [threading.Thread(target=worker, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(done) == 8
    assert sum(int(bytes(r["value"])) for r in store.snapshot().collect()) == 6000
    # each commit read what the one before it wrote
    starts = [(r.start_ts, r.commit_ts, bytes(r.user_key)) for r in store.versions().collect()]
    for a in starts:
        assert not any(b is not a and b[2] == a[2] and a[0] < b[1] < a[1] for b in starts)


def test_two_threads_on_one_key(store):
    ts = [store.begin() for _ in range(2)]
    out = []

    def go(t):
        t.put("k", str(t.start_ts))
        try:
            t.commit()
            out.append("committed")
        except txn.WriteConflict:
            out.append("conflict")

    threads = [threading.Thread(target=go, args=(t,)) for t in ts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out) == ["committed", "conflict"]


def test_transfers_keep_the_total(store):
    accounts = [f"acc{i}" for i in range(4)]

    def start(t):
        for a in accounts:
            t.put(a, "1000")

    txn.with_retry(store, start)
    rng = random.Random(3)
    for n in range(4):
        x, y = rng.sample(accounts, 2)
        first = [n % 2 == 0]

        def move(t):
            a, b = int(t.get(x)), int(t.get(y))
            t.put(x, str(a - 7))
            t.put(y, str(b + 7))
            if first[0]:  # someone else is faster once
                first[0] = False
                other = store.begin()
                other.put(x, str(a))
                other.commit()

        txn.with_retry(store, move, first_wait_s=0.001)
    assert sum(int(bytes(r["value"])) for r in store.snapshot().collect()) == 4000


def test_stream_follows_the_log(spark, store, tmp_path):
    def commit(**kv_):
        t = store.begin()
        for k, v in kv_.items():
            t.put(k, v) if v is not None else t.delete(k)
        t.commit()

    commit(a="1", b="2")
    got: list = []
    run = lambda: cdc.subscribe(store, lambda df, n: got.extend((bytes(r.user_key), r.op) for r in df.collect()), f"{tmp_path}/cp", once=True).awaitTermination()
    run()
    assert sorted(got) == [(b"a", "PUT"), (b"b", "PUT")]
    commit(a=None)
    run()
    assert sorted(got) == [(b"a", "DELETE"), (b"a", "PUT"), (b"b", "PUT")]


def test_status_and_deadlocks():
    assert txn.check_status(10, 0, 5, 7, False) == txn.Outcome.COMMITTED
    assert txn.check_status(10, 0, 5, None, False) == txn.Outcome.ROLLED_BACK
    assert txn.check_status(10, 9 << 18, 5, None, False) == txn.Outcome.UNKNOWN
    g = txn.WaitGraph()
    assert g.wait(1, 2, 0) == [] and g.wait(2, 3, 0) == []
    assert g.wait(3, 1, 0) == [1, 2, 3]
    assert g.wait(3, 1, 120_000) == []
    c = txn.Clock(lambda: 5)
    assert c.next() == 5 << 18 and c.next() == (5 << 18) + 1


def test_raw_keys(spark):
    t = kv.KeyValueTable.empty(spark).batch_put({f"k{i:03d}": str(i) for i in range(20)}).put(b"\xff", b"high")
    keys = lambda df: [bytes(r["key"]) for r in df.collect()]
    assert keys(t.scan("k003", "k006")) == [b"k003", b"k004", b"k005"]
    assert keys(t.scan("k018")) == [b"k018", b"k019", b"\xff"]
    assert keys(t.reverse_scan("k006", "k003", 2)) == [b"k005", b"k004"]
    assert t.scan(key_only=True, limit=1).columns == ["key"]
    assert keys(t.batch_get(["k001", "none"])) == [b"k001"] and t.get("none").count() == 0 and t.batch_get([]).count() == 0
    assert t.delete_range("k001", "k019").df.count() == 3
    assert t.batch_delete(["k000"]).delete("k001").df.count() == 19
    done, before, t2 = t.compare_and_swap("k005", "5", "five")
    assert done and before == b"5" and bytes(t2.get("k005").first()["value"]) == b"five"
    assert t.compare_and_swap("k005", "6", "x")[0] is False
    assert t.compare_and_swap("absent", None, "x")[0] is True
    assert t.put("gone", "x", ttl_seconds=-1).get("gone").count() == 0
    assert t.put("here", "x", ttl_seconds=1000).compact().get("here").count() == 1


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    folder = f"file://{tmp_path}/b"
    with pytest.raises(backup.BackupDamaged):
        backup.restore(spark, folder)
    m = backup.backup(df, folder)
    assert (m["total_kvs"], m["total_bytes"]) == (2, 3)
    assert sorted(map(tuple, backup.restore(spark, folder).collect())) == [("a", "1"), ("b", None)]
    again = backup.backup(df.where("key = 'a'"), folder)
    assert [tuple(r) for r in backup.restore(spark, folder).collect()] == [("a", "1")] and len(list(tmp_path.glob("b/data-*"))) == 1
    df.limit(1).write.mode("append").parquet(f"{folder}/{again['data']}")
    with pytest.raises(backup.BackupDamaged):
        backup.restore(spark, folder)


def test_statistics(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i % 3}") for i in range(20)], "k long, s string")
    got = {r.column_name: tuple(r)[1:] for r in stats.analyze(df, ["k", "s"]).collect()}
    assert got == {"k": (20, 0, 20, "0", "19"), "s": (20, 4, 3, "v0", "v2")}
    assert stats.analyze(df, ["k"], ndv_cap=7).first().ndv == 7
    assert stats.sample(df, "s", "k", 5).count() == 5
    p = df.select(F.col("s").alias("key"), F.col("k").cast("string").alias("value")).where("key is not null")
    assert stats.checksum(p).first() == stats.checksum(p.repartition(3)).first()
    assert stats.checksum(p.limit(0)).first()[1:] == (0, 0)
    assert stats.approximate_size(p) > 0
    locks = spark.createDataFrame([("k", "PUT", 5)], "user_key string, type string, start_ts long")
    assert stats.checksum(p, locks=locks, read_ts=4).first() == stats.checksum(p).first()
    with pytest.raises(mvcc.KeyLocked):
        stats.checksum(p, locks=locks)
    few = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    assert stats.stream_checksum(few) == zlib.crc32(b"a1b2")


def test_split_keys(spark):
    df = spark.createDataFrame([(f"k{i:02d}", 10) for i in range(20)], "key string, size long")
    assert [r.key for r in stats.split_keys(df, 4).orderBy("key").collect()] == ["k04", "k09", "k14"]
    assert stats.split_keys(df, 1).count() == 0 and stats.split_keys(df.limit(0), 4).count() == 0
    big = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 1)], "key string, size long")
    assert stats.split_keys(big, 3).count() <= 2
