import zlib
from collections import Counter

import pytest
import xxhash

from brindle.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1025])
def test_permutation(spark, n):
    got = [r.place for r in sharding.with_place(spark.range(n), "id", n, 5).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        assert got != sorted(got)
        assert got != [r.place for r in sharding.with_place(spark.range(n), "id", n, 6).orderBy("id").collect()]


def test_contract(documents, prose):
    rows = [(i, prose(i, i % 40)) for i in range(200)] + [(None, "x"), (None, None), (7, "dup"), (7, "dup"), (300, "é€"), (301, "")] + [(5, "hot")] * 100
    got = sharding.shard(documents(rows), 16).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_reproducible_whatever_the_layout(documents, prose):
    rows = [(i, prose(i, 10)) for i in range(120)]
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(documents(rows).repartition(7)).collect()}
    assert one == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(documents(rows[::-1]).coalesce(1)).collect()}
    assert one != {(r.doc_id, r.shard, r.slot) for r in sharding.shard(documents(rows), seed=1).collect()}


def test_edges(documents):
    assert sharding.shard(documents([])).collect() == []
    assert [(r.shard, r.slot) for r in sharding.shard(documents([(1, "a")])).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        sharding.shard(documents([]), 0)
    df = sharding.shard(documents([(1, "a")]))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, seed", [(1, 5), (7, 5), (65, -3), (1000, 2024)])
def test_against_a_plain_permutation(spark, n, seed):
    bits = 2
    while 1 << bits < n:
        bits += 1
    low = bits // 2

    def hashed(half, k):
        h = 42
        for number, size in ((half, 8), (seed, 8), (k, 4)):
            h = xxhash.xxh64_intdigest(number.to_bytes(size, "little", signed=True), h)
        return h

    def once(x):
        left, right = x >> low, x % (1 << low)
        for k in range(4):
            if k % 2:
                right ^= hashed(left, k) % (1 << low)
            else:
                left ^= hashed(right, k) % (1 << (bits - low))
        return left << low | right

    for r in sharding.with_place(spark.range(n), "id", n, seed).collect():
        want = once(r.id)
        while want >= n:
            want = once(want)
        assert r.place == want
