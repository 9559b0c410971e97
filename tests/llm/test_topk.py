import math

import numpy as np
import pytest

from brindle.llm import topk
from brindle.llm.topk import Settings

KIND = "vec_id long, embedding array<float>, label int, part string"


def brute(rows, asked, k=5):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    vectors = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = set()
    for q, v in {(q, tuple(w)) for q, v in asked if q is not None and (w := whole(v)) is not None}:
        best = {}
        for i, w in vectors:
            if i != q:
                s = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
                best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, r, i, s))
    return out


def run(spark, rows, step=10, s=Settings(block=8, cell_blocks=3, cell_queries=1)):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], KIND)
    got = topk.top_k(df, df.where(f"vec_id % {step} = 0"), s)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return {tuple(r) for r in got.collect()}, [(i, v) for i, v in rows if i is not None and i % step == 0]


@pytest.mark.parametrize("kind", ["normal", "clustered", "ties", "ragged", "huge"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6))
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(10, 6)) * 3, 15, 0) + x * 0.05
    if kind == "ties":
        x = rng.integers(-1, 2, (150, 6)).astype(float)
    if kind == "huge":
        x = x * 1e9
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(150), x)]
    if kind == "ragged":
        rows = [(i, v[: 1 + i % 6]) for i, v in rows]
    got, asked = run(spark, rows)
    assert got == brute(rows, asked)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (20, None), (7, [])]
    got, asked = run(spark, rows)
    assert got == brute(rows, asked)
    assert run(spark, [])[0] == set()
    assert run(spark, [(0, [1.0])])[0] == set()


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 40
    blocks = []
    for b, c in enumerate(centres):
        m = np.floor(c + rng.normal(size=(64, 16)))
        n, dim, kind, ids, forward, low, high = topk._packed(list(range(64 * b, 64 * b + 64)), list(m))
        blocks.append(topk._Block({"n": n, "dim": dim, "kind": kind, "ids": ids, "forward": forward, "low": low, "high": high}))
    *_, work = topk.search(blocks[:2], blocks, 5)
    assert work < 0.3 * 128 * 64 * 20


def test_clustered_vectors_are_pruned_and_others_are_not(spark):
    rng = np.random.default_rng(1)
    near = np.repeat(rng.normal(size=(40, 16)) * 3, 50, 0) + rng.normal(size=(2000, 16)) * 0.02
    far = rng.normal(size=(2000, 16))
    share = []
    for x in (near, far):
        rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(2000), x)]
        df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], KIND)
        report = {}
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), Settings(block=32), report=report)
        assert {tuple(r) for r in got.collect()} == brute(rows, [r for r in rows if r[0] % 50 == 0])
        share.append(report["scored"] / report["all"])
        assert report["all"] == 2000 * 40
    assert share[0] < 0.35
