import random

import numpy as np
import pyarrow as pa

from brindle.llm import quality, textkernel
from brindle.llm.labelled import remainder, sample
from brindle.llm.quality import Settings, features


def corpus(prose, n):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        t, good = prose(i, 80), i % 3 != 0
        if not good:
            w = t.split()
            t = [" ".join(x + "***" for x in w), " ".join(x for x in w[:6] for _ in range(12)), " ".join(x.upper() + "!!" for x in w[:8] * 8)][rng.randrange(3)]
        rows.append((i, t))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark, documents, prose):
    rows, labels = corpus(prose, 360)
    df = documents(rows)
    m = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int").where("doc_id < 260"))
    got = {r.doc_id: r.score for r in quality.score(df, m).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels if i >= 260)
    kept = {r.doc_id for r in quality.keep(df, m).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.5}
    assert quality.keep(df, m).schema == df.schema
    again = quality.train(df.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int").where("doc_id < 260"))
    assert np.array_equal(again.weights, m.weights)


def test_odd_rows(spark, documents, prose):
    rows, labels = corpus(prose, 60)
    odd = [(900, None), (901, ""), (None, "x"), (902, "a " * 50_000), (0, rows[0][1]), (903, "y" * 100_000)]
    m = quality.train(documents(rows + odd), spark.createDataFrame([*labels, (None, 1), (901, None), (901, 7), (0, 0)], "doc_id long, quality int"), s=Settings(rows=20))
    got = quality.score(documents(rows + odd), m).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[0]) == 1 and by[900] == by[901]
    assert quality.score(documents([]), m).collect() == [] and quality.keep(documents([]), m).collect() == []


def test_without_labels(spark, documents):
    df = documents([(1, "a b"), (2, "c")])
    for labels, want in (([], 0.5), ([(1, 1)], 0.9), ([(1, 0)], 0.1)):
        m = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        for r in quality.score(df, m).collect():
            assert abs(r.score - want) < 0.11


def test_features_are_those_of_each_text_alone(prose):
    texts = [prose(3, 40), "", "A!! B!! C!!", "z " * 40]
    together, begin = features(*textkernel.column_bytes(pa.array(texts)), 18)
    for i, t in enumerate(texts):
        alone, _ = features(*textkernel.column_bytes(pa.array([t])), 18)
        assert np.array_equal(together[begin[i] : begin[i + 1]], alone)


def test_samples_are_bounded(spark, documents):
    df = documents([(i, str(i)) for i in range(50)])
    y = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert sorted(r.y for r in sample(df, y, "quality", 3, 5).collect()) == [0] * 5 + [1] * 3
    import zlib

    got = {r.doc_id: r.m for r in df.select("doc_id", remainder("doc_id", 3).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_against_a_plain_solver():
    """Class ratios counted one by one, and the dual problem solved by projected gradients."""
    rng, s = np.random.default_rng(4), Settings(bits=6, epochs=3000)
    y = np.array([0, 1] * 9)
    rows = [np.unique(rng.integers(0, 40, 12) + 20 * c).astype(np.int32) for c in y]
    counts = [[s.smoothing + sum(f in r for r, c in zip(rows, y) if c == k) for f in range(64)] for k in (0, 1)]
    ratio = np.array([np.log(counts[1][f] / sum(counts[1])) - np.log(counts[0][f] / sum(counts[0])) for f in range(64)])
    x = np.zeros((18, 64))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    sign, cap = 2.0 * y - 1, s.cost * 0.5 / 0.5
    signed = x * sign[:, None]
    gram, alpha = signed @ signed.T, np.zeros(18)
    for _ in range(50_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cap)
    weights, slope, offset = quality.fit(rows, y, s)
    assert np.abs(weights - (signed.T @ alpha) * ratio).max() < 1e-5
    assert slope > 0 and np.isfinite(offset)


def test_scores_are_sums_over_features(spark, documents, prose):
    rows = [(i, prose(i, i * 7 % 60)) for i in range(30)] + [(90, None), (91, "A!! 7$ B!!")]
    weights = np.random.default_rng(2).normal(size=1 << 10).astype(np.float32)
    m = quality.Model(weights, 1.5, -0.25, 10)
    got = {r.doc_id: r.score for r in quality.score(documents(rows), m).collect()}
    for i, t in rows:
        found, _ = features(*textkernel.column_bytes(pa.array([t or ""])), 10)
        margin = sum(float(weights[f]) for f in found) / len(found) ** 0.5
        assert abs(got[i] - 1 / (1 + np.exp(-(1.5 * margin - 0.25)))) < 1e-9
