"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words and word pairs; runs of one to three word shapes; levels of
repetition) are hashed to 2^bits features and scaled by the log-ratio of their counts in
the two classes. On these a linear model with hinge loss is fitted by dual coordinate
descent (Hsieh et al., 2008), and its margin is mapped to 0..1 by a logistic curve fitted
on the part of the sample that was set aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import sample
from .util import ship


@dataclass(frozen=True)
class Settings:
    """rows: the most labelled documents of each class that are fitted."""

    bits: int = 20
    rows: int = 3000
    smoothing: float = 1.0
    cost: float = 0.1
    epochs: int = 12
    seed: int = 11


# classes of bytes: 0 lower case and beyond ASCII, 1 upper case, 2 digit, 3 and up each mark by itself
_CLASS = np.zeros(256, np.uint64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum():
        _CLASS[_b] = _b
_REPEATS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return tk.mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, begin): the distinct feature numbers of each text."""
    starts, ends, first = tk.spans(data, offsets)
    words = tk.hashes(data, starts, ends)
    n, counts = len(words), np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    upper = np.concatenate(([0], np.cumsum(_CLASS[data] == 1)))
    caps = upper[ends] - upper[starts]
    length = ends - starts
    fresh = np.ones(n, bool)
    fresh[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    shape = _CLASS[data[starts]] if n else np.zeros(0, np.uint64)
    if n:
        shape = shape * np.uint64(256) + _CLASS[data[ends - 1]]
        shape = shape * np.uint64(4) + np.minimum(caps, 2).astype(np.uint64) + (caps == length).astype(np.uint64)
        shape = shape * np.uint64(4) + np.minimum(length // 6, 3).astype(np.uint64)
        shape = shape * np.uint64(2) + fresh.astype(np.uint64)
    groups = [(_salted(words, 1), doc), (_salted(shape, 2), doc)]
    for values, width, salt in ((words, 2, 3), (shape, 2, 4), (shape, 3, 5)):
        if n >= width:
            inside = doc[width - 1 :] == doc[: n - width + 1]
            run = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                run = run * np.uint64(0xD1B54A32D192ED03) + values[j : j + len(run)]
            groups.append((_salted(run[inside], salt), doc[: len(run)][inside]))
    # how much of a text repeats itself: runs of three words that came before
    runs, at = tk.shingles(words, first, 3)
    once = np.diff(tk.distinct(runs, at)[1])
    total = np.diff(at)
    share = 1 - once / np.maximum(total, 1)
    for i, level in enumerate(_REPEATS):
        rows = np.flatnonzero(share >= level)
        groups.append((np.full(len(rows), tk.mix(np.uint64([1000 + i]))[0]), rows))
    for i in range(1, 16):
        rows = np.flatnonzero(counts >= 1 << i)
        groups.append((np.full(len(rows), tk.mix(np.uint64([2000 + i]))[0]), rows))
    groups.append((np.full(len(counts), tk.mix(np.uint64([3000]))[0]), np.arange(len(counts))))
    value = np.concatenate([g[0] for g in groups]) & np.uint64((1 << bits) - 1)
    row = np.concatenate([g[1] for g in groups]).astype(np.uint64)
    both = np.unique(row << np.uint64(bits) | value)
    begin = np.searchsorted(both >> np.uint64(bits), np.arange(len(counts) + 1, dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), begin


def fit(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float]:
    """(weights of all features, slope, offset) of the score 1 / (1 + exp(-(slope * margin + offset)))."""
    size = 1 << s.bits
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return np.zeros(size, np.float32), 1.0, (4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    aside = max(1, len(y) // 5)
    train, held = (order[aside:], order[:aside]) if len(set(y[order[aside:]].tolist())) == 2 and len(y) >= 20 else (order, order)
    p, q = np.full(size, s.smoothing), np.full(size, s.smoothing)
    for i in train:
        (p if y[i] else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    weights = np.zeros(size)
    alpha = np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y[train] == k).mean() for k in (0, 1)])
    cap = s.cost * 0.5 / share[y]
    norm = np.array([np.square(ratio[r]).sum() / max(1, len(r)) for r in rows])
    scale = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))
    for _ in range(s.epochs):
        for i in rng.permutation(train):
            if norm[i] <= 0:
                continue
            r = rows[i]
            x = ratio[r] * scale[i]
            step = sign[i] * (x @ weights[r]) - 1
            was = alpha[i]
            alpha[i] = min(max(was - step / norm[i], 0.0), cap[i])
            if alpha[i] != was:
                weights[r] += (alpha[i] - was) * sign[i] * x
    weights *= ratio
    margin = np.array([weights[rows[i]].sum() * scale[i] for i in held])
    slope, offset = logistic(margin[:, None], y[held])
    return weights.astype(np.float32), float(slope[0]), float(offset)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic regression by Newton steps; both classes weigh the same."""
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.maximum(np.abs(z).max(0), 1e-9)
    z = z / scale
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - goal)) + decay * 1e-2 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + decay * 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 5 / max(np.abs(d).max(), 1e-9))
        if np.abs(d).max() < 1e-9:
            break
    w = w / scale
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    offset: float
    bits: int

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, begin = features(data, offsets, self.bits)
        n = np.diff(begin)
        total = np.concatenate(([0.0], np.cumsum(self.weights[found], dtype=np.float64)))
        margin = (total[begin[1:]] - total[begin[:-1]]) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def train(df: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> Model:
    """Fits a model on at most s.rows labelled documents of each class; labels holds the rows that may be learnt from.

    Without labels, or with one class only, every score is the same: 0.5, or near that class.
    """
    ship(df.sparkSession)
    bits = s.bits

    def run(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            found, begin = features(data, offsets, bits)
            yield pa.RecordBatch.from_arrays([pa.array([found[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary()), piece.column(1)], names=["f", "y"])

    rows = sample(df, labels, label, s.rows).mapInArrow(tk.tidy(run), "f binary, y int").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.f)))  # whatever order the rows came in, the model is the same
    y = np.array([r.y for r in rows], np.int64)
    weights, slope, offset = fit([np.frombuffer(r.f, np.int32) for r in rows], y, s)
    return Model(weights, slope, offset, bits)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) of each row of df: 0 to 1, higher for better quality.

    A null text scores as an empty one; other columns are ignored; repeated rows are each
    scored, alike; an empty df gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2^bits numbers of four bytes

    def run(batches):
        for piece, data, offsets in tk.text_chunks(batches, limit=1 << 19):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sent.value.scores(data, offsets))], names=[key, "score"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(tk.tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, score double")


def keep(df: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df whose text scores least or more, with all their columns, whatever their names.

    A null text scores as an empty one; rows that repeat are each judged, alike, and a null
    key doesn't matter; an empty df gives no rows.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            good = [sent.value.scores(data, offsets) >= least for _, data, offsets in tk.text_chunks([flat], limit=1 << 19)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return df.mapInArrow(tk.tidy(run), df.schema)
