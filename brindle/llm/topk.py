"""Exact top-k inner products, a block of vectors at a time.

Vectors are ordered by the nearest of a few pivots (a bounded sample of them), then by id,
and ranges of that order form blocks with a forward index (the matrix of their integer
components) and the extremes of every component (term) in the block. A query's bound for a
block is the sum over its terms of the best that the block's extremes allow. Queries form
blocks in the same way. Each block of queries first scores the document blocks of its
highest bounds, which gives every query a floor for its k-th score. With the floors, only
the extremes of blocks (a small part of the data) meet all queries; a document block is
sent to a block of queries only if some bound reaches its query's floor. There each query
visits blocks from the highest bound down and scores them through their forward indexes,
until the next bound falls below its k-th score; a bound equal to that score is still
visited, as ties go to the smaller id. Pairs of blocks meet in a grid of cells of bounded
size; the best k of all cells are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .util import Scratch

_SCHEMA = "part long, n int, dim int, kind string, ids binary, forward binary, low binary, high binary"
_LIMIT = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    """block: vectors of a block; cell_blocks: blocks of a cell; cell_queries: blocks of queries of a cell.

    seeds: blocks that each block of queries scores first; pivots: vectors of the sample that
    orders all others.
    """

    k: int = 5
    scale: int = 256
    block: int = 512
    cell_blocks: int = 12
    cell_queries: int = 32
    seeds: int = 2
    pivots: int = 64


def _packed(ids: list[int], rows: list[np.ndarray]) -> list:
    dim = max(map(len, rows))
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    kind = "<i4" if np.abs(m).max(initial=0) < 2**31 else "<f8"
    pack = lambda x: np.ascontiguousarray(x.astype(kind)).tobytes()
    return [len(rows), dim, kind, np.array(ids, "<i8").tobytes(), pack(m), pack(m.min(0)), pack(m.max(0))]


def _whole(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """Each vector's integer components; None where one is null or not finite."""
    out = []
    for v in column:
        values = v.values
        x = None
        if values is not None and not values.null_count:
            x = np.floor(scale * np.asarray(values.to_numpy(zero_copy_only=False), np.float64))
            x = x if np.isfinite(x).all() else None
        out.append(x)
    return out


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))


def _pivots(df: DataFrame, s: Settings) -> list[np.ndarray]:
    """s.pivots vectors at most, those of the smallest hashes of ids."""
    rows = _usable(*df).orderBy(F.xxhash64("_id"), "_v").limit(s.pivots).collect()
    found = _whole(pa.array([r["_v"] for r in rows], pa.list_(pa.float64())), s.scale)
    return [x for x in found if x is not None]


def _nearest(rows: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    dim = max(map(len, (*rows, *pivots)))
    x, c = (np.array([np.pad(r, (0, dim - len(r))) for r in m]) for m in (rows, pivots))
    with np.errstate(all="ignore"):
        return np.nan_to_num(x @ c.T - (c * c).sum(1) / 2, nan=0.0).argmax(1)


def blocks(df: DataFrame, s: Settings, key: str, vector: str, scratch: Scratch, name: str, pivots: list[np.ndarray] = ()) -> DataFrame:
    """Blocks of all vectors with finite components, in the order of their nearest pivots, then ids."""
    from pyspark import TaskContext

    def placed(batches):
        for batch in batches:
            rows = _whole(batch.column(1), s.scale)
            ok = [i for i, x in enumerate(rows) if x is not None]
            if ok:
                near = _nearest([rows[i] for i in ok], pivots) if pivots else np.zeros(len(ok), np.int64)
                some = batch.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *some.columns], names=["_pivot", "_id", "_v"])

    def run(batches):
        ids, rows, made = [], [], 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, x in zip(batch.column(1).to_pylist(), _whole(batch.column(2), s.scale)):
                if ids and ids[-1] == i and np.array_equal(rows[-1], x):
                    continue
                ids.append(i)
                rows.append(x)
                if len(ids) == s.block:
                    yield _row([(part << 32) + made, *_packed(ids, rows)])
                    ids, rows, made = [], [], made + 1
        if ids:
            yield _row([(part << 32) + made, *_packed(ids, rows)])

    def _row(values):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["part", "n", "dim", "kind", "ids", "forward", "low", "high"])

    by = ["_pivot", "_id", "_v"]
    some = scratch.save(_usable(df, key, vector).mapInArrow(tk.tidy(placed), "_pivot int, _id long, _v array<double>"), f"{name}_placed")
    return scratch.save(some.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(tk.tidy(run), _SCHEMA), name)


class _Block:
    """A block of vectors; or of its extremes alone, without forward. floors: the least that its queries' k-th scores can be."""

    def __init__(self, row: dict):
        kind, self.n, self.part = row["kind"], row["n"], row.get("part")
        self.ids = np.frombuffer(row["ids"], "<i8") if row.get("ids") is not None else None
        self.forward = np.frombuffer(row["forward"], kind).reshape(self.n, row["dim"]).astype(np.float64) if row.get("forward") is not None else None
        self.low, self.high = (np.frombuffer(row[c], kind).astype(np.float64) for c in ("low", "high"))
        floors = row.get("floors")
        self.floors = np.full(self.n, -_LIMIT - 1) if floors is None else np.array(floors, np.int64)


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[-1] == dim else np.concatenate((m, np.zeros((*m.shape[:-1], dim - m.shape[-1]))), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T as int64, held at the ends of its range."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[-1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -_LIMIT - 1, _LIMIT).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, each id once."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        if len(np.unique(ids[at])) < k:
            at = np.arange(len(scores))
    else:
        at = np.arange(len(scores))
    at = at[np.lexsort((ids[at], -scores[at].astype(np.float64) if np.abs(scores).max(initial=0) < 2**53 else _descending(scores[at])))]
    _, first = np.unique(ids[at], return_index=True)
    return at[np.sort(first)[:k]]


def _descending(scores: np.ndarray) -> np.ndarray:
    return np.invert(scores)  # -1 - x has no overflow


def _bounds(q: _Block, documents: list[_Block]) -> np.ndarray:
    """Each query's bound for each block."""
    dim = max(b.low.shape[-1] for b in (q, *documents))
    low, high = (np.array([_wide(getattr(b, c), dim) for b in documents]) for c in ("low", "high"))
    vectors = _wide(q.forward, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(vectors, 0) @ high.T + np.minimum(vectors, 0) @ low.T
    # a float sum may be off by a little where numbers are very large
    return np.nan_to_num(bounds + np.abs(bounds) * 1e-12, nan=np.inf)


def search(queries: list[_Block], documents: list[_Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores) of each query's best k among the documents that reach its floor, and how many scores were computed."""
    out_q, out_i, out_s, work = [], [], [], 0
    if not documents or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    dim = max(b.forward.shape[1] for b in (*queries, *documents))
    forward = [_wide(b.forward, dim) for b in documents]
    for q in queries:
        vectors, bounds = _wide(q.forward, dim), _bounds(q, documents)
        order = np.argsort(-bounds, axis=1, kind="stable")
        ids = [np.zeros(0, np.int64)] * q.n
        scores = [np.zeros(0, np.int64)] * q.n
        live = np.ones(q.n, bool)
        for turn in range(len(documents)):
            for i in np.flatnonzero(live):
                least = max(int(q.floors[i]), int(scores[i][-1]) if len(ids[i]) == k else -_LIMIT - 1)
                if bounds[i, order[i, turn]] < least:
                    live[i] = False
            for b in np.unique(order[live, turn]):
                rows = np.flatnonzero(live & (order[:, turn] == b))
                found = _product(vectors[rows], forward[b])
                work += found.size
                for row, s in zip(rows, found):
                    other = (documents[b].ids != q.ids[row]) & (s >= q.floors[row])
                    if not other.any():
                        continue
                    i2, s2 = np.concatenate((ids[row], documents[b].ids[other])), np.concatenate((scores[row], s[other]))
                    at = best(i2, s2, k)
                    ids[row], scores[row] = i2[at], s2[at]
        for i in range(q.n):
            out_q.append(np.full(len(ids[i]), q.ids[i]))
            out_i.append(ids[i])
            out_s.append(scores[i])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s), work


def top_k(df: DataFrame, queries: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None, report: dict | None = None) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best rows of df by integer inner product.

    Components become floor(scale * x). Rows with a null key, a null vector, or a null or
    non-finite component take no part. A query never meets rows of its own id; rows that
    repeat an id count once, by their best score. Vectors of different lengths are compared
    as if the shorter ended in zeros. Scores beyond 64 bits are held at the ends of the
    range. Fewer than k candidates give fewer rows; empty tables give none. report, if given,
    gets the scores computed ("scored") and those of all pairs ("all").
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    pivots = _pivots((df, key, vector), s)
    own = blocks(df, s, key, vector, scratch, "blocks", pivots)
    asked = blocks(queries, s, key, vector, scratch, "queries", pivots)
    k = s.k

    def dealt(x: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        n = -(-x.count() // size) or 1
        return x.withColumn(name, F.pmod(F.xxhash64("part"), F.lit(n))), n

    def cells(left: DataFrame, right: DataFrame, do, schema: str) -> DataFrame:
        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            return do(*([_Block(r) for r in t.to_pylist()] for t in (a, b)))

        return left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInArrow(cell, schema)

    def everywhere(x: DataFrame, name: str, n: int) -> DataFrame:
        return x.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    # extremes are a small part of the data, so more of them make up a cell
    extremes, n_e = dealt(own.select("part", "n", "dim", "kind", "low", "high"), s.cell_blocks * 16, "d")
    q, n_q = dealt(asked, s.cell_queries, "q")
    extremes, met = everywhere(extremes, "q", n_q), everywhere(q, "d", n_e)

    def promising(qs, ds):
        out = []
        for a in qs if ds else ():
            mean = _bounds(a, ds).mean(0)
            out += [(a.part, ds[i].part, float(min(mean[i], 1e300))) for i in np.argsort(-mean)[: s.seeds]]
        return pa.table({"q": pa.array([x[0] for x in out], pa.int64()), "d": pa.array([x[1] for x in out], pa.int64()), "mean": pa.array([x[2] for x in out], pa.float64())})

    first = Window.partitionBy("q").orderBy(F.desc("mean"), "d")
    seeds = cells(met, extremes, promising, "q long, d long, mean double").withColumn("r", F.row_number().over(first)).where(F.col("r") <= s.seeds).select("q", "d")

    def scored(qs, ds):
        a, i, v, work = search(qs, ds, k)
        # a row without ids says how much was done
        return pa.table({"query_id": pa.array([*a.tolist(), None], pa.int64()), "vec_id": pa.array([*i.tolist(), None], pa.int64()), "score": pa.array([*v.tolist(), work], pa.int64())})

    def chosen(pairs: DataFrame, q: DataFrame) -> DataFrame:
        """The best of the pairs of blocks (q, d), by (query_id, vec_id, score)."""
        pairs = pairs.withColumn("qc", F.pmod(F.xxhash64("q"), F.lit(-(-q.count() // s.cell_queries) or 1))).withColumn("dc", F.pmod(F.xxhash64("d"), F.lit(-(-own.count() // s.cell_blocks) or 1)))
        pairs = scratch.save(pairs, "pairs")
        left = q.join(pairs.select(F.col("q").alias("part"), F.col("qc").alias("q"), F.col("dc").alias("d")).distinct(), "part")
        right = own.join(pairs.select(F.col("d").alias("part"), F.col("qc").alias("q"), F.col("dc").alias("d")).distinct(), "part")
        return scratch.save(cells(left, right, scored, "query_id long, vec_id long, score long"), "scored")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.where("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    tried = chosen(seeds, asked)
    floors = ranked(tried).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    ids = asked.select("part", "ids").mapInArrow(tk.tidy(_ids), "part long, at int, query_id long")
    floors = ids.join(floors, "query_id", "left").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "floor"))).alias("f"))
    floors = floors.select("part", F.transform("f", lambda x: F.coalesce(x["floor"], F.lit(-_LIMIT - 1))).alias("floors"))
    asked = scratch.save(asked.join(floors, "part"), "floored")
    met = everywhere(dealt(asked, s.cell_queries, "q")[0], "d", n_e)

    def reached(qs, ds):
        out = [(a.part, ds[i].part) for a in (qs if ds else ()) for i in np.flatnonzero((_bounds(a, ds) >= a.floors[:, None]).any(0))]
        return pa.table({"q": pa.array([x[0] for x in out], pa.int64()), "d": pa.array([x[1] for x in out], pa.int64())})

    found = chosen(cells(met, extremes, reached, "q long, d long"), asked)
    if report is not None:
        report["scored"] = sum(x.where("query_id is null").agg(F.sum("score")).first()[0] or 0 for x in (tried, found))
        report["all"] = (asked.agg(F.sum("n")).first()[0] or 0) * (own.agg(F.sum("n")).first()[0] or 0)
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(batches):
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(data, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["part", "at", "query_id"])
