"""Passages that repeat within and across documents, by MinHash banding of paragraphs.

Paragraphs are of two kinds. A line of min_words words or more is one. It is posted under
bands of the MinHash signature of its 5-word shingles, as many as the wanted recall asks
for; lines that collide in a band are compared on their whole shingle sets; confirmed pairs
form clusters by components.

A passage may begin and end anywhere, so every run of `words` words is a paragraph as well,
wherever lines begin and end. Its shingles are runs of `shingle` words, its MinHash the
smallest of their hashes. Equal runs have equal MinHashes, so one band of one coordinate
loses none; neighbouring runs mostly share theirs, so a text is posted about twice in
words - shingle + 2 words. Runs that collide are compared whole, by 96-bit hashes: first
cells of neighbouring runs at once, then, where no whole cell repeats, run by run. Clusters
are classes of equal runs.

All of a cluster but its first paragraph (smallest doc_id, then place) are removed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .near_dedup import LANES, NearDuplicates, near_duplicates
from .util import BROADCAST_ROWS, Scratch, fresh, number_rows

KEY = ["doc_id", "t"]
LINE, RUN = 0, 1
#: A place is a text's rank, times 2^28, plus a word of it; words stay below half of that, so places of two texts lie far apart.
PLACE_BITS = 28
_FACTORS = np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Settings:
    """min_words: the shortest line that is a paragraph of its own. words, shingle: of runs.

    width, percent, rows, miss: of lines; miss is the share of true pairs at the bound that
    banding may lose.
    """

    min_words: int = 20
    words: int = 50
    shingle: int = 25
    width: int = 5
    percent: int = 80
    rows: int = 2
    miss: float = 1e-6

    def __post_init__(self):
        if not 0 < self.shingle <= self.words:
            raise ValueError("shingle must be between 1 and words")

    @property
    def bands(self) -> int:
        """Bands needed: (1 - similarity^rows)^bands stays below miss; rounded up so that coordinates fill their lanes."""
        n = math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))
        while n * self.rows % LANES:
            n += 1
        return n


def _keyed(df: DataFrame) -> DataFrame:
    """(doc_id, t, text); t tells texts of one doc_id apart; rows equal in both are alike in all that follows."""
    text = F.col("text").cast("string")
    return df.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of texts whose key is in lists (written, one row a key), with its columns; only these are shuffled if they are few."""
    ids = lists.select(*KEY)
    if ids.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), KEY, "left_semi")
    return texts.join(lists, KEY)


# lines


def lines(df: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, t, begin int, end int, text) of all lines of min_words words or more; begin and end count words of the text."""

    def run(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            heads = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
            edges = np.searchsorted(starts, np.append(heads, len(data)))
            long = np.flatnonzero(np.diff(edges) >= s.min_words)
            a, b = edges[:-1][long], edges[1:][long]
            row = np.searchsorted(first, a, "right") - 1
            keys = [piece.column(i).take(pa.array(row)) for i in (0, 1)]
            text = [data[x:y].tobytes().decode() for x, y in zip(starts[a], ends[b - 1])]
            numbers = [pa.array((x - first[row]).astype(np.int32)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*keys, *numbers, pa.array(text, pa.string())], names=[*KEY, "begin", "end", "text"])

    return _keyed(df).mapInArrow(tk.tidy(run), "doc_id long, t long, begin int, end int, text string")


def _line_clusters(df: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """(doc_id, t, begin, end, removed, first) of every line in a cluster of two or more; first is the doc_id of the line that stays."""
    parts = scratch.save(lines(df, s).withColumn("id", F.monotonically_increasing_id()), "lines")
    bands = NearDuplicates(width=s.width, percent=s.percent, coordinates=s.bands * s.rows, rows=s.rows, matches=1, agreeing=s.bands * s.rows // 3)
    engine = Scratch(df.sparkSession, "lines")
    found = near_duplicates(parts.select(F.col("id").alias("doc_id"), "text"), bands, engine, unique=True)
    found = scratch.save(found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("cluster")), "clusters")
    engine.drop(engine.path)
    several = scratch.save(found.where("id <> cluster").select("cluster").distinct(), "several")
    named = scratch.save(found.join(several, "cluster").join(parts.drop("text"), "id"), "named")
    # written, so that a join with a large cluster can be split
    heads = scratch.save(named.groupBy("cluster").agg(F.min_by("id", F.struct(*KEY, "begin")).alias("head"), F.min("doc_id").alias("first")), "heads")
    return named.join(heads, "cluster").select(*KEY, "begin", "end", (F.col("id") != F.col("head")).alias("removed"), "first")


# runs of words


def _runs(words: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of width words, across texts too."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width if len(out) else 0):
        out *= factor
        out += words[j : j + len(out)]
    return tk.mix(out)


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every width neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def minima(words: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places among all words, hashes) of the shingles that are the MinHash of some run."""
    n = len(words) - s.words + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.maximum(_runs(words, s.shingle, _FACTORS[0]), np.uint64(1))
    span = s.words - s.shingle + 1
    low = _sliding(np.minimum, h, span)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low[text[:n] != text[s.words - 1 :]] = 0
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, low, edge)), span) == h)
    return at, h[at]


def cells(place: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first run, number of runs) of the cells of the given shingles, in order: the runs that hold one and not the one before."""
    row = np.searchsorted(first, place, "right") - 1
    low = np.maximum(first[row], place - (s.words - s.shingle))
    low[1:] = np.where(row[1:] == row[:-1], np.maximum(low[1:], place[:-1] + 1), low[1:])
    n = np.minimum(place, first[row + 1] - s.words) - low + 1
    return row[n > 0], low[n > 0], n[n > 0]


def _equal_runs(df: DataFrame, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((rank, begin, n, removed, first) of runs that occur again, n neighbours each, (rank, doc_id, t) of their texts).

    first is the rank of an earlier text that has them. A run inside a cell that repeats an
    earlier one is removed with it, and needn't be looked at again: its first occurrence is
    never inside such a cell. So all others are compared one by one.
    """
    texts = _keyed(df)

    def post(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            at, h = minima(tk.hashes(data, starts, ends), first, s)
            row = np.searchsorted(first, at, "right") - 1
            keys = [piece.column(i).take(pa.array(row)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((at - first[row]).astype(np.int32)), pa.array(h.view(np.int64))], names=[*KEY, "pos", "h"])

    def cut(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            words = tk.hashes(data, starts, ends)
            at = piece.column(piece.schema.get_field_index("at"))
            row, low, n = cells(np.unique(np.repeat(first[:-1], np.asarray(pc.list_value_length(at))) + np.asarray(at.flatten())), first, s)
            begin = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(begin, n)
            here = np.repeat(low, n) + step
            runs = [_runs(words, s.words, f)[here] for f in _FACTORS]
            whole = [tk.mix(np.add.reduceat(tk.mix(x + step.astype(np.uint64) * f), begin) + n.astype(np.uint64)) if len(n) else x for x, f in zip(runs, _FACTORS)]
            top = lambda x: (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(begin, n.sum()).astype(np.int32)), x) for x in (pa.array(runs[0].view(np.int64)), pa.array(top(runs[1])))]
            pos = low - first[row]
            if len(pos) and pos.max() >> (PLACE_BITS - 1):
                raise ValueError("a text has too many words")
            place = (np.asarray(piece.column(0))[row].astype(np.int64) << PLACE_BITS) + pos
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n.astype(np.int32)), pa.array(whole[0].view(np.int64)), pa.array(top(whole[1])), *lists], names=["place", "n", "h", "c", "hs", "cs"])

    posted = Scratch(df.sparkSession, "postings")
    all_postings = posted.save(texts.mapInArrow(tk.tidy(post), "doc_id long, t long, pos int, h long"), "posted")
    twice = posted.save(all_postings.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    found = posted.save(all_postings.join(twice, "h").groupBy(*KEY).agg(F.collect_list("pos").alias("at")), "lists")
    lists = scratch.save(number_rows(found, KEY, posted, "rank")[0], "lists")
    posted.drop(posted.path)
    scratch.release()

    made = scratch.save(_with(texts, lists).select("rank", "text", "at").mapInArrow(tk.tidy(cut), "place long, n int, h long, c int, hs array<long>, cs array<int>"), "cells")
    again, real = F.expr(f"place - a >= {s.words}"), F.expr(f"z - a >= {s.words}")
    heads = lambda x: x.groupBy("h", "c").agg(F.min("place").alias("a"), F.max("place").alias("z")).where("a <> z").select("h", "c", "a", real.alias("real"))
    own = scratch.save(heads(made), "cell_heads")
    judged = made.join(own, ["h", "c"], "left").withColumn("removed", F.coalesce(again, F.lit(False)))
    kept = lambda x: F.when(~F.col("removed"), F.col(x)).alias(x)
    judged = scratch.save(judged.select("place", "n", "a", "removed", F.coalesce("real", F.lit(False)).alias("real"), kept("hs"), kept("cs")), "judged")
    scratch.drop_named("cells")
    runs = judged.where("not removed").select("place", F.posexplode(F.arrays_zip("hs", "cs")).alias("i", "x")).select((F.col("place") + F.col("i")).alias("place"), F.col("x.hs").alias("h"), F.col("x.cs").alias("c"))
    of_runs = scratch.save(heads(runs), "run_heads")
    single = runs.join(of_runs, ["h", "c"]).withColumn("removed", again).where("removed or real").select("place", F.lit(1).alias("n"), "removed", "a")
    whole = judged.where("removed or real").select("place", "n", "removed", "a")
    rank = lambda x: F.shiftright(x, PLACE_BITS)
    out = whole.unionByName(single).select(rank("place").alias("rank"), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("begin"), "n", "removed", rank("a").alias("first"))
    return out, lists.select("rank", *KEY)


# both


def _found(df: DataFrame, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t, at) of all texts with paragraphs that repeat, (rank, doc_id, t)); at has (unit, begin, n, removed, first)."""
    runs, ranks = _equal_runs(df, s, scratch)
    runs = scratch.save(runs.join(ranks, "rank").select(*KEY, F.lit(RUN).alias("unit"), "begin", "n", "removed", "first"), "runs")
    scratch.drop_named("judged")
    scratch.release()
    whole = _line_clusters(df, s, scratch).select(*KEY, F.lit(LINE).alias("unit"), "begin", F.expr("end - begin").alias("n"), "removed", "first")
    lists = runs.unionByName(whole).groupBy(*KEY).agg(F.collect_list(F.struct("unit", "begin", "n", "removed", "first")).alias("at"))
    return scratch.save(lists, "found"), ranks


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges begin..end-1."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of places that lie inside."""
    step = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _fields(at: pa.Scalar) -> list[np.ndarray]:
    return [at.values.field(k).to_numpy(zero_copy_only=False) for k in range(5)]


def _spread(begin: np.ndarray, n: np.ndarray, mask: np.ndarray, words: int, s: Settings, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(runs, words covered by them) of the masked ranges of runs, but for some runs."""
    inside = _covered(begin[mask], (begin + n)[mask], words)
    if but is not None:
        inside &= ~but
    at = np.flatnonzero(inside)
    return inside, _covered(at, at + s.words, words)


def repeated_passages(df: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, unit, begin int, end int, words int, removed, first_doc_id) of every paragraph that repeats.

    df needs doc_id (integer) and text; other columns are ignored. begin and end count
    characters of text. unit "line" is a line in a cluster of two or more; first_doc_id has
    its first line, which is kept, and removed is true of the others. unit "passage" is a
    stretch of equal runs (cut at blanks, A to Z alike in both cases): of those that repeat
    what came before (removed), or of those that are kept for others; first_doc_id has its
    first run, earlier. Within a text only runs that don't overlap count as repeats. Rows
    without doc_id or text take no part. Rows that repeat a doc_id are texts of their own,
    one after another, but equal ones count as one. Nothing repeated or an empty df gives no
    rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "substring")
    lists, ranks = _found(df, s, scratch)

    def run(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            out = []
            for i in range(piece.num_rows):
                unit, begin, n, removed, source = _fields(piece.column(3)[i])
                total, key = int(first[i + 1] - first[i]), piece.column(0)[i].as_py()

                def add(kind, a, b, gone, head):
                    x, y = (int(chars[p] - chars[offsets[i]]) for p in (starts[first[i] + a], ends[first[i] + b - 1]))
                    out.append((key, kind, x, y, int(b - a), bool(gone), int(head)))

                for k in np.flatnonzero(unit == LINE):
                    add("line", begin[k], begin[k] + n[k], removed[k], source[k])
                gone, words = _spread(begin, n, (unit == RUN) & removed, total, s)
                for flag, (at, covered) in ((True, (gone, words)), (False, _spread(begin, n, (unit == RUN) & ~removed, total, s, gone))):
                    for a, b in zip(*_stretches(covered)):
                        k = np.flatnonzero((unit == RUN) & (removed == flag) & (begin <= a) & (a < begin + n))
                        add("passage", a, b, flag, source[k].min())
            kinds = pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "unit", "begin", "end", "words", "removed", "first"])

    schema = "doc_id long, unit string, begin int, end int, words int, removed boolean, first long"
    # rows equal in doc_id and text give the same spans
    out = scratch.save(_with(_keyed(df), lists).select(*KEY, "text", "at").mapInArrow(tk.tidy(run), schema).distinct(), "spans")
    sources = ranks.select(F.col("rank").alias("first"), F.lit("passage").alias("unit"), F.col("doc_id").alias("_source"))
    return out.join(sources, ["first", "unit"], "left").select(*(c for c in out.columns if c != "first"), F.coalesce("_source", "first").alias("first_doc_id"))


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, stretches) -> bytes:
    """text without the stretches; of the blanks on both sides of one those with more line breaks stay."""
    out, at = [], 0
    for a, b in stretches:
        before, after = ends[a - 1] if a else 0, starts[b] if b < len(starts) else len(text)
        left, right = text[before : starts[a]], text[ends[b - 1] : after]
        out += text[at:before], right if a and (b == len(starts) or right.count(b"\n") > left.count(b"\n")) else left
        at = after
    return b"".join([*out, text[at:]])


def without_repeats(df: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """df with removed lines and passages cut from text and n_chars, if there, counted anew; rows of which nothing is left go.

    df is read several times. Rows without doc_id or text stay as they are.
    """
    scratch = scratch or Scratch(df.sparkSession, "substring")
    lists = _found(df, s, scratch)[0].where(F.exists("at", lambda x: x["removed"]))
    doc, t, at = (fresh(df, x) for x in ("_cut_doc", "_cut_t", "_cut_at"))
    lists = scratch.save(lists.select(F.col("doc_id").alias(doc), F.col("t").alias(t), F.col("at").alias(at)), "cut")
    same = (F.col("doc_id") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    ids = lists.select(doc, t)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    names, place = df.columns, df.columns.index("text")

    def run(batches):
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            out = []
            for i in range(piece.num_rows):
                unit, begin, n, removed, _ = _fields(piece.column(piece.num_columns - 1)[i])
                own, total = slice(first[i], first[i + 1]), int(first[i + 1] - first[i])
                line = (unit == LINE) & removed
                inside = _spread(begin, n, (unit == RUN) & removed, total, s)[1] | _covered(begin[line], (begin + n)[line], total)
                out.append(_cut(data[offsets[i] : offsets[i + 1]].tobytes(), starts[own] - offsets[i], ends[own] - offsets[i], zip(*_stretches(inside))).decode())
            columns = piece.columns[:-1]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([bool(x.strip()) for x in out], pa.bool_()))

    hit = df.join(ids, same, "left_semi").join(lists, same).select(*(df[c] for c in df.columns), at)
    out = hit.mapInArrow(tk.tidy(run), df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df.join(ids, same, "left_anti").unionByName(out.select(*df.columns))
