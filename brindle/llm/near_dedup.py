"""MinHash near-duplicates by an inverted join of signature coordinates.

Every distinct shingle set is posted under each of its K (coordinate, value) pairs. A pair
of sets that meets the similarity bound agrees on at least T of K coordinates (for K = 35,
T = 13 and a similarity of 0.8, all but one pair in 10^8). Hence, with each set's
coordinates in order of list length, two such sets share one of their K-T+1 rarest
coordinates (the prefix); the T-1 longest lists of a set are skipped, and are only probed
through 9-bit lanes of the signature that travel with each posting. Pairs with T or more
agreeing lanes are confirmed on their full shingle sets.

Very long lists are never paired with themselves. First each set meets only the most
central set of each of its lists (so that a group of n copies costs n comparisons), and
confirmed links form preliminary classes. Only pairs of different classes are sought
after that: in short lists by the prefix join, and among the sets whose prefix reaches
into long lists by an exact prefix join over their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .util import Scratch, components, fresh, semi_join, small_batches


LANES, LANE_BITS = 7, 9
BITMAP = 16  # numbers of 64 bits
#: Pairs of whole texts that a worker holds.
PAIRS_AT_ONCE = 64
#: Shingles that are ranked by how many sets have them (2 MB in each worker), and how many of its earlier ones a posting carries.
COMMON, EARLIER = 1 << 17, 8


@dataclass(frozen=True)
class NearDuplicates:
    """Shingles of width words; links at percent of the union.

    Sets are posted under coordinates / rows keys, each of rows coordinates together (bands
    if that is over 1). Candidates share matches keys or more, and agree in agreeing lanes
    or more. Lists longer than long are taken the exact way.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 35
    rows: int = 1
    matches: int = 13
    agreeing: int = 13
    long: int = 64

    def __post_init__(self):
        if self.coordinates % LANES or self.coordinates % self.rows:
            raise ValueError(f"coordinates must be a multiple of {LANES} and of rows")

    def sets(self, batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for piece, data, offsets in tk.text_chunks(batches):
            starts, ends, first = tk.spans(data, offsets)
            values, begin = tk.distinct(*tk.shingles(tk.hashes(data, starts, ends), first, self.width))
            yield piece, values, begin


_LOW = sum(0xFF << (LANE_BITS * i) for i in range(LANES))
_HIGH = sum(0x100 << (LANE_BITS * i) for i in range(LANES))


def _signed(df: DataFrame, p: NearDuplicates) -> DataFrame:
    words = p.coordinates // LANES
    schema = "doc_id long, n_shingles long, set_hash long, set_check long, keys array<long>, lanes array<long>"

    def run(batches):
        salt = tk.mix(np.arange(1, p.coordinates + 1, dtype=np.uint64))
        for piece, values, begin in p.sets(batches):
            n = np.diff(begin)
            some = n > 0
            sig = tk.mix(tk.signatures(values, begin, p.coordinates) ^ salt)
            keys = np.zeros((len(n), p.coordinates // p.rows), np.uint64)
            for k in range(p.rows):
                keys = tk.mix(keys + sig[:, k :: p.rows])
            # two sums that don't depend on order identify a set
            h = np.zeros((2, len(n)), np.uint64)
            for i in (0, 1):
                if len(values):
                    h[i, some] = np.add.reduceat(tk.mix(values ^ salt[i]), begin[:-1][some])
            lanes = np.zeros((len(n), words), np.uint64)
            for k in range(p.coordinates):
                lanes[:, k // LANES] |= ((sig[:, k] >> np.uint64(40)) & np.uint64(511)) << np.uint64(LANE_BITS * (k % LANES))
            rows = lambda m, w: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, w, dtype=np.int32)), pa.array(m.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n.astype(np.int64)), pa.array(h[0].view(np.int64), mask=~some), pa.array(h[1].view(np.int64), mask=~some), rows(keys, keys.shape[1]), rows(lanes, words)],
                names=["doc_id", "n_shingles", "set_hash", "set_check", "keys", "lanes"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), schema)


def _agreeing(words: int):
    """How many lanes of a.l* and b.l* agree: at least as many as coordinates do."""
    same = F.lit(0)
    for i in range(words):
        x = F.col(f"a.l{i}").bitwiseXOR(F.col(f"b.l{i}"))
        full = (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))
        same = same + F.lit(LANES) - F.bit_count(full)
    return same


def _fits(p: NearDuplicates, both: str, x: str, y: str):
    """The bound p.percent for an intersection of size both."""
    return F.expr(f"100 * ({both}) >= {p.percent} * ({x} + {y} - ({both}))")


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearDuplicates, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the bound, written."""
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            at = 0
            size = max(1, (1 << 20) * batch.num_rows // max(1, batch.nbytes))
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at += size
                own = []
                for c in ("ta", "tb"):
                    data, offsets = tk.column_bytes(part.column(part.schema.get_field_index(c)))
                    starts, ends, first = tk.spans(data, offsets)
                    own.append(tk.distinct(*tk.shingles(tk.hashes(data, starts, ends), first, p.width)))
                (x, xb), (y, yb) = own
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    u, v = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                    both = len(u) + len(v) - len(np.unique(np.concatenate((u, v))))
                    keep[i] = both > 0 and 100 * both >= p.percent * (len(u) + len(v) - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    with small_batches(pairs.sparkSession, PAIRS_AT_ONCE):
        return scratch.save(two.select("a", "b", "ta", "tb").mapInArrow(tk.tidy(run), "a long, b long"), "confirmed")


def _rarity(counted: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, bool]:
    """(shingles that several sets of counted (s, f) have, sorted; the rank of each, rarest first; whether these are all).

    Beyond COMMON of them it takes those over a count; the others all rank before these.
    """
    common = scratch.save(counted.where("f > 1").select("s", "f"), "common")
    total, least = common.count(), 2
    if total > COMMON:
        room = COMMON
        # one row for each count, so few of them
        for f, k in sorted(((r["f"], r["count"]) for r in common.groupBy("f").count().collect()), reverse=True):
            room -= k
            if room < 0:
                least = f + 1
                break
    got = common.where(f"f >= {least}").toArrow()
    s = got["s"].to_numpy().view(np.uint64)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, got["f"].to_numpy()))] = np.arange(1, len(s) + 1)
    order = np.argsort(s)
    return s[order], rank[order], least == 2


def _long_list_pairs(members: DataFrame, texts: DataFrame, p: NearDuplicates, scratch: Scratch) -> DataFrame:
    """Pairs of different classes among members (doc_id, class, size, n), by an exact prefix join over their shingles.

    What a set shares with any other is at most m, its shingles that some other member has:
    sets with less than the bound in common with anything go first. The others are posted
    under their rarest shingles. Of an indexed set only the first n - ceil(2s/(1+s) n)
    + 1 can be the first one shared with an equal or larger set, of a probing set the first
    n - ceil(s n) + 1. Pairs that meet must still pass the bounds from sizes, from what is
    left of both sets from that shingle on, and from parity bitmaps: two sets differ in at
    least as many shingles as bits. A pair is made where it meets first: not under a shingle
    if one of the last EARLIER before it is shared too.
    """
    own = scratch.save(texts.select("doc_id", "text").join(members, "doc_id"), "own")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def all_shingles(batches):
        for piece, values, begin in p.sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(piece.column(0)), np.diff(begin))), pa.array(values.view(np.int64))], names=["doc_id", "s"])

    # dealt evenly, as each text becomes as many rows as it has shingles
    counted = own.select("doc_id", "text").repartition(tasks).mapInArrow(tk.tidy(all_shingles), "doc_id long, s long").groupBy("s").agg(F.count("*").alias("f"), F.min("doc_id").alias("doc_id"))
    common, ranks, every = _rarity(counted, scratch)

    def prefixes(batches):
        for piece, values, begin in p.sets(batches):
            n = np.diff(begin)
            of = np.repeat(np.arange(len(n)), n)
            parity = np.zeros((len(n), 64 * BITMAP), np.uint8)
            np.bitwise_xor.at(parity, (of, (tk.mix(values) % np.uint64(64 * BITMAP)).astype(np.int64)), 1)
            bits = np.packbits(parity, axis=1).view(np.int64)
            rank = np.zeros(len(values), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                rank = np.where(common[at] == values, ranks[at], 0)
            values = values[np.argsort(of * (len(common) + 1) + rank, kind="stable")]
            place = np.arange(len(values)) - begin[:-1][of]
            # shingles that no other set has come first, and are not posted
            alone = np.bincount(of[rank == 0], minlength=len(n)) if every else np.asarray(piece.column(piece.schema.get_field_index("u")))
            skip = alone if every else np.zeros_like(n)
            probe, index = (n - -(-x * n // y) + 1 for x, y in ((p.percent, 100), (2 * p.percent, 100 + p.percent)))
            rows = np.flatnonzero((place >= skip[of]) & (place < probe[of]) & (100 * (n - alone) >= p.percent * n)[of])
            doc, place = of[rows], place[rows]
            back = np.minimum(place - skip[doc], EARLIER)
            ends = np.concatenate(([0], np.cumsum(back)))
            earlier = np.repeat(rows - back - ends[:-1], back) + np.arange(ends[-1])
            before = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[earlier].view(np.int64)))
            columns = [c.take(pa.array(doc)) for c in piece.select(["doc_id", "class", "size"]).columns]
            more = [place < index[doc], n[doc], np.minimum((n - alone)[doc], n[doc] - place), values[rows].view(np.int64), *(bits[doc, i] for i in range(BITMAP))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, more), before], names=names)

    known = own.select("doc_id", "text", "class", "size")
    if not every:
        unique = counted.where("f = 1").groupBy("doc_id").agg(F.count("*").alias("u"))
        known = known.join(scratch.save(unique, "alone"), "doc_id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    names = ["doc_id", "class", "size", "index", "n", "rest", "s", *(f"p{i}" for i in range(BITMAP)), "before"]
    kinds = "doc_id long, class long, size long, index boolean, n long, rest long, s long, " + ", ".join(f"p{i} long" for i in range(BITMAP)) + ", before array<long>"
    rows = scratch.save(known.repartition(tasks).mapInArrow(tk.tidy(prefixes), kinds), "rows")
    largest = rows.groupBy("s").agg(F.max(F.struct("size", "class")).alias("top"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1")
    largest = scratch.save(largest.select("s", F.col("top.class").alias("top")), "largest")
    rows = scratch.save(rows.join(largest, "s").withColumn("outside", F.col("class") != F.col("top")), "met")
    scratch.drop_named("own", "common", "alone", "rows", "largest")
    sizes = f"(a.n > b.n or a.n = b.n and a.doc_id > b.doc_id) and 100 * b.n >= {p.percent} * a.n"
    apart = " + ".join(f"bit_count(a.p{i} ^ b.p{i})" for i in range(BITMAP))
    near = f"{100 + p.percent} * ({apart}) <= {100 - p.percent} * (a.n + b.n)"
    cond = F.expr(f"a.s = b.s and a.class <> b.class and {sizes}") & _fits(p, "least(a.rest, b.rest)", "a.n", "b.n") & F.expr(near) & F.expr("not arrays_overlap(a.before, b.before)")
    index = rows.where("index")
    pairs = [x.alias("a").join(y.alias("b"), cond).select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")) for x, y in ((rows.where("outside"), index), (rows.where("not outside"), index.where("outside")))]
    return pairs[0].union(pairs[1])


def near_duplicates(df: DataFrame, p: NearDuplicates = NearDuplicates(), scratch: Scratch | None = None, unique: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    df needs doc_id (integer, the key) and text; other columns are ignored, whatever their
    names. A null or blank text has no shingles, is linked with nothing and is its own
    component. A row without doc_id can't be named: component_id is null and kept false.
    Rows that repeat a doc_id are judged one by one, each by its own text, and each reported.
    component_id is the smallest doc_id reachable over links; kept says that it is the
    row's own. unique says that no doc_id repeats, so that needn't be looked up. An empty
    df gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "near")
    words, T = p.coordinates // LANES, p.matches
    signed = scratch.save(_signed(df, p), "signed")
    if not unique and _repeats(signed):
        return _by_row(df, signed, p, scratch)
    known = signed.where("doc_id is not null and n_shingles > 0")
    reps = scratch.save(known.groupBy("set_hash", "set_check", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    # one row of signed for each set
    sets = known.join(reps, (known["set_hash"] == reps["set_hash"]) & (known["set_check"] == reps["set_check"]) & (known["doc_id"] == reps["rep"]), "left_semi").withColumnRenamed("doc_id", "rep")
    sets = scratch.save(sets, "sets")
    signed = scratch.save(signed.select("doc_id", "n_shingles", "set_hash", "set_check"), "names")
    scratch.drop_named("signed", "reps")

    posted = sets.select(F.col("rep").alias("doc"), F.explode("keys").alias("key"))
    lists = scratch.save(posted.groupBy("key").agg(F.count("*").alias("len")).where("len > 1"), "lists")
    doc = Window.partitionBy("doc")
    # rank 1 is the longest list; a set in fewer than T shared lists agrees with none on T coordinates
    postings = posted.join(lists, "key").withColumn("rank", F.row_number().over(doc.orderBy(F.desc("len"), "key"))).withColumn("score", F.sum(F.log("len")).over(doc)).withColumn("shared", F.count("*").over(doc)).where(f"shared >= {T}")
    postings = scratch.save(postings.drop("shared"), "postings")
    scratch.drop_named("lists")
    eligible = scratch.save(postings.where("rank = 1").select(F.col("doc").alias("doc_id")), "eligible")
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = scratch.save(semi_join(source, eligible, "doc_id"), "texts")

    hubs = scratch.save(postings.groupBy("key").agg(F.max_by("doc", F.struct("score", F.negative("doc"))).alias("hub")), "hubs")
    met = postings.join(hubs, "key").where("doc <> hub").groupBy(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).agg(F.count("*").alias("c")).where(f"c >= {T}").select("a", "b")
    links = _confirmed(met, texts, p, scratch)
    classes = components(links, scratch)

    # from here on only pairs of different classes count
    lanes = sets.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), *(F.col("lanes")[i].alias(f"l{i}") for i in range(words)))
    prefix = postings.where(f"rank >= {T}").join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("class", F.coalesce("component", "doc"))
    prefix = scratch.save(prefix.join(lanes, "doc").select("doc", "n", "key", "len", "class", *(f"l{i}" for i in range(words))), "prefix")
    scratch.drop_named("postings", "hubs")
    scratch.release()
    short = prefix.where(f"len <= {p.long}")
    cond = F.expr(f"a.key = b.key and a.doc < b.doc and a.class <> b.class and 100 * least(a.n, b.n) >= {p.percent} * greatest(a.n, b.n)") & (_agreeing(words) >= p.agreeing)
    pairs = short.alias("a").join(short.alias("b"), cond).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()
    inside = scratch.save(prefix.where(f"len > {p.long}").select(F.col("doc").alias("doc_id"), "class", "n").distinct(), "inside")
    if inside.head(1):
        sizes = scratch.save(inside.groupBy("class").agg(F.count("*").alias("size")), "sizes")
        members = scratch.save(inside.join(sizes, "class").select("doc_id", "class", "size", "n"), "members")
        pairs = pairs.union(_long_list_pairs(members, texts, p, scratch)).distinct()
    more = _confirmed(scratch.save(pairs, "pairs"), texts, p, scratch)
    final = components(links.union(more), scratch) if more.head(1) else classes

    of_set = scratch.save(sets.join(final, F.col("rep") == F.col("node"), "left").select("set_hash", "set_check", F.coalesce("component", "rep").alias("own")), "of_set")
    out = signed.select("doc_id", "n_shingles", "set_hash", "set_check").join(of_set, ["set_hash", "set_check"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(False)).alias("kept"))


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1))


def _numbered(df: DataFrame, p: NearDuplicates, scratch: Scratch) -> tuple[DataFrame, DataFrame, str]:
    """(df with a number of its own for each row; (_row, id, n_shingles, component) of the rows with a doc_id, both written; the number's name in df)."""
    row = fresh(df, "_row")
    rows = scratch.save(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = rows.where("doc_id is not null")
    found = near_duplicates(known.select(F.col(row).alias("doc_id"), "text"), p, scratch, unique=True)
    ids = known.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("id"))
    found = found.select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("component")).join(ids, "_row")
    return rows, scratch.save(found, "judged"), row


def _by_row(df: DataFrame, signed: DataFrame, p: NearDuplicates, scratch: Scratch) -> DataFrame:
    """near_duplicates of rows that repeat a doc_id: links are sought between rows, components named by doc_id after that."""
    _, found, _ = _numbered(df.select("doc_id", "text"), p, scratch)
    names = found.groupBy("component").agg(F.min("id").alias("component_id"))
    out = found.join(names, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.union(signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(False)))


def without_duplicates(df: DataFrame, p: NearDuplicates = NearDuplicates(), scratch: Scratch | None = None) -> DataFrame:
    """df with one row of each component, that of the smallest doc_id; of rows that repeat a doc_id and a text one stays.

    Rows are told apart by place, so a doc_id that another row repeats doesn't matter.
    Rows without doc_id are linked with nothing.
    """
    scratch = scratch or Scratch(df.sparkSession, "near")
    rows, found, row = _numbered(df, p, scratch)
    # texts without words have no links: of those only full repeats go
    same = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("_row"))
    blank = semi_join(rows.select(F.col(row).alias("_row"), "doc_id", "text"), scratch.save(found.where("n_shingles = 0").select("_row"), "blank"), "_row").withColumn("nth", same).where("nth > 1").select("_row")
    # told by row and not by component, as a component may be large
    heads = scratch.save(found.groupBy("component").agg(F.min(F.struct("id", "_row")).alias("head")).select("head._row"), "heads")
    gone = found.join(heads, "_row", "left_anti").select("_row")
    gone = scratch.save(gone.union(blank), "gone")
    return rows.join(gone.withColumnRenamed("_row", row), row, "left_anti").select(*df.columns)
