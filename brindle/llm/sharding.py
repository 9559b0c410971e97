"""Shards by a keyed Feistel permutation over global row numbers. Built-in functions only.

Rows are numbered from 0 to n-1 in a reproducible order. The permutation acts on the
smallest domain of 2^b numbers that holds n, as Feistel rounds keyed by a seed over the
upper and the lower half of the bits; a result of n or more walks on through its cycle
until it is below n. The result p is the row's place in a shuffle of all rows that anyone
can compute: shard = p mod shards, slot = p div shards. So sizes of shards differ by one
row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch, number_rows

ROUNDS = 4


def domain_bits(rows: int) -> int:
    """Bits of the smallest domain that holds rows numbers; 2 at least."""
    return max(2, (rows - 1).bit_length())


def feistel(number: Column, bits: int, seed: int) -> Column:
    """A permutation of 0 .. 2^bits - 1: each round changes one half by a keyed hash of the other."""
    low = bits // 2
    masks = [(1 << (bits - low)) - 1, (1 << low) - 1]

    def one(halves: Column, k: Column) -> Column:
        hashed = lambda half: F.xxhash64(half, F.lit(seed).cast("long"), k)
        upper = halves["l"].bitwiseXOR(hashed(halves["r"]).bitwiseAND(F.lit(masks[0])))
        lower = halves["r"].bitwiseXOR(hashed(halves["l"]).bitwiseAND(F.lit(masks[1])))
        return F.when(k % 2 == 0, F.struct(upper.alias("l"), halves["r"].alias("r"))).otherwise(F.struct(halves["l"].alias("l"), lower.alias("r")))

    start = F.struct(F.shiftright(number, low).alias("l"), number.bitwiseAND(F.lit(masks[1])).alias("r"))
    return F.reduce(F.array(*map(F.lit, range(ROUNDS))), start, one, lambda h: F.shiftleft(h["l"], low).bitwiseOR(h["r"]))


def with_place(df: DataFrame, number: str, rows: int, seed: int, name: str = "place") -> DataFrame:
    """Adds a permutation of 0 .. rows - 1 of the column number.

    Less than half of the domain lies outside, so each step ends a walk with a chance over
    one half. Walks of 8 steps come first; the one in 256 that needs more gets 120 more. One
    in 10^36 would need still more; it raises an error, and another seed is due.
    """
    bits, n = domain_bits(rows), F.lit(rows).cast("long")

    def walk(at: Column, steps: int) -> Column:
        return F.reduce(F.sequence(F.lit(1), F.lit(steps)), at, lambda p, _: F.when(p < n, p).otherwise(feistel(p, bits, seed)))

    out = df.withColumn("_p", feistel(F.col(number), bits, seed)).withColumn("_p", walk(F.col("_p"), 8))
    out = out.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(walk(F.col("_p"), 120)))
    return out.withColumn(name, F.when(F.col("_p") < n, F.col("_p")).otherwise(F.raise_error(F.lit("a cycle walk is too long; take another seed")).cast("long"))).drop("_p")


def shuffled(df: DataFrame, order: list[str], seed: int, scratch: Scratch, name: str = "place") -> tuple[DataFrame, int]:
    """(df with each row's place in the keyed shuffle, number of rows)."""
    numbered, n = number_rows(df, order, scratch, "_row")
    return with_place(numbered, "_row", max(n, 1), seed, name).drop("_row"), n


def shard(df: DataFrame, shards: int = 16, seed: int = 2024, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (a null text has none); text_crc32 is of the same
    bytes. Rows are numbered by key, then text checksums; a null key comes first; rows equal
    in all of these are interchangeable. Other columns are ignored, an empty df gives no
    rows. The law is "rows": counts of shards differ by one at most; slots of a shard run
    from 0 without gaps. grown_shard is null, as this law keeps no row in place when a shard
    is added. A hot key or text is no burden, since places don't depend on them.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    scratch = scratch or Scratch(df.sparkSession, "shard")
    data = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(key), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("_hash"))
    out, _ = shuffled(rows, [key, "text_crc32", "size", "_hash"], seed, scratch)
    return out.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
