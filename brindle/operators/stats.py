"""Column statistics, range checksums, split points."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import of_column, to_str
from .mvcc import check_locks
from .scratch import running_total


def analyze(df: DataFrame, columns: list[str], ndv_cap: int | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column: column_name, total_count, null_count, ndv, min_value, max_value (as text). One pass over df.

    Distinct values are counted exactly, or as a sketch if approximate; ndv_cap bounds what
    is reported.
    """
    out = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        text = to_str(of_column(F.col(f"`{c}`"), df.schema[c].dataType))
        ndv = F.approx_count_distinct(text) if approximate else F.count_distinct(text)
        typed = of_column(F.col(f"`{c}`"), df.schema[c].dataType)
        shown = lambda x, t=typed: to_str(type(t)(x, t.kind))
        out += [F.count(f"`{c}`").alias(f"f{i}"), ndv.alias(f"d{i}"), shown(F.min(typed.col)).alias(f"l{i}"), shown(F.max(typed.col)).alias(f"h{i}")]
    row = df.agg(*out)
    cap = (lambda x: F.least(x, F.lit(ndv_cap))) if ndv_cap is not None else (lambda x: x)
    each = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total_count"), (F.col("n") - F.col(f"f{i}")).alias("null_count"), cap(F.col(f"d{i}")).alias("ndv"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*each)))


def sample(df: DataFrame, column: str, key: str, size: int = 10_000, seed: int = 0) -> DataFrame:
    """A reproducible uniform sample of a column's values, without nulls, in order: the size smallest keyed hashes."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))
    return some.orderBy("_h").limit(size).select("value").orderBy("value")


def approximate_size(df: DataFrame) -> int:
    """Bytes of df, as the optimizer estimates them from the files it reads; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checksum(df: DataFrame, key: str = "key", value: str = "value", locks: DataFrame | None = None, read_ts: int | None = None) -> DataFrame:
    """One row: checksum, total_kvs, total_bytes. With locks, one that may still commit by read_ts raises KeyLocked.

    The checksum is the exclusive-or of each pair's crc32 over key and value, so parts of a
    range can be summed up on their own and in any order.
    """
    if locks is not None:
        check_locks(locks, 2**63 - 1 if read_ts is None else read_ts)
    k, v = F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    return df.agg(
        F.coalesce(F.bit_xor(F.crc32(F.concat(k, v))), F.lit(0)).cast("bigint").alias("checksum"),
        F.count("*").alias("total_kvs"),
        F.coalesce(F.sum(F.octet_length(k) + F.octet_length(v)), F.lit(0)).cast("bigint").alias("total_bytes"),
    )


def stream_checksum(df: DataFrame, key: str = "key", value: str = "value") -> int:
    """crc32 of all pairs one after another in key order, on the driver: for small ranges that must match a stream's."""
    crc = 0
    for r in df.orderBy(key).select(F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))).toLocalIterator():
        crc = zlib.crc32(bytes(r[1]), zlib.crc32(bytes(r[0]), crc))
    return crc


def split_keys(df: DataFrame, parts: int, key: str = "key", size: str = "size") -> DataFrame:
    """(split_no, key): up to parts - 1 keys that cut the keys of df into parts of about the same bytes.

    Part i ends at the first key up to which the bytes reach i times the total divided by
    parts. A key is given once, and neither the first key nor an empty range is cut.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    chunk = int(total) // parts if parts > 1 else 0
    if chunk <= 0:
        return df.select(F.lit(0).cast("bigint").alias("split_no"), key).limit(0)
    run = running_total(df.select(key, size), size, [key])
    bucket = F.least(F.expr(f"running div {chunk}"), F.lit(parts - 1))
    reached = run.withColumn("_b", bucket).withColumn("_was", F.least(F.expr(f"(running - {size}) div {chunk}"), F.lit(parts - 1)))
    crossed = reached.where("_b > _was and _b >= 1")
    first = df.agg(F.min(key)).first()[0]
    return crossed.where(F.col(key) != F.lit(first)).groupBy(key).agg(F.max("_b").cast("bigint").alias("split_no")).select("split_no", key)
