"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def sample(df: DataFrame, labels: DataFrame, label: str, rows: int, zeros: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most rows labelled documents of class 1 and zeros (or rows) of class 0, taken in the order of a hash of the key.

    labels has (key, label 0 or 1); a key with contradictory labels counts as 1, null labels
    and keys are left out. The sample's keys are at most rows + zeros, so they are broadcast.
    """
    y = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = y.where("y = 1").orderBy(*order).limit(rows).union(y.where("y = 0").orderBy(*order).limit(rows if zeros is None else zeros))
    source = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return source.join(F.broadcast(chosen), "_key").select("text", "y")
