"""An ordered table of raw keys and values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mvcc import key_range

SCHEMA = "key binary, value binary, expire_at timestamp"


def _bytes(x: bytes | str) -> bytearray:
    return bytearray(x.encode() if isinstance(x, str) else x)


class KeyValueTable:
    """Immutable: each write gives a new table over a lazy union and anti-join. Keys order as unsigned bytes.

    A value may expire: reads leave out what expired before now. That is checked on read,
    nothing is removed before compact().
    """

    def __init__(self, df: DataFrame):
        if "expire_at" not in df.columns:
            df = df.withColumn("expire_at", F.lit(None).cast("timestamp"))
        self.stored = df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "expire_at")

    @classmethod
    def empty(cls, spark: SparkSession) -> KeyValueTable:
        return cls(spark.createDataFrame([], SCHEMA))

    @property
    def df(self) -> DataFrame:
        """(key, value) of all live pairs."""
        return self.stored.where(F.col("expire_at").isNull() | (F.col("expire_at") > F.current_timestamp())).select("key", "value")

    # reads

    def get(self, key: bytes | str) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(_bytes(key)))

    def batch_get(self, keys: Iterable[bytes | str]) -> DataFrame:
        """The pairs that are there; keys that aren't are left out."""
        wanted = [F.lit(_bytes(k)) for k in keys]
        return self.df.where(F.col("key").isin(*wanted)) if wanted else self.df.limit(0)

    def scan(self, start: bytes | str | None = None, end: bytes | str | None = None, limit: int = 0, key_only: bool = False) -> DataFrame:
        """[start, end) going up; a limit of 0 or less is none."""
        df = key_range(self.df, None if start is None else bytes(_bytes(start)), None if end is None else bytes(_bytes(end)), "key").orderBy("key")
        return self._cut(df, limit, key_only)

    def reverse_scan(self, start: bytes | str | None = None, end: bytes | str | None = None, limit: int = 0, key_only: bool = False) -> DataFrame:
        """Going down from start, which is left out, to end, which is in."""
        df = key_range(self.df, None if end is None else bytes(_bytes(end)), None if start is None else bytes(_bytes(start)), "key").orderBy(F.desc("key"))
        return self._cut(df, limit, key_only)

    @staticmethod
    def _cut(df: DataFrame, limit: int, key_only: bool) -> DataFrame:
        df = df.limit(limit) if limit > 0 else df
        return df.select("key") if key_only else df

    # writes

    def merge(self, pairs: DataFrame, ttl_seconds: int | None = None) -> KeyValueTable:
        """Puts all (key, value) of a DataFrame with distinct keys: one join, however many pairs."""
        until = F.lit(None).cast("timestamp") if ttl_seconds is None else F.current_timestamp() + F.make_interval(secs=F.lit(ttl_seconds))
        new = pairs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), until.alias("expire_at"))
        return KeyValueTable(self.stored.join(new.select("key"), "key", "left_anti").select("key", "value", "expire_at").unionByName(new))

    def batch_put(self, pairs: dict[bytes | str, bytes | str], ttl_seconds: int | None = None) -> KeyValueTable:
        rows = [(_bytes(k), _bytes(v)) for k, v in pairs.items()]
        return self.merge(self.stored.sparkSession.createDataFrame(rows, "key binary, value binary"), ttl_seconds)

    def put(self, key: bytes | str, value: bytes | str, ttl_seconds: int | None = None) -> KeyValueTable:
        return self.batch_put({key: value}, ttl_seconds)

    def batch_delete(self, keys: Iterable[bytes | str]) -> KeyValueTable:
        gone = [F.lit(_bytes(k)) for k in keys]
        return KeyValueTable(self.stored.where(~F.col("key").isin(*gone))) if gone else self

    def delete(self, key: bytes | str) -> KeyValueTable:
        return self.batch_delete([key])

    def delete_range(self, start: bytes | str | None, end: bytes | str | None) -> KeyValueTable:
        """Without the keys in [start, end)."""
        test = F.lit(True)
        if start is not None:
            test = test & (F.col("key") >= F.lit(_bytes(start)))
        if end is not None:
            test = test & (F.col("key") < F.lit(_bytes(end)))
        return KeyValueTable(self.stored.where(~test))

    def compare_and_swap(self, key: bytes | str, expected: bytes | str | None, value: bytes | str) -> tuple[bool, bytes | None, KeyValueTable]:
        """(done, value before, table): puts value if the key holds expected; None expects that it is absent."""
        row = self.get(key).first()
        before = None if row is None else bytes(row["value"])
        same = before is None if expected is None else before == bytes(_bytes(expected))
        return same, before, self.put(key, value) if same else self

    def compact(self) -> KeyValueTable:
        """Written out: drops what has expired, and cuts the lineage of past writes."""
        from .scratch import stable

        return KeyValueTable(stable(self.stored.where(F.col("expire_at").isNull() | (F.col("expire_at") > F.current_timestamp())), "kv"))
