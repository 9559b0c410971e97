"""Versioned tables: snapshots, history, garbage collection, locks.

versions: user_key, commit_ts, start_ts, op (PUT, DELETE, ROLLBACK, LOCK), value.
locks: user_key, type (PUT, DELETE, LOCK, PESSIMISTIC), start_ts, ttl_ms, and what else a
transaction notes.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = ("PUT", "DELETE")
LOGICAL_BITS = 18


class KeyLocked(RuntimeError):
    """A read met locks that may still commit before its timestamp."""

    def __init__(self, keys: list[Any]):
        super().__init__(f"{len(keys)} keys or more are locked")
        self.keys = keys


def physical_ms(ts: Column) -> Column:
    """Milliseconds of a hybrid timestamp."""
    return F.shiftright(ts, LOGICAL_BITS)


def key_range(df: DataFrame, low: Any = None, high: Any = None, key: str = "user_key") -> DataFrame:
    """Keys in [low, high); None is open."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(bytearray(low) if isinstance(low, bytes) else low))
    if high is not None:
        df = df.where(F.col(key) < F.lit(bytearray(high) if isinstance(high, bytes) else high))
    return df


def blocking(locks: DataFrame, read_ts: int) -> DataFrame:
    """Locks that a read at read_ts must wait for."""
    return locks.where(F.col("type").isin(*CONTENT) & (F.col("start_ts") <= read_ts))


def check_locks(locks: DataFrame, read_ts: int, low: Any = None, high: Any = None, most: int = 100) -> None:
    """Raises KeyLocked, with up to most keys, if the range holds a blocking lock."""
    found = key_range(blocking(locks, read_ts), low, high).orderBy("user_key").limit(most).select("user_key").collect()
    if found:
        raise KeyLocked([r[0] for r in found])


def latest(versions: DataFrame, read_ts: int | None = None, low: Any = None, high: Any = None) -> DataFrame:
    """(user_key, commit_ts, start_ts, op, value): each key's newest PUT or DELETE at read_ts. One partial aggregate."""
    df = key_range(versions.where(F.col("op").isin(*CONTENT)), low, high)
    if read_ts is not None:
        df = df.where(F.col("commit_ts") <= read_ts)
    newest = df.groupBy("user_key").agg(F.max_by(F.struct("commit_ts", "start_ts", "op", "value"), "commit_ts").alias("w"))
    return newest.select("user_key", "w.*")


def snapshot(versions: DataFrame, read_ts: int, locks: DataFrame | None = None, low: Any = None, high: Any = None) -> DataFrame:
    """(user_key, value) as of read_ts. With locks, a blocking one in the range raises KeyLocked, first inserts included."""
    if locks is not None:
        check_locks(locks, read_ts, low, high)
    return latest(versions, read_ts, low, high).where("op = 'PUT'").select("user_key", "value")


def get(versions: DataFrame, key: Any, read_ts: int, locks: DataFrame | None = None) -> DataFrame:
    """(user_key, value) of one key as of read_ts; empty if absent."""
    return batch_get(versions, [key], read_ts, locks)


def batch_get(versions: DataFrame, keys: list[Any], read_ts: int, locks: DataFrame | None = None) -> DataFrame:
    """(user_key, value) of the keys that are there as of read_ts."""
    literals = [F.lit(bytearray(k) if isinstance(k, bytes) else k) for k in keys]
    one = lambda df: df.where(F.col("user_key").isin(*literals)) if literals else df.limit(0)
    return snapshot(one(versions), read_ts, None if locks is None else one(locks))


def scan(versions: DataFrame, read_ts: int, low: Any = None, high: Any = None, limit: int | None = None, reverse: bool = False, locks: DataFrame | None = None, key_only: bool = False) -> DataFrame:
    """The snapshot in key order, or from the end; [low, high) either way."""
    df = snapshot(versions, read_ts, locks, low, high)
    df = df.orderBy(F.col("user_key").desc() if reverse else F.col("user_key").asc())
    if limit is not None and limit > 0:
        df = df.limit(limit)
    return df.select("user_key") if key_only else df


def history(versions: DataFrame, key: Any = None, start_ts: int | None = None) -> DataFrame:
    """All versions of a key, or of a transaction, newest first."""
    df = versions
    if key is not None:
        df = df.where(F.col("user_key") == F.lit(bytearray(key) if isinstance(key, bytes) else key))
    if start_ts is not None:
        df = df.where(F.col("start_ts") == start_ts)
    return df.orderBy("user_key", F.desc("commit_ts"))


def collect_garbage(versions: DataFrame, safe_point: int) -> DataFrame:
    """The versions that a collection up to safe_point leaves.

    Everything above the safe point stays, and of each key its newest PUT or DELETE up to it
    (a DELETE as well); older ones, and rollbacks and locks up to it, go. Safe point 0 is
    refused.
    """
    if safe_point <= 0:
        raise ValueError("the safe point must be above 0")
    below = versions.where((F.col("commit_ts") <= safe_point) & F.col("op").isin(*CONTENT))
    # times alone are aggregated, in part before the shuffle, and versions met by key and time, so a hot key is no burden
    newest = below.groupBy("user_key").agg(F.max("commit_ts").alias("commit_ts"))
    return versions.where(F.col("commit_ts") > safe_point).unionByName(below.join(newest, ["user_key", "commit_ts"], "left_semi").select(*versions.columns))


def delete_range(versions: DataFrame, low: Any, high: Any) -> DataFrame:
    """versions without any of the keys in [low, high); an end is required."""
    if high is None:
        raise ValueError("delete_range needs an end")
    low = F.lit(bytearray(low) if isinstance(low, bytes) else low) if low is not None else None
    test = F.col("user_key") < F.lit(bytearray(high) if isinstance(high, bytes) else high)
    return versions.where(~(test if low is None else test & (F.col("user_key") >= low)))


class SafePoint:
    """The garbage collector's safe point: an operator's floor or ten minutes ago, held back by live services."""

    DELAY_MS = 10 * 60 * 1000

    def __init__(self):
        self.current, self.floor, self.services = 0, None, {}

    def set_service(self, name: str, ts: int, ttl_ms: int, now_ms: int) -> int:
        """A service's claim; ttl 0 or less withdraws it."""
        if ttl_ms <= 0:
            self.services.pop(name, None)
        else:
            self.services[name] = (ts, now_ms + ttl_ms)
        return self.get(now_ms)

    def get(self, now_ms: int) -> int:
        self.services = {k: v for k, v in self.services.items() if v[1] > now_ms}
        base = self.floor if self.floor is not None else max(0, now_ms - self.DELAY_MS) << LOGICAL_BITS
        self.current = max(self.current, min([base, *(ts for ts, _ in self.services.values())]))
        return self.current


def empty_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VERSIONS)


VERSIONS = "user_key binary, commit_ts long, start_ts long, op string, value binary"
