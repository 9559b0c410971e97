"""The change feed over a version log."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mvcc
from ..operators.txn import VersionStore


def incremental(versions: DataFrame, after_ts: int, up_to_ts: int, low: Any = None, high: Any = None) -> DataFrame:
    """(user_key, commit_ts, start_ts, op, value): each key's last PUT or DELETE with a commit in (after_ts, up_to_ts]."""
    return mvcc.latest(versions.where(F.col("commit_ts") > after_ts), up_to_ts, low, high)


def resolved_ts(versions: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """One row, resolved_ts: the smallest start of a lock less one, else the last commit (0 if there is none)."""
    last = versions.agg(F.coalesce(F.max("commit_ts"), F.lit(0)).alias("last"))
    if locks is None:
        return last.select(F.col("last").alias("resolved_ts"))
    # two aggregates of one row each
    first = locks.agg(F.min("start_ts").alias("first"))
    both = last.withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.coalesce(F.col("first") - 1, F.col("last")).alias("resolved_ts"))


def apply(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot with each key's last change laid on top."""
    return snapshot.join(changes.select("user_key"), "user_key", "left_anti").unionByName(changes.where("op = 'PUT'").select("user_key", "value"))


def feed(store: VersionStore, after_ts: int = 0, low: Any = None, high: Any = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of all version rows of a log, from its beginning on and as commits arrive.

    Catching up and following are one: the source reads each commit folder once, and the
    query's checkpoint remembers which.
    """
    spark = store.spark
    # the recursive listing sees commits that appear while the stream runs
    rows = spark.readStream.schema(mvcc.VERSIONS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(f"{store.path}/log")
    return mvcc.key_range(rows.where(F.col("commit_ts") > after_ts), low, high)


def subscribe(store: VersionStore, handle: Callable[[DataFrame, int], None], checkpoint: str, after_ts: int = 0, low: Any = None, high: Any = None, once: bool = False) -> StreamingQuery:
    """Calls handle(rows, batch) for each batch, exactly once for each checkpoint if handle is idempotent; once stops at what is there."""
    writer = feed(store, after_ts, low, high).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def materialize(store: VersionStore, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps the changes of the feed in folder as Parquet; latest state is mvcc.latest over it.

    The source reads each commit's folder once and the sink writes each batch once, so no
    change comes twice and no state is kept.
    """
    writer = feed(store).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
