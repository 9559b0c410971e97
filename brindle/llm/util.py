"""Scratch tables in the shared folder, sized broadcasts, connected components, global row numbers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one long each up to which a set of ids may be broadcast (about 16 MB); above, joins shuffle.
BROADCAST_ROWS = 1_000_000

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: list[tuple[SparkSession, str]] = []
_local = None
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="brindle-code-")
    with zipfile.ZipFile(path := f"{folder}/brindle.zip", "w") as z:
        for d, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(f"{d}/{name}", os.path.relpath(f"{d}/{name}", os.path.dirname(top)))
    sc.addPyFile(path)
    # Arrow batches of 64 MB, in the JVM and again in Python, are too much for small executors
    if spark.conf.get(BATCH_BYTES, None) in (None, "67108864b", "64m"):
        spark.conf.set(BATCH_BYTES, "8m")
    _shipped.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one of this process in local mode only."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local = _local or tempfile.TemporaryDirectory(prefix="brindle-")
        root = f"file://{_local.name}"
    return root.rstrip("/")


class Scratch:
    """Names of written tables of one run; they go when the process ends, or by drop()."""

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark = spark
        self.path = f"{scratch_root(spark)}/brindle-{what}-{uuid.uuid4().hex}"
        self.n = 0
        self.last: dict[str, str] = {}
        _made.append((spark, self.path))

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and reads it again: cuts the lineage, survives lost executors, and has a known size."""
        return self.spark.read.schema(df.schema).parquet(self.write(df, name))

    def write(self, df: DataFrame, name: str = "t") -> str:
        self.n += 1
        path = self.last[name] = f"{self.path}/{self.n}-{name}"
        # texts are worth the stronger codec; each of its streams takes native memory, beside the heap
        df.write.option("compression", "zstd" if "text" in df.columns else "snappy").parquet(path)
        return path

    def drop(self, name_or_path: str) -> None:
        _delete(self.spark, name_or_path if "/" in name_or_path else f"{self.path}/{name_or_path}")

    def drop_named(self, *names: str) -> None:
        """Deletes the tables saved last under these names; nothing may read them any more."""
        for name in names:
            if name in self.last:
                self.drop(self.last.pop(name))

    def release(self) -> None:
        """Lets executors delete the shuffle files of jobs that have ended: Spark does so when the driver's JVM collects their handles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While it lasts, jobs hand Python at most rows rows at a time: for rows that hold whole texts twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:
            return  # the session has ended; its folder is the cluster's to clear


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def semi_join(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of big whose key is in ids (a saved table of distinct keys): by broadcast if they are few, else shuffled."""
    few = ids.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes of edges (a, b: long) but each component's smallest, which is its name.

    Alternates large-star and small-star (Kiveris et al., 2014) until all are stars. Each
    round is written; hubs with very many neighbours are handled by partial minima and by
    joins that Spark may split.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if not e.head(1):
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last: list[str] = []
    while True:
        both = e.union(e.select("v", "u"))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.save(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = scratch.save(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for path in last:
            scratch.drop(path)
        last = [f"{scratch.n - i}-{name}" for i, name in ((3, "least"), (2, "large"), (1, "least"), (0, "edges"))]
        # done when every node has one edge, to a node that has none: each round keeps components together
        if not e.groupBy("u").count().where("count > 1").head(1) and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").head(1):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def number_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str = "row") -> tuple[DataFrame, int]:
    """(df with the global number of each row, from 0 without gaps, in the order of the columns given; number of rows).

    Nulls come first. Sorts by ranges; a number is a row's place in its range plus the rows
    of all ranges before. Rows equal in all of order are interchangeable, and ranges may cut
    between them. Only one count for each range is ever put into one task.
    """
    by = [*(F.col(c) for c in order), F.col("_tie")]
    ranged = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    # the id is the range's number, times 2^33, plus the row's place in it; written, it stays as it is
    ranged = scratch.save(ranged.withColumn("_id", F.monotonically_increasing_id()).drop("_tie"), "ranged").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each range (thousands at most), so it is broadcast
    out = ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_part", "_id", "_before"), ranged.count()
