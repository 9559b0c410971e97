"""Files in the folder that driver and executors share, and atomic publication by rename."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local = _local or tempfile.TemporaryDirectory(prefix="brindle-core-")
        root = f"file://{_local.name}"
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/brindle-{what}-{uuid.uuid4().hex}"


class Files:
    """The file system of a path, by way of the driver's JVM; works for any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def rename(self, a: str, b: str) -> bool:
        """False if b is there already."""
        if self.exists(b):
            return False
        parent = self.path(b).getParent()
        self.fs.mkdirs(parent)
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def create(self, p: str) -> bool:
        """Makes an empty file; False if it is there already. As atomic as the file system's exclusive create."""
        try:
            self.fs.create(self.path(p), False).close()
            return True
        except Exception as e:
            if self.exists(p) or "exists" in str(e):
                return False
            raise

    def names(self, p: str) -> list[str]:
        """Names in a folder, but for hidden ones."""
        return [n for n in (f.getPath().getName() for f in self.fs.listStatus(self.path(p))) if n[0] not in "._"] if self.exists(p) else []

    def age_seconds(self, p: str) -> float:
        """0 if it isn't there."""
        try:
            return time.time() - self.fs.getFileStatus(self.path(p)).getModificationTime() / 1000
        except Exception:
            if self.exists(p):
                raise
            return 0.0

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))


def stable(df: DataFrame, what: str = "stable") -> DataFrame:
    """df written and read again: every later use sees the same rows."""
    spark = df.sparkSession
    path = f"{new_folder(spark, what)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, size: str, order: list[str], name: str = "running") -> DataFrame:
    """df with the sum of size over all rows up to each in order.

    Sorted by ranges: totals within ranges, plus one total for each range. No task sees more
    than its range, and a window without partitions only the ranges' totals.
    """
    by = [F.col(c) for c in order]
    ranged = stable(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum(size).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_within", F.sum(size).over(within)).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")
