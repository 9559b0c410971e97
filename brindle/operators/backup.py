"""Backup of a snapshot to a folder, and restore that verifies it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .scratch import Files
from .stats import checksum


class BackupDamaged(RuntimeError):
    """What was read isn't what the manifest says was written."""


def backup(snapshot: DataFrame, folder: str, key: str = "key", value: str = "value", read_ts: int | None = None) -> dict:
    """Writes the pairs as Parquet, then a manifest with counts and a checksum; without a manifest there is no backup.

    Each backup has a folder of its own, named by its manifest; manifests are numbered, and
    the last one counts. What an earlier one names goes only when the new one is there.
    """
    spark, files = snapshot.sparkSession, Files(snapshot.sparkSession, folder)
    before = sorted(files.names(folder))
    last = max((int(n.split("-")[1]) for n in before if n.startswith("manifest-")), default=0)
    name = f"data-{uuid.uuid4().hex}"
    snapshot.write.parquet(f"{folder}/{name}")
    written = spark.read.schema(snapshot.schema).parquet(f"{folder}/{name}")
    manifest = checksum(written, key, value).first().asDict() | {"key": key, "value": value, "read_ts": read_ts, "schema": snapshot.schema.json(), "data": name}
    staging = f"{folder}/_{name}"
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(staging)
    files.rename(staging, f"{folder}/manifest-{last + 1:09d}")
    for n in before:
        files.delete(f"{folder}/{n}")
    return manifest


def _manifest(spark: SparkSession, folder: str) -> dict:
    found = sorted(n for n in Files(spark, folder).names(folder) if n.startswith("manifest-"))
    if not found:
        raise BackupDamaged("there is no manifest")
    return json.loads(spark.read.text(f"{folder}/{found[-1]}").first()[0])


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of a backup, after its counts and checksum are found right."""
    from pyspark.sql.types import StructType

    manifest = _manifest(spark, folder)
    data = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(f"{folder}/{manifest['data']}")
    found = checksum(data, manifest["key"], manifest["value"]).first().asDict()
    if any(found[k] != manifest[k] for k in found):
        raise BackupDamaged(f"{found} for {manifest}")
    return data
