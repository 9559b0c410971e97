"""Tables with their keys and indexes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import RequestError


#: Columns that a versioned table has beside those of its rows: when a version was committed, and PUT or DELETE.
VERSION_COLUMNS = ("commit_ts", "op")


@dataclass
class Table:
    """handle is the column of the row key; a table without one is ordered by all its columns. stored has the indexes that are tables of their own."""

    name: str
    df: DataFrame
    handle: str | None = None
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    version: int = 0
    versioned: bool = False
    stored: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """The columns of a row; a versioned table has commit_ts and op besides."""
        return [c for c in self.df.columns if not (self.versioned and c in VERSION_COLUMNS)]

    @property
    def order(self) -> list[str]:
        return [self.handle] if self.handle else self.columns

    def rows(self, read_ts: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows, of a versioned table as of read_ts: each handle's newest version, by one partial aggregate.

        where must be about handles alone, so that it may come first.
        """
        df = self.df if where is None else self.df.where(where)
        if not self.versioned:
            if read_ts is not None:
                raise RequestError(f"{self.name} has no versions to read at a timestamp")
            return df
        df = df.where(F.col("op").isin("PUT", "DELETE"))
        if read_ts is not None:
            df = df.where(F.col("commit_ts") <= read_ts)
        rest = [c for c in self.columns if c != self.handle]
        newest = df.groupBy(self.handle).agg(F.max_by(F.struct("op", *rest), "commit_ts").alias("_v")).where("_v.op = 'PUT'")
        return newest.select(*(F.col(c) if c == self.handle else F.col(f"_v.`{c}`").alias(c) for c in self.columns))

    def index_columns(self, name: str) -> tuple[str, ...]:
        if name not in self.indexes:
            raise RequestError(f"no index {name} on {self.name}")
        return self.indexes[name]


class Catalog:
    """Named tables of a session. Tables on disk are opened when they are first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self._unopened: dict[str, tuple] = {}

    def register(self, name: str, df: DataFrame, handle: str | None = None, indexes: dict[str, tuple[str, ...]] | None = None) -> Table:
        if handle is not None and handle not in df.columns:
            raise RequestError(f"{name} has no column {handle}")
        if indexes and not handle:
            raise RequestError("an index needs a handle")
        self._unopened.pop(name, None)
        before = self.tables.get(name)
        self.tables[name] = Table(name, df, handle, dict(indexes or {}), before.version + 1 if before else 0)
        return self.tables[name]

    def register_versions(self, name: str, df: DataFrame, handle: str, indexes: dict[str, tuple[str, ...]] | None = None) -> Table:
        """A table of row versions: its rows' columns, commit_ts and op. Requests read it as of their read_ts, or its latest state."""
        if missing := [c for c in VERSION_COLUMNS if c not in df.columns]:
            raise RequestError(f"{name} has no column {missing[0]}")
        table = self.register(name, df, handle, indexes)
        table.versioned = True
        return table

    def read(self, name: str, path: str, handle: str | None = None, indexes: dict[str, tuple[str, ...]] | None = None) -> None:
        """A table of Parquet files."""
        self._unopened[name] = (path, handle, indexes)

    def __getitem__(self, name: str) -> Table:
        if name in self._unopened:
            path, handle, indexes = self._unopened[name]
            self.register(name, self.spark.read.parquet(path), handle, indexes)
        if name not in self.tables:
            raise RequestError(f"no table {name}")
        return self.tables[name]
