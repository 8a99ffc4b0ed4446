"""Named tables, views kept by name, and secondary indexes over Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.index import Index


class UnknownTable(KeyError):
    pass


class Catalog:
    """Tables of one folder (``name.parquet`` each) and what is registered beside them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._indexes: dict[str, Index] = {}
        self._indexed: dict[str, str] = {}

    def register(self, name: str, frame: DataFrame) -> None:
        self._frames[name] = frame

    def table(self, name: str) -> DataFrame:
        if name in self._views:
            return self._views[name]
        if name not in self._frames:
            if self.folder is None:
                raise UnknownTable(name)
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    # materialized views: a query's result under a name
    def create_view(self, name: str, frame: DataFrame, path: str | None = None) -> DataFrame:
        """With a path the result is written there and read back; otherwise the
        plan is kept and run with each use."""
        if path:
            frame.write.mode("overwrite").parquet(path)
            frame = self.spark.read.parquet(path)
        self._views[name] = frame
        return frame

    def drop_view(self, name: str) -> None:
        self._views.pop(name, None)

    # secondary indexes
    def create_index(self, name: str, table: str, columns: Sequence[str], primary_key: str, unique: bool = False, path: str | None = None) -> Index:
        """With a path the index is stored there; otherwise it is derived with each use."""
        if name in self._indexes:
            raise ValueError(f"index {name} exists")
        index = Index(name, self.table(table), tuple(columns), primary_key, unique)
        if path:
            index = index.store(path)
        if unique:
            index.check_unique()
        self._indexes[name] = index
        self._indexed[name] = table
        return index

    def index_on(self, table: str, column: str) -> Index | None:
        """An index on that column alone."""
        return next((self._indexes[n] for n, t in self._indexed.items() if t == table and self._indexes[n].columns == (column,)), None)

    def maintain(self, table: str, after: DataFrame, path: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Puts the table's new state under its name and brings its stored indexes up
        to it, each under path."""
        self.register(table, after)
        for name in [n for n, t in self._indexed.items() if t == table]:
            index = self._indexes[name]
            if index.stored is not None:
                index = index.changed(after, f"{path}/{name}", inserted, deleted)
                if index.unique:
                    index.check_unique()
                self._indexes[name] = index
            else:
                self._indexes[name] = replace(index, table=after)

    def drop_index(self, name: str) -> None:
        if name not in self._indexes:
            raise KeyError(name)
        del self._indexes[name], self._indexed[name]

    def index(self, name: str) -> Index:
        return self._indexes[name]

    def list_indexes(self) -> list[str]:
        return sorted(self._indexes)
