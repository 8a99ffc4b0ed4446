"""Secondary indexes: projections (index key, primary key) and queries on them.

An index over several columns has a struct as its key, so its order is the order
of the tuples.  Rows that lack one of the columns are not indexed.

An index may be stored: entries in Parquet, in ranges of the key and sorted in
them, so that a key or range reads few row groups.  A stored index is maintained by
``changed``, which writes what inserted and deleted rows make of it; without a store
the entries are derived from the table with each use.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UniqueViolation(ValueError):
    pass


@dataclass(frozen=True)
class Index:
    name: str
    table: DataFrame
    columns: tuple[str, ...]
    primary_key: str
    unique: bool = False
    stored: DataFrame | None = None

    def entries(self) -> DataFrame:
        """(index_key, primary_key); index_key is a column or a struct of columns."""
        return self.stored if self.stored is not None else self._of(self.table)

    def store(self, path: str, entries: DataFrame | None = None) -> Index:
        """The index written to path; entries: what to write instead of the table's."""
        rows = self._of(self.table) if entries is None else entries
        rows.repartitionByRange("index_key", "primary_key").sortWithinPartitions("index_key", "primary_key").write.parquet(path)
        return replace(self, stored=self.table.sparkSession.read.parquet(path))

    def changed(self, table: DataFrame, path: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> Index:
        """The stored index after rows were inserted and deleted (whole rows, as in the
        table); table is the table after it.  An updated row is one of either."""
        entries = self.entries()
        if deleted is not None:
            gone = self._of(deleted)
            entries = entries.join(gone, (entries["index_key"] == gone["index_key"]) & (entries["primary_key"] == gone["primary_key"]), "left_anti")
        if inserted is not None:
            entries = entries.unionByName(self._of(inserted))
        return replace(self, table=table).store(path, entries)

    def _of(self, table: DataFrame) -> DataFrame:
        present = F.lit(True)
        for c in self.columns:
            present = present & F.col(c).isNotNull()
        key = F.col(self.columns[0]) if len(self.columns) == 1 else F.struct(*self.columns)
        return table.where(present).select(key.alias("index_key"), F.col(self.primary_key).alias("primary_key"))

    def _literal(self, value: Any) -> Column:
        if len(self.columns) == 1:
            return F.lit(value)
        return F.struct(*[F.lit(v).alias(c) for v, c in zip(value, self.columns, strict=True)])

    def key(self, value: Any) -> DataFrame:
        return self.entries().where(F.col("index_key") == self._literal(value))

    def range(self, start: Any = None, end: Any = None, limit: int | None = None) -> DataFrame:
        """start <= index_key < end, in order of (index_key, primary_key)."""
        out = self.entries()
        if start is not None:
            out = out.where(F.col("index_key") >= self._literal(start))
        if end is not None:
            out = out.where(F.col("index_key") < self._literal(end))
        if limit is not None:
            out = out.orderBy("index_key", "primary_key").limit(limit)
        return out

    def lookup(self, value: Any) -> DataFrame:
        """Rows of the table whose key is value: a filter that reaches the scan, or, with
        a stored index, the rows with the primary keys that it gives."""
        if self.stored is not None:
            hits = self.key(value).select(F.col("primary_key").alias(self.primary_key))
            return self.table.join(hits, self.primary_key, "left_semi")
        condition = F.lit(True)
        for c, v in zip(self.columns, (value,) if len(self.columns) == 1 else value, strict=True):
            condition = condition & (F.col(c) == F.lit(v))
        return self.table.where(condition)

    def violations(self) -> DataFrame:
        return self.entries().groupBy("index_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def check_unique(self) -> None:
        if not self.violations().isEmpty():
            raise UniqueViolation(self.name)


@dataclass(frozen=True)
class JoinQuery:
    """Joins two indexes on equal index keys.  Either side may be restricted to
    a key or a half-open range; without a restriction the whole index counts."""

    left: Index
    right: Index
    kind: str = "inner"
    left_key: Any = None
    right_key: Any = None
    left_range: tuple[Any, Any] | None = None
    right_range: tuple[Any, Any] | None = None
    limit: int | None = None

    def _side(self, index: Index, key: Any, bounds: tuple[Any, Any] | None) -> DataFrame:
        if key is not None:
            return index.key(key)
        return index.range(*bounds) if bounds is not None else index.entries()

    def execute(self) -> DataFrame:
        """(left_key, right_key, left_data, right_data); the unmatched side is NULL."""
        if self.kind not in ("inner", "left", "right", "full"):
            raise ValueError(f"unknown join {self.kind}")
        a = self._side(self.left, self.left_key, self.left_range).select(F.col("index_key").alias("left_key"), F.col("primary_key").alias("left_data"))
        b = self._side(self.right, self.right_key, self.right_range).select(F.col("index_key").alias("right_key"), F.col("primary_key").alias("right_data"))
        out = a.join(b, F.col("left_key") == F.col("right_key"), self.kind).select("left_key", "right_key", "left_data", "right_data")
        if self.limit is not None:
            out = out.orderBy(*[F.col(c).asc_nulls_last() for c in ("left_key", "right_key", "left_data", "right_data")]).limit(self.limit)
        return out


def multi_query(parts: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Results of several index queries as rows (alias, primary_key)."""
    out = None
    for alias, rows in parts.items():
        rows = rows.select(F.lit(alias).alias("alias"), "primary_key")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no queries")
    return out.orderBy("alias", "primary_key").limit(limit) if limit is not None else out
