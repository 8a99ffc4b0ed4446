"""Ordered key-value views over DataFrames with columns key and value.

Keys are strings or binary; both compare by unsigned bytes.  All scans are
[start, end) unless said otherwise, and None leaves an end open.  Nothing here
collects: a scan is a filter and a sort, a multi-get is a join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEY, MAX_VALUE = 4096, 1 << 20
MAX_BATCH, OP_OVERHEAD = 1 << 20, 16


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None: there is none."""
    stripped = prefix.rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None


@dataclass(frozen=True)
class NumberKey:
    """Keys made of a text prefix and a column of numbers from 0, padded to a fixed
    width that they fit, such as 'order:0000000042'.  Bounds on such keys are bounds on the column too, which
    a Parquet scan can use to skip row groups."""

    prefix: str
    column: str
    width: int

    def key(self) -> Column:
        return F.concat(F.lit(self.prefix), F.lpad(F.col(self.column).cast("string"), self.width, "0"))

    def _number(self, key: str | None) -> int | None:
        if key is None or not key.startswith(self.prefix):
            return None
        digits = key[len(self.prefix) :]
        return int(digits) if len(digits) == self.width and digits.isascii() and digits.isdigit() else None

    def bounds(self, start: str | None, end: str | None, include_end: bool = False) -> Column:
        """What a key in the range asks of the column; the key's own test still decides."""
        out, low, high = F.lit(True), self._number(start), self._number(end)
        if low is not None:
            out = out & (F.col(self.column) >= low)
        if high is not None:
            out = out & (F.col(self.column) <= high if include_end else F.col(self.column) < high)
        return out

    def prefix_bounds(self, prefix: str) -> Column:
        """What a key with the prefix asks of the column."""
        digits = prefix[len(self.prefix) :]
        if not prefix.startswith(self.prefix):
            return F.lit(self.prefix.startswith(prefix))
        if not (digits.isascii() and digits.isdigit()) or len(digits) > self.width:
            return F.lit(True)  # the key's own test decides
        rest = 10 ** (self.width - len(digits))
        return F.col(self.column).between(int(digits) * rest, (int(digits) + 1) * rest - 1)


@dataclass(frozen=True)
class NamedNumberKey:
    """Keys made of a text prefix, a text column, a separator and a column padded to a
    fixed width, such as 'cust:BUILDING:00000042'."""

    prefix: str
    name: str
    separator: str
    column: str
    width: int

    def key(self) -> Column:
        return F.concat(F.lit(self.prefix), F.col(self.name), F.lit(self.separator), F.lpad(F.col(self.column).cast("string"), self.width, "0"))

    def bounds(self, start: str | None, end: str | None, include_end: bool = False) -> Column:
        """Only bounds that are the beginning of a name are used: a key is no less than
        one if its name is not, or if the bound goes beyond its name at a separator."""
        out = F.lit(True)
        if start is not None and start.startswith(self.prefix) and self.separator not in (rest := start[len(self.prefix) :]):
            out = out & ((F.col(self.name) >= F.lit(rest)) | F.startswith(F.lit(rest), F.col(self.name)))
        if end is not None and end.startswith(self.prefix) and self.separator not in (rest := end[len(self.prefix) :]):
            out = out & (F.col(self.name) <= F.lit(rest))
        return out

    def prefix_bounds(self, prefix: str) -> Column:
        """A name that begins with the rest, or one that the rest goes beyond at a separator."""
        if not prefix.startswith(self.prefix):
            return F.lit(self.prefix.startswith(prefix))
        rest = prefix[len(self.prefix) :]
        out = F.col(self.name).startswith(rest)
        for i in range(len(rest)):
            if rest.startswith(self.separator, i):
                out = out | (F.col(self.name) == F.lit(rest[:i]))
        return out


@dataclass(frozen=True)
class KeyValue:
    """A key-value view; ``codec`` and ``rows`` allow bounds to reach the table."""

    frame: DataFrame
    codec: NumberKey | NamedNumberKey | None = None
    rows: DataFrame | None = None
    value: Column | None = None

    @classmethod
    def of(cls, rows: DataFrame, codec: NumberKey | NamedNumberKey, value: Column) -> KeyValue:
        return cls(rows.select(codec.key().alias("key"), value.alias("value")), codec, rows, value)

    def _bounded(self, start, end, include_end: bool = False) -> DataFrame:
        if self.codec is None or self.rows is None or self.value is None:
            return self.frame
        return self.rows.where(self.codec.bounds(start, end, include_end)).select(self.codec.key().alias("key"), self.value.alias("value"))

    def scan(self, start=None, end=None, reverse: bool = False, include_start: bool = True, include_end: bool = False, limit: int | None = None, ordered: bool = True) -> DataFrame:
        base = self._bounded(start, end, include_end)
        if start is not None:
            base = base.where(F.col("key") >= F.lit(start) if include_start else F.col("key") > F.lit(start))
        if end is not None:
            base = base.where(F.col("key") <= F.lit(end) if include_end else F.col("key") < F.lit(end))
        if ordered or limit is not None:
            base = base.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
        return base.limit(limit) if limit is not None else base

    def prefix(self, prefix, limit: int | None = None) -> DataFrame:
        """Keys that begin with prefix.  Bounds as well as the test itself, so
        that a stored key column is pruned."""
        raw = prefix.encode() if isinstance(prefix, str) else prefix
        end = successor(raw)
        base = self.frame
        if self.codec is not None and self.rows is not None and self.value is not None and isinstance(prefix, str):
            base = self.rows.where(self.codec.prefix_bounds(prefix)).select(self.codec.key().alias("key"), self.value.alias("value"))
        base = base.where(F.col("key") >= F.lit(prefix)).where(F.startswith(F.col("key"), F.lit(prefix)))
        if end is not None and not isinstance(prefix, str):
            base = base.where(F.col("key") < F.lit(end))
        base = base.orderBy("key")
        return base.limit(limit) if limit is not None else base

    def get(self, key) -> DataFrame:
        return self._bounded(key, key, include_end=True).where(F.col("key") == F.lit(key)).select("value")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """keys(ordinal, key) -> (ordinal, key, value), value NULL where missing."""
        return keys.join(self.frame, "key", "left").select("ordinal", "key", "value").orderBy("ordinal")

    def exists(self, keys: DataFrame) -> DataFrame:
        """keys(ordinal, key) -> (ordinal, key, found)."""
        found = self.frame.select("key").distinct().withColumn("found", F.lit(True))
        return keys.join(found, "key", "left").select("ordinal", "key", F.coalesce("found", F.lit(False)).alias("found"))

    def count(self, start=None, end=None) -> DataFrame:
        return self.scan(start, end, ordered=False).agg(F.count(F.lit(1)).alias("n"))

    def overlay(self, writes: DataFrame) -> DataFrame:
        """The view under a write set (seq, key, value, is_deleted): a key's last
        write hides what is stored."""
        last = last_writes(writes)
        kept = self.frame.join(last, "key", "left_anti").select("key", "value")
        return kept.unionByName(last.where("not is_deleted").select("key", "value"))

    def compare_and_swap(self, swaps: DataFrame) -> DataFrame:
        """swaps(key, expected, new), at most one per key; NULL stands for absent.
        Returns (key, swapped, value): the value afterwards, NULL for absent."""
        now = self.frame.select("key", F.col("value").alias("now"))
        ok = F.col("expected").eqNullSafe(F.col("now"))
        return swaps.join(now, "key", "left").select("key", ok.alias("swapped"), F.when(ok, F.col("new")).otherwise(F.col("now")).alias("value"))


@dataclass
class IteratorBuilder:
    """Step-by-step description of a scan, with a read time for versioned views."""

    start: object = None
    end: object = None
    backward: bool = False
    include_start: bool = True
    include_end: bool = False
    limit: int | None = None
    read_ts: int | None = None

    def with_(self, **changes) -> IteratorBuilder:
        return replace(self, **changes)

    def build(self, view: KeyValue) -> DataFrame:
        frame = view.frame
        if self.read_ts is not None:
            from siltstone.operators.versions import as_of

            frame = as_of(frame, ["key"], "ts", F.lit(self.read_ts), [F.col("seq").desc()]).select("key", "value")
            view = KeyValue(frame)
        return view.scan(self.start, self.end, self.backward, self.include_start, self.include_end, self.limit)


def last_writes(writes: DataFrame) -> DataFrame:
    """The last operation on each key of a batch (seq, key, value, is_deleted)."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "seq").alias("w"))
    return last.select("key", "w.value", "w.is_deleted")


def valid(writes: DataFrame) -> DataFrame:
    """writes with a column error: why an operation is refused, else NULL."""
    size = F.octet_length("key")
    return writes.withColumn(
        "error",
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty key")
        .when(size > MAX_KEY, "key too long")
        .when(~F.col("is_deleted") & (F.coalesce(F.octet_length("value"), F.lit(0)) > MAX_VALUE), "value too long"),
    )


def batch_size(writes: DataFrame) -> DataFrame:
    """Bytes of a batch with its overhead, and whether it is within the limit."""
    size = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + OP_OVERHEAD)
    return writes.agg(F.coalesce(size, F.lit(0)).alias("bytes")).select("bytes", (F.col("bytes") <= MAX_BATCH).alias("fits"))


def render(c: Column) -> Column:
    """Text of a binary, or hex: and its digits where it is not UTF-8."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.concat(F.lit("hex:"), F.lower(F.hex(c))))
