"""A key-value store on Parquet runs: the programmatic surface in one class.

Every write is a batch that is appended as one run of versions (key, value, seq,
ts, tx_id, is_deleted); reads take the newest version.  Batches are what Spark
is good at: single puts work but cost a job each.  One writer is assumed; runs
are named by their first sequence number, so a batch that is written again
replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.kv import MAX_BATCH, MAX_KEY, MAX_VALUE, OP_OVERHEAD, KeyValue
from siltstone.operators.versions import compact, latest

SCHEMA = "key binary, value binary, seq long, ts long, tx_id long, is_deleted boolean"


class Conflict(RuntimeError):
    """Another transaction has committed a key since this one began."""


class Refused(ValueError):
    """A key or value is empty or too long, or a batch too large."""


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


@dataclass
class WriteBatch:
    """Operations in order; the last one on a key wins."""

    ops: list[tuple[bytes, bytes | None]] = field(default_factory=list)
    size: int = 0

    def put(self, key, value) -> WriteBatch:
        key, value = _bytes(key), _bytes(value)
        if not key or len(key) > MAX_KEY or len(value) > MAX_VALUE:
            raise Refused("key or value out of bounds")
        return self._add(key, value)

    def delete(self, key) -> WriteBatch:
        return self._add(_bytes(key), None)

    def _add(self, key: bytes, value: bytes | None) -> WriteBatch:
        size = len(key) + len(value or b"") + OP_OVERHEAD
        if self.size + size > MAX_BATCH:
            raise Refused("batch too large")
        self.ops.append((key, value))
        self.size += size
        return self


@dataclass
class Transaction:
    tx_id: int
    read_seq: int
    writes: dict[bytes, bytes | None] = field(default_factory=dict)
    state: str = "active"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._transactions: dict[int, Transaction] = {}
        self._runs: list[str] = self._found()
        last = self.versions().agg(F.max("seq"), F.max("tx_id")).first()
        self._seq, self._tx = (last[0] or 0) + 1, (last[1] or 0) + 1

    def _found(self) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = place.getFileSystem(conf)
        return sorted(x.getPath().toString() for x in fs.listStatus(place) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) if fs.exists(place) else []

    # --- reading
    def versions(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*self._runs) if self._runs else self.spark.createDataFrame([], SCHEMA)

    def view(self, at: int | None = None) -> KeyValue:
        """The newest versions, or those that stood at a sequence number."""
        rows = self.versions() if at is None else self.versions().where(F.col("seq") <= at)
        return KeyValue(latest(rows, ["key"], ["seq"]).select("key", "value"))

    def get(self, key) -> bytes | None:
        row = latest(self.versions().where(F.col("key") == F.lit(bytearray(_bytes(key)))), ["key"], ["seq"]).first()
        return bytes(row["value"]) if row else None

    def exists(self, key) -> bool:
        return self.get(key) is not None

    contains_key = exists

    def get_batch(self, keys: Iterable) -> list[bytes | None]:
        """Values in the order of the keys; missing ones are None."""
        asked = self.spark.createDataFrame([(i, bytearray(_bytes(k))) for i, k in enumerate(keys)], "ordinal int, key binary")
        return [None if r["value"] is None else bytes(r["value"]) for r in self.view().multi_get(asked).collect()]

    def scan(self, start=None, end=None, **options) -> DataFrame:
        bound = lambda x: None if x is None else bytearray(_bytes(x))
        return self.view().scan(bound(start), bound(end), **options)

    range = scan

    def scan_reverse(self, start=None, end=None) -> DataFrame:
        return self.scan(start, end, reverse=True)

    def scan_prefix(self, prefix) -> DataFrame:
        return self.view().prefix(bytearray(_bytes(prefix)))

    def keys_with_prefix(self, prefix) -> DataFrame:
        return self.scan_prefix(prefix).select("key")

    # --- writing
    def load(self, rows: DataFrame, tx_id: int = 0) -> None:
        """Appends a table (key, value, is_deleted) of any size as one run.  Keys
        must not repeat in it: their order would not be defined."""
        out = rows.select(F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(self._seq).cast("long").alias("seq"), F.lit(self._seq).cast("long").alias("ts"), F.lit(tx_id).cast("long").alias("tx_id"), "is_deleted")
        self._append(out, 1)

    def _append(self, rows: DataFrame, n: int) -> None:
        run = f"{self.path}/runs/{self._seq:020d}"
        rows.write.mode("overwrite").parquet(run)
        self._runs.append(run)
        self._seq += n

    def write_batch(self, batch: WriteBatch, tx_id: int = 0) -> None:
        if batch.ops:
            rows = [(bytearray(k), None if v is None else bytearray(v), self._seq + i, self._seq + i, tx_id, v is None) for i, (k, v) in enumerate(batch.ops)]
            self._append(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), len(rows))

    def put(self, key, value) -> None:
        self.write_batch(WriteBatch().put(key, value))

    def put_batch(self, pairs: Iterable[tuple]) -> None:
        batch = WriteBatch()
        for k, v in pairs:
            batch.put(k, v)
        self.write_batch(batch)

    def delete(self, key) -> bool:
        """Whether the key was there."""
        found = self.exists(key)
        self.write_batch(WriteBatch().delete(key))
        return found

    def delete_batch(self, keys: Iterable) -> None:
        batch = WriteBatch()
        for k in keys:
            batch.delete(k)
        self.write_batch(batch)

    def compare_and_swap(self, key, expected, new) -> bool:
        """None stands for absent on either side."""
        if self.get(key) != (None if expected is None else _bytes(expected)):
            return False
        self.write_batch(WriteBatch().delete(key) if new is None else WriteBatch().put(key, new))
        return True

    # --- transactions: the first to commit a key wins
    def begin(self) -> int:
        tx = Transaction(self._tx, self._seq - 1)
        self._transactions[tx.tx_id] = tx
        self._tx += 1
        return tx.tx_id

    def _active(self, tx_id: int) -> Transaction:
        tx = self._transactions.get(tx_id)
        if tx is None or tx.state != "active":
            raise KeyError(f"no active transaction {tx_id}")
        return tx

    def put_tx(self, tx_id: int, key, value) -> None:
        batch = WriteBatch().put(key, value)
        self._active(tx_id).writes.update(batch.ops)

    def delete_tx(self, tx_id: int, key) -> None:
        self._active(tx_id).writes[_bytes(key)] = None

    def get_tx(self, tx_id: int, key) -> bytes | None:
        """Its own write, or what stood when it began."""
        tx = self._active(tx_id)
        if _bytes(key) in tx.writes:
            return tx.writes[_bytes(key)]
        row = self.view(tx.read_seq).get(bytearray(_bytes(key))).first()
        return bytes(row["value"]) if row else None

    def commit(self, tx_id: int) -> None:
        tx = self._active(tx_id)
        keys = self.spark.createDataFrame([(bytearray(k),) for k in tx.writes], "key binary")
        if tx.writes and not self.versions().where(F.col("seq") > tx.read_seq).join(F.broadcast(keys), "key", "left_semi").isEmpty():
            tx.state = "aborted"
            raise Conflict(f"transaction {tx_id}")
        self.write_batch(WriteBatch(list(tx.writes.items())), tx_id)
        tx.state = "committed"

    def abort(self, tx_id: int) -> None:
        self._active(tx_id).state = "aborted"

    def active_transactions(self) -> list[int]:
        return [t.tx_id for t in self._transactions.values() if t.state == "active"]

    # --- care
    def compact(self) -> None:
        """All runs as one sorted run; older versions and deletions go."""
        rows = compact(self.versions(), ["key"], ["seq"]).sort("key")
        run = f"{self.path}/runs/{self._seq:020d}"
        rows.write.mode("overwrite").parquet(run)
        jvm, conf, old = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), self._runs
        self._runs = [run]
        for x in old:
            place = jvm.org.apache.hadoop.fs.Path(x)
            place.getFileSystem(conf).delete(place, True)

    def backup(self, path: str, since: int = 0) -> None:
        """All versions, or those after a sequence number."""
        self.versions().where(F.col("seq") > since).write.mode("overwrite").parquet(path)

    def restore(self, path: str, until: int | None = None) -> None:
        """Adds a backup's versions, up to a sequence number, to an empty store."""
        rows = self.spark.read.schema(SCHEMA).parquet(path)
        rows = rows if until is None else rows.where(F.col("seq") <= until)
        top = rows.agg(F.max("seq"), F.max("tx_id")).first()
        self._append(rows, 0)
        self._seq, self._tx = (top[0] or 0) + 1, max(self._tx, (top[1] or 0) + 1)

    def verify(self) -> bool:
        """Whether every sequence number stands for one version of a key."""
        return self.versions().groupBy("key", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def stats(self) -> dict[str, int]:
        n = self.versions().agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_deleted").alias("deletions"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes")).first()
        return n.asDict() | {"runs": len(self._runs), "live": self.view().frame.count()}

    def sync(self) -> None:
        """Runs are durable when a write returns."""

    checkpoint = flush = sync


class AsyncStore:
    """The same calls as futures; Spark runs the jobs of several threads at once."""

    def __init__(self, store: Store, threads: int = 8):
        self.store = store
        self._pool = ThreadPoolExecutor(threads)

    def submit(self, call: Callable, *args) -> Future:
        return self._pool.submit(call, *args)

    def concurrent_gets(self, keys: Iterable) -> list[bytes | None]:
        return [f.result() for f in [self.submit(self.store.get, k) for k in keys]]

    def pipeline(self, *calls: tuple) -> list:
        """(method name, *arguments) in order, each after the one before."""
        return self.submit(lambda: [getattr(self.store, name)(*args) for name, *args in calls]).result()

    def close(self) -> None:
        self._pool.shutdown()
