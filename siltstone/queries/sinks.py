"""Sinks and the store, written to the session's checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.operators import kv
from siltstone.queries.tables import KV_SQL, kv_orders, table, wal
from siltstone.queries.versions import _APPLIED
from siltstone.registry import register
from siltstone.session import checkpoint_dir
from siltstone.sources.wal import read_log, replay, write_log
from siltstone.store import Store
from siltstone.streaming import streams


def _place(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def wal_sink(spark, folder):
    """The log in segments with checksums, read again and replayed."""
    place = _place(spark, "wal")
    write_log(wal(spark, folder), place, segment_rows=5000)
    return replay(read_log(spark, place))


register("wal_sink", wal_sink, f"SELECT key, value FROM {_APPLIED.format('')} WHERE n = 1 AND NOT gone")


def sink_autobatch(spark, folder):
    """A stream written in micro-batches; what the files hold in the end."""
    place = _place(spark, "autobatch")
    stream = streams.read_events(spark, folder, "events.parquet")
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


register("sink_autobatch", sink_autobatch, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")


def store_load(spark, folder):
    """Orders loaded as a run, a second run that changes and removes some, compacted."""
    store = Store(spark, _place(spark, "store"))
    first = kv_orders(spark, folder).frame.withColumn("is_deleted", F.lit(False))
    store.load(first)
    number = F.substr("key", F.lit(7)).cast("long")
    store.load(first.where(number % 3 == 0).select("key", F.lit("changed").alias("value"), (number % 2 == 0).alias("is_deleted")))
    store.compact()
    return store.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_N = "substr(key, 7)::BIGINT"
register("store_load", store_load, f"SELECT key, CASE WHEN {_N} % 3 = 0 THEN 'changed' ELSE value END AS value FROM {KV_SQL} WHERE NOT ({_N} % 6 = 0)")
register(
    "s_utf8_or_hex",
    lambda s, d: table(s, d, "nation").select("n_nationkey", kv.render(F.when(F.col("n_nationkey") % 2 == 0, F.unhex(F.lit("C328"))).otherwise(F.encode("n_name", "UTF-8"))).alias("shown")),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'hex:c328' ELSE n_name END AS shown FROM nation",
)
