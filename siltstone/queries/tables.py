"""Tables of a folder and the key-value, version and log tables made from them.

Each has its SQL twin, used in the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.kv import KeyValue, NamedNumberKey, NumberKey
from siltstone.plans.builder import Builder
from siltstone.plans.spec import QuerySpec
from siltstone.sources.catalog import Catalog


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def compiled(spec: QuerySpec):
    """A query function that builds a specification over a folder."""
    return lambda spark, folder: Builder(Catalog(spark, folder)).build(spec)


ORDER_KEY = NumberKey("order:", "o_orderkey", 10)
KV_SQL = "(SELECT 'order:' || lpad(o_orderkey::VARCHAR, 10, '0') AS key, o_orderstatus || ':' || o_orderpriority AS value FROM orders)"


def kv_orders(spark: SparkSession, folder: str) -> KeyValue:
    return KeyValue.of(table(spark, folder, "orders"), ORDER_KEY, F.concat_ws(":", "o_orderstatus", "o_orderpriority"))


SEG_KEY = NamedNumberKey("cust:", "c_mktsegment", ":", "c_custkey", 8)
SEG_SQL = "(SELECT 'cust:' || c_mktsegment || ':' || lpad(c_custkey::VARCHAR, 8, '0') AS key, c_name AS value FROM customer)"


def kv_segments(spark: SparkSession, folder: str) -> KeyValue:
    return KeyValue.of(table(spark, folder, "customer"), SEG_KEY, F.col("c_name"))


#: Versions of (l_orderkey, l_linenumber); the tie-break makes the order total up to equal rows.
VERSION_ORDER = ["ts", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
VERSIONS_SQL = "(SELECT *, l_shipdate AS ts, l_returnflag = 'R' AS is_deleted FROM lineitem)"
VERSION_DESC = ", ".join(f"{c} DESC" for c in VERSION_ORDER)
VERSION_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ts"]


def line_versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("ts", F.col("l_shipdate")).withColumn("is_deleted", F.col("l_returnflag") == "R")


#: A log: ten events a transaction, every seventh of which does not commit.
WAL_SQL = """(SELECT event_id AS lsn, ts, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Put' END AS op, user_id::VARCHAR AS key,
  event_type || ':' || value::VARCHAR AS value, event_id // 10 AS tx_id, (event_id // 10) % 7 <> 0 AS committed FROM events)"""


def wal_ops(spark: SparkSession, folder: str) -> DataFrame:
    tx = F.floor(F.col("event_id") / 10).cast("long")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("lsn"), "ts", F.when(F.col("event_type") == "error", "Delete").otherwise("Put").alias("op"),
        F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), tx.alias("tx_id"),
    )


def wal(spark: SparkSession, folder: str) -> DataFrame:
    """The operations with a commit entry after each committed transaction."""
    ops = wal_ops(spark, folder).select(F.col("lsn") * 2, "ts", "op", "key", F.col("kind").alias("value"), "tx_id").toDF("lsn", "ts", "op", "key", "value", "tx_id")
    commits = ops.where("tx_id % 7 <> 0").groupBy("tx_id").agg((F.max("lsn") + 1).alias("lsn"), F.max("ts").alias("ts"))
    return ops.unionByName(commits.select("lsn", "ts", F.lit("TxCommit").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "tx_id"))


#: Event versions with writers, for visibility: transaction = event_id div 10.
EV_SQL = """(SELECT user_id AS key, event_id AS seq, event_id AS ts, event_id // 10 AS tx_id, event_type AS value, event_type = 'error' AS is_deleted FROM events)"""


def event_versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), F.floor(F.col("event_id") / 10).cast("long").alias("tx_id"),
        F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_deleted"),
    )
