"""Ordered key-value reads and writes, backups and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import backup, kv
from siltstone.operators.kv import IteratorBuilder, KeyValue
from siltstone.queries.tables import EV_SQL, KV_SQL, SEG_SQL, event_versions, kv_orders, kv_segments, table
from siltstone.registry import register

LO, HI = "order:0000000100", "order:0000000400"


def reg(name, query, sql):
    register(name, query, sql)


reg("kv_scan", lambda s, d: kv_orders(s, d).scan(LO, HI), f"SELECT key, value FROM {KV_SQL} WHERE key >= '{LO}' AND key < '{HI}' ORDER BY key")
reg("kv_scan_reverse", lambda s, d: kv_orders(s, d).scan(LO, HI, reverse=True), f"SELECT key, value FROM {KV_SQL} WHERE key >= '{LO}' AND key < '{HI}' ORDER BY key DESC")
reg("kv_scan_prefix", lambda s, d: kv_segments(s, d).prefix("cust:BUILDING:"), f"SELECT key, value FROM {SEG_SQL} WHERE starts_with(key, 'cust:BUILDING:') ORDER BY key")
reg("kv_range", lambda s, d: kv_orders(s, d).scan(None, HI, ordered=False), f"SELECT key, value FROM {KV_SQL} WHERE key < '{HI}'")
reg("kv_scan_limit", lambda s, d: kv_orders(s, d).scan(LO, None, limit=20), f"SELECT key, value FROM {KV_SQL} WHERE key >= '{LO}' ORDER BY key LIMIT 20")
reg("kv_scan_reverse_limit", lambda s, d: kv_orders(s, d).scan(None, HI, reverse=True, limit=20), f"SELECT key, value FROM {KV_SQL} WHERE key < '{HI}' ORDER BY key DESC LIMIT 20")
reg("kv_keys_prefix", lambda s, d: kv_segments(s, d).prefix("cust:M").select("key"), f"SELECT key FROM {SEG_SQL} WHERE starts_with(key, 'cust:M')")
reg("kv_scan_keys", lambda s, d: kv_segments(s, d).scan("cust:A", "cust:B").select("key"), f"SELECT key FROM {SEG_SQL} WHERE key >= 'cust:A' AND key < 'cust:B'")
reg("kv_count", lambda s, d: kv_orders(s, d).count(LO, HI), f"SELECT count(*) AS n FROM {KV_SQL} WHERE key >= '{LO}' AND key < '{HI}'")
reg("kv_get", lambda s, d: kv_orders(s, d).get("order:0000000007"), f"SELECT value FROM {KV_SQL} WHERE key = 'order:0000000007'")


def kv_iter_builder(spark, folder):
    """All four ways to include or exclude the ends, each backward with a limit."""
    view, out = kv_orders(spark, folder), None
    for a in (True, False):
        for b in (True, False):
            part = IteratorBuilder(LO, HI, backward=a, include_start=a, include_end=b, limit=7).build(view).withColumn("way", F.lit(f"{int(a)}{int(b)}"))
            out = part if out is None else out.unionByName(part)
    return out


reg(
    "kv_iter_builder",
    kv_iter_builder,
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT key, value, '{int(a)}{int(b)}' AS way FROM {KV_SQL} WHERE key {'>=' if a else '>'} '{LO}' AND key {'<=' if b else '<'} '{HI}' ORDER BY key {'DESC' if a else 'ASC'} LIMIT 7)"
        for a in (True, False)
        for b in (True, False)
    ),
)


def _keys(spark):
    names = ["order:0000000007", "order:9999999999", "order:0000000001", "order:0000000007", "nothing"]
    return spark.createDataFrame(list(enumerate(names)), "ordinal int, key string")


_KEYS_SQL = "(VALUES (0, 'order:0000000007'), (1, 'order:9999999999'), (2, 'order:0000000001'), (3, 'order:0000000007'), (4, 'nothing')) AS k(ordinal, key)"
reg("kv_multi_get", lambda s, d: kv_orders(s, d).multi_get(_keys(s)), f"SELECT ordinal, key, value FROM {_KEYS_SQL} LEFT JOIN {KV_SQL} USING (key) ORDER BY ordinal")
reg("kv_exists", lambda s, d: kv_orders(s, d).exists(_keys(s)), f"SELECT ordinal, k.key, k.key IN (SELECT key FROM {KV_SQL}) AS found FROM {_KEYS_SQL}")


# A batch of writes made from all orders: every third key is changed, every fifth
# removed, and both an older and a newer operation on the same key occur.
_K = "'order:' || lpad(o_orderkey::VARCHAR, 10, '0')"


def _writes(spark, folder):
    base = table(spark, folder, "orders")
    key = F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    changed = base.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("long").alias("seq"), key.alias("key"), F.lit("changed").alias("value"), F.lit(False).alias("is_deleted"))
    removed = base.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 1000000000000).alias("seq"), key.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_deleted"))
    added = base.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 2000000000000).alias("seq"), F.concat(key, F.lit("/new")).alias("key"), F.lit("added").alias("value"), F.lit(False).alias("is_deleted"))
    return changed.union(removed).union(added)


_WRITES_SQL = f"""(SELECT o_orderkey AS seq, {_K} AS key, 'changed' AS value, false AS is_deleted FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey + 1000000000000, {_K}, NULL, true FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey + 2000000000000, {_K} || '/new', 'added', false FROM orders WHERE o_orderkey % 7 = 0)"""
_LAST_SQL = f"(SELECT key, value, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM {_WRITES_SQL}) WHERE n = 1)"
_AFTER_SQL = f"SELECT key, value FROM {KV_SQL} WHERE key NOT IN (SELECT key FROM {_WRITES_SQL}) UNION ALL SELECT key, value FROM {_LAST_SQL} WHERE NOT is_deleted"

reg("kv_tx_iter", lambda s, d: kv_orders(s, d).overlay(_writes(s, d)), _AFTER_SQL)
reg(
    "sink_put",
    lambda s, d: kv_orders(s, d).overlay(_writes(s, d).where("not is_deleted")),
    f"SELECT key, value FROM {KV_SQL} WHERE key NOT IN (SELECT key FROM {_WRITES_SQL} WHERE NOT is_deleted) UNION ALL SELECT key, value FROM {_WRITES_SQL} WHERE NOT is_deleted",
)


def sink_delete(spark, folder):
    """Which deletions found their key, and all keys that are left."""
    view, gone = kv_orders(spark, folder), _writes(spark, folder).where("is_deleted")
    found = view.exists(gone.select(F.col("seq").alias("ordinal"), "key")).groupBy("found").agg(F.count(F.lit(1)).alias("n"))
    return found.union(KeyValue(view.overlay(gone)).count().select(F.lit(None).cast("boolean").alias("found"), "n"))


reg(
    "sink_delete",
    sink_delete,
    f"""SELECT key IN (SELECT key FROM {KV_SQL}) AS found, count(*) AS n FROM {_WRITES_SQL} WHERE is_deleted GROUP BY 1
    UNION ALL SELECT NULL, count(*) FROM {KV_SQL} WHERE key NOT IN (SELECT key FROM {_WRITES_SQL} WHERE is_deleted)""",
)


def sink_batch(spark, folder):
    """A batch of all writes applied in order, with its size and refused operations."""
    writes = _writes(spark, folder)
    state = KeyValue(kv_orders(spark, folder).overlay(writes)).count().select(F.lit("rows").alias("what"), F.col("n").cast("long"))
    size = kv.batch_size(writes).select(F.lit("bytes").alias("what"), F.col("bytes").cast("long").alias("n"))
    refused = kv.valid(writes).where("error is not null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("refused").alias("what"), "n")
    return state.union(size).union(refused)


reg(
    "sink_batch",
    sink_batch,
    f"""SELECT 'rows' AS what, count(*)::BIGINT AS n FROM ({_AFTER_SQL})
    UNION ALL SELECT 'bytes', sum(strlen(key) + coalesce(strlen(value), 0) + 16)::BIGINT FROM {_WRITES_SQL} UNION ALL SELECT 'refused', 0::BIGINT""",
)


def kv_cas(spark, folder):
    """Swaps of all keys that expect F:1-URGENT, and as many of keys beyond the table that are expected to be absent."""
    orders = table(spark, folder, "orders")
    key = lambda c: F.concat(F.lit("order:"), F.lpad(c.cast("string"), 10, "0"))
    some = orders.select(key(F.col("o_orderkey")).alias("key"), F.lit("F:1-URGENT").alias("expected"), F.lit("done").alias("new"))
    fresh = orders.select(key(F.col("o_orderkey") + 5000000000).alias("key"), F.lit(None).cast("string").alias("expected"), F.lit("fresh").alias("new"))
    return kv_orders(spark, folder).compare_and_swap(some.union(fresh))


reg(
    "kv_cas",
    kv_cas,
    f"""SELECT w.key, coalesce(t.value, '#') = coalesce(expected, '#') AS swapped, CASE WHEN coalesce(t.value, '#') = coalesce(expected, '#') THEN w.new ELSE t.value END AS value
    FROM (SELECT {_K} AS key, 'F:1-URGENT' AS expected, 'done' AS new FROM orders
      UNION ALL SELECT 'order:' || lpad((o_orderkey + 5000000000)::VARCHAR, 10, '0'), NULL, 'fresh' FROM orders) AS w
    LEFT JOIN {KV_SQL} AS t USING (key)""",
)


# The tree engine's scans: the same order on other entry points.
def _tree(spark, folder):
    return table(spark, folder, "part").select(F.encode(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "UTF-8").alias("key"), F.encode("p_name", "UTF-8").alias("value"))


def _text(df):
    return df.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


reg(
    "bt_range",
    lambda s, d: _text(KeyValue(_tree(s, d)).scan(bytearray(b"00000010"), bytearray(b"00000090"), include_end=True)),
    "SELECT lpad(p_partkey::VARCHAR, 8, '0') AS key, p_name AS value FROM part WHERE p_partkey BETWEEN 10 AND 90",
)


def bt_scan_parallel(spark, folder):
    """Shards by hash, merged back into one order: a repartitioned scan and a sort."""
    shards = _tree(spark, folder).repartition(8, "key").sortWithinPartitions("key")
    return _text(KeyValue(shards).scan(bytearray(b"00000100")))


reg("bt_scan_parallel", bt_scan_parallel, "SELECT lpad(p_partkey::VARCHAR, 8, '0') AS key, p_name AS value FROM part WHERE p_partkey >= 100")


def sink_cli(spark, folder):
    """Values as the command line prints them: text, or hex where it is not UTF-8."""
    rows = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.unhex(F.lit("FF00FE"))).otherwise(F.encode("p_name", "UTF-8")).alias("raw"))
    return rows.select("p_partkey", kv.render(F.col("raw")).alias("shown"))


reg("sink_cli", sink_cli, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'hex:ff00fe' ELSE p_name END AS shown FROM part")

# --- backups: one a day, full on the first of each eight days
_BACKUP_SQL = "(SELECT dense_rank() OVER (ORDER BY day) AS backup_id, CASE WHEN date_part('day', day) % 8 = 1 THEN 'full' ELSE 'incremental' END AS kind, day AS ts FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM events))"


def _backups(spark, folder):
    days = table(spark, folder, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    first = days.agg(F.min("ts").alias("first"))
    return days.crossJoin(F.broadcast(first)).select((F.datediff("ts", "first") + 1).alias("backup_id"), F.when(F.dayofmonth("ts") % 8 == 1, "full").otherwise("incremental").alias("kind"), "ts")


POINT = "2024-01-20 12:00:00"
reg("backup_full", lambda s, d: _backups(s, d).where("kind = 'full'").select("kind", "ts"), f"SELECT kind, ts FROM {_BACKUP_SQL} WHERE kind = 'full'")
reg("backup_pit", lambda s, d: backup.restore_point(_backups(s, d), F.lit(POINT).cast("timestamp_ntz")).select("kind", "ts"), f"""SELECT kind, ts FROM {_BACKUP_SQL} AS b, (SELECT max(ts) AS f FROM {_BACKUP_SQL} WHERE kind = 'full' AND ts <= TIMESTAMP '{POINT}')
  WHERE (kind = 'full' AND ts = f) OR (kind = 'incremental' AND ts > f AND ts <= TIMESTAMP '{POINT}')""")
reg(
    "backup_incr",
    lambda s, d: backup.changed_since(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified")), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'",
)


def backup_dedup(spark, folder):
    """Two manifests of the documents, with changes made to every eleventh text
    and every thirteenth source, compared; counted by kind of change."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    before = docs.where("doc_id % 10 <> 0")
    after = docs.where("doc_id % 10 <> 1").withColumn("hash", F.when(F.col("doc_id") % 11 == 0, F.lit("new")).otherwise(F.col("hash")))
    after = after.withColumn("source", F.when(F.col("doc_id") % 13 == 0, F.lit("moved")).otherwise(F.col("source")))
    return backup.changes(before, after, "doc_id", "hash", ["source"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


reg(
    "backup_dedup",
    backup_dedup,
    """SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'Created' WHEN doc_id % 10 = 1 THEN 'Deleted'
      WHEN doc_id % 11 = 0 THEN 'Content' WHEN doc_id % 13 = 0 THEN 'Metadata' ELSE 'Unchanged' END AS change FROM documents) GROUP BY 1""",
)
reg(
    "join_anti_manifest",
    lambda s, d: table(s, d, "documents").where("doc_id % 10 <> 1").join(table(s, d, "documents").where("doc_id % 10 <> 0").select("doc_id"), "doc_id", "left_anti").select("doc_id"),
    "SELECT doc_id FROM documents WHERE doc_id % 10 <> 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)",
)
reg(
    "agg_dedup_stats",
    lambda s, d: backup.dedup_stats(table(s, d, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size")), "h", "size").withColumn("ratio", F.round("ratio", 6)),
    """SELECT sum(n)::BIGINT AS chunks, count(*)::BIGINT AS unique_chunks, sum(a)::BIGINT AS total_bytes, sum(o)::BIGINT AS stored_bytes, round(sum(a) / sum(o), 6) AS ratio
    FROM (SELECT count(*) AS n, sum(strlen(text)) AS a, max(strlen(text)) AS o FROM documents GROUP BY sha256(text))""",
)


def recover_selective(spark, folder):
    """Of three tables, two are chosen, one of them without some keys."""
    parts = [table(spark, folder, t).select(F.lit(t).alias("table"), F.col(k).cast("string").alias("key")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    rows = parts[0].union(parts[1]).union(parts[2])
    keep = rows.where("length(key) <= 2")
    return backup.select_tables(rows, include=["customer", "nation"], keys=keep)


reg("recover_selective", recover_selective, """SELECT 'customer' AS "table", c_custkey::VARCHAR AS key FROM customer WHERE c_custkey < 100 UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation""")


def backup_chunks(spark, folder):
    """Content-defined chunks of the pages: chunks, distinct ones and bytes."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    return backup.dedup_stats(backup.chunk_texts(pages, "page_id", "html"), "digest", "size").select("total_bytes", (F.col("unique_chunks") <= F.col("chunks")).alias("saves"))


reg("backup_chunks", backup_chunks, "SELECT sum(strlen(html))::BIGINT AS total_bytes, true AS saves FROM pages")


def kv_read_at(spark, folder):
    """An iterator with a read time over versioned keys."""
    versions = event_versions(spark, folder)
    return IteratorBuilder(start=20, end=60, read_ts=600).build(KeyValue(versions))


reg(
    "kv_read_at",
    kv_read_at,
    f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM {EV_SQL} WHERE ts <= 600) WHERE n = 1 AND NOT is_deleted AND key >= 20 AND key < 60",
)
