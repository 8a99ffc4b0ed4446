"""Versions, snapshots, isolation, conflicts, logs and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import conflicts as X
from siltstone.operators import versions as V
from siltstone.operators.kv import KeyValue
from siltstone.queries.tables import EV_SQL, VERSION_COLUMNS, VERSION_DESC, VERSION_ORDER, VERSIONS_SQL, event_versions, line_versions, table, wal
from siltstone.registry import register
from siltstone.sources.wal import replay

KEYS = ["l_orderkey", "l_linenumber"]
COLS = ", ".join(VERSION_COLUMNS)
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {VERSION_DESC}) AS rn FROM {VERSIONS_SQL} {{}})"
AT = "1995-06-17 00:00:00"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


register("v_latest", lambda s, d: V.latest(line_versions(s, d), KEYS, VERSION_ORDER).select(*VERSION_COLUMNS), f"SELECT {COLS} FROM {_RANKED.format('')} WHERE rn = 1 AND NOT is_deleted")
register(
    "v_asof",
    lambda s, d: V.as_of(line_versions(s, d), KEYS, "ts", ntz(AT), [F.col(c).desc() for c in VERSION_ORDER[1:]]).select(*VERSION_COLUMNS),
    f"SELECT {COLS} FROM {_RANKED.format(f'''WHERE l_shipdate <= TIMESTAMP '{AT}' ''')} WHERE rn = 1 AND NOT is_deleted",
)
register("merge", lambda s, d: V.newest(line_versions(s, d), KEYS, VERSION_ORDER).select(*VERSION_COLUMNS, "is_deleted"), f"SELECT {COLS}, is_deleted FROM {_RANKED.format('')} WHERE rn = 1")


def v_compact(spark, folder):
    """Four runs by line date merged to one, deletions kept as older runs may lie below."""
    rows = line_versions(spark, folder)
    runs = [rows.where(F.year("ts") % 4 == k) for k in range(4)]
    return V.compact(runs[0].union(runs[1]).union(runs[2]).union(runs[3]), KEYS, VERSION_ORDER, drop_deleted=False).groupBy("is_deleted").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


register("v_compact", v_compact, f"SELECT is_deleted, count(*) AS n, sum(l_quantity) AS q FROM {_RANKED.format('')} WHERE rn = 1 GROUP BY 1")


def v_compact_scores(spark, folder):
    """Levels from the suppliers' nations: files and bytes against their limits."""
    rows = table(spark, folder, "supplier").groupBy((F.col("s_nationkey") % 5).alias("level")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("s_name")).alias("bytes"))
    return V.compaction_scores(rows.withColumn("max_bytes", F.lit(300) * (F.col("level") + 1))).select("level", F.round("score", 6).alias("score"), "pick")


register("v_compact_scores", v_compact_scores, "SELECT level, round(s, 6) AS score, s > 1 AS pick FROM (SELECT level, CASE WHEN level = 0 THEN files / 4 ELSE bytes / (300 * (level + 1)) END AS s FROM (SELECT s_nationkey % 5 AS level, count(*) AS files, sum(length(s_name)) AS bytes FROM supplier GROUP BY 1))")
register(
    "v_write_amp",
    lambda s, d: table(s, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum("l_extendedprice") / F.sum(F.col("l_extendedprice") * 0.85), 6).alias("write_amp")),
    "SELECT l_linestatus, round(sum(l_extendedprice) / sum(l_extendedprice * 0.85::DOUBLE), 6) AS write_amp FROM lineitem GROUP BY 1",
)

# --- snapshots and isolation over event versions
ACTIVE = "tx_id % 9 = 4"


def _active(versions):
    return versions.where(ACTIVE).select("tx_id").distinct()


_NEWEST_EV = "row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"


def v_snapshot(spark, folder):
    versions = event_versions(spark, folder)
    return V.snapshot(versions, ["key"], ["ts", "seq"], F.lit(700), _active(versions)).select("key", "value", "seq")


register("v_snapshot", v_snapshot, f"SELECT key, value, seq FROM (SELECT * FROM {EV_SQL} WHERE ts <= 700 AND NOT ({ACTIVE}) QUALIFY {_NEWEST_EV}) WHERE NOT is_deleted")


def _committed(versions):
    return versions.where("tx_id % 7 <> 0").groupBy("tx_id").agg((F.max("seq") + 5).alias("commit_ts"))


_SEEN_SQL = f"(SELECT v.*, c.commit_ts FROM {EV_SQL} AS v LEFT JOIN (SELECT tx_id, max(seq) + 5 AS commit_ts FROM {EV_SQL} WHERE tx_id % 7 <> 0 GROUP BY 1) AS c USING (tx_id))"


def v_isolation(spark, folder):
    """Versions that transaction 42, begun at 450, sees under each level."""
    versions, out = event_versions(spark, folder), None
    for level in V.LEVELS:
        part = V.visible(versions, level, 42, 450, _committed(versions)).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs")).select(F.lit(level).alias("level"), "n", "seqs")
        out = part if out is None else out.union(part)
    return out


register(
    "v_isolation",
    v_isolation,
    " UNION ALL ".join(
        f"SELECT '{level}' AS level, count(*) AS n, sum(seq)::BIGINT AS seqs FROM {_SEEN_SQL} WHERE tx_id = 42 OR {cond}"
        for level, cond in (("read_uncommitted", "true"), ("read_committed", "commit_ts IS NOT NULL"), ("repeatable_read", "commit_ts <= 450"), ("serializable", "commit_ts <= 450"), ("snapshot", "commit_ts <= 450"))
    ),
)


def v_range_visible(spark, folder):
    versions = event_versions(spark, folder)
    seen = V.visible(versions, "snapshot", 42, 800, _committed(versions)).where("key >= 30 AND key < 70")
    return V.latest(seen, ["key"], ["ts", "seq"]).select("key", "value", "seq")


register("v_range_visible", v_range_visible, f"SELECT key, value, seq FROM (SELECT * FROM {_SEEN_SQL} WHERE (tx_id = 42 OR commit_ts <= 800) AND key >= 30 AND key < 70 QUALIFY {_NEWEST_EV}) WHERE NOT is_deleted")


def v_read_own(spark, folder):
    """A transaction reads its own writes first: every fourth key changed or removed."""
    versions = event_versions(spark, folder)
    base = V.latest(versions, ["key"], ["ts", "seq"]).select("key", "value")
    writes = base.where("key % 4 = 0").select(F.col("key").alias("seq"), "key", F.lit("mine").alias("value"), (F.col("key") % 8 == 0).alias("is_deleted"))
    return KeyValue(base).overlay(writes)


register("v_read_own", v_read_own, f"SELECT key, CASE WHEN key % 4 = 0 THEN 'mine' ELSE value END AS value FROM (SELECT * FROM {EV_SQL} QUALIFY {_NEWEST_EV}) WHERE NOT is_deleted AND key % 8 <> 0")
register(
    "v_gc",
    lambda s, d: V.collect_garbage(event_versions(s, d), ["key"], ["ts", "seq"], F.lit(600)).select("key", "seq"),
    f"SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, ts < 600 ORDER BY ts DESC, seq DESC) AS n FROM {EV_SQL}) WHERE ts >= 600 OR n = 1",
)


def _gc_versions(spark, folder):
    return event_versions(spark, folder).select("key", F.col("seq").alias("version"), F.col("ts").alias("created"), "tx_id", "is_deleted", (F.col("seq") % 6).alias("references"))


_LIVE = "tx_id > 60 AND tx_id % 9 = 4"
register(
    "agg_version_dist",
    lambda s, d: _gc_versions(s, d).select(V.version_class(F.lit(500), F.expr(ACTIVE)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN is_deleted THEN 'tombstones' WHEN seq % 6 = 0 THEN 'unreferenced' WHEN ts <= 500 AND {ACTIVE} THEN 'old_referenced' WHEN ts <= 500 THEN 'old_collectible' ELSE 'active' END AS class, count(*) AS n FROM {EV_SQL} GROUP BY 1",
)


def st_watermark_gc(spark, folder):
    """What may go below the least version of an active transaction."""
    rows = _gc_versions(spark, folder)
    active = rows.where(_LIVE).select("tx_id").distinct()
    return V.garbage(rows, V.low_watermark(rows, active), F.lit(900), active).select("version", "is_deleted")


register("st_watermark_gc", st_watermark_gc, f"SELECT seq AS version, is_deleted FROM {EV_SQL} WHERE ts <= 900 AND (is_deleted OR (NOT ({_LIVE}) AND seq < (SELECT min(seq) FROM {EV_SQL} WHERE {_LIVE})))")

# --- as-of join: each order with the newest event of its customer (as user) before its place
_PROBE_SQL = "(SELECT o_orderkey, o_custkey % 150 AS key, o_orderkey % 1000 AS at FROM orders)"


def join_asof(spark, folder):
    probes = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("key"), (F.col("o_orderkey") % 1000).alias("at"))
    return V.as_of_join(probes, event_versions(spark, folder), ["key"], "at", "ts", ["seq"], ["seq", "value"]).select("o_orderkey", "seq", "value")


register("join_asof", join_asof, f"SELECT o_orderkey, e.seq, e.value FROM {_PROBE_SQL} AS p ASOF LEFT JOIN {EV_SQL} AS e ON p.key = e.key AND p.at >= e.ts")

# --- conflicts between transactions: ten events each, running for 40 ticks
_TXS_SQL = "(SELECT tx_id, min(seq) AS start_ts, CASE WHEN tx_id % 11 = 0 THEN NULL ELSE min(seq) + 40 END AS commit_ts FROM {ev} GROUP BY 1)".format(ev=EV_SQL)
_READS_SQL = f"(SELECT DISTINCT tx_id, key FROM {EV_SQL} WHERE value IN ('view', 'click'))"
_WRITES_SQL = f"(SELECT DISTINCT tx_id, key FROM {EV_SQL} WHERE value NOT IN ('view', 'click'))"
_RANGES_SQL = f"(SELECT tx_id, min(key) AS lo, min(key) + 6 AS hi FROM {EV_SQL} WHERE value = 'signup' GROUP BY 1)"
_OVERLAP = "(y.commit_ts IS NULL OR x.start_ts < y.commit_ts) AND (x.commit_ts IS NULL OR y.start_ts < x.commit_ts)"


def _txs(spark, folder):
    ev = event_versions(spark, folder)
    txs = ev.groupBy("tx_id").agg(F.min("seq").alias("start_ts")).withColumn("commit_ts", F.when(F.col("tx_id") % 11 != 0, F.col("start_ts") + 40))
    read = F.col("value").isin("view", "click")
    ranges = ev.where("value = 'signup'").groupBy("tx_id").agg(F.min("key").alias("lo"), (F.min("key") + 6).alias("hi"))
    return txs, ev.where(read).select("tx_id", "key").distinct(), ev.where(~read).select("tx_id", "key").distinct(), ranges


def _both(a: str, b: str, apart: str) -> str:
    return f"(SELECT DISTINCT a.tx_id AS tx_a, b.tx_id AS tx_b, a.key AS key FROM {a} AS a JOIN {b} AS b ON a.key = b.key AND a.tx_id {apart} b.tx_id JOIN {_TXS_SQL} AS x ON x.tx_id = a.tx_id JOIN {_TXS_SQL} AS y ON y.tx_id = b.tx_id WHERE {_OVERLAP})"


_WW, _RW = _both(_WRITES_SQL, _WRITES_SQL, "<"), _both(_READS_SQL, _WRITES_SQL, "<>")
_PH = f"(SELECT DISTINCT a.tx_id AS tx_a, b.tx_id AS tx_b, b.key AS key FROM {_RANGES_SQL} AS a JOIN {_WRITES_SQL} AS b ON b.key >= a.lo AND b.key < a.hi AND a.tx_id <> b.tx_id JOIN {_TXS_SQL} AS x ON x.tx_id = a.tx_id JOIN {_TXS_SQL} AS y ON y.tx_id = b.tx_id WHERE {_OVERLAP})"


def _ww(spark, folder):
    txs, _, writes, _ = _txs(spark, folder)
    return X.write_write(writes, txs)


def _rw(spark, folder):
    txs, reads, writes, _ = _txs(spark, folder)
    return X.read_write(reads, writes, txs)


def _phantoms(spark, folder):
    txs, _, writes, ranges = _txs(spark, folder)
    return X.phantoms(ranges, writes, txs)


register("c_ww", _ww, f"SELECT * FROM {_WW}")
register("c_rw", _rw, f"SELECT * FROM {_RW}")
register("c_phantom", _phantoms, f"SELECT * FROM {_PH}")
register("join_interval", lambda s, d: _phantoms(s, d).groupBy("tx_a").agg(F.count(F.lit(1)).alias("n")), f"SELECT tx_a, count(*) AS n FROM {_PH} GROUP BY 1")


def c_skew(spark, folder):
    txs, reads, writes, _ = _txs(spark, folder)
    return X.write_skew(reads, writes, txs)


register("c_skew", c_skew, f"SELECT DISTINCT a.tx_a, a.tx_b FROM {_RW} AS a JOIN {_RW} AS b ON a.tx_a = b.tx_b AND a.tx_b = b.tx_a WHERE a.tx_a < a.tx_b AND (a.tx_a, a.tx_b) NOT IN (SELECT (tx_a, tx_b) FROM {_WW})")


def c_validate(spark, folder):
    """Verdicts with the level chosen by the transaction's number."""
    txs, reads, writes, ranges = _txs(spark, folder)
    level = F.element_at(F.array(*[F.lit(x) for x in V.LEVELS]), (F.col("tx_id") % 5 + 1).cast("int"))
    return X.validate(txs, level, X.write_write(writes, txs), X.read_write(reads, writes, txs), X.phantoms(ranges, writes, txs))


def _ends(sql: str) -> str:
    return f"(SELECT tx_a FROM {sql} UNION SELECT tx_b FROM {sql})"


register(
    "c_validate",
    c_validate,
    f"""SELECT tx_id, level, CASE WHEN NOT (CASE level WHEN 'read_uncommitted' THEN false WHEN 'read_committed' THEN ww WHEN 'snapshot' THEN ww WHEN 'repeatable_read' THEN ww OR rw ELSE ww OR rw OR ph END) THEN 'Valid'
      WHEN level = 'snapshot' THEN 'Retry' ELSE 'Invalid' END AS verdict
    FROM (SELECT tx_id, ['read_uncommitted', 'read_committed', 'repeatable_read', 'serializable', 'snapshot'][tx_id % 5 + 1] AS level,
      tx_id IN {_ends(_WW)} AS ww, tx_id IN {_ends(_RW)} AS rw, tx_id IN {_ends(_PH)} AS ph FROM {_TXS_SQL})""",
)


def c_first_committer(spark, folder):
    txs, _, writes, _ = _txs(spark, folder)
    return X.first_committer(writes, event_versions(spark, folder).select("key", "tx_id", "ts"), txs)


register("c_first_committer", c_first_committer, f"SELECT tx_id, tx_id IN (SELECT w.tx_id FROM {_WRITES_SQL} AS w JOIN {_TXS_SQL} AS t USING (tx_id) JOIN {EV_SQL} AS v ON v.key = w.key AND v.tx_id <> w.tx_id AND v.ts > t.start_ts) AS aborts FROM {_TXS_SQL}")


def _locks(spark, folder):
    """Requests for what other transactions hold, over all transactions and keys."""
    _, _, writes, _ = _txs(spark, folder)
    held = writes.withColumn("mode", F.when(F.col("key") % 2 == 0, "exclusive").otherwise("shared"))
    keys = writes.agg((F.max("key") + 1).alias("keys"))
    asked = writes.crossJoin(F.broadcast(keys)).select("tx_id", ((F.col("key") * 7 + F.col("tx_id")) % F.col("keys")).alias("key"), F.when(F.col("key") % 3 == 0, "update").otherwise("shared").alias("mode"))
    return asked, held


def _wait_edges(spark, folder):
    return X.waits_for(*_locks(spark, folder))


register("c_cycle", lambda s, d: X.wait_cycles(*_locks(s, d)))
register("c_deadlock", lambda s, d: X.youngest(X.wait_cycles(*_locks(s, d))))
register(
    "c_lock_compat",
    lambda s, d: X.lock_matrix(s),
    "SELECT held, wanted, (held, wanted) IN (" + ", ".join(f"('{a}', '{b}')" for a, bs in X.COMPATIBLE.items() for b in bs) + ") AS compatible FROM "
    + "(SELECT unnest([" + ", ".join(f"'{x}'" for x in X.LOCKS) + "]) AS held), (SELECT unnest([" + ", ".join(f"'{x}'" for x in X.LOCKS) + "]) AS wanted)",
)

# --- logs
_APPLIED = "(SELECT user_id::VARCHAR AS key, event_type AS value, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10 DESC, event_id DESC) AS n FROM events WHERE (event_id // 10) % 7 <> 0 {})"
register("wal_source", lambda s, d: replay(wal(s, d)), f"SELECT key, value FROM {_APPLIED.format('')} WHERE n = 1 AND NOT gone")


def wal_point_in_time(spark, folder):
    """State at a time: commits after it do not count."""
    return replay(wal(spark, folder), until_ts=ntz("2024-01-16 00:00:00"))


_PIT = "AND event_id // 10 IN (SELECT event_id // 10 FROM events GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-16')"
register("wal_point_in_time", wal_point_in_time, f"SELECT key, value FROM {_APPLIED.format(_PIT)} WHERE n = 1 AND NOT gone")


def st_wal_fold(spark, folder):
    """The log as a fold: keys, and how many are live after all committed operations."""
    state = replay(wal(spark, folder))
    return state.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


register("st_wal_fold", st_wal_fold, f"SELECT value, count(*) AS n FROM {_APPLIED.format('')} WHERE n = 1 AND NOT gone GROUP BY 1")
