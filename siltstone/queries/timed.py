"""Time-driven metrics, in batch form and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import metrics
from siltstone.queries.tables import table
from siltstone.registry import register
from siltstone.session import checkpoint_dir
from siltstone.streaming import streams


def events(spark, folder):
    return table(spark, folder, "events")


register(
    "st_tumbling_hour",
    lambda s, d: metrics.by_hour(events(s, d), "ts", "value").withColumn("avg_value", F.round("avg_value", 6)),
    "SELECT hour, n, round(a, 6) AS avg_value, n = max(n) OVER () AS is_peak FROM (SELECT date_part('hour', ts) AS hour, count(*) AS n, avg(value) AS a FROM events GROUP BY 1)",
)
_DAILY = "(SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)"


def _daily(spark, folder):
    return events(spark, folder).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


register("st_tumbling_day", lambda s, d: _daily(s, d), f"SELECT day::TIMESTAMP AS day, n FROM {_DAILY}")
register(
    "st_trend",
    lambda s, d: metrics.trend(_daily(s, d), "day", "n", 30).withColumn("change_percent", F.round("change_percent", 6)),
    f"SELECT count(*) AS days, arg_min(n, day) AS base, arg_max(n, day) AS now, round(CASE WHEN arg_min(n, day) <> 0 AND count(*) > 1 THEN (arg_max(n, day) - arg_min(n, day)) / arg_min(n, day) * 100 ELSE 0 END, 6) AS change_percent FROM (SELECT * FROM {_DAILY} ORDER BY day DESC LIMIT 30)",
)
_USED = ("event_id", "ts", "event_type", "value")
_TRAIL = "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {} SECOND PRECEDING AND CURRENT ROW)"
register(
    "st_sliding_latency",
    lambda s, d: metrics.trailing(events(s, d).select(*_USED), "ts", "value", "event_type", 3600).select("event_id", "n", F.round("avg", 5).alias("avg"), "p95", "p99"),
    f"SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 5) AS avg, list_sort(list(value) OVER w)[floor(count(*) OVER w * 0.95)::INT + 1] AS p95, list_sort(list(value) OVER w)[floor(count(*) OVER w * 0.99)::INT + 1] AS p99 {_TRAIL.format(3600)}",
)
register(
    "st_window_metrics",
    lambda s, d: metrics.trailing(events(s, d).select(*_USED), "ts", "value", "event_type", 60).select("event_id", F.col("n").alias("n60")).join(metrics.trailing(events(s, d).select(*_USED), "ts", "value", "event_type", 300).select("event_id", F.col("n").alias("n300")), "event_id"),
    f"SELECT a.event_id, n60, n300 FROM (SELECT event_id, count(*) OVER w AS n60 {_TRAIL.format(60)}) AS a JOIN (SELECT event_id, count(*) OVER w AS n300 {_TRAIL.format(300)}) AS b USING (event_id)",
)

# --- snapshots of running counters, one an hour
_SNAP_SQL = """(SELECT ts, sum(r) OVER o AS reads, sum(w) OVER o AS writes, sum(e) OVER o AS errors, rl AS read_latency, wl AS write_latency, hit_rate, row_number() OVER o AS compactions
  FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) FILTER (event_type IN ('view', 'click')) AS r, count(*) FILTER (event_type IN ('purchase', 'signup')) AS w, count(*) FILTER (event_type = 'error') AS e,
    floor(avg(value))::BIGINT AS rl, floor(max(value))::BIGINT AS wl, round(avg((value > 50)::INT), 6) AS hit_rate FROM events GROUP BY 1) WINDOW o AS (ORDER BY ts))"""


def _snapshots(spark, folder):
    """Counters by hour; the running sums order a few hundred rows."""
    from pyspark.sql.window import Window

    hourly = events(spark, folder).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count_if(F.col("event_type").isin("view", "click")).alias("r"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("w"), F.count_if(F.col("event_type") == "error").alias("e"),
        F.floor(F.avg("value")).alias("read_latency"), F.floor(F.max("value")).alias("write_latency"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("hit_rate"),
    )
    over = Window.partitionBy(F.lit(0)).orderBy("ts")
    return hourly.select("ts", F.sum("r").over(over).alias("reads"), F.sum("w").over(over).alias("writes"), F.sum("e").over(over).alias("errors"), "read_latency", "write_latency", "hit_rate", F.row_number().over(over).alias("compactions"))


NOW = "2024-01-20 00:00:00"
register(
    "agg_window_metrics",
    lambda s, d: metrics.window_metrics(_snapshots(s, d), F.lit(NOW).cast("timestamp_ntz"), 86400).select(
        F.round("reads_per_sec", 9).alias("reads_per_sec"), F.round("writes_per_sec", 9).alias("writes_per_sec"), F.col("avg_read_latency").cast("long").alias("avg_read_latency"), F.col("avg_write_latency").cast("long").alias("avg_write_latency"), "hit_rate", F.col("compactions").cast("long").alias("compactions"), F.round("error_rate", 9).alias("error_rate")
    ),
    f"""SELECT round((arg_max(reads, ts) - arg_min(reads, ts)) / date_diff('second', min(ts), max(ts)), 9) AS reads_per_sec, round((arg_max(writes, ts) - arg_min(writes, ts)) / date_diff('second', min(ts), max(ts)), 9) AS writes_per_sec,
    (sum(read_latency) // count(*))::BIGINT AS avg_read_latency, (sum(write_latency) // count(*))::BIGINT AS avg_write_latency, arg_max(hit_rate, ts) AS hit_rate, (arg_max(compactions, ts) - arg_min(compactions, ts))::BIGINT AS compactions,
    round((arg_max(errors, ts) - arg_min(errors, ts)) / (arg_max(reads + writes, ts) - arg_min(reads + writes, ts)), 9) AS error_rate
    FROM {_SNAP_SQL} WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND AND ts <= TIMESTAMP '{NOW}'""",
)
register("st_snapshots", lambda s, d: _snapshots(s, d).orderBy(F.desc("ts")).limit(360).select("ts", F.col("reads").cast("long").alias("reads"), F.col("writes").cast("long").alias("writes")), f"SELECT ts, reads::BIGINT AS reads, writes::BIGINT AS writes FROM {_SNAP_SQL} ORDER BY ts DESC LIMIT 360")


def sink_report(spark, folder):
    """One row of the metrics as JSON and as a line of comma-separated values."""
    last = _snapshots(spark, folder).orderBy(F.desc("ts")).limit(1)
    names = ["reads", "writes", "errors", "read_latency", "write_latency", "hit_rate"]
    return last.select(F.to_json(F.struct(*names)).alias("json"), F.concat_ws(",", *[F.col(n).cast("string") for n in names]).alias("csv"))


register("sink_report", sink_report)
register(
    "st_session_ttl",
    lambda s, d: metrics.live_sessions(events(s, d).select("event_id", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires")), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id"),
    "SELECT event_id FROM events WHERE NOT (TIMESTAMP '2024-01-15' > ts + INTERVAL 24 HOUR)",
)
register(
    "st_stride",
    lambda s, d: metrics.strides(events(s, d), "event_type", "user_id", "event_id").withColumn("share", F.round("share", 6)),
    """WITH s AS (SELECT event_type, user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS stride, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events),
    c AS (SELECT event_type, stride, count(*) AS n FROM s WHERE back < 16 AND stride IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS t, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, stride) AS r FROM c)
    SELECT event_type, stride, round(n / t, 6) AS share, CASE WHEN n / t < 0.5 THEN 'random' WHEN stride = 1 THEN 'sequential' ELSE 'strided' END AS pattern FROM b WHERE r = 1""",
)


def v_quota(spark, folder):
    """Orders that fit under a customer's limit, in order of their keys."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    limits = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1000000).cast("decimal(18,2)").alias("max_size"))
    return metrics.quota(orders, limits, "o_custkey", "size").select("seq", "allowed")


register("v_quota", v_quota, "SELECT o_orderkey AS seq, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 1000000 AS allowed FROM orders")


def st_rate_limit(spark, folder):
    """A bucket per event type: 40 requests an hour, bursts of 10."""
    out = metrics.token_bucket(events(spark, folder), "event_type", "ts", "event_id", 40 / 3600.0, 10.0)
    return out.groupBy("event_type", "allowed").agg(F.count(F.lit(1)).alias("n"))


register("st_rate_limit", st_rate_limit)


# --- streams over the same table, run to the end
def _once(spark, make, mode: str, keys=()):
    name = f"s{uuid.uuid4().hex}"
    return streams.run_once(make, name, f"{checkpoint_dir(spark)}/{name}", mode, keys)


def _stream(spark, folder):
    return streams.read_events(spark, folder, "events.parquet")


def stream_tumbling(spark, folder):
    out = _once(spark, streams.tumbling(_stream(spark, folder), "ts", "1 day", "event_type", "value"), "update", ("start", "end", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


register("stream_tumbling", stream_tumbling, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")


def stream_sliding(spark, folder):
    """Every window with its count and mean."""
    out = _once(spark, streams.sliding(_stream(spark, folder), "ts", "2 hours", "1 hour", "event_type", "value"), "update", ("start", "end", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


register(
    "stream_sliding",
    stream_sliding,
    "SELECT (date_trunc('hour', ts) - to_hours(h))::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY 1, 2",
)


def stream_sessions(spark, folder):
    """Every session, closed or open, with gaps of 30 minutes, by user."""
    out = _once(spark, streams.sessions(_stream(spark, folder), "ts", "30 minutes", "user_id"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


register(
    "stream_sessions",
    stream_sessions,
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM
    (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM
      (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""",
)
