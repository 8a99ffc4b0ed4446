"""Time-driven metrics over event tables: windows, trends, strides, quotas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def percentile_by_group(df: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """The same for every group of a table, by counts of distinct values: what is
    sorted and kept per group is its distinct values, not its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value))).alias(name) for name, p in ps.items()])


def kth_of_ranges(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, ks: list[np.ndarray]) -> list[np.ndarray]:
    """For each range [lo, hi) of codes its k-th least, counted from 0, for several k.

    A wavelet matrix, one bit at a time: codes are dealt by the bit, in order, and
    a range becomes the range of its zeros or of its ones.  Work is the number of
    codes and ranges times the bits, whatever the length of the ranges."""
    at = [(lo, hi, k, np.zeros_like(k)) for k in ks]
    for bit in reversed(range(int(codes.max(initial=0)).bit_length())):
        ones = (codes >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        for i, (a, b, k, found) in enumerate(at):
            a0, b0 = zeros[a], zeros[b]
            up = k >= b0 - a0
            at[i] = np.where(up, zeros[-1] + a - a0, a0), np.where(up, zeros[-1] + b - b0, b0), np.where(up, k - (b0 - a0), k), found | (up.astype(np.int64) << bit)
        codes = np.concatenate([codes[~ones], codes[ones]])
    return [found for *_, found in at]


def _trail(rows: pa.Table, seconds: int, schema: pa.Schema) -> pa.Table:
    """A stretch of ``trailing``: its own rows with what lies in the window of each."""
    rows = rows.sort_by("_us")
    known = rows.filter(pc.is_valid(rows["_value"]))
    us, values = known["_us"].to_numpy(), known["_value"].to_numpy()
    own = rows.filter(pc.equal(rows["_part"], rows["_own"]))
    now = own["_us"].to_numpy()
    window = seconds * 1_000_000
    lo, hi = np.searchsorted(us, now - window, "left"), np.searchsorted(us, now, "right")
    n, some = hi - lo, hi > lo
    # a window is the end of one block of its length and the beginning of the next: sums without differences
    block, sums = us // window, np.zeros(len(now), np.longdouble)
    if len(us):
        upto, since, cuts = [], [], np.flatnonzero(np.diff(block)) + 1
        for part in np.split(values.astype(np.longdouble), cuts):
            upto.append(np.cumsum(part))
            since.append(np.cumsum(part[::-1])[::-1])
        upto, since = np.concatenate(upto), np.concatenate(since)
        first, last = np.minimum(lo, len(us) - 1), np.maximum(hi - 1, 0)
        sums += np.where(some & (block[first] < now // window), since[first], 0)
        sums += np.where(some & (block[last] == now // window), upto[last], 0)
    distinct, codes = np.unique(values, return_inverse=True)
    places = [np.floor(n * p).astype(np.int64) for p in (0.95, 0.99)]
    found = kth_of_ranges(codes.astype(np.int64), lo, hi, places)
    take = lambda k: pa.array(distinct if len(distinct) else [], rows["_value"].type).take(pa.array(np.where(some, k, 0), mask=~some))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = pa.array(sums.astype(float) / n, mask=~some)
    made = [pa.array(n.astype(np.int32)), mean, take(found[0]), take(found[1]), pa.array(n / float(seconds))]
    return pa.Table.from_arrays([*own.drop_columns(["_us", "_own", "_part", "_value"]).columns, *made], schema=schema)


def trailing(df: DataFrame, ts: str, value: str, group: str, seconds: int) -> DataFrame:
    """Each row with count, mean, p95, p99 and rate of its group's last seconds;
    p is sorted[floor(n * p)], values that are NULL do not count.

    Time is cut into stretches no shorter than the window, and a row is seen by
    its own stretch and the next one, so a group's windows run in parallel.  A
    stretch of n rows costs n * log n, however many of them a window holds."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = max(seconds, 3600) * 1_000_000
    cut = df.withColumn("_us", us).where("_us is not null").withColumn("_own", F.floor(F.col("_us") / stretch)).withColumn("_value", F.col(value))
    cut = cut.withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
    kind = df.schema[value].dataType
    made = [("n", T.IntegerType()), ("avg", T.DoubleType()), ("p95", kind), ("p99", kind), ("per_sec", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, type_) for name, type_ in made]])

    def run(rows: pa.Table) -> pa.Table:
        names = [f for f in rows.schema if f.name not in ("_us", "_own", "_part", "_value")]
        value_type = rows.schema.field("_value").type
        new = [pa.int32(), pa.float64(), value_type, value_type, pa.float64()]
        return _trail(rows, seconds, pa.schema([*names, *[pa.field(name, t) for (name, _), t in zip(made, new)]]))

    return cut.groupBy(group, "_part").applyInArrow(run, schema)


def window_metrics(snapshots: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rates between the first and last snapshot of the last seconds, whole means
    of the latencies, the last hit rate and the share of errors.

    snapshots: ts, reads, writes, read_latency, write_latency, hit_rate, errors,
    compactions; counters only grow."""
    own = snapshots.where((F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))
    fields = [c for c in snapshots.columns if c != "ts"]
    ends = own.agg(
        F.min_by(F.struct(*fields), "ts").alias("a"), F.max_by(F.struct(*fields), "ts").alias("z"),
        F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("us"), F.count(F.lit(1)).alias("n"),
        F.sum("read_latency").alias("rl"), F.sum("write_latency").alias("wl"),
    )
    grown = lambda c: F.col(f"z.{c}") - F.col(f"a.{c}")
    rate = lambda c: F.when(F.col("us") >= 1_000_000, grown(c) / (F.col("us") / 1e6)).otherwise(0.0)
    ops = grown("reads") + grown("writes")
    return ends.where("n > 0").select(
        rate("reads").alias("reads_per_sec"), rate("writes").alias("writes_per_sec"),
        F.floor(F.col("rl") / F.col("n")).alias("avg_read_latency"), F.floor(F.col("wl") / F.col("n")).alias("avg_write_latency"),
        F.col("z.hit_rate").alias("hit_rate"), grown("compactions").alias("compactions"),
        F.when(ops > 0, grown("errors") / ops).otherwise(0.0).alias("error_rate"),
    )


def by_hour(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Counter and running mean per hour of the day, and which hour is the peak."""
    out = df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))
    return out.withColumn("is_peak", F.col("n") == F.max("n").over(Window.partitionBy(F.lit(0))))  # 24 rows at most


def trend(daily: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """Percent change from the first to the last of the last days; 0 on a base of 0."""
    last = daily.orderBy(F.desc(day)).limit(days)
    ends = last.agg(F.min_by(value, day).alias("base"), F.max_by(value, day).alias("now"), F.count(F.lit(1)).alias("days"))
    return ends.select("days", "base", "now", F.when((F.col("base") != 0) & (F.col("days") > 1), (F.col("now") - F.col("base")) / F.col("base") * 100.0).otherwise(0.0).alias("change_percent"))


def strides(df: DataFrame, group: str, place: str, order: str, window: int = 16) -> DataFrame:
    """Most frequent step over the last accesses of each group, ties to the least
    step, with its share; sequential if it is 1, strided if constant otherwise."""
    # the limit on the rank is applied before the shuffle too
    recent = df.select(group, place, order).withColumn("back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("back") <= window)
    steps = recent.withColumn("stride", F.col(place) - F.lag(place).over(Window.partitionBy(group).orderBy(order)))
    last = steps.where(F.col("stride").isNotNull())
    counts = last.groupBy(group, "stride").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.max_by(F.struct("stride", "n"), F.struct(F.col("n"), -F.col("stride"))).alias("b"), F.sum("n").alias("total"))
    share = F.col("b.n") / F.col("total")
    kind = F.when(share < 0.5, "random").when(F.col("b.stride") == 1, "sequential").otherwise("strided")
    return best.select(group, F.col("b.stride").alias("stride"), share.alias("share"), kind.alias("pattern"))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired: hidden strictly after their expiry."""
    return sessions.where(~(now > F.col("expires")))


def quota(requests: DataFrame, limits: DataFrame, group: str, size: str) -> DataFrame:
    """requests with whether they fit under their group's limit, in order of seq:
    the sizes so far are a running sum."""
    over = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return requests.join(limits, group).withColumn("used", F.sum(size).over(over)).withColumn("allowed", F.col("used") <= F.col("max_size"))


def token_bucket(df: DataFrame, group: str, ts: str, order: str, rate: float, burst: float) -> DataFrame:
    """rows with allowed: a bucket per group holds burst tokens and gains rate per
    second; a request takes one.  Each answer depends on the one before, so a
    group's requests run through Python in order, a batch at a time."""
    from collections.abc import Iterator

    import pandas as pd

    ordered = df.select(group, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).repartition(F.col(group)).sortWithinPartitions(group, "us", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = object(), burst, 0
        for b in batches:
            allowed, left = [], []
            for g, us in zip(b[group], b["us"]):
                if g != current:
                    current, tokens, last = g, burst, us
                tokens = min(burst, tokens + (us - last) / 1e6 * rate)
                last = us
                ok = tokens >= 1.0
                tokens -= ok
                allowed.append(ok)
                left.append(tokens)
            yield b.assign(allowed=allowed, tokens=left)

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, us long, allowed boolean, tokens double")
