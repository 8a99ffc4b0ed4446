"""Version tables: many versions of a key, newest wins, deletions explicit.

Columns that matter: the key columns, a time, a tie-break that makes the order
total, is_deleted, and for transactions tx_id.  The newest version of a key is
found by an aggregate (max_by), which combines before the shuffle, and not by
sorting a window, wherever only one version is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(versions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the version that is largest by the order columns."""
    over = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def latest(versions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest version of each key, without keys whose newest is a deletion."""
    return newest(versions, keys, order).where(~F.col("is_deleted"))


def as_of(versions: DataFrame, keys: Sequence[str], ts: str, at: Column, tie: Sequence[Column] = ()) -> DataFrame:
    """Newest version with ts <= at, deletions removed."""
    over = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *tie)
    seen = versions.where(F.col(ts) <= at).withColumn("_n", F.row_number().over(over))
    return seen.where((F.col("_n") == 1) & ~F.col("is_deleted")).drop("_n")


def as_of_join(probes: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, ts: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For every probe (keys, at) the newest version with ts <= at, else NULLs.

    Probes and versions are put into one stream per key and the last version is
    carried along, so a key costs its rows, not their product."""
    a = probes.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_p"), F.lit(None).alias("_v"), F.lit(None).alias("_o"))
    b = versions.select(*keys, F.col(ts).alias("_at"), F.lit(0).alias("_probe"), F.lit(None).alias("_p"), F.struct(*fields).alias("_v"), F.struct(*order).alias("_o"))
    over = Window.partitionBy(*keys).orderBy(F.col("_at"), F.col("_probe"), F.col("_o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(over)).where("_probe = 1")
    return both.select("_p.*", *[F.col(f"_last.{f}").alias(f) for f in fields])


def snapshot(versions: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, active: DataFrame) -> DataFrame:
    """What a snapshot sees: versions up to its time whose transactions were not
    active then (active has tx_id)."""
    visible = versions.where(F.col("ts") <= at).join(active.select("tx_id"), "tx_id", "left_anti").select(*versions.columns)
    return latest(visible, keys, order)


LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable", "snapshot")


def visible(versions: DataFrame, level: str, tx_id: int, start_ts: int, committed: DataFrame) -> DataFrame:
    """Versions that a transaction may see; committed has (tx_id, commit_ts).
    Its own writes always count."""
    if level not in LEVELS:
        raise ValueError(f"unknown isolation level {level}")
    own = F.col("tx_id") == tx_id
    if level == "read_uncommitted":
        return versions
    known = versions.join(committed.select("tx_id", "commit_ts"), "tx_id", "left")
    if level == "read_committed":
        seen = F.col("commit_ts").isNotNull()
    else:
        seen = F.col("commit_ts") <= start_ts
    return known.where(own | F.coalesce(seen, F.lit(False))).select(*versions.columns)


def collect_garbage(versions: DataFrame, keys: Sequence[str], order: Sequence[str], min_ts: Column) -> DataFrame:
    """Keeps what is at or above min_ts, and of each key the newest version below."""
    over = Window.partitionBy(*keys, "_old").orderBy(*[F.col(c).desc() for c in order])
    ranked = versions.withColumn("_old", F.col("ts") < min_ts).withColumn("_n", F.row_number().over(over))
    return ranked.where(~F.col("_old") | (F.col("_n") == 1)).select(*versions.columns)


def low_watermark(versions: DataFrame, active: DataFrame) -> DataFrame:
    """One row (watermark): the least version of an active transaction, or the
    largest of all if none is active."""
    live = versions.join(active.select("tx_id").distinct().withColumn("_live", F.lit(True)), "tx_id", "left")
    return live.agg(F.coalesce(F.min(F.when(F.col("_live"), F.col("version"))), F.max("version")).alias("watermark"))


def garbage(versions: DataFrame, watermark: DataFrame, cutoff: Column, active: DataFrame) -> DataFrame:
    """Versions that may go: old, below the watermark and of no active
    transaction; and deletions that are old."""
    marked = versions.crossJoin(F.broadcast(watermark)).join(active.select("tx_id").distinct().withColumn("_live", F.lit(True)), "tx_id", "left")
    old = F.col("created") <= cutoff
    goes = old & (F.col("is_deleted") | ((F.col("version") < F.col("watermark")) & F.col("_live").isNull()))
    return marked.where(goes).select(*versions.columns)


def version_class(cutoff: Column, live: Column) -> Column:
    """tombstones, unreferenced, old_referenced, old_collectible or active, in this precedence."""
    return (
        F.when(F.col("is_deleted"), "tombstones")
        .when(F.col("references") == 0, "unreferenced")
        .when((F.col("created") <= cutoff) & live, "old_referenced")
        .when(F.col("created") <= cutoff, "old_collectible")
        .otherwise("active")
    )


def compact(runs: DataFrame, keys: Sequence[str], order: Sequence[str], drop_deleted: bool = True) -> DataFrame:
    """Merges sorted runs to one: newest version of each key; deletions go only
    when nothing older can lie below."""
    merged = newest(runs, keys, order)
    return merged.where(~F.col("is_deleted")) if drop_deleted else merged


def compaction_scores(levels: DataFrame, level0_files: int = 4) -> DataFrame:
    """levels(level, files, bytes, max_bytes) -> score and whether to compact:
    files over their number at level 0, bytes over the level's size below."""
    score = F.when(F.col("level") == 0, F.col("files") / level0_files).otherwise(F.col("bytes") / F.col("max_bytes"))
    return levels.withColumn("score", score).withColumn("pick", F.col("score") > 1.0)
