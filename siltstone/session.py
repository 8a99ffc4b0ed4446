"""Spark sessions and the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that queries rely on; sizes are left to the cluster.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    # checkpoints that nothing refers to any more are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Profiles for kinds of work, as additions to BASE.
PROFILES = {
    "balanced": {},
    "scan": {"spark.sql.files.maxPartitionBytes": "256m", "spark.sql.parquet.aggregatePushdown": "true"},
    "shuffle": {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m", "spark.shuffle.file.buffer": "1m"},
    "low_memory": {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m", "spark.sql.autoBroadcastJoinThreshold": "4m"},
    "development": {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
}


def create(app: str = "siltstone", profile: str = "balanced", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (BASE | PROFILES[profile] | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder, from spark.checkpoint.dir.

    Where none is set a local session (tests) gets a temporary one, which goes when
    the program ends; a cluster gets an error, as its machines share no such folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
            place = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, place, ignore_errors=True)
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes a query's shuffle files when the query ends; after it,
    the setting is what it was before.  For functions that run many jobs."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that what
    follows neither repeats it nor depends on the executors that made it.  Its shuffle
    files are removed: from then on the checkpoint stands in for them."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    with tidy(spark):
        return df.select("*").checkpoint(eager=True)  # a plan made under this setting
