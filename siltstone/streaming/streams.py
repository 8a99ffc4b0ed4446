"""Structured Streaming forms of the time-driven metrics and of log replay.

Event time is a timestamp (Parquet's timestamp without zone is cast), late rows
beyond the watermark are dropped, and state is bounded by it.  In append mode
only closed windows are given out; update and complete give open ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.operators.versions import newest


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet", ts: str = "ts", watermark: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream with a watermark on ts."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def tumbling(stream: DataFrame, ts: str, size: str, group: str, value: str) -> DataFrame:
    """Count and mean per window and group; runs on batches as well."""
    return stream.groupBy(F.window(ts, size).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "avg_value"
    )


def sliding(stream: DataFrame, ts: str, size: str, slide: str, group: str, value: str) -> DataFrame:
    return stream.groupBy(F.window(ts, size, slide).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "avg_value"
    )


def sessions(stream: DataFrame, ts: str, gap: str, group: str) -> DataFrame:
    return stream.groupBy(F.session_window(ts, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n"
    )


class _LastWrite(StatefulProcessor):
    """Keeps each key's last write by lsn and gives out what changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "lsn long, op string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else (-1, "", None)
        before = best[0]
        for batch in rows:
            i = batch["lsn"].idxmax()
            if int(batch.at[i, "lsn"]) > best[0]:
                best = (int(batch.at[i, "lsn"]), str(batch.at[i, "op"]), None if pd.isna(batch.at[i, "value"]) else str(batch.at[i, "value"]))
        if best[0] > before:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "lsn": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def fold_log(stream: DataFrame) -> DataFrame:
    """Operations (key, lsn, op, value) -> the last one of each key, as it changes.
    Needs the RocksDB state store."""
    schema = "key string, lsn long, op string, value string"
    return stream.groupBy("key").transformWithStateInPandas(_LastWrite(), outputStructType=schema, outputMode="Update", timeMode="None")


def fold_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends each batch's last writes as a run of a
    version table under path.  Runs are named by batch, so a batch that is done
    again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch.select("key", "lsn", "op", "value"), ["key"], ["lsn"]).write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    return write


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete", keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over all there is; each batch's results are written as Parquet
    under the checkpoint's folder by the executors, and read back.

    With mode update a batch holds the groups that it changed, and the last state of
    each (by ``keys``) is the result; complete gives the last batch, whose state is
    kept whole, as windows of sessions can only be had so before they close."""
    path = f"{checkpoint}-{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # nothing came
        return stream.sparkSession.createDataFrame([], stream.schema)
    out = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "update":
        return newest(out, list(keys), ["batch"]).drop("batch")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def auto_batch(stream: DataFrame, path: str, checkpoint: str, delay: str = "10 seconds"):
    """Writes a stream in micro-batches: what arrives within the delay, together."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=delay).start()


