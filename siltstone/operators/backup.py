"""Backups: which files to take, which to restore, and what has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_since(files: DataFrame, last: Column) -> DataFrame:
    """An incremental backup's files: those modified after the last backup."""
    return files.where(F.col("modified") > last)


def restore_point(backups: DataFrame, target: Column) -> DataFrame:
    """backups(backup_id, kind, ts): the newest full one at or before target, and
    the incremental ones between it and target, in order."""
    full = backups.where((F.col("kind") == "full") & (F.col("ts") <= target)).agg(F.max("ts").alias("full_ts"))
    both = backups.crossJoin(F.broadcast(full))
    use = ((F.col("kind") == "full") & (F.col("ts") == F.col("full_ts"))) | ((F.col("kind") == "incremental") & (F.col("ts") > F.col("full_ts")) & (F.col("ts") <= target))
    return both.where(use).drop("full_ts")


def changes(before: DataFrame, after: DataFrame, key: str, content: str, meta: Sequence[str] = ()) -> DataFrame:
    """(key, change): Created, Content, Metadata, Deleted or Unchanged."""
    b = before.select(key, F.col(content).alias("_bc"), F.struct(*[F.col(m) for m in meta] or [F.lit(0).alias("_")]).alias("_bm"), F.lit(1).alias("_b"))
    a = after.select(key, F.col(content).alias("_ac"), F.struct(*[F.col(m) for m in meta] or [F.lit(0).alias("_")]).alias("_am"), F.lit(1).alias("_a"))
    change = (
        F.when(F.col("_b").isNull(), "Created")
        .when(F.col("_a").isNull(), "Deleted")
        .when(~F.col("_bc").eqNullSafe(F.col("_ac")), "Content")
        .when(~F.col("_bm").eqNullSafe(F.col("_am")), "Metadata")
        .otherwise("Unchanged")
    )
    return b.join(a, key, "full").select(key, change.alias("change"))


def dedup_stats(chunks: DataFrame, digest: str, size: str) -> DataFrame:
    """Chunks, distinct chunks, bytes, and bytes kept when equal chunks are stored once."""
    one = chunks.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("all"), F.max(size).alias("one"))
    return one.agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum("all").alias("total_bytes"), F.sum("one").alias("stored_bytes")
    ).withColumn("ratio", F.col("total_bytes") / F.col("stored_bytes"))


def chunk_texts(rows: DataFrame, key: str, text: str, mask_bits: int = 8, least: int = 64, most: int = 4096) -> DataFrame:
    """Content-defined chunks of a text column: (key, place, size, digest).

    A chunk ends where a rolling hash over the last bytes has mask_bits zero
    bits, so an insertion moves no boundary but those beside it.  Python is used
    as each boundary depends on the one before."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    def cuts(raw: bytes) -> list[int]:
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
        rolling = np.zeros(len(b), dtype=np.uint64)
        for k in range(min(16, len(b))):  # a window of 16 bytes
            rolling[k:] += b[: len(b) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        ends = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64((1 << mask_bits) - 1) == 0) + 1
        out, at = [], 0
        for e in ends.tolist():
            while e - at > most:
                at += most
                out.append(at)
            if e - at >= least:
                at = e
                out.append(at)
        while len(raw) - at > most:
            at += most
            out.append(at)
        return out + ([len(raw)] if at < len(raw) else [])

    def run(batches):
        for batch in batches:
            got: list[tuple] = []
            for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                raw, at = (t or "").encode(), 0
                for place, end in enumerate(cuts(raw)):
                    got.append((k, place, end - at, hashlib.sha256(raw[at:end]).hexdigest()))
                    at = end
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch[0].type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["key", "place", "size", "digest"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"key {kind}, place long, size long, digest string")


def select_tables(rows: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), keys: DataFrame | None = None) -> DataFrame:
    """Selective restore of rows (table, key, ...): chosen tables, without others,
    and only the given keys (table, key)."""
    out = rows
    if include is not None:
        out = out.where(F.col("table").isin(*include))
    if exclude:
        out = out.where(~F.col("table").isin(*exclude))
    return out.join(keys, ["table", "key"], "left_semi") if keys is not None else out
