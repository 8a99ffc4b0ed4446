"""Documents in blocks of bounded size, and values that several blocks share.

A block is a hash class of documents with about BLOCK_MB of text, so that a
Python worker holds one block at a time whatever the size of the corpus; the
number of blocks follows the number of bytes.  Equal work in a block is done
once, and what a block sends out is distinct per block: a passage that a third
of all documents share costs one entry per block, not one per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_MB = 4


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores after it that no column has (columns compare without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def plain_names(columns: list[str]) -> list[str]:
    """doc_id and text, and numbered names for the rest, as Python functions over
    rows cannot take columns of any name; toDF() puts the names back."""
    return [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(columns)]


def in_blocks(docs: DataFrame, block_mb: float = BLOCK_MB) -> tuple[DataFrame, int]:
    """docs with their block first, and the number of blocks; one pass over the lengths."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-int((size["b"] or 0) + 64 * size["n"]) // int(block_mb * 1e6)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "block")]
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *others), blocks


#: Blocks whose values one range of hashes holds, and the ranges that small inputs are cut into.
BLOCKS_A_RANGE, LEAST_RANGES = 16, 48


def buckets_for(n_blocks: int) -> int:
    """Ranges of hashes in which the blocks' values meet: BLOCKS_A_RANGE blocks'
    worth each.  A block sends a row to each range, so n blocks send n * n /
    BLOCKS_A_RANGE rows, until rows hold one value each."""
    return max(1, min(n_blocks, LEAST_RANGES), n_blocks // BLOCKS_A_RANGE)


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in one fixed order, whatever order a shuffle gave them."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def by_bucket(block: int, values: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's sorted distinct values, cut into ranges of their hash space."""
    at = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    small = np.minimum(counts, 255).astype(np.uint8)
    rows = [(k, values[cut[k] : cut[k + 1]].tobytes(), small[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "block", "vals", "counts"],
    )


BUCKET_SCHEMA = "bucket int, block int, vals binary, counts binary"


def shared(spread: DataFrame, least_blocks: int, least_rows: int) -> DataFrame:
    """(block, vals, counts): of each block's values, those that occur in
    least_blocks blocks and least_rows rows at least, with their rows over all
    blocks (each block counts 255 at most)."""

    def meet(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        vals = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["vals"]]
        cnts = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table["counts"]]
        source = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(v) for v in vals])
        v, c = np.concatenate(vals), np.concatenate(cnts).astype(np.int64)
        order = np.argsort(v, kind="stable")
        v, c, source = v[order], c[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        rows, times = np.add.reduceat(c, first), np.diff(np.append(first, len(v)))
        keep = (rows >= least_rows) & (times >= least_blocks)
        each = np.repeat(keep, times)
        total = np.repeat(np.minimum(rows, 0xFFFFFFFF).astype(np.uint32), times)[each]
        v, source = v[each], source[each]
        order = np.argsort(source, kind="stable")  # values stay sorted within a block
        v, total, source = v[order], total[order], source[order]
        cut = np.searchsorted(source, np.arange(len(blocks) + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table(
            {
                "block": pa.array(blocks[some], pa.int32()),
                "vals": pa.array([v[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
                "counts": pa.array([total[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
            }
        )

    return spread.groupBy("bucket").applyInArrow(meet, "block int, vals binary, counts binary")


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What shared() gave for one block: sorted values and their rows."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    v = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["vals"]])
    c = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table["counts"]])
    order = np.argsort(v)
    return v[order], c[order]
