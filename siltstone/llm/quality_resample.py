"""Quality classifier by importance resampling.

Two bag models of hashed n-grams, target and raw, give every document a log
importance weight: the mean over its n-grams of log(target) - log(raw), times
EFFECTIVE, and with PRIOR n-grams of ratio 0 added, so that a short text says
little.  A document so weighs as EFFECTIVE of its n-grams would, however long it is; sums over all n-grams differ by thousands, and against them the sampling
noise of about 1 would decide nothing.  The raw model counts all documents; the
target model counts a bounded sample of rows labelled as good (SAMPLE_DOCS, texts
up to SAMPLE_CHARS).

Gumbel noise is added to the log weights and the k largest are kept, which draws
k documents one after the other, without replacement, each time in proportion
to exp(log weight).  k is the number of documents whose weight is no more than SLACK
below the level that KEEP_GOOD of the sample reach, so it follows the corpus.  Documents as good as
the sample are drawn almost surely, much worse ones almost never, and those between
by chance, the more likely the larger their weight.

n-grams are words, pairs of words, and words that repeat 1 to 4 places on (one
n-gram for each distance), over runs of letters and digits or of punctuation.

The k-th largest value is found exactly by counting the digits of the scores
in millionths, most significant first: four small aggregations, and
no sort.  Equal scores at the border are all kept.

Nulls, ties and odd input: a null or empty text has weight 0; a null doc_id has
the noise of one fixed number; rows that repeat a doc_id have its noise, and a
repeated id does not make the sample larger; without labels for good documents the
target is the raw model and every weight 0, so all documents are kept; an empty
table gives an empty result; further columns are carried along unread whatever
their names: a result whose name is taken has underscores after it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.llm import _text as T
from siltstone.llm._blocks import free_name, plain_names
from siltstone.session import durable, tidy

BUCKETS = 10_000
LAGS = 4
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 50_000
EFFECTIVE, PRIOR = 10.0, 30
KEEP_GOOD = 0.9998
#: What an unlabelled good document may lie below the level of the labelled ones.
SLACK = 2.0
SMOOTH = 1.0
SEED = 42

#: 0 white space, 1 letters, digits and everything beyond ASCII, 2 punctuation
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[T.SPACE] = 0
CLASSES[0x80:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    CLASSES[_a:_b] = 1


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, where each row's n-grams begin) of a column."""
    w = T.Words(texts, classes=CLASSES)
    n, h = len(w.hash), w.hash
    one = (h % np.uint64(BUCKETS)).astype(np.int32)
    two = np.full(n, -1, np.int32)
    if n > 1:
        two[:-1] = np.where(T.inside(w.first, 2, n - 1), T.grams(h, 2) % np.uint64(BUCKETS), -1)
    parts = [one, two]
    row = w.row_of()
    for lag in range(1, LAGS + 1):
        same = np.full(n, -1, np.int32)
        if n > lag:
            same[:-lag][(h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])] = BUCKETS + lag - 1
        parts.append(same)
    # the n-grams that begin at one word stand together, so rows stay in order
    grid = np.stack(parts, axis=1) if n else np.zeros((0, 2 + LAGS), np.int32)
    real = grid >= 0
    begin = np.concatenate([[0], np.cumsum(real.sum(axis=1))])[w.first]
    return grid[real], begin


def counted(docs: DataFrame) -> np.ndarray:
    """n-gram counts over all rows: a sum per task, then one sum."""
    size = BUCKETS + LAGS

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for part in T.slices(b, "text"):
                total += np.bincount(features(part["text"])[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for bucket, n in docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    return share(target) - share(raw)


def weights(texts, ratios: np.ndarray) -> np.ndarray:
    """Log importance weight of every row."""
    f, begin = features(texts)
    total = np.concatenate([[0.0], np.cumsum(ratios[f])])
    mean = (total[begin[1:]] - total[begin[:-1]]) / (np.diff(begin) + PRIOR)
    return np.round(EFFECTIVE * mean, 6) + 0.0


def gumbel(ids: pa.Array, seed: int = SEED) -> np.ndarray:
    """Gumbel noise, a function of doc_id and the seed alone."""
    x = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False).view(np.uint64)
    u = (T.mix(T.mix(x ^ np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64)
    return np.round(-np.log(-np.log((u + 0.5) / 2.0**53)), 6)


def kth_largest(scores: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column (1: the largest), exactly."""
    if k <= 0:
        return None
    digits = [(F.shiftright(column, 16 * d).bitwiseAND(0xFFFF) if d < 3 else F.shiftright(column, 48)).cast("int").alias(f"d{d}") for d in (3, 2, 1, 0)]
    table = scores.select(*digits)
    value = 0
    for d in (3, 2, 1, 0):
        for digit, n in sorted(table.groupBy(f"d{d}").count().collect(), reverse=True):
            if k <= n:
                break
            k -= n
        else:
            return None
        table = table.where(F.col(f"d{d}") == digit)
        value = value * 65536 + digit
    return value


def good_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id and text of a bounded number of rows labelled as good."""
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(good), "doc_id")
    return durable(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample_docs))


def resample(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, sample_docs: int = SAMPLE_DOCS, seed: int = SEED) -> DataFrame:
    """docs with log_weight, perturbed (both in millionths, long) and kept as the last columns."""
    names = [*docs.columns, *(free_name(docs.columns, n) for n in ("log_weight", "perturbed", "kept"))]
    docs = docs.toDF(*plain_names(docs.columns))
    with tidy(docs.sparkSession):
        ratios, border = _drawn(docs, labels, keep_good, sample_docs, seed)
    # the documents are scored once more rather than shuffled to their scores
    drawn = F.lit(False) if border is None else F.col("perturbed") >= border
    return _scored(docs, ratios, seed).withColumn("kept", drawn).toDF(*names)


def _scored(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """docs with log_weight and perturbed in millionths."""

    def score(batches):
        millionths = lambda x: pa.array(np.clip(np.rint(x * 1e6), -9e18, 9e18).astype(np.int64))
        for batch in batches:
            for b in T.slices(batch, "text"):
                w = weights(b["text"], ratios)
                yield pa.RecordBatch.from_arrays([*b.columns, millionths(w), millionths(w + gumbel(b["doc_id"], seed))], names=[*b.schema.names, "log_weight", "perturbed"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("log_weight", LongType()), StructField("perturbed", LongType())]))


def _drawn(docs: DataFrame, labels: DataFrame, keep_good: float, sample_docs: int, seed: int) -> tuple[np.ndarray, int | None]:
    """The ratios of the two models, and the least perturbed weight that is drawn."""
    sample = good_sample(docs, labels, sample_docs)
    ratios = log_ratios(counted(sample), counted(docs))
    known = durable(_scored(sample, ratios, seed).select("log_weight"))
    n_known = known.count()
    # the level that keep_good of the good reach; it is one of their weights
    level = kth_largest(known, "log_weight", max(1, -int(-n_known * keep_good // 1))) if n_known else None
    plain = durable(_scored(docs.select("doc_id", "text"), ratios, seed).select("log_weight", "perturbed"))
    k = plain.where(F.col("log_weight") >= level - int(SLACK * 1e6)).count() if level is not None else plain.count()
    return ratios, kth_largest(plain, "perturbed", k)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    out = resample(docs, labels, **options)
    return out.where(out[out.columns[-1]]).select(*[out[f"`{c}`"] for c in docs.columns])


def op5_quality_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (F.col("log_weight") / 1e6).alias("log_weight"), (F.col("perturbed") / 1e6).alias("perturbed"), "kept")
