"""Column statistics as queries: profiles, histograms, selectivity, cardinality.

Profiles and frequent values are one aggregation.  An equi-height histogram
needs ranks; ranks come from counts of distinct values, not from one global
sort, so the only ungrouped window runs over counts per range of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Selectivity where nothing is known.
DEFAULT_EQ, DEFAULT_RANGE, DEFAULT_UNKNOWN, DEFAULT_NULL = 0.1, 0.3, 0.5, 0.05
UNKNOWN_JOIN_ROWS = 1_000_000


def profile(df: DataFrame, column: str) -> DataFrame:
    """rows, nulls, null_fraction, distinct values, average length, least, largest."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.avg(c.isNull().cast("int")).alias("null_fraction"),
        F.count_distinct(c).alias("distinct_count"),
        F.avg(F.length(c.cast("string"))).alias("avg_length"),
        F.min(c.cast("string")).alias("min_value"),
        F.max(c.cast("string")).alias("max_value"),
    )


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def ranked(df: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """Distinct values with n and the rank of their first row, from 0.

    Values are cut into ranges at approximate quantiles; ranks run inside a range
    and start at the rows of the ranges before it, a sum over a few rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = [q for q in df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.01)] if ranges > 1 else []
    which = F.lit(0)
    for q in sorted(set(cuts)):
        which = which + (F.col("v") > q).cast("int")
    counts = counts.withColumn("r", which)
    inside = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("r").agg(F.sum("n").alias("t"))
    below = totals.alias("a").join(totals.alias("b"), F.col("b.r") < F.col("a.r"), "left").groupBy("a.r").agg(F.coalesce(F.sum("b.t"), F.lit(0)).alias("base"))
    return counts.join(F.broadcast(below), "r").select("v", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))


def histogram_equal_height(df: DataFrame, column: str, most: int = 256) -> DataFrame:
    """(bucket, boundary, n, distinct_n): buckets of rows div buckets rows each, of
    which the last takes the remainder; the boundary is a bucket's last value."""
    rows = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).first()[0]
    buckets = max(1, min(most, rows // 10))
    height = max(1, rows // buckets)
    values = ranked(df, column)
    bucket_of = lambda rank: F.least(F.floor(rank / height), F.lit(buckets - 1))
    first, last = bucket_of(F.col("first")), bucket_of(F.col("first") + F.col("n") - 1)
    parts = values.select("v", "n", "first", F.explode(F.sequence(first, last)).alias("bucket"))
    start = F.greatest(F.col("bucket") * height, F.col("first"))
    stop = F.least(F.when(F.col("bucket") == buckets - 1, F.lit(rows)).otherwise((F.col("bucket") + 1) * height), F.col("first") + F.col("n"))
    return parts.groupBy("bucket").agg(F.max("v").alias("boundary"), F.sum(stop - start).alias("n"), F.count(F.lit(1)).alias("distinct_n"))


def histogram_equal_width(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, low, high, n) with bins of equal width from least to largest."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    both = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / buckets
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(buckets - 1)))
    counts = both.select(bin_.cast("int").alias("bucket"), "lo", "hi").groupBy("bucket", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), "n")


def correlation(df: DataFrame, column: str, position: Column) -> DataFrame:
    """Pearson correlation of a column with its rows' position; 0 if undefined."""
    r = F.corr(F.col(column).cast("double"), position.cast("double"))
    return df.agg(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def selectivity_equals(histogram: DataFrame, value) -> DataFrame:
    """count / distinct / rows of the value's bucket: the first whose boundary is
    not below it, else the last."""
    total = histogram.agg(F.sum("n").alias("total"), F.max("bucket").alias("last"))
    own = histogram.where(F.col("boundary") >= F.lit(value)).agg(F.min("bucket").alias("b"))
    pick = total.crossJoin(own).select("total", F.coalesce("b", "last").alias("bucket"))
    return histogram.join(F.broadcast(pick), "bucket").select((F.col("n") / F.col("distinct_n") / F.col("total")).alias("selectivity"))


def selectivity_range(histogram: DataFrame, low=None, high=None) -> DataFrame:
    """Share of the rows in all buckets that a range touches, ends included."""
    ends = histogram.agg(
        F.sum("n").alias("total"),
        F.max("bucket").alias("last"),
        (F.min(F.when(F.col("boundary") >= F.lit(low), F.col("bucket"))) if low is not None else F.min("bucket")).alias("a"),
        (F.min(F.when(F.col("boundary") >= F.lit(high), F.col("bucket"))) if high is not None else F.max("bucket")).alias("z"),
    )
    both = histogram.crossJoin(F.broadcast(ends.select("total", F.coalesce("a", "last").alias("a"), F.coalesce("z", "last").alias("z"))))
    return both.where("bucket between a and z").groupBy("total").agg(F.sum("n").alias("n")).select((F.col("n") / F.col("total")).alias("selectivity"))


def selectivity_default(operator: str, distinct: Column | None = None, null_fraction: Column | None = None, values: int = 1) -> Column:
    """Selectivity without a histogram."""
    one = 1.0 / distinct if distinct is not None else F.lit(DEFAULT_EQ)
    match operator:
        case "eq":
            return one
        case "in":
            return F.least(one * values, F.lit(1.0))
        case "range" | "gt" | "lt":
            return F.lit(DEFAULT_RANGE)
        case "isnull":
            return null_fraction if null_fraction is not None else F.lit(DEFAULT_NULL)
        case "isnotnull":
            return 1.0 - (null_fraction if null_fraction is not None else F.lit(DEFAULT_NULL))
    return F.lit(DEFAULT_UNKNOWN)


def join_cardinality(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Estimated rows of an equi join: L * R * product of 1 / max(distinct)."""
    a = left.agg(F.count(F.lit(1)).alias("l"), *[F.count_distinct(x).alias(f"l{i}") for i, (x, _) in enumerate(keys)])
    b = right.agg(F.count(F.lit(1)).alias("r"), *[F.count_distinct(y).alias(f"r{i}") for i, (_, y) in enumerate(keys)])
    rows = F.col("l").cast("double") * F.col("r")
    for i in range(len(keys)):
        rows = rows / F.greatest(F.col(f"l{i}"), F.col(f"r{i}"))
    return a.crossJoin(b).select(F.floor(rows).cast("long").alias("estimated_rows"))
