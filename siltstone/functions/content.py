"""Content measures: entropy, kinds of data, storage tiers, bloom filters.

All are expressions on columns; only the measures of a text's characters are
taken in Python, by batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the classifier.
ENTROPY_CUT, TEXT_CUT, JSON_CUT, NUMERIC_CUT = 7.5, 0.8, 0.1, 0.6
#: Fixed values of the tiers: name, least and largest hotness, cost per GB, read latency (us).
TIERS = (("hot", 75.0, 100.0, 0.25, 50.0), ("warm", 25.0, 75.0, 0.10, 200.0), ("cold", 0.0, 25.0, 0.023, 5000.0))
#: Data moves from hot below 50, from warm above 80 or below 10, from cold above 30.
HOT_DOWN, WARM_UP, WARM_DOWN, COLD_UP = 50.0, 80.0, 10.0, 30.0


def entropy(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, entropy): Shannon bits per byte of a string's bytes, through a grouped
    count of distinct bytes per row."""
    bytes_ = F.sequence(F.lit(0), F.octet_length(data) - 1)
    each = rows.where(F.octet_length(data) > 0).select(key, F.octet_length(data).alias("n"), F.explode(F.transform(bytes_, lambda i: F.substring(F.hex(F.encode(data, "UTF-8")), i * 2 + 1, F.lit(2)))).alias("b"))
    counts = each.groupBy(key, "n", "b").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy(key).agg((-F.sum(p * F.log2(p))).alias("entropy"))


_MEASURES = "chars bigint, bits double, printable bigint, json_marks bigint, numeric bigint"
_CLASSES = [np.array([ord(c) for c in chars]) for chars in ("".join(map(chr, range(0x20, 0x7F))) + "\t\n\r", '{}[]":,', "0123456789.-+eE")]


def _measure(data: bytes) -> tuple:
    """Characters of one text, bits each, and how many are in each of the classes."""
    if data.isascii():
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=128)
    else:
        codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        most = int(codes.max())
        if most < 1024 + 4 * len(codes):
            counts = np.bincount(codes, minlength=128)
        else:  # counts of the few high ones are put after those of the low ones
            counts = np.concatenate([np.bincount(codes[codes < 128], minlength=128), np.unique(codes[codes >= 128], return_counts=True)[1]])
    n, kinds = int(counts.sum()), counts[counts > 0]
    p = kinds / n if n else kinds
    return (n, float(-(p * np.log2(p)).sum()) if len(kinds) > 1 else 0.0, *(int(counts[c].sum()) for c in _CLASSES))


def measures(text: Column) -> Column:
    """(chars, bits, printable, json_marks, numeric) of a text: how many characters it
    has and their Shannon entropy, and how many are of each class; all from one count
    of its characters.  NULL for NULL."""

    def run(batch: pa.Array) -> pa.Array:
        coded = batch.cast(pa.binary()).dictionary_encode()  # texts that are equal are counted once
        found = [None if not v.is_valid else _measure(v.as_py()) for v in coded.dictionary]
        types = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _MEASURES.split(", ")]
        columns = [pa.array([r[i] for r in found], t).take(coded.indices) for i, t in enumerate(types)]
        return pa.StructArray.from_arrays(columns, names, mask=coded.indices.is_null())

    return F.arrow_udf(run, _MEASURES)(text)


def data_type(text: Column, found: Column) -> Column:
    """Mixed, Compressed, Json, Text, Numeric or Binary, by shares of characters;
    ``found`` are the text's measures."""
    n = found["chars"]
    printable, json_marks, numeric = (found[c] / n for c in ("printable", "json_marks", "numeric"))
    starts = F.substr(text, F.lit(1), F.lit(1)).isin("{", "[")
    return (
        F.when(n == 0, "Mixed")
        .when(found["bits"] > ENTROPY_CUT, "Compressed")
        .when((printable > TEXT_CUT) & starts & (json_marks > JSON_CUT), "Json")
        .when(printable > TEXT_CUT, "Text")
        .when(numeric > NUMERIC_CUT, "Numeric")
        .otherwise("Binary")
    )


def space_saved(original: Column, compressed: Column) -> Column:
    """Percent of the original size that compression saves; never below 0."""
    return F.when(original > 0, F.greatest(original - compressed, F.lit(0)) / original * 100.0).otherwise(0.0)


def efficiency(original: Column, compressed: Column, millis: Column) -> Column:
    """Share of the size saved per millisecond."""
    return F.when(millis > 0, (1.0 - compressed / original) / millis).otherwise(0.0)


def hotness(age_hours: Column, reads_per_hour: Column, writes_per_hour: Column) -> Column:
    recency = 100.0 * F.exp(-age_hours / 24.0)
    return 0.6 * recency + 0.4 * F.least(F.lit(100.0), reads_per_hour + 2.0 * writes_per_hour)


def tier(heat: Column) -> Column:
    """The tier whose range of hotness holds the value."""
    out = F
    for name, least, *_ in TIERS[:-1]:
        out = out.when(heat >= least, name)
    return out.otherwise(TIERS[-1][0])


def placement(heat: Column, reads_per_hour: Column, name: str) -> Column:
    """How well data fits a tier: 0.8 of the match of hotness, 0.2 of cost efficiency."""
    _, least, most, cost, latency = next(t for t in TIERS if t[0] == name)
    match = F.when(heat < least, 100.0 - (least - heat)).when(heat > most, 100.0 - (heat - most)).otherwise(100.0)
    worth = F.when(reads_per_hour > 0, 1.0 / (cost * latency)).otherwise(1.0 / cost)
    return match * 0.8 + F.least(worth, F.lit(20.0)) * 0.2


def migrate(current: Column, heat: Column) -> Column:
    """Where data goes next; between the thresholds it stays."""
    return (
        F.when((current == "hot") & (heat < HOT_DOWN), "warm")
        .when((current == "warm") & (heat > WARM_UP), "hot")
        .when((current == "warm") & (heat < WARM_DOWN), "cold")
        .when((current == "cold") & (heat > COLD_UP), "warm")
        .otherwise(current)
    )


def bloom_fpr(bits: Column, items: Column, hashes: Column) -> Column:
    return F.pow(1.0 - F.exp(-hashes * items / bits), hashes)


def bloom_bits(items: Column, rate: float) -> Column:
    return F.ceil(-items * math.log(rate) / math.log(2) ** 2)


def bloom_hashes(bits: Column, items: Column) -> Column:
    return F.greatest(F.lit(1), F.round(bits / items * math.log(2)).cast("long"))


def like_selectivity(pattern: Column) -> Column:
    """Expected share of rows of a LIKE pattern, by where its wildcards stand."""
    first, last = F.startswith(pattern, F.lit("%")), F.endswith(pattern, F.lit("%"))
    return F.when(first & last, 0.5).when(first, 0.25).when(last, 0.15).otherwise(0.05)
