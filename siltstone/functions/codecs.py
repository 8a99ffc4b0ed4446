"""Key codecs as column expressions.

Composite keys join parts with a delimiter that is doubled inside parts; var-int
keys are LEB128; prefix keys strip a common prefix.  Only the decoding of a
composite with doubled delimiters needs Python, in Arrow batches.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def composite(parts: list[Column], delimiter: str = ":") -> Column:
    return F.concat_ws(delimiter, *[F.replace(p, F.lit(delimiter), F.lit(delimiter * 2)) for p in parts])


def split_plain(key: Column, delimiter: str = ":") -> Column:
    """Parts of a key that holds no doubled delimiter."""
    return F.split(key, re.escape(delimiter))


def split_composite(delimiter: str = ":"):
    """A function of a key column: its parts with doubled delimiters undone.  An
    empty part beside a delimiter cannot be told from a doubled one, as in any
    codec of this kind; parts are taken from the left."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(keys: pd.Series) -> pd.Series:
        mark = "\x00"
        return keys.map(lambda k: None if k is None else [p.replace(mark, delimiter) for p in k.replace(delimiter * 2, mark).split(delimiter)])

    return split


def varint_length(n: Column) -> Column:
    """Bytes of the LEB128 form of a non-negative long."""
    return reduce(lambda acc, k: acc.when(n < F.lit(1 << (7 * k)), k), range(1, 9), F).otherwise(9)


def varint_hex(n: Column) -> Column:
    """Hex digits of the LEB128 form, lowest seven bits first."""
    digits = F.transform(
        F.sequence(F.lit(0), varint_length(n) - 1),
        lambda i: F.lpad(
            F.hex(F.call_function("shiftrightunsigned", n, i * 7).bitwiseAND(F.lit(127)) + F.when(i < varint_length(n) - 1, 128).otherwise(0)), 2, "0"
        ),
    )
    return F.array_join(digits, "")


def varint_value(hex_digits: Column) -> Column:
    """The inverse of varint_hex."""
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(hex_digits) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(hex_digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.reverse(bytes_), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(F.lit(127)))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings; that of a set is that of its least
    and largest."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(a, k) == F.left(b, k))
    return F.left(a, F.array_max(same))


def common_prefix_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select(common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


def strip_prefix(key: Column, prefix: str, marker: str = "\xff") -> Column:
    """The key without the prefix; a key that lacks it is marked."""
    return F.when(F.startswith(key, F.lit(prefix)), F.substr(key, F.lit(len(prefix) + 1))).otherwise(F.concat(F.lit(marker), key))
