"""Sets of whole numbers as bitmaps: one row for each 64 numbers of a key that hold any, as the bits of one long.

A set of any size is spread over its buckets, so it is built, joined and counted by all tasks, and never lies in one row. A
row is no larger than one of the numbers would be, so sets that hold few of many numbers cost no more than their numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: numbers of a bucket, as its bits are a long.
BITS = 64


def build(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, bucket, bits) of the numbers in ``index``; nulls are left out. Combined before the shuffle."""
    rows = df.where(F.col(index).isNotNull())
    number = F.col(index).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(BITS - 1)).cast("int"))
    return rows.groupBy(*keys, F.shiftright(number, 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def _together(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets)


def union(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """What is in any of the sets, key by key."""
    return _together(sets).groupBy(*keys, "bucket").agg(F.bit_or("bits").alias("bits"))


def intersection(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """What is in all of the sets, key by key; without the buckets that become empty."""
    met = _together(sets).groupBy(*keys, "bucket").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return met.where((F.col("_n") == len(sets)) & (F.col("bits") != 0)).drop("_n")


def sizes(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many numbers a set holds."""
    return sets.groupBy(*keys).agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))


def members(sets: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, index): one row for each number of a set."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.col("bits"), i) == 1))
    return sets.select(*keys, "bucket", bit.alias("_bit")).select(*keys, (F.col("bucket") * BITS + F.col("_bit")).alias(index))


def difference(sets: DataFrame, gone: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, index): the numbers of the first sets that aren't in the second."""
    both = sets.join(gone.withColumnRenamed("bits", "_gone"), [*keys, "bucket"], "left")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("long"))))
    return members(both.select(*keys, "bucket", left.alias("bits")).where("bits <> 0"), keys, index)
