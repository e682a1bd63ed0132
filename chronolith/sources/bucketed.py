"""Tables bucketed by key: a lookup reads its bucket alone, and a join shuffles only the other side.

Rows are dealt out once, when they are written, by the hash that Spark's joins use. Each bucket is one file, sorted by
``order``, so a point lookup also skips the row groups whose bounds exclude it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, name: str, keys: list[str], buckets: int, order: list[str] | None = None, path: str | None = None) -> None:
    """Writes the table ``name`` in ``buckets`` files, at ``path`` or in the warehouse."""
    dealt = df.repartition(buckets, *keys)  # the writer's own hash, so a task writes one bucket
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*(order or keys))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def get(spark: SparkSession, name: str, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the asked keys (null matches nothing). Asked keys go to the table's buckets; the table stays where it is."""
    return spark.table(name).join(asked.select(*keys).distinct(), keys, "left_semi")


def joined(spark: SparkSession, name: str, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``other`` with the table's rows of equal keys."""
    return other.join(spark.table(name), keys, how)


def point(spark: SparkSession, name: str, **key) -> DataFrame:
    """Rows of one key; with all bucketing columns given, one bucket is read."""
    rows = spark.table(name)
    for c, v in key.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows
