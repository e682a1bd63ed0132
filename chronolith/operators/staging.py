"""Bulk loads from CSV: lines are staged or rejected, and unique keys checked before anything is added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources import files
from chronolith.sources.scratch import scratch


class NotUnique(ValueError):
    """Rows of a batch clash with one another or with stored ones."""


def stage_csv(spark: SparkSession, path: str, schema: str, required: list[str], header: bool = False, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(staged, rejected) of CSV files read with a fixed ``schema`` (DDL).

    A line that doesn't fit the schema is rejected as ``malformed``, one without a ``required`` value as ``missing``;
    rejected rows are (line, reason, file), and ``line`` is null for the latter. Files are read once.
    """
    columns = [part.strip().split()[0] for part in schema.split(",")]
    raw = spark.read.schema(f"{schema}, _line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("header", header).option("sep", sep).csv(path)
    at = scratch(spark, "staged")
    raw.withColumn("_file", F.input_file_name()).write.parquet(at)
    seen = spark.read.schema(f"{schema}, _line string, _file string").parquet(at)
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reason = F.when(F.col("_line").isNotNull(), "malformed").when(missing, "missing")
    judged = seen.withColumn("_reason", reason)
    return judged.where("_reason is null").select(*columns), judged.where("_reason is not null").select(F.col("_line").alias("line"), F.col("_reason").alias("reason"), F.col("_file").alias("file"))


def clashes(staged: DataFrame, stored: DataFrame | None, unique: list[str]) -> DataFrame:
    """(unique columns, stored): values that a batch has more than once, or that are stored already.

    A null in any of the columns clashes with nothing. Of the stored table only rows between the batch's least and greatest
    first value are read, and those go through Spark's runtime Bloom filter of the batch where that pays off.
    """
    keys = staged.select(*unique).dropna()
    own = keys.groupBy(*unique).agg(F.count("*").alias("_n")).where("_n > 1").select(*unique, F.lit(False).alias("stored"))
    if stored is None:
        return own
    low, high = keys.agg(F.min(unique[0]), F.max(unique[0])).first()
    if low is None:
        return own
    near = stored.where(F.col(unique[0]).between(F.lit(low), F.lit(high))).select(*unique)
    return own.unionByName(near.join(keys, unique, "left_semi").distinct().withColumn("stored", F.lit(True)))


def insert_unique(staged: DataFrame, path: str, unique: list[str]) -> int:
    """Adds a batch to the Parquet table at ``path``; how many rows there were. A clash is an error, and nothing is written then.

    ``staged`` is computed more than once, so it should be a stored table such as ``stage_csv``'s.
    """
    spark = staged.sparkSession
    stored = spark.read.schema(staged.schema).parquet(path) if files.exists(spark, path) else None
    bad = clashes(staged, stored, unique).take(3)
    if bad:
        raise NotUnique("; ".join(f"{ {c: r[c] for c in unique} } {'is stored already' if r.stored else 'occurs more than once'}" for r in bad))
    n = staged.count()
    staged.write.mode("append").parquet(path)
    return n
