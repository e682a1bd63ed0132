"""Series on Parquet: validated, resumable writing in time-ordered files, and pruned reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series, violations
from chronolith.sources.scratch import scratch

#: Rows of a file at most.
ROWS_PER_FILE = 1_000_000


class OrderError(ValueError):
    """Rows to be written break the order of their series."""


def validate(df: DataFrame, spec: Series) -> None:
    bad = violations(df, spec).select(spec.key, spec.end, "previous_end").take(3)
    if bad:
        raise OrderError(f"{len(bad)} or more rows out of order, such as {bad[0].asDict()}")


def segment_name(segments: Segments, at: Column) -> Column:
    """The folder's name of the segment of a time; names sort as segments do."""
    return F.date_format(segments.columns(at)[0], "yyyy-MM-dd'T'HHmmss")


def ranged(df: DataFrame, spec: Series, segments: Segments) -> DataFrame:
    """Rows with their ``segment``, ordered in ranges of (segment, key, time), which spread a hot key over many tasks."""
    rows = spec.rows(df).withColumn("segment", segment_name(segments, F.col(spec.end)))
    return rows.repartitionByRange("segment", spec.key, spec.end).sortWithinPartitions("segment", spec.key, spec.end, spec.seq)


def _save(ranged: DataFrame, path: str, mode: str) -> None:
    ranged.write.mode(mode).partitionBy("segment").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def write(df: DataFrame, spec: Series, segments: Segments, path: str, mode: str = "append") -> None:
    """Ordered files in one folder a segment."""
    _save(ranged(df, spec, segments), path, mode)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resume_points(stored: DataFrame, spec: Series) -> DataFrame:
    """(key, resume_at): rows of a source before it are there already."""
    return stored.groupBy(spec.key).agg(F.max(spec.end).alias("resume_at"))


def resumed(stored: DataFrame, source: DataFrame, spec: Series) -> DataFrame:
    """The stored rows before each key's resume point and the source's rows from it on.

    Rows at the resume point are taken from the source if it has any of the key from there on, so equal times come once.
    """
    points = resume_points(stored, spec)
    fresh = source.join(points, spec.key, "left").where(F.col("resume_at").isNull() | (F.col(spec.end) >= F.col("resume_at"))).drop("resume_at")
    replaced = fresh.join(points, spec.key).where(F.col(spec.end) == F.col("resume_at")).select(F.col(spec.key), F.col("resume_at").alias(spec.end)).distinct()
    kept = stored.join(replaced, [spec.key, spec.end], "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def update(stored: DataFrame, load: Callable[[DataFrame], DataFrame], spec: Series) -> DataFrame:
    """Ask ``load`` for rows from the resume points on, check their order and add them."""
    points = resume_points(stored, spec)
    fresh = load(points)
    validate(fresh, spec)
    return resumed(stored, fresh, spec)


def until(df: DataFrame, spec: Series, limit) -> DataFrame:
    """A snapshot that ends at ``limit``."""
    return df.where(F.col(spec.end) <= limit)


def write_counted(df: DataFrame, spec: Series, segments: Segments, path: str, mode: str = "append") -> dict:
    """``write``, and what it wrote: rows, first and last time, counted while writing."""
    seen = Observation()  # behind the ranges, as finding their bounds reads the rows, too
    counted = ranged(df, spec, segments).observe(seen, F.count(F.lit(1)).alias("rows"), F.min(spec.end).alias("first"), F.max(spec.end).alias("last"))
    _save(counted, path, mode)
    return seen.get


def progress(df: DataFrame, spec: Series, low, high) -> DataFrame:
    """Per key: rows, first and last time, and the percentage of the time from ``low`` to ``high`` that is reached."""
    seconds = lambda a, b: F.timestamp_diff("SECOND", a.cast("timestamp"), b.cast("timestamp"))
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (low, high))
    done = spec.rows(df).groupBy(spec.key).agg(F.count("*").alias("rows"), F.min(spec.end).alias("first"), F.max(spec.end).alias("last"))
    share = F.round(100.0 * seconds(low, F.col("last")) / seconds(low, high), 6)
    return done.withColumn("percent", F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))


def gaps(df: DataFrame, spec: Series, expected, seconds: int = 365 * 86_400) -> DataFrame:
    """(key, last, missing_seconds) of the series that end more than ``seconds`` before the ``expected`` time."""
    ends = spec.rows(df).groupBy(spec.key).agg(F.max(spec.end).alias("last"))
    missing = F.timestamp_diff("SECOND", F.col("last").cast("timestamp"), F.lit(expected).cast("timestamp"))
    return ends.withColumn("missing_seconds", missing).where(F.col("missing_seconds") > seconds)


def append_rows(df: DataFrame, path: str, seq: str) -> None:
    """Adds rows to a collection on disk, each with its number ``seq`` from the caller, in files sorted by it."""
    df.sortWithinPartitions(seq).write.mode("append").parquet(path)


def iterate(spark: SparkSession, path: str, seq: str, reverse: bool = False) -> DataFrame:
    """A collection on disk in the order of its rows' numbers, or backwards."""
    return spark.read.parquet(path).orderBy(F.desc(seq) if reverse else F.asc(seq))


def without_series(df: DataFrame, spec: Series, keys: list) -> DataFrame:
    """All but the series of these keys."""
    return df.where(~F.coalesce(F.col(spec.key).isin(keys), F.lit(False)))


def with_places(ordered: DataFrame, name: str, first: int = 0) -> DataFrame:
    """``ordered`` with ``name``, each row's place in the order in which it comes, from ``first``.

    The rows are written as they come, with the number of their task; tasks are counted and rows numbered within them.
    """
    spark = ordered.sparkSession
    path = scratch(spark, "places")
    ordered.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_nth")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_task").agg(F.count("*").alias("_c"))  # one row a task
    before = sizes.select("_task", F.coalesce(F.sum("_c").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1)) + first  # Spark's ids have the task above 33 bits
    return rows.join(F.broadcast(before), "_task").withColumn(name, place).drop("_task", "_nth", "_before")
