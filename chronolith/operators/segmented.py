"""Series cut into calendar segments: counts, prefix counts, lookups by global position, missing segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series, as_of

#: Positions of a key whose segments and probes meet in one task.
POSITIONS = 1_000_000


def segment_counts(df: DataFrame, spec: Series, segments: Segments) -> DataFrame:
    """(key, segment_from, segment_to, rows_in_segment, preceding) of the segments that hold rows."""
    low, high = segments.columns(F.col(spec.end))
    held = spec.rows(df).groupBy(spec.key, low.alias("segment_from"), high.alias("segment_to")).agg(F.count("*").alias("rows_in_segment"))
    before = W.partitionBy(spec.key).orderBy("segment_from").rowsBetween(W.unboundedPreceding, -1)
    return held.withColumn("preceding", F.coalesce(F.sum("rows_in_segment").over(before), F.lit(0)))


def segment_of_position(counted: DataFrame, spec: Series, probes: DataFrame, key: str, index: str) -> DataFrame:
    """``probes`` with the segment that holds a global position, and the place in it (inner: others fall away)."""
    held = ["segment_from", "segment_to", "rows_in_segment", "preceding"]
    found = as_of(counted, probes, (spec.key, "preceding", "segment_from"), (key, index), held, POSITIONS)
    place = F.col(index) - F.col("preceding")
    return found.where((place >= 0) & (place < F.col("rows_in_segment"))).withColumn("position_in_segment", place).drop("preceding", "rows_in_segment")


def enumerate_segments(windows: DataFrame, segments: Segments, low: str, high: str, max_steps: str = "1 day") -> DataFrame:
    """One row per segment that a row's [low, high] touches; ``max_steps`` must not exceed a segment's length.

    ``nth`` counts the segments of a row from 0 in ascending order, ``nth_back`` in descending order. Equal rows count once;
    a row without a low or high end touches nothing. Windows are shuffled, their segments aren't.
    """
    held = windows.where(F.col(low).isNotNull() & F.col(high).isNotNull()).distinct()
    steps = F.concat(F.sequence(F.col(low), F.col(high), F.expr(f"interval {max_steps}")), F.array(high))
    starts = F.array_distinct(F.transform(steps, lambda at: segments.columns(at)[0]))
    touched = held.withColumn("_starts", starts).select(*windows.columns, F.size("_starts").alias("_n"), F.posexplode("_starts").alias("nth", "segment_from"))
    end = segments.columns(F.col("segment_from"))[1]
    return touched.select(*windows.columns, "segment_from", end.alias("segment_to"), "nth", (F.col("_n") - 1 - F.col("nth")).alias("nth_back"))


def next_segment(segments: Segments, ts: Column) -> tuple[Column, Column]:
    """Bounds of the segment after that of ``ts``."""
    return segments.columns(segments.columns(ts)[1])


def previous_segment(segments: Segments, ts: Column) -> tuple[Column, Column]:
    """Bounds of the segment before that of ``ts``."""
    return segments.columns(F.timestamp_add("MICROSECOND", F.lit(-1), segments.columns(ts)[0]))


def missing_segments(needed: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Needed (key, segment_from, segment_to) that aren't complete, with or without rows."""
    done = status.where(F.col("status").isin("COMPLETE", "COMPLETE_EMPTY")).select(key, "segment_from")
    return needed.join(done, [key, "segment_from"], "left_anti")


def outside_segment(df: DataFrame, end: str, low: str, high: str) -> DataFrame:
    """Loaded rows whose time isn't in the segment they were loaded for."""
    return df.where((F.col(end) < F.col(low)) | (F.col(end) >= F.col(high)))


def ensure_segments(needed: DataFrame, status: DataFrame, key: str, load: Callable[[DataFrame], DataFrame], end: str) -> tuple[DataFrame, DataFrame]:
    """(rows, status): what ``load`` gives for the needed segments that aren't complete, and the status with them added.

    ``load`` takes (key, segment_from, segment_to) and returns rows that carry these; a row outside its segment is an
    error. A segment without rows becomes COMPLETE_EMPTY.
    """
    absent = missing_segments(needed, status, key)
    rows = load(absent)
    wrong = outside_segment(rows, end, "segment_from", "segment_to").take(1)
    if wrong:
        raise ValueError(f"a row outside the segment it was loaded for: {wrong[0].asDict()}")
    held = rows.groupBy(key, "segment_from").agg(F.count("*").alias("_n"))
    state = F.when(F.col("_n") > 0, "COMPLETE").otherwise("COMPLETE_EMPTY")
    fresh = absent.join(held, [key, "segment_from"], "left").select(key, "segment_from", "segment_to", state.alias("status"))
    rest = status.join(fresh, [key, "segment_from"], "left_anti")
    return rows, rest.unionByName(fresh.select(*status.columns))
