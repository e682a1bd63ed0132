"""Temporal lookups on keyed, time-ordered series, for many keys and probe times at once.

A series is all rows of one key, ordered by (end time, sequence number); equal times are allowed. Rows with a null key or a
null end time belong to no series. Every lookup comes from three counts of a probe (key, time d): ``lt`` rows before d,
``le`` rows not after d, ``n`` rows of the key. Counts are taken within calendar buckets of a key and added to the counts
of the buckets before, so that no task sorts a whole series however large one key is; the rows a lookup asks for are then
joined by (key, position), which spreads a hot key over all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows and probes that one task of an as-of lookup sorts, on average; beyond that, the shuffle gets more partitions.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class Series:
    """Columns of a series table: key, start and end time (start: the end time unless given), and the tie breaker."""

    key: str
    end: str
    seq: str
    start: str | None = None
    #: Calendar unit, or for numbers the width, whose rows of one key one task can sort; None: all rows of a key.
    bucket: str | int | None = "day"

    @property
    def begin(self) -> str:
        return self.start or self.end

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.key).isNotNull() & F.col(self.end).isNotNull())

    def __post_init__(self):
        if not self.seq:
            raise ValueError("a series needs a tie breaker for equal times")

    @property
    def order(self) -> list[Column]:
        return [F.col(self.key).asc(), F.col(self.end).asc(), F.col(self.seq).asc()]


def bucket_of(bucket: str | int | None, at: Column) -> Column:
    if bucket is None:
        return F.lit(0)
    return F.date_trunc(bucket, at) if isinstance(bucket, str) else F.floor(at / bucket)


def _bucket(spec: Series, ts: Column) -> Column:
    return bucket_of(spec.bucket, ts)


def _dealt(both: DataFrame, bucket: str | int | None) -> DataFrame:
    """Rows and probes with key and bucket (a null time's comes first) as structs.

    A struct with a null in it equals another one, so a plain join on both keeps nulls and the partitioning of the windows.
    """
    t = F.col("_t")
    return both.withColumns({"_k": F.struct("_k"), "_b": F.struct(t.isNotNull().alias("_timed"), bucket_of(bucket, t).alias("_at"))})


def _parts(both: DataFrame) -> int:
    """Partitions for ``both`` that leave TASK_ROWS rows to each; 0 if the session's are enough."""
    if both.isStreaming:
        return 0
    parts = math.ceil(both.count() / TASK_ROWS)
    return parts if parts > int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def _bases(counts: DataFrame) -> DataFrame:
    """(_k, _b, _c rows) with ``_base``, the rows of the key in earlier buckets, and ``_n``, all its rows."""
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("_k", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(W.partitionBy("_k")).alias("_n"))


def positions(df: DataFrame, spec: Series) -> DataFrame:
    """``df`` with ``position`` (from 0, per key) and ``series_rows`` (rows of the key)."""
    rows = spec.rows(df).withColumns({"_k": F.col(spec.key), "_b": _bucket(spec, F.col(spec.end))})
    bases = _bases(rows.groupBy("_k", "_b").agg(F.count("*").alias("_c")))
    local = F.row_number().over(W.partitionBy("_k", "_b").orderBy(spec.end, spec.seq))
    placed = rows.withColumn("_local", local).join(bases, ["_k", "_b"])
    return placed.withColumns({"position": F.col("_base") + F.col("_local") - 1, "series_rows": F.col("_n")}).drop("_k", "_b", "_base", "_n", "_local")


def locate(df: DataFrame, spec: Series, probes: DataFrame, key: str, at: str) -> DataFrame:
    """``probes`` with ``lt``, ``le`` and ``n``. A null time lies after all rows; a null or unknown key has n = 0."""
    ts = F.col(at)
    rows = spec.rows(df).select(F.col(spec.key).alias("_k"), F.col(spec.end).alias("_t"), F.lit(1).alias("_row"))
    kept = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    asked = probes.select(F.col(key).alias("_k"), ts.alias("_t"), F.lit(0).alias("_row"), kept.alias("_probe"))
    both = _dealt(rows.unionByName(asked, allowMissingColumns=True), spec.bucket)
    bases = _bases(both.groupBy("_k", "_b").agg(F.sum("_row").alias("_c")))
    in_bucket = W.partitionBy("_k", "_b").orderBy("_t")
    counted = both.withColumns(
        {
            "_le": F.sum("_row").over(in_bucket.rangeBetween(W.unboundedPreceding, W.currentRow)),
            "_eq": F.sum("_row").over(W.partitionBy("_k", "_b", "_t")),
        }
    ).where("_row = 0")
    other = bases.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), "_base", "_n")
    found = counted.join(other, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    timeless = F.col("_t").isNull()
    le = F.when(timeless, F.col("_n")).otherwise(F.col("_base") + F.col("_le"))
    lt = F.when(timeless, F.col("_n")).otherwise(F.col("_base") + F.col("_le") - F.col("_eq"))
    return found.select("_probe.*", lt.alias("lt"), le.alias("le"), F.col("_n").alias("n"))


def as_of(rows: DataFrame, probes: DataFrame, on: tuple[str, str, str], at: tuple[str, str], columns: list[str], bucket, forward: bool = False, fallback: bool = False) -> DataFrame:
    """``probes`` with the ``columns`` of the last row not after each (``forward``: of the first row not before it).

    ``on`` names key, order and tie breaker of ``rows`` (a null order comes first), ``at`` key and order of ``probes``; a
    null order asks for the last row. Of equal rows the last counts (forward: the first). Without a row there is nothing,
    or with ``fallback`` the first row of the key (forward: the last).

    Rows are shuffled once, with the probes, by key and bucket; a bucket's outermost row is carried over to the next ones,
    one row for each key and bucket. Both are counted first, so that what a task sorts doesn't grow with the tables.
    """
    key, order, tie = on
    kept = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_t"), F.col(tie).alias("_s"), F.lit(0).alias("_asks"), F.struct(*columns).alias("_row"))
    asked = probes.select(F.col(at[0]).alias("_k"), F.col(at[1]).alias("_t"), F.lit(1).alias("_asks"), kept.alias("_probe"))
    both = known.unionByName(asked, allowMissingColumns=True)
    parts, both = _parts(both), _dealt(both, bucket)
    both = both.repartition(parts, "_k", "_b") if parts else both
    rank = F.when(F.col("_asks") == 0, F.struct(F.col("_t").isNotNull(), "_t", "_s"))
    ends = both.groupBy("_k", "_b").agg(F.min_by("_row", rank).alias("_low"), F.max_by("_row", rank).alias("_high"))
    ends = ends.repartition(parts, "_k") if parts else ends
    up, down = W.partitionBy("_k").orderBy(F.asc("_b")), W.partitionBy("_k").orderBy(F.desc("_b"))
    whole = (W.unboundedPreceding, W.unboundedFollowing)
    carried = F.last("_low" if forward else "_high", True).over((down if forward else up).rowsBetween(W.unboundedPreceding, -1))
    least, most = F.first("_low", True).over(up.rowsBetween(*whole)), F.last("_high", True).over(up.rowsBetween(*whole))
    outer = ends.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), carried.alias("_carried"), least.alias("_least"), most.alias("_most"))
    near = W.partitionBy("_k", "_b").orderBy(*([F.desc_nulls_last("_t"), "_asks", F.desc("_s")] if forward else [F.asc_nulls_first("_t"), "_asks", "_s"]))
    seen = both.withColumn("_near", F.last("_row", True).over(near.rowsBetween(W.unboundedPreceding, W.currentRow))).where("_asks = 1")
    found = seen.join(outer, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    row = F.coalesce("_near", "_carried", *(["_most" if forward else "_least"] if fallback else []))
    row = F.when(F.col("_t").isNull(), F.col("_most")).otherwise(row)
    return found.withColumn("_got", row).select("_probe.*", *[F.col(f"_got.{c}").alias(c) for c in columns])


def latest(df: DataFrame, spec: Series, probes: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``probes`` with the ``columns`` of the last row not after each; of the first row if all are later."""
    return as_of(spec.rows(df), probes, (spec.key, spec.end, spec.seq), (key, at), columns, spec.bucket, fallback=True)


def same_value(df: DataFrame, spec: Series, value: str, low, high) -> DataFrame:
    """(key, value, time): the last time in a range at which a series has the value."""
    rows = spec.rows(df).where(F.col(spec.end).between(low, high))
    return rows.groupBy(spec.key, value).agg(F.max(spec.end).alias(spec.end))


def adjusted(probes: DataFrame, at: str, highest) -> DataFrame:
    """Probes beyond the highest allowed time ask for that time."""
    return probes.withColumn(at, F.least(at, F.lit(highest).cast("timestamp_ntz")))


def latest_position() -> Column:
    """Of the last row not after the probe; of the first row if all are later. Null for an empty series."""
    return F.when(F.col("n") > 0, F.greatest(F.lit(0), F.col("le") - 1))


def previous_position(shift: int) -> Column:
    """Of the row ``shift`` rows back, but not before the first. Without a row before the probe: the first."""
    if shift < 0:
        raise ValueError("a shift must not be negative")
    exact = F.col("le") > F.col("lt")
    back = F.greatest(F.lit(0), F.col("le") - 1 - shift)
    if shift == 1:
        back = F.when(exact, F.greatest(F.lit(0), F.col("lt") - 1)).otherwise(back)
    return F.when(F.col("n") > 0, F.when(F.col("lt") == 0, F.lit(0)).otherwise(back))


def next_position(shift: int) -> Column:
    """Of the row ``shift`` rows on, but not after the last. Without a row after the probe: the last."""
    if shift < 0:
        raise ValueError("a shift must not be negative")
    p = F.when(F.col("le") > F.col("lt"), F.col("le") - 1).otherwise(F.col("le"))
    return F.when(F.col("n") > 0, F.least(F.col("n") - 1, p + shift))


def clamped_position(index: str) -> Column:
    """A position asked for, moved into the series."""
    return F.when(F.col("n") > 0, F.least(F.greatest(F.col(index).cast("long"), F.lit(0)), F.col("n") - 1))


def fetch(df: DataFrame, spec: Series, located: DataFrame, key: str, position: Column, columns: list[str], how: str = "left") -> DataFrame:
    """``located`` with ``position`` and the ``columns`` of the row there (null without one)."""
    rows = positions(df, spec).select(F.col(spec.key).alias("_k"), F.col("position").alias("_p"), *columns)
    asked = located.withColumn("position", position)
    return asked.join(rows, (asked[key] == rows["_k"]) & (asked["position"] == rows["_p"]), how).drop("_k", "_p")


def at_index(df: DataFrame, spec: Series, probes: DataFrame, key: str, index: str, columns: list[str]) -> DataFrame:
    """Rows at positions moved into the series."""
    counts = spec.rows(df).groupBy(F.col(spec.key).alias("_kk")).agg(F.count("*").alias("n"))
    located = probes.join(counts, probes[key] == F.col("_kk"), "left").drop("_kk").fillna({"n": 0})
    return fetch(df, spec, located, key, clamped_position(index), columns)


def neighbours(df: DataFrame, spec: Series, located: DataFrame, key: str, before: int, columns: list[str]) -> DataFrame:
    """The last ``before`` rows not after each probe (negative: the first ``-before`` rows not before it), one per row.

    Nothing is repeated at the edges of a series: a probe has as many rows as there are.
    """
    low, high = (F.greatest(F.lit(0), F.col("le") - before), F.col("le") - 1) if before > 0 else (F.col("lt"), F.least(F.col("n"), F.col("lt") - before) - 1)
    asked = located.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    asked = asked.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    return fetch(df, spec, asked, key, F.col("_at"), columns, "inner").drop("_low", "_high", "_at")


def range_rows(df: DataFrame, spec: Series, low=None, high=None, key=None, reverse: bool = False) -> DataFrame:
    """Rows with low <= end time <= high (None: open), in order, or the newest first."""
    rows = spec.rows(df)
    if key is not None:
        rows = rows.where(F.col(spec.key) == key)
    if low is not None:
        rows = rows.where(F.col(spec.end) >= low)
    if high is not None:
        rows = rows.where(F.col(spec.end) <= high)
    order = [F.col(spec.key), F.col(spec.end).desc(), F.col(spec.seq).desc()] if reverse else spec.order
    return rows.orderBy(*order)


def counts(df: DataFrame, spec: Series, low=None, high=None) -> DataFrame:
    """(key, n) of the rows in a range; keys without rows there are absent."""
    rows = spec.rows(df)
    if low is not None:
        rows = rows.where(F.col(spec.end) >= low)
    if high is not None:
        rows = rows.where(F.col(spec.end) <= high)
    return rows.groupBy(spec.key).agg(F.count("*").alias("n"))


def edges(df: DataFrame, spec: Series, columns: list[str]) -> DataFrame:
    """Per key the first and the last row's ``columns``, as first_* and last_*; combined before the shuffle."""
    order = F.struct(spec.end, spec.seq)
    row = F.struct(*columns)
    both = spec.rows(df).groupBy(spec.key).agg(F.min_by(row, order).alias("_f"), F.max_by(row, order).alias("_l"))
    return both.select(spec.key, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"_l.{c}").alias(f"last_{c}") for c in columns])


def violations(df: DataFrame, spec: Series, chunk: int = 1_000_000) -> DataFrame:
    """Rows that break the order: a start after its end, or before the end of the row written before (``previous_end``).

    ``seq`` (a whole number) is the order of writing; one task compares the rows of one key in ``chunk`` numbers.
    """
    rows = spec.rows(df).withColumns({"_k": F.col(spec.key), "_b": F.floor(F.col(spec.seq) / chunk)})
    ends = rows.groupBy("_k", "_b").agg(F.max_by(spec.end, spec.seq).alias("_last"))
    carried = ends.select("_k", "_b", F.lag("_last").over(W.partitionBy("_k").orderBy("_b")).alias("_carried"))
    before = F.lag(spec.end).over(W.partitionBy("_k", "_b").orderBy(spec.seq))
    checked = rows.withColumn("_before", before).join(carried, ["_k", "_b"]).withColumn("previous_end", F.coalesce("_before", "_carried"))
    return checked.where((F.col(spec.begin) > F.col(spec.end)) | (F.col(spec.begin) < F.col("previous_end"))).drop("_k", "_b", "_before", "_carried")


def series_states(df: DataFrame, spec: Series, keys: DataFrame | None = None) -> DataFrame:
    """Per key (of ``keys``, if given, with or without rows): rows, violations, whether the series is empty or inconsistent."""
    bad = violations(df, spec).groupBy(spec.key).agg(F.count("*").alias("violations"))
    held = counts(df, spec)
    held = held if keys is None else keys.select(spec.key).distinct().join(held, spec.key, "left")
    n, wrong = (F.coalesce(c, F.lit(0)) for c in ("n", "violations"))
    return held.join(bad, spec.key, "left").select(spec.key, n.alias("n"), wrong.alias("violations"), (n == 0).alias("empty"), (wrong > 0).alias("inconsistent"))
