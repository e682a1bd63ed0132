"""Ordered (hash key, range key) tables and plain key tables as DataFrames: upserts, lookups, ranges, deletions.

A change set is a DataFrame with the table's columns, a version that orders changes, and ``deleted`` (true: the row goes).
A null range key is a key of its own and sorts first. For a plain map leave ``range_key`` out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.series import as_of


@dataclass(frozen=True)
class Table:
    hash_key: str
    range_key: str | None = None
    #: Calendar unit or width of range keys whose rows of one hash key one task can sort; None: all of a hash key.
    bucket: str | int | None = None

    @property
    def keys(self) -> list[str]:
        return [self.hash_key] + ([self.range_key] if self.range_key else [])

    def order(self, reverse: bool = False) -> list[Column]:
        return [F.col(self.hash_key).asc()] + [F.col(self.range_key).desc_nulls_last() if reverse else F.col(self.range_key).asc_nulls_first()]


def _matching(table: Table, a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for k in table.keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def apply_changes(changes: DataFrame, table: Table, version: str) -> DataFrame:
    """The rows that remain when all changes are applied in order of version; an aggregate, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in table.keys]
    last = changes.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    rows = last.select(*table.keys, "_r.*")
    return rows.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in rest else rows


def put(rows: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """Upsert: ``new`` (one row a key) replaces rows of equal keys."""
    return rows.join(new, _matching(table, rows, new), "left_anti").unionByName(new)


def put_if_absent(rows: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    return rows.unionByName(new.join(rows, _matching(table, new, rows), "left_anti"))


def get(rows: DataFrame, keys: DataFrame, table: Table) -> DataFrame:
    """Rows of the asked keys; both sides' null range keys match."""
    return rows.join(keys.select(*table.keys).distinct(), _matching(table, rows, keys), "left_semi")


def _values(rows: DataFrame, table: Table) -> list[str]:
    return [c for c in rows.columns if c != table.hash_key]


def last_rows(rows: DataFrame, table: Table) -> DataFrame:
    """Per hash key its row with the greatest range key."""
    rank = F.struct(F.col(table.range_key).isNotNull(), table.range_key)
    return rows.groupBy(table.hash_key).agg(F.max_by(F.struct(*_values(rows, table)), rank).alias("_r")).select(table.hash_key, "_r.*")


def first_rows(rows: DataFrame, table: Table) -> DataFrame:
    """Per hash key its row with the least range key; a null one comes first."""
    rank = F.struct(F.col(table.range_key).isNotNull(), table.range_key)
    return rows.groupBy(table.hash_key).agg(F.min_by(F.struct(*_values(rows, table)), rank).alias("_r")).select(table.hash_key, "_r.*")


def _near(rows: DataFrame, table: Table, probes: DataFrame, at: tuple[str, str], **how) -> DataFrame:
    return as_of(rows, probes, (table.hash_key, table.range_key, table.range_key), at, _values(rows, table), table.bucket, **how)


def latest(rows: DataFrame, table: Table, probes: DataFrame, hash_at: str, range_at: str) -> DataFrame:
    """``probes`` with the row of the greatest range key not above theirs, else the first row of the hash key."""
    return _near(rows, table, probes, (hash_at, range_at), fallback=True)


def previous(rows: DataFrame, table: Table, probes: DataFrame, hash_at: str, range_at: str) -> DataFrame:
    """``probes`` with the row of the greatest range key not above theirs (the floor), or nulls."""
    return _near(rows, table, probes, (hash_at, range_at))


def following(rows: DataFrame, table: Table, probes: DataFrame, hash_at: str, range_at: str) -> DataFrame:
    """``probes`` with the row of the least range key not below theirs (the ceiling), or nulls."""
    return _near(rows, table, probes, (hash_at, range_at), forward=True)


def contains_keys(rows: DataFrame, keys: DataFrame, table: Table) -> DataFrame:
    """Distinct asked keys with ``there``."""
    asked = keys.select(*table.keys).distinct()
    held = rows.select(*[F.col(k).alias(f"_{k}") for k in table.keys]).distinct().withColumn("_there", F.lit(True))
    on = F.lit(True)
    for k in table.keys:
        on = on & asked[k].eqNullSafe(held[f"_{k}"])
    return asked.join(held, on, "left").select(*table.keys, F.coalesce("_there", F.lit(False)).alias("there"))


def replace_if(rows: DataFrame, new: DataFrame, table: Table, value: str, expected: str) -> DataFrame:
    """Upsert of those of ``new`` whose ``expected`` equals the stored value (null: no row is stored)."""
    held = rows.select(*[F.col(k).alias(f"_{k}") for k in table.keys], F.col(value).alias("_held"))
    on = F.lit(True)
    for k in table.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    agreed = new.join(held, on, "left").where(F.col("_held").eqNullSafe(F.col(expected))).select(*rows.columns)
    return put(rows, agreed, table)


def append_only(rows: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """``new`` keys added to a table that forbids replacing: a key that is there is an error, found before anything is returned."""
    clash = new.join(rows, _matching(table, new, rows), "left_semi").take(1)
    if clash:
        raise ValueError(f"a key that is there already: {clash[0].asDict()}")
    return rows.unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, table: Table) -> DataFrame:
    return rows.join(keys, _matching(table, rows, keys), "left_anti")


def _within(table: Table, hash_key, low, high) -> Column:
    inside = F.lit(True) if hash_key is None else F.col(table.hash_key) == F.lit(hash_key)
    if low is not None:
        inside = inside & (F.col(table.range_key) >= F.lit(low))
    if high is not None:
        inside = inside & (F.col(table.range_key) <= F.lit(high))
    return F.coalesce(inside, F.lit(False))


def range_of(rows: DataFrame, table: Table, hash_key=None, low=None, high=None, reverse: bool = False) -> DataFrame:
    """Rows with low <= range key <= high (None: open) in order; reverse takes the greatest first."""
    return rows.where(_within(table, hash_key, low, high)).orderBy(*table.order(reverse))


def delete_range(rows: DataFrame, table: Table, hash_key, low=None, high=None) -> DataFrame:
    return rows.where(~_within(table, hash_key, low, high))


def remove_all(rows: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows whose key satisfies the predicate."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def get_or_load(rows: DataFrame, keys: DataFrame, table: Table, load: Callable[[DataFrame], DataFrame], value: str = "value") -> DataFrame:
    """``rows`` and what ``load`` finds for the asked keys that aren't there; null values aren't stored."""
    absent = keys.select(*table.keys).distinct().join(rows, _matching(table, keys, rows), "left_anti")
    return rows.unionByName(load(absent).where(F.col(value).isNotNull()))


def _not_older(at: Column, now: Column, seconds: int) -> Column:
    """Whether ``at`` lies at most ``seconds`` before ``now``, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", at.cast("timestamp"), now.cast("timestamp")) <= seconds * 1_000_000


def purge(rows: DataFrame, created: str, now: Column, seconds: int) -> DataFrame:
    """All rows, or none once the table's first row is older than ``seconds``: a table that expires as a whole."""
    first = rows.agg(F.min(created).alias("_first"))
    expired = first.where(_not_older(F.col("_first"), now, seconds)).isEmpty()
    return rows.limit(0) if expired else rows


def unexpired(rows: DataFrame, created: str, now: Column, every: str) -> DataFrame:
    """Rows made in the same calendar ``every`` (hour, day, month) as ``now``."""
    return rows.where(F.date_trunc(every, F.col(created)) == F.date_trunc(every, now))


def younger_than(rows: DataFrame, created: str, now: Column, seconds: int) -> DataFrame:
    """Rows not older than a fixed duration."""
    return rows.where(_not_older(F.col(created), now, seconds))


def contains_values(rows: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Distinct asked values (null included) with ``there``: whether any key has the value."""
    asked = values.select(value).distinct()
    held = rows.select(F.col(value).alias("_held")).distinct().withColumn("_there", F.lit(True))
    return asked.join(held, F.col(value).eqNullSafe(F.col("_held")), "left").select(value, F.coalesce("_there", F.lit(False)).alias("there"))


def remove_if(rows: DataFrame, expected: DataFrame, table: Table, value: str) -> DataFrame:
    """Without the keys of ``expected`` whose stored value is the one named there."""
    gone = expected.select(*[F.col(k).alias(f"_{k}") for k in table.keys], F.col(value).alias("_expected"))
    on = F.col(value).eqNullSafe(F.col("_expected"))
    for k in table.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(gone, on, "left_anti")


def compute(rows: DataFrame, keys: DataFrame, table: Table, value: str, new: Callable[[Column, Column], Column]) -> DataFrame:
    """The table after a new value is made for each asked key; a null one removes the key, or leaves it out.

    ``new`` gets the stored value (null without one) and whether the key is stored. ``rows`` holds keys and value only.
    """
    asked = keys.select(*[F.col(k).alias(f"_{k}") for k in table.keys]).distinct().withColumn("_asked", F.lit(True))
    on = F.lit(True)
    for k in table.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = rows.withColumn("_stored", F.lit(True)).join(asked, on, "full")
    stored, named = F.coalesce("_stored", F.lit(False)), F.coalesce("_asked", F.lit(False))
    made = F.when(named, new(F.col(value), stored)).otherwise(F.col(value))
    key_columns = [F.when(stored, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in table.keys]
    return both.select(*key_columns, made.alias(value), named.alias("_made")).where(F.col(value).isNotNull() | ~F.col("_made")).drop("_made")
