"""Calendar segments as column expressions: half-open ranges [segment_from, segment_to).

Every segment lies in a calendar period of a larger unit (its parent) and starts a whole number of periods after it; the
last segment of a parent ends with the parent. Weeks count from the Monday on or before the start of the parent, and the
first segment of a year starts with the year. The unit ``ever`` is one segment for all times. A null time has a null
segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lengths in microseconds.
FIXED = {
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
#: Calendar lengths in months.
MONTHS = {"month": 1, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}
#: The larger unit that even multiples are aligned to, and how many of the unit it holds.
PARENTS = {
    "millisecond": ("second", 1000),
    "second": ("minute", 60),
    "minute": ("hour", 60),
    "hour": ("day", 24),
    "week": ("year", 52),
    "month": ("year", 12),
    "year": ("decade", 10),
    "decade": ("century", 10),
    "century": ("millennium", 10),
}


#: The bounds of all times.
EVER = ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")


@dataclass(frozen=True)
class Segments:
    """Periods of ``count`` ``unit``s. ``zone`` moves the calendar to another time zone; times stay as they are."""

    unit: str
    count: int = 1
    zone: str | None = None

    def __post_init__(self):
        if self.unit not in FIXED and self.unit not in MONTHS and self.unit != "ever":
            raise ValueError(f"unknown unit {self.unit!r}")
        if self.count < 1:
            raise ValueError("a period must be positive")

    @property
    def parent(self) -> str:
        if self.count == 1:
            return self.unit
        larger, held = PARENTS.get(self.unit, (None, 0))
        if larger and held % self.count == 0:
            return larger
        return self._parent_of_crooked()

    def _parent_of_crooked(self) -> str:
        if self.unit in MONTHS:
            return "century" if MONTHS[self.unit] * self.count < 12 else "millennium"
        length = FIXED[self.unit] * self.count
        for below, parent in ((10_000, "second"), (FIXED["second"], "minute"), (FIXED["minute"], "hour"), (FIXED["hour"], "day"), (FIXED["day"], "month"), (30 * FIXED["day"], "year"), (365 * FIXED["day"], "century")):
            if length < below:
                return parent
        return "millennium"

    def columns(self, ts: Column) -> tuple[Column, Column]:
        """(segment_from, segment_to) of ``ts``."""
        if self.unit == "ever":
            return tuple(F.when(ts.isNotNull(), F.lit(at).cast("timestamp_ntz")) for at in EVER)
        local = F.convert_timezone(F.lit("UTC"), F.lit(self.zone), ts.cast("timestamp_ntz")) if self.zone else ts
        start, end = self._local(local)
        if self.zone:
            start, end = (F.convert_timezone(F.lit(self.zone), F.lit("UTC"), c.cast("timestamp_ntz")) for c in (start, end))
        return start.cast("timestamp_ntz"), end.cast("timestamp_ntz")

    def _local(self, ts: Column) -> tuple[Column, Column]:
        parent = truncate(self.parent, ts)
        parent_end = add(self.parent, 1, parent)
        origin = F.date_trunc("week", parent) if self.unit == "week" else parent
        if self.unit in MONTHS and self.parent != self.unit:
            months = MONTHS[self.unit] * self.count
            passed = (F.year(ts) * 12 + F.month(ts)) - (F.year(origin) * 12 + F.month(origin))
            start = add("month", F.floor(passed / months).cast("int") * months, origin)
            end = add("month", months, start)
        elif self.parent == self.unit:
            return origin, add(self.unit, 1, origin)
        else:
            length = FIXED[self.unit] * self.count
            passed = F.floor(F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp")) / length).cast("long")
            start = F.timestamp_add("MICROSECOND", passed * length, origin)
            end = F.timestamp_add("MICROSECOND", F.lit(length), start)
        return F.greatest(start, parent), F.least(end, parent_end)


def truncate(unit: str, ts: Column) -> Column:
    """Start of the calendar unit of ``ts``."""
    if unit in ("decade", "century", "millennium"):
        years = MONTHS[unit] // 12
        return F.make_timestamp((F.floor(F.year(ts) / years) * years).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(unit, ts)


def add(unit: str, n: Column | int, ts: Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    if unit in MONTHS:
        return F.timestamp_add("MONTH", n * MONTHS[unit], ts)
    return F.timestamp_add("MICROSECOND", n.cast("long") * FIXED[unit], ts)
