"""Segments of a series as a Spark source: a partition for each segment, filled by a function where the task runs.

The function gets the name and the bounds of one segment and gives its rows as Arrow record batches. Comparisons of the
time column with constants leave out segments that can't hold what they ask for; Spark applies them to the rows, too. What
goes wrong in a segment is raised with its name, and so is a row outside the bounds it was loaded for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


@dataclass(frozen=True)
class Segment(InputPartition):
    """Times from ``low`` up to ``high``, without it."""

    name: str
    low: datetime
    high: datetime


class SegmentError(RuntimeError):
    """A segment couldn't be loaded."""


Load = Callable[[Segment], Iterable[pa.RecordBatch]]


class _Reader(DataSourceReader):
    def __init__(self, end: str, needed: list[Segment], load: Load):
        self.end, self.needed, self.load = end, needed, load

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.end,) and isinstance(at, datetime):
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.needed = [s for s in self.needed if s.low <= at]
                if isinstance(f, LessThan):
                    self.needed = [s for s in self.needed if s.low < at]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.needed = [s for s in self.needed if s.high > at]
            yield f  # segments are left out, rows are for Spark to judge

    def partitions(self) -> list[Segment]:
        return self.needed

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        if segment is None:  # no segment is needed
            return
        where = f"segment {segment.name} [{segment.low}, {segment.high})"
        try:
            for batch in self.load(segment):
                times = batch.column(batch.schema.get_field_index(self.end))
                found = pc.min_max(times).as_py()
                if times.null_count or (len(times) and not (segment.low <= found["min"] and found["max"] < segment.high)):
                    raise ValueError(f"times from {found['min']} to {found['max']}, {times.null_count} of them null")
                yield batch
        except Exception as e:
            raise SegmentError(f"{where}: {type(e).__name__}: {e}") from e


def read_segments(spark: SparkSession, needed: Iterable[Segment], load: Load, schema: str, end: str, name: str = "segments") -> DataFrame:
    """The rows (columns of ``schema``, DDL) that ``load`` gives for the ``needed`` segments, read when they are asked for.

    ``end`` is the time column, without time zone, and null in no row. Without segments there are no rows. ``name`` is
    registered with the session. Predicates reach sources by a setting of the session, which this call switches on; sources
    in Python that take them are refused without it.
    """
    segments = list(needed)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _Reader(end, segments, load)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def stored_segments(path: str, columns: list[str]) -> Load:
    """Loads from a folder ``segment=name`` of Parquet files under ``path``, which executors must reach; none has no rows."""

    def load(segment: Segment) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset
        from pyarrow.fs import FileSystem, FileType, LocalFileSystem

        system, base = FileSystem.from_uri(path) if re.match(r"\w+:", path) else (LocalFileSystem(), path)
        folder = f"{base}/segment={segment.name}"
        if system.get_file_info(folder).type == FileType.Directory:
            yield from dataset.dataset(folder, filesystem=system, format="parquet").to_batches(columns=columns)

    return load
