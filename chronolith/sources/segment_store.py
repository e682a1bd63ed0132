"""A stored series that is changed segment by segment, with a summary that answers what needs no rows.

Rows lie in one folder a segment, in files ordered by key and time. Beside them, a summary has one row for each key and
segment: how many rows, the first and the last of them. An update or a deletion rewrites the segments it touches, and their
summaries; all other files stay as they are. Counts, edges and most lookups come from the summary, and the rest reads the
segments that it names. Names of segments go through the driver, which lists the folders anyway.

``lock`` is there while a change is made. A change that was cut off leaves it behind, and ``repair`` brings the summary of
the segments in question in line with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series, as_of
from chronolith.sources import files
from chronolith.sources.scratch import scratch
from chronolith.sources.store import ROWS_PER_FILE, ranged, segment_name, validate


class Locked(RuntimeError):
    """Another change is under way, or one was cut off."""


@dataclass(frozen=True)
class SegmentStore:
    """The store at ``path`` of rows with the columns of ``schema`` (DDL, key, time and tie breaker of ``spec`` among them)."""

    path: str
    spec: Series
    segments: Segments
    schema: str

    @property
    def columns(self) -> list[str]:
        return [*self.kinds]

    @property
    def kinds(self) -> dict[str, str]:
        return dict(part.strip().split(" ", 1) for part in self.schema.split(", "))

    # ------------------------------------------------------------ reading

    def _read(self, spark: SparkSession, part: str, schema: str, names: list[str] | None) -> DataFrame:
        """A part of the store; only the folders of the named segments are listed and read."""
        base = f"{self.path}/{part}"
        if names is None:
            return files.stored(spark, base, schema)
        paths = [p for p in (f"{base}/segment={n}" for n in names) if files.exists(spark, p)]
        return spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def rows(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """All rows with their ``segment``, or those of the named segments."""
        return self._read(spark, "rows", f"{self.schema}, segment string", names)

    def summary(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """(key, segment_from, segment_to, n, first, last, low, high, segment) for each key and segment that has rows."""
        row = f"struct<{', '.join(f'{c}: {kind}' for c, kind in self.kinds.items())}>"
        time = self.kinds[self.spec.end]
        schema = f"{self.spec.key} {self.kinds[self.spec.key]}, segment_from timestamp_ntz, segment_to timestamp_ntz, n long, first {row}, last {row}, low {time}, high {time}, segment string"
        return self._read(spark, "summary", schema, names)

    # ------------------------------------------------------------ changing

    @contextmanager
    def _changing(self, spark: SparkSession) -> Iterator[None]:
        if not files.create_new(spark, f"{self.path}/lock"):
            raise Locked(f"{self.path} is being changed, or a change was cut off; repair() ends the latter")
        try:
            yield
        except BaseException:
            if not files.exists(spark, f"{self.path}/pending"):  # nothing has been changed yet
                files.remove(spark, f"{self.path}/lock")
            raise
        files.remove(spark, f"{self.path}/pending")
        files.remove(spark, f"{self.path}/lock")

    def _begin(self, spark: SparkSession, names: list[str]) -> None:
        """Notes the segments that are about to change."""
        spark.createDataFrame([(n,) for n in names], "segment string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pending")

    @staticmethod
    def _names(rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select("segment").distinct().collect())

    def _overwrite(self, df: DataFrame, part: str) -> None:
        """Replaces the folders of the segments that ``df`` has rows of; others stay untouched."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("segment").parquet(f"{self.path}/{part}")

    def _summarise(self, spark: SparkSession, names: list[str] | None) -> None:
        rows, order = self.rows(spark, names), F.struct(self.spec.end, self.spec.seq)
        low, high = self.segments.columns(F.col(self.spec.end))
        row = F.struct(*self.columns)
        held = rows.groupBy(self.spec.key, low.alias("segment_from"), high.alias("segment_to"), "segment").agg(F.count("*").alias("n"), F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
        held = held.withColumns({"low": F.col(f"first.{self.spec.end}"), "high": F.col(f"last.{self.spec.end}")})
        self._overwrite(held.select(*self.summary(spark).columns).hint("rebalance", "segment"), "summary")

    def write(self, df: DataFrame) -> None:
        """The first rows of a new store."""
        spark = df.sparkSession
        if files.exists(spark, f"{self.path}/rows"):
            raise FileExistsError(self.path)
        with self._changing(spark):
            self._begin(spark, [])
            self._overwrite(ranged(df.select(*self.columns), self.spec, self.segments), "rows")
            self._summarise(spark, None)

    def resume_points(self, spark: SparkSession) -> DataFrame:
        """(key, resume_at): the last time of each key, from the summary."""
        return self.summary(spark).groupBy(self.spec.key).agg(F.max("high").alias("resume_at"))

    def update(self, source: DataFrame) -> list[str]:
        """Takes the rows of ``source`` from each key's resume point on; returns the segments that were rewritten.

        Rows before it are skipped. If the source has rows at the resume point, they replace those stored there. The new
        rows' order is checked before anything is changed. Rows without a key or time are left out.
        """
        spark, spec = source.sparkSession, self.spec
        with self._changing(spark):
            path = scratch(spark, "fresh")
            fresh = spec.rows(source.select(*self.columns)).join(self.resume_points(spark), spec.key, "left").where(F.col("resume_at").isNull() | (F.col(spec.end) >= F.col("resume_at")))
            fresh.withColumn("segment", segment_name(self.segments, F.col(spec.end))).write.parquet(path)
            fresh = files.stored(spark, path, f"{self.schema}, resume_at {self.kinds[spec.end]}, segment string")
            validate(fresh, spec)
            names = self._names(fresh)
            if names:
                self._begin(spark, names)
                replaced = fresh.where(F.col(spec.end) == F.col("resume_at")).select(spec.key, spec.end).distinct()
                kept = self.rows(spark, names).join(replaced, [spec.key, spec.end], "left_anti")
                self._overwrite(ranged(kept.select(*self.columns).unionByName(fresh.select(*self.columns)), spec, self.segments), "rows")
                self._summarise(spark, names)
        return names

    def delete(self, keys: DataFrame) -> list[str]:
        """Removes the series of the keys in ``keys``; returns the segments that were rewritten or removed."""
        spark, key = keys.sparkSession, self.spec.key
        with self._changing(spark):
            gone = keys.select(key).distinct()
            held = self.summary(spark).select("segment", key)
            touched = held.join(gone.withColumn("_gone", F.lit(True)), key, "left").groupBy("segment").agg(F.bool_or(F.col("_gone").isNotNull()).alias("some"), F.bool_and(F.col("_gone").isNotNull()).alias("all")).where("some").collect()
            names, emptied = sorted(r.segment for r in touched), [r.segment for r in touched if r.all]
            rest = [n for n in names if n not in set(emptied)]
            self._begin(spark, names)
            if rest:
                self._overwrite(ranged(self.rows(spark, rest).join(gone, key, "left_anti").select(*self.columns), self.spec, self.segments), "rows")
                self._summarise(spark, rest)
            for name in emptied:
                for part in ("rows", "summary"):
                    files.remove(spark, f"{self.path}/{part}/segment={name}")
        return names

    def repair(self, spark: SparkSession) -> list[str]:
        """Ends a change that was cut off: the summary of its segments is made from their rows. Returns these segments.

        Spark replaces a folder when all its new files are written, so a segment is as before or as after the change; the
        same change can then be made again.
        """
        names = sorted(r[0] for r in files.stored(spark, f"{self.path}/pending", "segment string").collect())
        for name in names:
            files.remove(spark, f"{self.path}/summary/segment={name}")
        if names:
            self._summarise(spark, names)
        elif files.exists(spark, f"{self.path}/rows"):
            self._summarise(spark, None)  # the first write
        files.remove(spark, f"{self.path}/pending")
        files.remove(spark, f"{self.path}/lock")
        return names

    # ------------------------------------------------------------ what the summary answers

    def counts(self, spark: SparkSession, low=None, high=None) -> DataFrame:
        """(key, n) of the rows in a range. Segments that lie in it as a whole are counted by the summary; others are read."""
        key, end = self.spec.key, self.spec.end
        held = self.summary(spark)
        meets = whole = F.lit(True)
        if low is not None:
            meets, whole = meets & (F.col("high") >= low), whole & (F.col("low") >= low)
        if high is not None:
            meets, whole = meets & (F.col("low") <= high), whole & (F.col("high") <= high)
        known = held.where(whole).select(key, "n")
        if low is None and high is None:
            return known.groupBy(key).agg(F.sum("n").alias("n"))
        cut = held.where(meets & ~whole)
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(end) >= low)
        if high is not None:
            inside = inside & (F.col(end) <= high)
        # rows of a key that the summary has counted in that segment are left out
        read = self.rows(spark, self._names(cut)).where(inside).join(cut.select(key, "segment"), [key, "segment"], "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        return known.unionByName(read).groupBy(key).agg(F.sum("n").alias("n"))

    def edges(self, spark: SparkSession, columns: list[str]) -> DataFrame:
        """Per key the first and the last row's ``columns``, as first_* and last_*."""
        both = self.summary(spark).groupBy(self.spec.key).agg(F.min_by("first", "segment_from").alias("_f"), F.max_by("last", "segment_from").alias("_l"))
        return both.select(self.spec.key, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"_l.{c}").alias(f"last_{c}") for c in columns])

    def segment_counts(self, spark: SparkSession) -> DataFrame:
        """(key, segment_from, segment_to, rows_in_segment, preceding) of the segments that hold rows."""
        before = W.partitionBy(self.spec.key).orderBy("segment_from").rowsBetween(W.unboundedPreceding, -1)
        return self.summary(spark).select(self.spec.key, "segment_from", "segment_to", F.col("n").alias("rows_in_segment"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("preceding"))

    def latest(self, probes: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
        """``probes`` with the ``columns`` of the last row not after each; of the first row if all are later.

        The last segment that begins not after a probe holds its row: its last row, if that isn't after the probe, and else
        one that has to be read. A null time asks for the last row.
        """
        spark, spec = probes.sparkSession, self.spec
        held = self.summary(spark).select(spec.key, *[F.col(c).alias(f"_{c}") for c in ("segment", "low", "high", "first", "last")])
        met = ["_segment", "_low", "_high", "_first", "_last"]
        path = scratch(spark, "met")
        as_of(held, probes, (spec.key, "_low", "_segment"), (key, at), met, spec.bucket, fallback=True).write.parquet(path)
        found = spark.read.parquet(path)
        before, after = F.col("_low") > F.col(at), F.col(at).isNull() | (F.col("_high") <= F.col(at))
        known = found.where(F.col("_low").isNull() | before | after)
        row = F.when(before, F.col("_first")).otherwise(F.col("_last"))
        known = known.withColumn("_row", row).select(*probes.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])
        inner = found.where(~before & ~after).select(*probes.columns, "_segment")
        names = sorted(r[0] for r in inner.select("_segment").distinct().collect())
        if not names:
            return known
        read = as_of(spec.rows(self.rows(spark, names)), inner.select(*probes.columns), (spec.key, spec.end, spec.seq), (key, at), columns, spec.bucket)
        return known.unionByName(read)
