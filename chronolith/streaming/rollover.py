"""Closed live segments become history while the stream runs.

A sink for ``live_ingest``'s rows. The accepted rows of a micro-batch are added to the live table. A key whose newest row lies
in a later segment than its open one closes the latter: its rows go from the live table to history, and the status table
has it as COMPLETE; the new segment is the key's open one. Rejected rows are kept aside.

Each part of the tables that a micro-batch writes lies in folders of that batch's id, and the snapshot of open segments comes
last. So a batch that is run again, after a failure or by the engine's own doing, overwrites exactly what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources import files

STATUS = "key {key}, segment_from timestamp_ntz, n long, first_ts timestamp_ntz, last_ts timestamp_ntz, status string, segment string, batch long"
#: The batch id of ``finish``, beyond all of a stream.
LAST = (1 << 62) - 1


@dataclass(frozen=True)
class Rollover:
    """Tables below ``path`` for rows (key, seq, start_ts, end_ts, segment_from, value, status, rolled_over)."""

    path: str
    key: str = "long"
    value: str = "double"

    @property
    def _rows(self) -> str:
        return f"key {self.key}, seq long, start_ts timestamp_ntz, end_ts timestamp_ntz, segment_from timestamp_ntz, value {self.value}, segment string, batch long"

    def _table(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        return files.stored(spark, f"{self.path}/{part}", schema)

    def _segments(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """Live rows of the named segments, whose folders alone are read."""
        base = f"{self.path}/live"
        paths = [p for p in (f"{base}/segment={n}" for n in names) if files.exists(spark, p)]
        return spark.read.schema(self._rows).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], self._rows)

    def history(self, spark: SparkSession) -> DataFrame:
        """Rows of closed segments."""
        return self._table(spark, "history", self._rows)

    def status(self, spark: SparkSession) -> DataFrame:
        """(key, segment_from, n, first_ts, last_ts, status, segment, batch) of closed segments."""
        return self._table(spark, "status", STATUS.format(key=self.key))

    def rejected(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "rejected", f"{self._rows}, status string".replace("segment string, ", ""))

    def _snapshots(self, spark: SparkSession) -> list[int]:
        """Ids of the batches whose snapshot of open segments is complete."""
        ids = [int(f.split("=")[1]) for f in files.folders(spark, f"{self.path}/open")]
        return sorted(i for i in ids if files.exists(spark, f"{self.path}/open/batch={i}/_SUCCESS"))

    def _open_after(self, spark: SparkSession, batch_id: int | None) -> DataFrame:
        schema = f"key {self.key}, segment_from timestamp_ntz, segment string"
        return spark.createDataFrame([], schema) if batch_id is None else spark.read.schema(schema).parquet(f"{self.path}/open/batch={batch_id}")

    def open_segments(self, spark: SparkSession) -> DataFrame:
        """(key, segment_from, segment): each key's segment that is still live."""
        return self._open_after(spark, max(self._snapshots(spark), default=None))

    def live(self, spark: SparkSession) -> DataFrame:
        """Rows of open segments."""
        held = self.open_segments(spark)
        names = [r[0] for r in held.select("segment").distinct().collect()]  # folders at most
        return self._segments(spark, names).join(held.select("key", "segment_from"), ["key", "segment_from"], "left_semi")

    def persist(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        snapshots = self._snapshots(spark)
        if snapshots and snapshots[-1] == LAST:
            raise ValueError(f"{self.path} is finished")
        if snapshots and batch_id < snapshots[-1]:
            return  # written long ago
        times = {c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts", "segment_from")}
        plain = batch.withColumns(times).withColumn("segment", F.date_format("segment_from", "yyyy-MM-dd'T'HHmmss"))
        # the batch is computed once, by this write; all else reads what it has written
        plain.write.mode("overwrite").parquet(f"{self.path}/arrived/batch={batch_id}")
        arrived = spark.read.schema(plain.schema).parquet(f"{self.path}/arrived/batch={batch_id}").withColumn("batch", F.lit(batch_id))
        names = [part.split()[0] for part in self._rows.split(", ")]
        self._write(arrived.where("status = 'accepted'").select(*names).hint("rebalance", "segment"), "live", ["segment", "batch"])
        self._write(arrived.where("status <> 'accepted'").select(*[c for c in names if c != "segment"], "status"), "rejected", ["batch"])
        before = max((i for i in snapshots if i < batch_id), default=None)
        self._roll(spark, batch_id, before, arrived.where("status = 'accepted'").select("key", "segment_from", "segment").distinct())
        files.remove(spark, f"{self.path}/arrived/batch={batch_id}")
        self._clear(spark, before, snapshots)

    def finish(self, spark: SparkSession) -> None:
        """Closes the segments that are still open, when the stream has ended for good."""
        snapshots = [i for i in self._snapshots(spark) if i < LAST]
        if snapshots:
            self._roll(spark, LAST, snapshots[-1], None)

    def _write(self, df: DataFrame, part: str, by: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{part}")

    def _roll(self, spark: SparkSession, batch_id: int, before: int | None, seen: DataFrame | None) -> None:
        """Closes what lies before each key's newest segment, or everything without ``seen``."""
        known = self._open_after(spark, before)
        both = known if seen is None else known.unionByName(seen).distinct()
        newest = both.groupBy("key").agg(F.max_by(F.struct("segment_from", "segment"), "segment_from").alias("_n"))
        newest = newest.select("key", F.col("_n.segment_from").alias("_newest"), F.col("_n.segment").alias("_segment"))
        closed = known if seen is None else both.join(newest, "key").where("segment_from < _newest").select("key", "segment_from", "segment")
        names = sorted(r[0] for r in closed.select("segment").distinct().collect())  # folders at most
        if names:
            again = self._closed_before(spark, names, batch_id).join(closed, ["key", "segment_from"], "left_semi").take(1)
            if again:
                raise ValueError(f"a segment that is history already: {again[0].asDict()}")
            rows = self._segments(spark, names).where(F.col("batch") <= batch_id).drop("batch").join(closed.select("key", "segment_from"), ["key", "segment_from"], "left_semi")
            moved = rows.withColumn("batch", F.lit(batch_id).cast("long"))
            self._write(moved.select(*[part.split()[0] for part in self._rows.split(", ")]).repartitionByRange("segment", "key", "end_ts").sortWithinPartitions("segment", "key", "end_ts", "seq"), "history", ["segment", "batch"])
            done = rows.groupBy("key", "segment_from", "segment").agg(F.count("*").alias("n"), F.min("end_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))
            self._write(done.withColumns({"status": F.lit("COMPLETE"), "batch": F.lit(batch_id).cast("long")}).hint("rebalance", "segment"), "status", ["segment", "batch"])
        left = known.limit(0) if seen is None else newest.select("key", F.col("_newest").alias("segment_from"), F.col("_segment").alias("segment"))
        left.write.mode("overwrite").parquet(f"{self.path}/open/batch={batch_id}")

    def _closed_before(self, spark: SparkSession, names: list[str], batch_id: int) -> DataFrame:
        base, schema = f"{self.path}/status", STATUS.format(key=self.key)
        paths = [p for p in (f"{base}/segment={n}" for n in names) if files.exists(spark, p)]
        held = spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return held.where(F.col("batch") < batch_id).select("key", "segment_from")

    def _clear(self, spark: SparkSession, before: int | None, snapshots: list[int]) -> None:
        """Removes snapshots and live segments that no batch needs any more, even if the last one is run again."""
        for i in snapshots:
            if before is not None and i < before:
                files.remove(spark, f"{self.path}/open/batch={i}")
        oldest = self._open_after(spark, before).agg(F.min("segment")).first()[0] if before is not None else None
        for name in files.folders(spark, f"{self.path}/live"):
            if oldest is not None and name.split("=")[1] < oldest:
                files.remove(spark, f"{self.path}/live/{name}")
