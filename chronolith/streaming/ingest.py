"""Live ingest as a sink: rows are judged in order of arrival, with the keys' states in a table beside the rows.

A micro-batch's rows and the states that came before are dealt by key and sorted by (key, arrival), so a task sees one key after
another and one Arrow batch at a time: what it holds doesn't grow with a key's rows, however many of them one key has. A key's
state is one row, the end and the segment of its last accepted row. Judged rows and new states are one write in a folder of
the batch's id; a batch that is run again overwrites it. Statuses are those of ``live``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series
from chronolith.sources import files

LEAST = np.iinfo(np.int64).min
STATE, ROW = 0, 1


def _instants(start, end, segment, last, opened):
    """(accepted, rolled over, last end, open segment): no row is longer than an instant, so the last end is a running maximum."""
    good = start <= end
    before = np.maximum.accumulate(np.r_[last, np.where(good, end, LEAST)])[:-1]
    taken = good & (start >= before)
    rolled = np.zeros(len(start), bool)
    if taken.any():
        own = segment[taken]
        rolled[taken] = own > np.r_[own[0] if opened == LEAST else opened, own[:-1]]
        last, opened = int(end[taken][-1]), int(own[-1])
    return taken, rolled, last, opened


def _intervals(start, end, segment, last, opened):
    """The same for rows of any length: a rejected row's end doesn't count, so each row needs the ones before."""
    taken, rolled = np.zeros(len(start), bool), np.zeros(len(start), bool)
    for i, (a, b, s) in enumerate(zip(start.tolist(), end.tolist(), segment.tolist())):
        if last <= a <= b:
            taken[i], rolled[i] = True, LEAST < opened < s
            last, opened = b, s
    return taken, rolled, last, opened


def judged(start, end, segment, last, opened):
    """(accepted, rolled over, last end, open segment) of one key's rows in order of arrival, after the state before them."""
    return (_instants if (start >= end).all() else _intervals)(start, end, segment, last, opened)


def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of (key, kind, seq, start_us, end_us, segment_us, value), sorted by (key, kind, seq), with status and rolled_over.

    A key may go on over several frames. Its state, if there is one, comes first; its new state follows its last row.
    """
    key, last, opened, sample = None, LEAST, LEAST, None

    def states(made):
        keys, ends, segments = zip(*made)
        blank = sample["value"].dtype if sample["value"].dtype.kind in "fM" else object
        rows = {"key": pd.Series(keys, dtype=sample["key"].dtype), "kind": STATE, "seq": 0, "start_us": ends, "end_us": ends, "segment_us": segments}
        rows |= {"value": pd.Series([None] * len(keys), dtype=blank), "status": "state", "rolled_over": False}
        return pd.DataFrame(rows).astype({c: sample[c].dtype for c in ("kind", "seq")})

    for frame in frames:
        sample = frame if sample is None else sample
        keys = frame["key"].to_numpy()
        kind, start, end, segment = (frame[c].to_numpy(np.int64) for c in ("kind", "start_us", "end_us", "segment_us"))
        status, rolled, out = np.full(len(frame), "late", object), np.zeros(len(frame), bool), []
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(frame)] if len(frame) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if key is None or keys[a] != key:
                if last > LEAST:
                    out.append((key, last, opened))
                key, last, opened = keys[a], LEAST, LEAST
            if kind[a] == STATE:
                last, opened = int(end[a]), int(segment[a])
                a += 1
            s, e = start[a:b], end[a:b]
            if len(s):
                taken, rolled[a:b], last, opened = judged(s, e, segment[a:b], last, opened)
                status[a:b][s > e] = "malformed"
                status[a:b][taken] = "accepted"
        yield pd.concat([frame.assign(status=status, rolled_over=rolled)[kind == ROW], *([states(out)] if out else [])])
    if last > LEAST:
        yield states([(key, last, opened)])


@dataclass(frozen=True)
class Ingest:
    """Tables below ``path`` of a stream's rows; ``key`` and ``kind`` are the types of key and value."""

    path: str
    spec: Series
    segments: Segments
    value: str
    key: str = "long"
    kind: str = "double"
    #: A state expires if its row ended longer before the newest one of all; late rows of its key are accepted again then.
    expire_seconds: int | None = None
    #: Called with the judged rows and the batch's id, such as a ``Rollover``'s ``persist``.
    then: Callable[[DataFrame, int], None] | None = None

    @property
    def _judged(self) -> str:
        return f"key {self.key}, seq long, start_us long, end_us long, segment_us long, value {self.kind}, status string, rolled_over boolean"

    def _batches(self, spark: SparkSession) -> list[int]:
        ids = [int(f.split("=")[1]) for f in files.folders(spark, self.path)]
        return sorted(i for i in ids if files.exists(spark, f"{self.path}/batch={i}/_SUCCESS"))

    def _states(self, spark: SparkSession, batch_id: int | None) -> DataFrame:
        return files.stored(spark, f"{self.path}/batch={batch_id}/kind={STATE}", self._judged)

    def _shown(self, rows: DataFrame) -> DataFrame:
        """Rows with times instead of microseconds."""
        at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
        return rows.select("key", "seq", at("start_us").alias("start_ts"), at("end_us").alias("end_ts"), at("segment_us").alias("segment_from"), "value", "status", "rolled_over")

    def rows(self, spark: SparkSession) -> DataFrame:
        """(key, seq, start_ts, end_ts, segment_from, value, status, rolled_over) of all rows so far."""
        paths = [f"{self.path}/batch={i}/kind={ROW}" for i in self._batches(spark)]
        paths = [p for p in paths if files.exists(spark, p)]
        return self._shown(spark.read.schema(self._judged).parquet(*paths) if paths else spark.createDataFrame([], self._judged))

    def states(self, spark: SparkSession) -> DataFrame:
        """(key, last_end, segment_from) of each key that has an accepted row and hasn't expired."""
        held = self._shown(self._states(spark, max(self._batches(spark), default=None)))
        return held.select("key", F.col("end_ts").alias("last_end"), "segment_from")

    def persist(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        known = self._batches(spark)
        if known and batch_id < known[-1]:
            return  # written long ago
        before = max((i for i in known if i < batch_id), default=None)
        low, _ = self.segments.columns(F.col(self.spec.end))
        us = lambda c: F.unix_micros(c.cast("timestamp"))
        rows = self.spec.rows(batch).select(
            F.col(self.spec.key).cast(self.key).alias("key"),
            F.lit(ROW).alias("kind"),
            F.col(self.spec.seq).cast("long").alias("seq"),
            us(F.col(self.spec.begin)).alias("start_us"),
            us(F.col(self.spec.end)).alias("end_us"),
            us(low).alias("segment_us"),
            F.col(self.value).cast(self.kind).alias("value"),
        )
        rows = rows.where("start_us is not null")
        both = rows.unionByName(self._unexpired(self._states(spark, before)).select(*[F.lit(STATE).alias(c) if c == "kind" else c for c in rows.columns]))
        ordered = both.repartition("key").sortWithinPartitions("key", "kind", "seq")
        ordered.mapInPandas(judge, f"key {self.key}, kind int, seq long, start_us long, end_us long, segment_us long, value {self.kind}, status string, rolled_over boolean").write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/batch={batch_id}")
        if self.then:
            self.then(self._shown(files.stored(spark, f"{self.path}/batch={batch_id}/kind={ROW}", self._judged)), batch_id)
        for i in known:
            if before is not None and i < before:  # the last two are enough, even if this batch is run again
                files.remove(spark, f"{self.path}/batch={i}/kind={STATE}")

    def _unexpired(self, states: DataFrame) -> DataFrame:
        if self.expire_seconds is None:
            return states
        newest = states.agg(F.max("end_us")).first()[0]
        return states if newest is None else states.where(F.col("end_us") >= newest - self.expire_seconds * 1_000_000)


def expired(states: DataFrame, at: Column, seconds: int) -> DataFrame:
    """(key, last_end, segment_from, expired): whether a state's row ended more than ``seconds`` before a time."""
    age = F.timestamp_diff("MICROSECOND", F.col("last_end").cast("timestamp"), at.cast("timestamp"))
    return states.withColumn("expired", age > seconds * 1_000_000)
