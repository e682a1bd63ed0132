"""Live ingest: rows are accepted in order of arrival per key, late ones are turned away, segments roll over.

A row is ``late`` if it starts before the end of the last accepted row of its key, ``malformed`` if it starts after its own
end, else ``accepted``; equal times are accepted. A watermark would compare with all keys, so each key has its own state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series, latest
from chronolith.streaming.ingest import LEAST, judged

STATE = "last_end timestamp, segment timestamp"


def _ingest(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Statuses of one key's rows in one micro-batch, whose size the trigger bounds."""
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    start, end, segment = (rows[c].to_numpy("datetime64[us]").astype(np.int64) for c in ("start_ts", "end_ts", "segment_from"))
    last, opened = (int(np.datetime64(v, "us").astype(np.int64)) for v in state.get) if state.exists else (LEAST, LEAST)
    taken, rolled, last, opened = judged(start, end, segment, last, opened)
    if last > LEAST:
        state.update(tuple(np.datetime64(v, "us").item() for v in (last, opened)))
    yield rows.assign(status=np.select([start > end, taken], ["malformed", "accepted"], "late"), rolled_over=rolled)


def live_ingest(stream: DataFrame, spec: Series, segments: Segments, value: str) -> DataFrame:
    """(key, seq, start_ts, end_ts, segment_from, value, status, rolled_over) for each row of ``stream``.

    ``rolled_over``: the row is the first of a new segment, so the one before is complete. Rows with a null key or time
    are dropped. ``seq`` is the order of arrival of rows in one micro-batch.
    """
    low, _ = segments.columns(F.col(spec.end))
    rows = spec.rows(stream).select(
        F.col(spec.key).alias("key"),
        F.col(spec.seq).cast("long").alias("seq"),
        F.col(spec.begin).cast("timestamp").alias("start_ts"),
        F.col(spec.end).cast("timestamp").alias("end_ts"),
        low.cast("timestamp").alias("segment_from"),
        F.col(value).alias("value"),
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = f"{fields}, status string, rolled_over boolean"
    return rows.groupBy("key").applyInPandasWithState(_ingest, out, STATE, "append", GroupStateTimeout.NoTimeout)


def unified(history: DataFrame, live: DataFrame, end: str, live_from) -> DataFrame:
    """History before the live segment's start and the live rows from it on; no row twice."""
    return history.where(F.col(end) < live_from).unionByName(live.where(F.col(end) >= live_from))


def check_rollover(history: DataFrame, spec: Series, live_from) -> None:
    """History must end before the live segment starts; an overlap is an error that names a row."""
    wrong = history.where(F.col(spec.end) >= F.lit(live_from).cast("timestamp_ntz")).select(spec.key, spec.end).take(1)
    if wrong:
        raise ValueError(f"history reaches into the live segment from {live_from}: {wrong[0].asDict()}")


def latest_of_both(history: DataFrame, live: DataFrame, spec: Series, live_from, probes: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``probes`` with the last row not after each, of the live segment if it has one, else of history."""
    return latest(unified(history, live, spec.end, F.lit(live_from).cast("timestamp_ntz")), spec, probes, key, at, columns)


def complete_segments(ingested: DataFrame) -> DataFrame:
    """Per key the segments that a later accepted row has closed."""
    held = ingested.where("status = 'accepted'").groupBy("key", "segment_from").agg(F.count("*").alias("n"))
    newest = held.groupBy("key").agg(F.max("segment_from").alias("newest"))
    return held.join(newest, "key").where("segment_from < newest").drop("newest")
