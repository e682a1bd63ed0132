"""Live ingest in several micro-batches: per-key state, late and malformed rows, rollover."""

from datetime import datetime, timedelta

import pytest

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series
from chronolith.streaming.live import complete_segments, live_ingest, unified

SPEC = Series(key="k", start="a", end="b", seq="seq")
SCHEMA = "k string, a timestamp_ntz, b timestamp_ntz, seq long, v double"
T0 = datetime(2000, 1, 1)


def row(k, seq, start, end):
    return (k, T0 + timedelta(hours=start), T0 + timedelta(hours=end), seq, float(seq))


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("live")
    batches = [
        [row("x", 1, 0, 1), row("x", 2, 5, 6), row("y", 3, 30, 31), row("x", 4, 3, 4)],
        [row("x", 5, 5, 7), row("x", 6, 6, 6), row("x", 7, 9, 8), row("y", 8, 29, 40), row("x", 9, 26, 27)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{base}/in/part={i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part=*")
    out = live_ingest(stream, SPEC, Segments("day"), "v")
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_statuses(ingested):
    status = {r["seq"]: r["status"] for r in ingested.collect()}
    assert status == {1: "accepted", 2: "accepted", 3: "accepted", 4: "late", 5: "late", 6: "accepted", 7: "malformed", 8: "late", 9: "accepted"}


def test_rollover_and_completed_segments(ingested):
    assert [r["seq"] for r in ingested.where("rolled_over").collect()] == [9]
    done = complete_segments(ingested).collect()
    assert [(r["key"], r["n"]) for r in done] == [("x", 3)]


def test_live_and_history_meet_once(spark):
    rows = spark.createDataFrame([row("x", i, i, i) for i in range(5)], SCHEMA)
    assert unified(rows, rows, "b", T0 + timedelta(hours=2)).count() == 5
