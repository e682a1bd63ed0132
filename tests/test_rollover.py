"""Closed segments go to history batch by batch; batches run twice change nothing."""

import os
from datetime import datetime, timedelta

import pytest

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series
from chronolith.streaming.live import live_ingest
from chronolith.streaming.rollover import Rollover

T0 = datetime(2000, 1, 1)
SCHEMA = "key string, seq long, start_ts timestamp, end_ts timestamp, segment_from timestamp, value double, status string, rolled_over boolean"


def row(key, seq, hours, status="accepted"):
    at = T0 + timedelta(hours=hours)
    return (key, seq, at, at, at.replace(hour=0), float(seq), status, False)


BATCHES = [
    [row("x", 1, 1), row("x", 2, 5), row("y", 3, 2), row("x", 4, 3, "late")],
    [row("x", 5, 23), row("y", 6, 30)],
    [],
    [row("x", 7, 25), row("x", 8, 80), row("y", 9, 31), row("z", 10, 5), row("z", 11, 4, "malformed")],
    [row("y", 12, 31)],
]


def plain(batches, finished=False):
    """(history, status, live) after some batches, by a loop."""
    rows, newest = [], {}
    for b in batches:
        for r in b:
            if r[6] == "accepted":
                rows.append(r)
                newest[r[0]] = max(newest.get(r[0], r[4]), r[4])
    closed = [r for r in rows if finished or r[4] < newest[r[0]]]
    status = {}
    for r in closed:
        status.setdefault((r[0], r[4]), []).append(r[3])
    return sorted(r[1] for r in closed), {k: (len(v), min(v), max(v)) for k, v in status.items()}, sorted(r[1] for r in rows if r not in closed)


def state(spark, sink):
    history = [r.seq for r in sink.history(spark).collect()]
    status = [r for r in sink.status(spark).collect()]
    assert all(r.status == "COMPLETE" for r in status) and len({(r.key, r.segment_from) for r in status}) == len(status)
    return sorted(history), {(r.key, r.segment_from): (r.n, r.first_ts, r.last_ts) for r in status}, sorted(r.seq for r in sink.live(spark).collect())


@pytest.fixture
def sink(tmp_path):
    return Rollover(str(tmp_path / "sink"), "string")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batches(spark, sink):
    for i, b in enumerate(BATCHES):
        sink.persist(frame(spark, b), i)
        assert state(spark, sink) == plain(BATCHES[: i + 1])
    assert sorted((r.seq, r.status) for r in sink.rejected(spark).collect()) == [(4, "late"), (11, "malformed")]
    assert {r.key: r.segment_from for r in sink.open_segments(spark).collect()} == {"x": T0 + timedelta(3), "y": T0 + timedelta(1), "z": T0}
    sink.finish(spark)
    assert state(spark, sink) == plain(BATCHES, True)
    sink.finish(spark)
    assert state(spark, sink) == plain(BATCHES, True)
    with pytest.raises(ValueError, match="finished"):
        sink.persist(frame(spark, BATCHES[0]), 5)


def test_a_batch_that_is_run_again(spark, sink):
    for i, b in enumerate(BATCHES):
        sink.persist(frame(spark, b), i)
        sink.persist(frame(spark, b), i)
        assert state(spark, sink) == plain(BATCHES[: i + 1])
    sink.persist(frame(spark, BATCHES[1]), 1)  # long ago
    assert state(spark, sink) == plain(BATCHES)


@pytest.mark.parametrize("lost", ["history", "status", "open"])
def test_a_batch_that_was_cut_off(spark, sink, lost, monkeypatch):
    """The driver ends before one of the writes; then the batch is run again."""
    for i, b in enumerate(BATCHES[:3]):
        sink.persist(frame(spark, b), i)
    real = Rollover._write

    def write(self, df, part, by):
        if part == lost:
            raise RuntimeError("lost")
        real(self, df, part, by)

    if lost == "open":
        monkeypatch.setattr(Rollover, "_open_after", lambda self, spark, i: (_ for _ in ()).throw(RuntimeError("lost")))
    else:
        monkeypatch.setattr(Rollover, "_write", write)
    with pytest.raises(RuntimeError, match="lost"):
        sink.persist(frame(spark, BATCHES[3]), 3)
    monkeypatch.undo()
    sink.persist(frame(spark, BATCHES[3]), 3)
    assert state(spark, sink) == plain(BATCHES[:4])


def test_live_folders_that_are_history_go(spark, sink):
    for i in range(6):
        sink.persist(frame(spark, [row("x", i, 24 * i), row("y", 100 + i, 24 * i + 1)]), i)
    left = sorted(os.listdir(f"{sink.path}/live"))
    assert [f for f in left if f.startswith("segment")] == ["segment=2000-01-05T000000", "segment=2000-01-06T000000"]
    assert len([f for f in os.listdir(f"{sink.path}/open") if f.startswith("batch")]) == 2
    assert len(sink.history(spark).collect()) == 10


def test_a_stream_that_is_restarted(spark, tmp_path):
    """In two runs of one query, with a file a batch; all that was accepted is in history or live in the end."""
    schema = "k string, a timestamp_ntz, seq long, v double"
    rows = [("xyz"[i % 3], T0 + timedelta(hours=(i * 7) // 2 - (40 if i % 11 == 5 else 0)), i, float(i)) for i in range(90)]
    sink = Rollover(str(tmp_path / "sink"), "string")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = live_ingest(stream, Series("k", "a", "seq"), Segments("day"), "v")
        out.writeStream.foreachBatch(sink.persist).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for half in range(2):
        for i in range(3):
            part = rows[(3 * half + i) * 15 : (3 * half + i + 1) * 15]
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{half}{i}")
        run()
    last, batches = {}, []
    for k, at, seq, _ in rows:
        if k in last and at < last[k]:
            continue
        last[k] = at
        batches.append((k, seq, at, at, at.replace(hour=0), 0.0, "accepted"))
    assert state(spark, sink) == plain([batches])
    assert len(sink.rejected(spark).collect()) == len(rows) - len(batches)
    sink.finish(spark)
    assert state(spark, sink) == plain([batches], True)
