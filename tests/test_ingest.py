"""The ingest sink against a loop over rows, batch by batch, with keys that reach over many Arrow batches."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators.series import Series
from chronolith.streaming.ingest import ROW, STATE, Ingest, expired, judge
from chronolith.streaming.rollover import Rollover

SPEC = Series(key="k", start="a", end="b", seq="seq")
SCHEMA = "k string, a timestamp_ntz, b timestamp_ntz, seq long, v double"
T0 = datetime(2000, 1, 1)


def made(seed, n=400, intervals=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.choice("xxxxxyz")  # one key has most rows
        start = T0 + timedelta(minutes=i * 11 + rnd.randrange(-90, 90))
        length = rnd.choice([0, 0, 5, 30, -7]) if intervals else rnd.choice([0, 0, 0, -7])
        rows.append((k, start, start + timedelta(minutes=length), i, float(i)))
    return rows


def plain(rows):
    last, out = {}, {}
    for k, a, b, seq, _ in sorted(rows, key=lambda r: r[3]):
        held = last.get(k)
        if a > b:
            out[seq] = ("malformed", False)
        elif held and a < held[0]:
            out[seq] = ("late", False)
        else:
            day = b.replace(hour=0, minute=0)
            out[seq] = ("accepted", bool(held) and day > held[1])
            last[k] = (b, day)
    return out, last


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark, rows):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("intervals", [True, False])
def test_batches(spark, tmp_path, small_batches, intervals):
    rows = made(4, intervals=intervals)
    sink = Ingest(str(tmp_path / "t"), SPEC, Segments("day"), "v", "string")
    for i, (lo, hi) in enumerate([(0, 150), (150, 150), (150, 390), (390, 400)]):
        for _ in range(1 + i % 2):  # every second batch is run twice
            sink.persist(frame(spark, [*rows[lo:hi], (None, T0, T0, 9_000, 0.0), ("x", None, None, 9_001, 0.0)]), i)
        want, last = plain(rows[:hi])
        got = {r.seq: (r.status, r.rolled_over) for r in sink.rows(spark).collect()}
        assert got == want
        assert {r.key: (r.last_end, r.segment_from) for r in sink.states(spark).collect()} == last
    sink.persist(frame(spark, rows[:5]), 1)  # long ago
    assert sink.rows(spark).count() == 400
    assert sorted((r.seq, r.value, r.start_ts, r.end_ts) for r in sink.rows(spark).collect()) == [(s, v, a, b) for _, a, b, s, v in rows]


def test_a_hot_key_is_judged_frame_by_frame():
    """No more than one frame is held: each is answered before the next one is asked for."""
    asked = []

    def frames():
        for i in range(50):
            asked.append(i)
            at = range(i * 1_000, (i + 1) * 1_000)
            yield pd.DataFrame({"key": "x", "kind": ROW, "seq": at, "start_us": [10 * s for s in at], "end_us": [10 * s + 9 for s in at], "segment_us": 0, "value": 1.0})

    for i, out in enumerate(judge(frames())):
        assert len(asked) == min(i + 1, 50)
        assert len(out) == (1_000 if i < 50 else 1) and (out["status"] == ("accepted" if i < 50 else "state")).all()
    assert i == 50 and out["kind"].tolist() == [STATE] and out["end_us"].tolist() == [499_999]


def test_expiry(spark, tmp_path):
    sink = Ingest(str(tmp_path / "t"), SPEC, Segments("day"), "v", "string", expire_seconds=86_400)
    at = lambda h: T0 + timedelta(hours=h)
    sink.persist(frame(spark, [("x", at(5), at(5), 1, 0.0), ("y", at(50), at(50), 2, 0.0)]), 0)
    assert {r.key: r.expired for r in expired(sink.states(spark), F.lit(at(50)).cast("timestamp_ntz"), 86_400).collect()} == {"x": True, "y": False}
    sink.persist(frame(spark, [("x", at(1), at(1), 3, 0.0), ("y", at(49), at(49), 4, 0.0)]), 1)
    assert {r.seq: r.status for r in sink.rows(spark).collect()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "late"}
    assert {r.key: r.last_end for r in sink.states(spark).collect()} == {"x": at(1), "y": at(50)}


def test_with_rollover(spark, tmp_path):
    rows = made(9)
    history = Rollover(str(tmp_path / "r"), "string")
    sink = Ingest(str(tmp_path / "t"), SPEC, Segments("day"), "v", "string", then=history.persist)
    for i in range(3):
        spark.createDataFrame(rows[i * 130 : (i + 1) * 130], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.writeStream.foreachBatch(sink.persist).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want, last = plain(rows[:390])
    days = {s: b.replace(hour=0, minute=0) for _, _, b, s, _ in rows}
    key = {s: k for k, _, _, s, _ in rows}
    accepted = [s for s, (status, _) in want.items() if status == "accepted"]
    assert sorted(r.seq for r in history.live(spark).collect()) == sorted(s for s in accepted if days[s] == last[key[s]][1])
    assert sorted(r.seq for r in history.history(spark).collect()) == sorted(s for s in accepted if days[s] < last[key[s]][1])


def test_states_of_a_frame_are_one_frame(monkeypatch):
    """Not one for each of its keys."""
    import pandas as pd

    n, seen, concat = 500, [], pd.concat
    frame = pd.DataFrame({"key": range(n), "kind": ROW, "seq": 0, "start_us": range(n), "end_us": range(n), "segment_us": 0, "value": 1.0})
    monkeypatch.setattr(pd, "concat", lambda frames, **how: seen.append(len(frames)) or concat(frames, **how))
    out = concat(list(judge(iter([frame]))))
    assert max(seen) <= 2
    states = out[out.kind == STATE]
    assert states.key.tolist() == list(range(n)) and states.end_us.tolist() == list(range(n)) and states.value.isna().all()
