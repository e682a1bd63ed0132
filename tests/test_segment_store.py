"""A store that is changed segment by segment, against plain Python, and which files its changes and lookups touch."""

import os
from bisect import bisect_right
from datetime import datetime, timedelta

import pytest

from chronolith.functions.segments import Segments
from chronolith.operators import segmented, series
from chronolith.operators.series import Series
from chronolith.sources import files
from chronolith.sources.segment_store import Locked, SegmentStore
from chronolith.sources.store import OrderError

SPEC = Series("k", "ts", "seq")
SCHEMA = "k string, ts timestamp_ntz, seq long, v double"
T0 = datetime(2000, 1, 1)


def row(k, hours, seq, v=0.0):
    return (k, T0 + timedelta(hours=hours), seq, float(v))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    """Key x has a row every six hours for ten days, key y on the second and third day only, key z on the fifth."""
    made = SegmentStore(str(tmp_path / "store"), SPEC, Segments("day"), SCHEMA)
    rows = [row("x", 6 * i, i) for i in range(40)] + [row("y", 24 + i, 100 + i) for i in range(48)] + [row("z", 100, 200), row("z", 101, 201), row("z", 101, 202)]
    made.write(frame(spark, [*rows, (None, T0, 1, 0.0), ("x", None, 2, 0.0)]))
    return made, rows


def files_of(store, part="rows"):
    found = {}
    for d, _, names in os.walk(f"{store.path}/{part}"):
        for n in names:
            if n.endswith(".parquet"):
                found[f"{os.path.basename(d)}/{n}"] = os.stat(f"{d}/{n}").st_mtime_ns
    return found


def held(spark, store):
    return sorted(tuple(r) for r in store.rows(spark).select("k", "ts", "seq", "v").collect())


def summary_is_right(spark, store):
    want = {}
    for k, ts, seq, v in held(spark, store):
        day = ts.replace(hour=0)
        want.setdefault((k, day), []).append((ts, seq))
    got = {(r.k, r.segment_from): (r.n, r["first"].seq, r["last"].seq, r.low, r.high) for r in store.summary(spark).collect()}
    assert got == {key: (len(x), min(x)[1], max(x)[1], min(x)[0], max(x)[0]) for key, x in want.items()}


def test_write(spark, store):
    made, rows = store
    assert held(spark, made) == sorted(rows)
    summary_is_right(spark, made)
    with pytest.raises(FileExistsError):
        made.write(frame(spark, rows))


def test_update_rewrites_the_touched_segments_only(spark, store):
    made, rows = store
    before, sums = files_of(made), files_of(made, "summary")
    source = [row("x", 6 * i, i, 1) for i in range(30, 44)] + [row("y", 70, 300, 1), row("y", 71, 301, 1), row("w", 300, 400, 1)]
    names = made.update(frame(spark, source))
    # x resumes at hour 234 (day 10), y at hour 71 (day 3), w is new
    assert names == ["2000-01-03T000000", "2000-01-10T000000", "2000-01-11T000000", "2000-01-13T000000"]
    after = files_of(made)
    touched = {f"segment={n}" for n in names}
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in after if f.split("/")[0] not in touched}
    assert all(after[f] == before[f] for f in before if f.split("/")[0] not in touched)
    assert all(files_of(made, "summary")[f] == sums[f] for f in sums if f.split("/")[0] not in touched)
    want = [r for r in rows if not (r[0] == "x" and r[1] == T0 + timedelta(hours=234)) and not (r[0] == "y" and r[1] == T0 + timedelta(hours=71))]
    want += [r for r in source if (r[0] != "x" or r[1] >= T0 + timedelta(hours=234)) and (r[0] != "y" or r[1] >= T0 + timedelta(hours=71))]
    assert held(spark, made) == sorted(want)
    summary_is_right(spark, made)


def test_update_with_nothing_new(spark, store):
    made, rows = store
    before = files_of(made)
    assert made.update(frame(spark, [row("x", 0, 900), row("z", 3, 901)])) == []
    assert files_of(made) == before and held(spark, made) == sorted(rows)
    assert made.update(frame(spark, [])) == []


def test_rows_out_of_order_change_nothing(spark, store):
    made, rows = store
    before = files_of(made)
    with pytest.raises(OrderError):
        made.update(frame(spark, [row("x", 300, 1000), row("x", 299, 1001)]))
    assert files_of(made) == before and not files.exists(spark, f"{made.path}/lock")
    assert made.update(frame(spark, [row("x", 300, 1000), row("x", 301, 1001)])) == ["2000-01-13T000000"]


def test_delete(spark, store):
    made, rows = store
    before = files_of(made)
    names = made.delete(frame(spark, [row("z", 0, 0), row("y", 0, 0), row("none", 0, 0)]).select("k"))
    assert names == ["2000-01-02T000000", "2000-01-03T000000", "2000-01-05T000000"]
    after = files_of(made)
    assert all(after[f] == t for f, t in before.items() if f.split("=")[1].split("/")[0] not in names)
    assert held(spark, made) == sorted(r for r in rows if r[0] == "x")
    summary_is_right(spark, made)
    # the last key's segments go with it
    assert len(made.delete(frame(spark, [row("x", 0, 0)]).select("k"))) == 10
    assert files_of(made) == {} == files_of(made, "summary") and held(spark, made) == []
    made.update(frame(spark, [row("x", 1, 1)]))
    assert held(spark, made) == [row("x", 1, 1)]


def test_a_change_that_was_cut_off(spark, store):
    """The rows of a segment are new, its summary isn't."""
    made, rows = store
    real = SegmentStore._summarise

    def lost(self, spark, names):
        raise RuntimeError("lost")

    SegmentStore._summarise = lost
    try:
        with pytest.raises(RuntimeError, match="lost"):
            made.update(frame(spark, [row("x", 400, 1000)]))
    finally:
        SegmentStore._summarise = real
    with pytest.raises(Locked):
        made.update(frame(spark, [row("x", 401, 1001)]))
    with pytest.raises(Locked):
        made.delete(frame(spark, []).select("k"))
    assert made.repair(spark) == ["2000-01-17T000000"]
    summary_is_right(spark, made)
    assert held(spark, made) == sorted([*rows, row("x", 400, 1000)])
    assert made.update(frame(spark, [row("x", 401, 1001)])) == ["2000-01-17T000000"]


@pytest.mark.parametrize(("low", "high"), [(None, None), (30, None), (None, 47), (24, 48), (25, 26), (7, 7), (0, 1000), (500, 600), (47, 72)])
def test_counts(spark, store, low, high):
    made, rows = store
    a, b = (None if h is None else T0 + timedelta(hours=h) for h in (low, high))
    want = {}
    for k, ts, _, _ in rows:
        if (a is None or ts >= a) and (b is None or ts <= b):
            want[k] = want.get(k, 0) + 1
    assert {r.k: r.n for r in made.counts(spark, a, b).collect()} == want


def folders_read(df):
    """Segments whose rows a plan reads."""
    return {f.split("segment=")[1].split("/")[0][:10] for f in df.inputFiles() if "/rows/" in f}


def test_counts_read_the_cut_segments_only(spark, store):
    made, _ = store
    between = lambda low, high: folders_read(made.counts(spark, T0 + timedelta(hours=low), T0 + timedelta(hours=high)))
    assert folders_read(made.counts(spark)) == set()
    assert between(30, 150) == {"2000-01-02", "2000-01-07"}
    assert between(24, 143) == set()  # all in these days is counted by the summary


def test_edges_and_segment_counts(spark, store):
    made, _ = store
    rows = made.rows(spark).select("k", "ts", "seq", "v")
    by = lambda df: sorted(map(tuple, df.collect()))
    assert by(made.edges(spark, ["seq", "ts"])) == by(series.edges(rows, SPEC, ["seq", "ts"]))
    assert by(made.segment_counts(spark)) == by(segmented.segment_counts(rows, SPEC, Segments("day")))


def test_latest(spark, store):
    made, rows = store
    asked = [(i, k, h) for i, (k, h) in enumerate((k, h) for k in ("x", "y", "z", "u", None) for h in [*range(-10, 260, 7), 100, 101, 24, 71, None])]
    probes = spark.createDataFrame([(i, k, None if h is None else T0 + timedelta(hours=h)) for i, k, h in asked], "low int, k string, at timestamp_ntz")
    got = {r.low: r.seq for r in made.latest(probes, "k", "at", ["ts", "seq", "v"]).collect()}
    assert len(got) == len(asked)
    for i, k, h in asked:
        own = sorted((ts, seq) for x, ts, seq, _ in rows if x == k)
        n = len(own) if h is None else bisect_right(own, (T0 + timedelta(hours=h), 1 << 40))
        assert got[i] == (own[max(0, n - 1)][1] if own else None), (k, h)


def test_latest_reads_what_its_probes_need(spark, store):
    made, _ = store
    at = lambda *hours: folders_read(made.latest(spark.createDataFrame([(T0 + timedelta(hours=h), "x") for h in hours], "at timestamp_ntz, k string"), "k", "at", ["seq"]))
    assert at(20, 23, 47, -5, 999) == set()  # first and last rows of days: the summary has them
    assert at(50) == {"2000-01-03"}
    assert at(50, 55, 100) == {"2000-01-03", "2000-01-05"}


def test_stores_without_rows(spark, tmp_path):
    made = SegmentStore(str(tmp_path / "none"), SPEC, Segments("day"), SCHEMA)
    assert made.rows(spark).count() == made.summary(spark).count() == made.counts(spark).count() == made.counts(spark, T0).count() == 0
    probes = spark.createDataFrame([("x", T0)], "k string, at timestamp_ntz")
    assert made.latest(probes, "k", "at", ["seq"]).collect()[0].seq is None
    assert made.update(frame(spark, [row("x", 1, 1), row("x", 30, 2)])) == ["2000-01-01T000000", "2000-01-02T000000"]
    summary_is_right(spark, made)
