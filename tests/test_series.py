"""Edges of the temporal lookups, on small series with equal times, against loops over sorted lists."""

import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.functions.segments import Segments
from chronolith.operators import range_table as rt
from chronolith.operators import relational as rel
from chronolith.operators import series
from chronolith.operators.series import Series
from chronolith.sources import store

SPEC = Series(key="k", end="ts", seq="seq", bucket="day")
T0 = datetime(2000, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, seq long"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(5)
    rows, at = [], {}
    for k in "abc":
        times = sorted(T0 + timedelta(hours=6 * rnd.randrange(40)) for _ in range(25))
        at[k] = times
        rows += [(k, t, i) for i, t in enumerate(times)]
    rows += [(None, T0, 1), ("a", None, 99)]
    asked = [(i, rnd.choice("abcd"), T0 + timedelta(hours=3 * rnd.randrange(-8, 90))) for i in range(150)]
    asked += [(900, "a", None), (901, "d", None), (902, None, T0), (903, "b", datetime(1, 1, 1)), (904, "b", datetime(9999, 12, 31))]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "probe long, k string, at timestamp_ntz"), at, asked


def test_counts_and_positions(spark, made):
    df, probes, at, asked = made
    found = {r["probe"]: r for r in series.locate(df, SPEC, probes, "k", "at").collect()}
    assert len(found) == len(asked)
    for i, k, d in asked:
        times = at.get(k, [])
        lt, le = (len(times), len(times)) if d is None else (bisect_left(times, d), bisect_right(times, d))
        assert (found[i]["lt"], found[i]["le"], found[i]["n"]) == (lt, le, len(times)), (i, k, d)


def shifted(times, d, n, forward):
    """Position after stepping n rows from the as-of row, edge rows repeated."""
    if not times:
        return None
    if forward:
        if d is None or d >= times[-1]:
            return len(times) - 1
        le, lt = bisect_right(times, d), bisect_left(times, d)
        return min(len(times) - 1, (le - 1 if le > lt else le) + n)
    if d <= times[0]:
        return 0
    le, lt = bisect_right(times, d), bisect_left(times, d)
    return max(0, lt - 1) if n == 1 and le > lt else max(0, le - 1 - n)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_shifts(spark, made, n):
    df, probes, at, asked = made
    found = series.locate(df, SPEC, probes, "k", "at")
    rows = found.select("probe", series.previous_position(n).alias("b"), series.next_position(n).alias("f")).collect()
    held = {r["probe"]: r for r in rows}
    for i, k, d in asked:
        assert held[i]["f"] == shifted(at.get(k, []), d, n, True)
        if d is not None:
            assert held[i]["b"] == shifted(at.get(k, []), d, n, False)


def test_negative_shift_is_an_error():
    with pytest.raises(ValueError):
        series.previous_position(-1)
    with pytest.raises(ValueError):
        series.next_position(-1)


def test_equal_times_give_the_last_written(spark):
    df = spark.createDataFrame([("a", T0, 2), ("a", T0, 1), ("a", T0 + timedelta(1), 3)], SCHEMA)
    probes = spark.createDataFrame([("a", T0)], "k string, at timestamp_ntz")
    found = series.locate(df, SPEC, probes, "k", "at")
    assert series.fetch(df, SPEC, found, "k", series.latest_position(), ["seq"]).first()["seq"] == 2


def test_neighbours_do_not_repeat_edges(spark, made):
    df, probes, at, _ = made
    found = series.locate(df, SPEC, probes.where("probe = 904"), "k", "at")
    assert series.neighbours(df, SPEC, found, "k", 100, ["seq"]).count() == len(at["b"])
    assert series.neighbours(df, SPEC, found, "k", -100, ["seq"]).count() == 0


def test_empty_series(spark):
    df = spark.createDataFrame([], SCHEMA)
    probes = spark.createDataFrame([("a", T0)], "k string, at timestamp_ntz")
    found = series.locate(df, SPEC, probes, "k", "at")
    row = series.fetch(df, SPEC, found, "k", series.latest_position(), ["seq"]).first()
    assert row["n"] == 0 and row["seq"] is None and row["position"] is None


def test_violations_across_chunks(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(h), i) for i, h in enumerate([1, 2, 2, 1, 5])], SCHEMA)
    assert [r["seq"] for r in series.violations(df, SPEC, chunk=3).collect()] == [3]


def test_resume_takes_each_row_once(spark):
    years = [(("a"), datetime(y, 1, 1), y) for y in range(1990, 2021)]
    stored = spark.createDataFrame([r for r in years if 2000 <= r[2] <= 2010], SCHEMA)
    out = store.update(stored, lambda points: spark.createDataFrame(years, SCHEMA), SPEC)
    assert sorted(r["seq"] for r in out.collect()) == list(range(2000, 2021))


def test_disorder_is_refused(spark):
    rows = spark.createDataFrame([("a", T0 + timedelta(1), 1), ("a", T0, 2)], SCHEMA)
    with pytest.raises(store.OrderError):
        store.validate(rows, SPEC)


@pytest.mark.parametrize("unit,count", [("day", 10), ("week", 2), ("hour", 7), ("month", 5), ("decade", 1), ("century", 2), ("minute", 90)])
def test_segments_hold_their_times_and_do_not_overlap(spark, unit, count):
    times = spark.range(3000).select((F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(id as int) * 5, 13)")).alias("ts"))
    low, high = Segments(unit, count).columns(F.col("ts"))
    rows = times.select("ts", low.alias("lo"), high.alias("hi"))
    assert rows.where("ts < lo or ts >= hi").count() == 0
    bounds = sorted({(r["lo"], r["hi"]) for r in rows.collect()})
    assert all(a[1] <= b[0] or unit == "week" for a, b in zip(bounds, bounds[1:]))


def test_null_range_keys(spark):
    t = rt.Table("h", "r")
    rows = spark.createDataFrame([(1, None, 2), (1, 1, 4), (1, 2, 5), (1, 3, 5), (2, None, 8)], "h int, r int, value int")
    assert [r["value"] for r in rt.range_of(rows, t, 1).collect()] == [2, 4, 5, 5]
    assert [r["value"] for r in rt.range_of(rows, t, 1, reverse=True).collect()] == [5, 5, 4, 2]
    new = spark.createDataFrame([(1, None, 7), (3, 1, 9)], "h int, r int, value int")
    assert sorted(r["value"] for r in rt.put(rows, new, t).collect()) == [4, 5, 5, 7, 8, 9]
    assert sorted(r["value"] for r in rt.put_if_absent(rows, new, t).collect()) == [2, 4, 5, 5, 8, 9]
    assert sorted(r["value"] for r in rt.delete(rows, new, t).collect()) == [4, 5, 5, 8]
    assert sorted(r["value"] for r in rt.delete_range(rows, t, 1, 2).collect()) == [2, 4, 8]


def test_entities(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 3), (3, "b", 1)], "id long, name string, version int")
    assert rel.find_one(rows, {"name": "a"})["id"] == 1 and rel.find_one(rows, {"id": 9}) is None
    with pytest.raises(ValueError):
        rel.find_one(rows, {"name": "b"})
    with pytest.raises(ValueError):
        rel.by_example({"id": 1})
    changed = spark.createDataFrame([(1, "x", 0), (2, "y", 2), (4, "z", 0)], "id long, name string, version int")
    kept = {r["id"]: (r["name"], r["version"]) for r in rel.save_all(rows, changed, "id", "version").collect()}
    assert kept == {1: ("x", 1), 2: ("b", 3), 3: ("b", 1), 4: ("z", 0)}
    assert [r["id"] for r in rel.stale_changes(rows, changed, "id", "version").collect()] == [2]


def test_as_of_lookups_get_more_partitions_with_more_rows(spark, monkeypatch):
    """What a task sorts is bounded by the number of partitions; results stay the same."""
    from pyspark.sql import functions as F

    from chronolith.operators import series

    rows = spark.range(4000).selectExpr("id % 40 as k", "id * 2 as t", "id as v")
    probes = spark.range(4000).selectExpr("id % 41 as key", "id * 2 + 1 as at", "id as probe")
    for forward in (False, True):
        ask = lambda: series.as_of(rows, probes, ("k", "t", "t"), ("key", "at"), ["t", "v"], 512, forward=forward)  # noqa: B023, E731
        monkeypatch.setattr(series, "TASK_ROWS", 1 << 18, raising=False)
        want = sorted(map(str, ask().collect()))
        monkeypatch.setattr(series, "TASK_ROWS", 200, raising=False)
        assert sorted(map(str, ask().collect())) == want
        assert ask().select(F.spark_partition_id().alias("task")).distinct().count() > 20
