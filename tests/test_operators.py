"""Edges of the range-table, segment, entity, store and array operators on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.functions import arrays
from chronolith.functions.segments import Segments
from chronolith.operators import range_table as rt
from chronolith.operators import relational as rel
from chronolith.operators import segmented, series
from chronolith.operators.series import Series
from chronolith.sources import store
from chronolith.streaming import live

T0 = datetime(2000, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    """Hash key 1 has a row without a range key and rows 1 to 3; hash key 2 has one row."""
    return spark.createDataFrame([(1, None, 2), (1, 1, 4), (1, 2, 5), (1, 3, 6), (2, 7, 8)], "h int, r int, v int")


@pytest.mark.parametrize("bucket", [None, 2])
def test_neighbours_of_range_keys(spark, table, bucket):
    t = rt.Table("h", "r", bucket)
    asked = spark.createDataFrame([(0, 1, 2), (1, 1, 0), (2, 1, 99), (3, 1, None), (4, 2, 1), (5, 2, 7), (6, 3, 1), (7, None, 1)], "id int, key int, place int")
    got = lambda f: {r.id: r.v for r in f(table, t, asked, "key", "place").collect()}
    assert got(rt.latest) == {0: 5, 1: 2, 2: 6, 3: 6, 4: 8, 5: 8, 6: None, 7: None}
    assert got(rt.previous) == {0: 5, 1: 2, 2: 6, 3: 6, 4: None, 5: 8, 6: None, 7: None}
    assert got(rt.following) == {0: 5, 1: 4, 2: None, 3: 6, 4: 8, 5: 8, 6: None, 7: None}
    assert sorted((r.h, r.v) for r in rt.last_rows(table, t).collect()) == [(1, 6), (2, 8)]
    assert sorted((r.h, r.v) for r in rt.first_rows(table, t).collect()) == [(1, 2), (2, 8)]


def test_keys_conditions_and_restricted_tables(spark, table):
    t = rt.Table("h", "r")
    keys = spark.createDataFrame([(1, None), (1, 9), (1, 9), (2, 7)], "h int, r int")
    assert sorted((r.h, r.r or 0, r.there) for r in rt.contains_keys(table, keys, t).collect()) == [(1, 0, True), (1, 9, False), (2, 7, True)]
    new = spark.createDataFrame([(1, 1, 40, 4), (1, 2, 50, 0), (5, 5, 55, None)], "h int, r int, v int, seen int")
    assert sorted(r.v for r in rt.replace_if(table, new, t, "v", "seen").collect()) == [2, 5, 6, 8, 40, 55]
    assert rt.append_only(table, new.where("h = 5").drop("seen"), t).count() == 6
    with pytest.raises(ValueError):
        rt.append_only(table, new.drop("seen"), t)


def test_purge(spark):
    rows = spark.createDataFrame([(T0,), (T0 + timedelta(days=9),)], "at timestamp")
    now = F.lit(T0 + timedelta(days=10))
    assert [rt.purge(rows, "at", now, d * 86_400).count() for d in (9, 10)] == [0, 2]


def test_segments_are_enumerated_without_a_shuffle_of_them(spark):
    """Weeks that a year cuts, against each day's segment; equal windows count once, those without an end touch nothing."""
    made = [(1, T0, T0 + timedelta(days=400)), (1, T0, T0 + timedelta(days=400)), (2, T0, T0), (3, None, T0), (4, T0, None)]
    windows = spark.createDataFrame(made, "k int, low timestamp_ntz, high timestamp_ntz")
    out = segmented.enumerate_segments(windows, Segments("week"), "low", "high")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.k, r.nth, r.nth_back, r.segment_from, r.segment_to) for r in out.collect())
    low, high = Segments("week").columns(F.col("at"))
    days = spark.createDataFrame([(T0 + timedelta(days=i),) for i in range(401)], "at timestamp_ntz")
    weeks = sorted({tuple(r) for r in days.select(low, high).collect()})
    assert got == [(1, i, len(weeks) - 1 - i, *w) for i, w in enumerate(weeks)] + [(2, 0, 0, *weeks[0])]


def test_age_is_not_cut_to_seconds(spark):
    rows = spark.createDataFrame([(T0 - timedelta(microseconds=us),) for us in (0, 1, 500_000, 999_999)], "at timestamp")
    now = F.lit(T0 + timedelta(days=5))
    assert [r["at"] for r in rt.younger_than(rows, "at", now, 5 * 86_400).collect()] == [T0]
    assert rt.purge(rows, "at", now, 5 * 86_400).count() == 0 and rt.purge(rows.where(F.col("at") == F.lit(T0)), "at", now, 5 * 86_400).count() == 1


def test_latest_with_ties_and_a_key_of_many_buckets(spark):
    """Against a loop; one key has rows in many days, with days between that hold probes only."""
    rows = [("a", T0 + timedelta(hours=7 * (i // 2)), i) for i in range(200)] + [("b", T0, 1000)]
    asked = [(i, k, None if i % 17 == 0 else T0 + timedelta(hours=5 * i - 40)) for i, k in enumerate("ab" * 160)] + [(999, "c", T0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long")
    probes = spark.createDataFrame(asked, "probe long, k string, at timestamp_ntz")
    got = {r.probe: r.seq for r in series.latest(df, Series("k", "ts", "seq"), probes, "k", "at", ["ts", "seq"]).collect()}
    for i, k, at in asked:
        own = [(t, s) for x, t, s in rows if x == k]
        below = [s for t, s in own if at is None or t <= at]
        assert got[i] == (below[-1] if below else own[0][1] if own else None)


def test_segments_meet_and_neighbours(spark):
    """Half-open ranges without overlap, weeks included, and the next and previous ones."""
    days = spark.range(900).select(F.timestamp_add("HOUR", (F.col("id") * 24).cast("int"), F.lit(T0)).cast("timestamp_ntz").alias("t"))
    for spec in (Segments("week"), Segments("week", 2), Segments("day", 10), Segments("month", 5)):
        low, high = spec.columns(F.col("t"))
        after, before = segmented.next_segment(spec, F.col("t")), segmented.previous_segment(spec, F.col("t"))
        found = days.select("t", low.alias("a"), high.alias("b"), after[0].alias("c"), before[1].alias("d")).collect()
        assert all(r.a <= r.t < r.b and r.c == r.b and r.d == r.a for r in found)
        ordered = sorted({(r.a, r.b) for r in found})
        assert all(x[1] == y[0] for x, y in zip(ordered, ordered[1:]))
    ever = days.select(*Segments("ever").columns(F.col("t"))).distinct()
    assert ever.count() == 1 and days.select(Segments("ever").columns(F.lit(None).cast("timestamp"))[0]).distinct().collect()[0][0] is None


def test_segment_of_position(spark):
    counted = spark.createDataFrame([("a", 0, 1, 3, 0), ("a", 1, 2, 1, 3), ("b", 0, 1, 2, 0)], "k string, segment_from int, segment_to int, rows_in_segment long, preceding long")
    asked = spark.createDataFrame([(i, k, i - 1) for k in "abc" for i in range(6)], "id int, key string, at int")
    got = sorted((r.key, r["at"], r.segment_from, r.position_in_segment) for r in segmented.segment_of_position(counted, Series("k", "ts", "seq"), asked, "key", "at").collect())
    assert got == [("a", 0, 0, 0), ("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 3, 1, 0), ("b", 0, 0, 0), ("b", 1, 0, 1)]


def test_loaded_rows_must_lie_in_their_segment(spark):
    needed = spark.createDataFrame([("a", T0, T0 + timedelta(days=1))], "k string, segment_from timestamp_ntz, segment_to timestamp_ntz")
    status = needed.limit(0).withColumn("status", F.lit(""))
    load = lambda at: lambda absent: absent.withColumn("ts", F.lit(at).cast("timestamp_ntz"))
    rows, after = segmented.ensure_segments(needed, status, "k", load(T0), "ts")
    assert rows.count() == 1 and [r.status for r in after.collect()] == ["COMPLETE"]
    assert segmented.ensure_segments(needed, after, "k", load(T0), "ts")[0].count() == 0
    empty = segmented.ensure_segments(needed, status, "k", lambda absent: load(T0)(absent).limit(0), "ts")[1]
    assert [r.status for r in empty.collect()] == ["COMPLETE_EMPTY"]
    with pytest.raises(ValueError):
        segmented.ensure_segments(needed, status, "k", load(T0 + timedelta(days=1)), "ts")


def test_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(None if i % 50 == 7 else f"n{i * 37 % 500:03}", i) for i in range(500)], "name string, i long").repartition(5)
    for groups in (1, 7, 64):
        got = {r.i: r.id for r in rel.with_ids(rows, ["name", "i"], "id", 10, groups).collect()}
        order = sorted(rows.collect(), key=lambda r: (r.name is not None, r.name or "", r.i))
        assert [got[r.i] for r in order] == list(range(10, 510))
    assert rel.with_ids(rows.limit(0), ["name", "i"], "id", 10).count() == 0


def test_entities(spark, tmp_path):
    rows = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(10)], "id long, name string")
    assert rel.exists(rows, {"name": "odd"}) and not rel.exists(rows, {"name": "none"})
    assert [r.id for r in rel.find_all(rows, {"name": "odd"}, [F.col("id").desc()], 1, 2).collect()] == [7, 5]
    assert [tuple(r) for r in rel.count_like(rows, [{"name": "odd"}, {}]).collect()] == [(0, 5), (1, 10)]
    assert [(r.id, r.row_number, r.total) for r in rel.with_total(rel.page(rows, [F.col("id")], 1, 4), rows).collect()] == [(4, 4, 10), (5, 5, 10), (6, 6, 10), (7, 7, 10)]
    assert rel.bulk_insert(rows, f"{tmp_path}/t") == 10 and rel.bulk_insert(rows.limit(3), f"{tmp_path}/t") == 3
    assert spark.read.parquet(f"{tmp_path}/t").count() == 13


def test_counted_writes_gaps_and_collections(spark, tmp_path):
    spec = Series("k", "ts", "seq")
    rows = spark.createDataFrame([("a", T0 + timedelta(days=i), i) for i in range(5)] + [("b", T0, 9)], "k string, ts timestamp_ntz, seq long")
    seen = store.write_counted(rows, spec, Segments("month"), f"{tmp_path}/s")
    assert (seen["rows"], seen["first"], seen["last"]) == (6, T0, T0 + timedelta(days=4))
    late = store.gaps(rows, spec, T0 + timedelta(days=5), 2 * 86_400).collect()
    assert [(r.k, r.missing_seconds) for r in late] == [("b", 5 * 86_400)]
    assert {r.k: r.percent for r in store.progress(rows, spec, T0, T0 + timedelta(days=8)).collect()} == {"a": 50.0, "b": 0.0}
    for part in (rows.where("seq < 3"), rows.where("seq >= 3")):
        store.append_rows(part, f"{tmp_path}/c", "seq")
    assert [r.seq for r in store.iterate(spark, f"{tmp_path}/c", "seq", reverse=True).collect()] == [9, 4, 3, 2, 1, 0]


def test_rollover_guard(spark):
    rows = spark.createDataFrame([("a", T0, 1)], "k string, ts timestamp_ntz, seq long")
    live.check_rollover(rows, Series("k", "ts", "seq"), T0 + timedelta(seconds=1))
    with pytest.raises(ValueError):
        live.check_rollover(rows, Series("k", "ts", "seq"), T0)


def test_arrays(spark):
    made = spark.range(1).select(*[arrays.new_array(kind, 3).alias(kind) for kind in arrays.ZERO])
    assert {f.name: f.dataType.elementType.simpleString() for f in made.schema} == {"boolean": "boolean", "byte": "tinyint", "int": "int", "long": "bigint", "double": "double"}
    row = made.select(arrays.put(F.col("double"), F.lit(1), F.lit(2.5)).alias("d"), arrays.get(F.col("int"), 3).alias("beyond"), arrays.set_bits(arrays.bit_set(F.array(F.lit(0), F.lit(2)), 4)).alias("s")).first()
    assert (row.d, row.beyond, row.s) == ([0.0, 2.5, 0.0], None, [0, 2])
    with pytest.raises(ValueError):
        arrays.new_array("text", 1)


def test_a_series_needs_a_tie_breaker():
    with pytest.raises(ValueError):
        Series("k", "ts", "")
