"""Bitmaps, bucketed tables, CSV staging, uniqueness on write and the map view on small tables, with their plans."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from chronolith.functions import bitmaps
from chronolith.operators import range_table as rt
from chronolith.operators import staging
from chronolith.sources import bucketed, store


def test_bitmaps_against_sets(spark):
    rnd = random.Random(2)
    pool = [0, 1, -1, 32_767, 32_768, 32_769, -32_767, -32_768, 65_536, 65_537, 1 << 40, -(1 << 40), *range(100, 200)]
    made = {(s, k): {rnd.choice(pool) for _ in range(rnd.randrange(1, 60))} for s in "ab" for k in (1, 2, None)}
    made[("a", 7)] = {5}
    made[("b", 8)] = {6}
    df = {s: bitmaps.build(spark.createDataFrame([(k, i) for (t, k), v in made.items() if t == s for i in [*v, *v, None]], "k int, i long"), ["k"], "i") for s in "ab"}
    sets = {s: {k: v for (t, k), v in made.items() if t == s} for s in "ab"}
    got = lambda d: {k: {r.i for r in d.collect() if r.k == k} for k in {r.k for r in d.collect()}}
    keyed = lambda f: {k: v for k in {*sets["a"], *sets["b"]} if (v := f(sets["a"].get(k, set()), sets["b"].get(k, set())))}
    for s in "ab":
        assert got(bitmaps.members(df[s], ["k"], "i")) == sets[s]
        assert {r.k: r.n for r in bitmaps.sizes(df[s], ["k"]).collect()} == {k: len(v) for k, v in sets[s].items()}
    assert got(bitmaps.members(bitmaps.union([df["a"], df["b"]], ["k"]), ["k"], "i")) == {k: sets["a"].get(k, set()) | sets["b"].get(k, set()) for k in {*sets["a"], *sets["b"]}}
    # keys are compared as joins do: a null key has no partner
    named = lambda d: {k: v for k, v in d.items() if k is not None}
    assert named(got(bitmaps.members(bitmaps.intersection([df["a"], df["b"]], ["k"]), ["k"], "i"))) == named(keyed(lambda a, b: a & b))
    assert named(got(bitmaps.difference(df["a"], df["b"], ["k"], "i"))) == named(keyed(lambda a, b: a - b))


def test_bitmaps_of_sparse_sets_are_no_larger_than_their_numbers(spark):
    """And hold the least and the greatest numbers there are."""
    rows = spark.range(2_000).select((F.col("id") % 50).alias("k"), (F.col("id") * 1_000_003).alias("i"))
    sets = bitmaps.build(rows, ["k"], "i")
    assert dict(sets.dtypes)["bits"] == "bigint" and sets.count() <= 2_000
    ends = [-(1 << 63), -(1 << 63) + 1, -65, -64, -63, -1, 0, 63, 64, (1 << 63) - 1]
    made = bitmaps.build(spark.createDataFrame([(1, i) for i in ends], "k int, i long"), ["k"], "i")
    assert sorted(r.i for r in bitmaps.members(made, ["k"], "i").collect()) == ends
    odd = bitmaps.build(spark.createDataFrame([(1, i) for i in ends[1::2]], "k int, i long"), ["k"], "i")
    assert sorted(r.i for r in bitmaps.difference(made, odd, ["k"], "i").collect()) == ends[::2]


@pytest.fixture(scope="module")
def bucketed_lines(spark, tmp_path_factory):
    name = f"t_{uuid.uuid4().hex}"
    rows = spark.range(5_000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    bucketed.save(rows, name, ["k"], 8, ["k", "v"], str(tmp_path_factory.mktemp("b") / "t"))
    yield name
    spark.sql(f"drop table {name}")


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_table_is_not_shuffled(spark, bucketed_lines, no_broadcast):
    asked = spark.range(0, 900, 3).select(F.col("id").alias("k"))
    found = bucketed.get(spark, bucketed_lines, asked, ["k"])
    p = plan(found)
    assert p.count("Exchange") == 1 and p.index("Exchange") > p.index("FileScan")  # the asked keys' only
    assert sorted(r.v for r in found.collect()) == [i for i in range(5_000) if i % 700 % 3 == 0]
    both = bucketed.joined(spark, bucketed_lines, spark.table(bucketed_lines).withColumnRenamed("v", "w"), ["k"])
    assert "Exchange" not in plan(both) and both.count() == sum(len(range(k, 5_000, 700)) ** 2 for k in range(700))
    counted = spark.table(bucketed_lines).groupBy("k").agg(F.sum("v"))
    assert "Exchange" not in plan(counted)


def test_a_point_reads_one_bucket(spark, bucketed_lines):
    one = bucketed.point(spark, bucketed_lines, k=17)
    assert sorted(r.v for r in one.collect()) == list(range(17, 5_000, 700))
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    buckets = {f: n for f, n in spark.table(bucketed_lines).groupBy(F.input_file_name()).count().collect()}
    home = one.select(F.input_file_name()).first()[0]
    assert len(buckets) == 8 and leaf.metrics().apply("numOutputRows").value() == buckets[home]  # of that bucket, not of all


def test_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('id;name;at\n1;"one; two";2020-01-01\nx;bad;2020-01-01\n2;;2020-01-01\n3;three\n4;four;2020-01-01;more\n;none;2020-01-01\n5;five;soon\n')
    (tmp_path / "in/b.csv").write_text("id;name;at\n6;six;\n")
    staged, rejected = staging.stage_csv(spark, f"{tmp_path}/in", "id long, name string, at date", ["id", "name"], header=True, sep=";")
    assert sorted((r.id, r.name, str(r["at"])) for r in staged.collect()) == [(1, "one; two", "2020-01-01"), (6, "six", "None")]
    got = sorted((r.reason, r.line or "", os.path.basename(r.file)) for r in rejected.collect())
    assert got == sorted([("malformed", x, "a.csv") for x in ("x;bad;2020-01-01", "3;three", "4;four;2020-01-01;more", "5;five;soon")] + [("missing", "", "a.csv")] * 2)


def test_unique_on_write(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, "a int, b string, v int")
    files = lambda: {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)} if os.path.exists(path) else {}
    assert staging.insert_unique(frame((1, "x", 1), (1, "y", 2), (2, None, 3), (2, None, 4), (None, "x", 5)), path, ["a", "b"]) == 5
    assert staging.insert_unique(frame((2, None, 6), (3, "x", 7)), path, ["a", "b"]) == 2
    before = files()
    for bad, said in ((frame((4, "p", 1), (4, "p", 2)), "occurs more than once"), (frame((5, "n", 1), (1, "y", 2)), "is stored already")):
        with pytest.raises(staging.NotUnique, match=said):
            staging.insert_unique(bad, path, ["a", "b"])
        assert files() == before
    with pytest.raises(staging.NotUnique, match=re.escape("'a': 4")):
        staging.insert_unique(frame((4, "p", 1), (4, "p", 2)), path, ["a", "b"])
    assert staging.insert_unique(frame(), path, ["a", "b"]) == 0
    p = plan(staging.clashes(frame((3, "q", 1), (7, "q", 1)), spark.read.parquet(path), ["a", "b"]))
    assert "GreaterThanOrEqual(a,3)" in p and "LessThanOrEqual(a,7)" in p


def test_map_view(spark):
    t = rt.Table("h", "r")
    rows = spark.createDataFrame([(1, None, 10), (1, 1, None), (2, 2, 20), (3, None, 30)], "h int, r int, v int")
    asked = spark.createDataFrame([(10,), (10,), (99,), (None,)], "v int")
    assert {r.v: r.there for r in rt.contains_values(rows, asked, "v").collect()} == {10: True, 99: False, None: True}
    gone = spark.createDataFrame([(1, None, 10), (1, 1, None), (2, 2, 21), (9, 9, 9)], "h int, r int, v int")
    assert sorted(r.h for r in rt.remove_if(rows, gone, t, "v").collect()) == [2, 3]
    keys = spark.createDataFrame([(1, None), (2, 2), (2, 2), (5, None), (6, 6)], "h int, r int")
    new = lambda old, stored: F.when(~stored & (F.col("_h") == 5), 50).when(old == 10, 11)
    got = sorted((r.h, r.r or 0, r.v or 0) for r in rt.compute(rows, keys, t, "v", new).collect())
    # 2 becomes null and goes, 6 isn't made; what isn't asked stays, null or not
    assert got == [(1, 0, 11), (1, 1, 0), (3, 0, 30), (5, 0, 50)]


def test_places_follow_the_order_of_reading(spark):
    df = spark.range(1_000).select(F.pmod(F.hash("id"), F.lit(97)).alias("a"), "id")
    up = store.with_places(df.orderBy(F.desc("a"), "id"), "nth", 1).collect()
    assert [r.id for r in sorted(up, key=lambda r: r.nth)] == [r.id for r in sorted(up, key=lambda r: (-r.a, r.id))]
    assert sorted(r.nth for r in up) == list(range(1, 1_001))
    assert store.with_places(df.limit(0).orderBy("a"), "nth").collect() == []
