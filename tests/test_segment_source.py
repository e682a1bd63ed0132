"""Segments as a source: which are loaded, what their filters leave out, and errors that name them."""

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.sources.segment_source import Segment, read_segments, stored_segments

T0 = datetime(2000, 1, 1)
DAYS = [Segment(f"d{i}", T0 + timedelta(days=i), T0 + timedelta(days=i + 1)) for i in range(5)]
SCHEMA = "k string, ts timestamp_ntz, v long"


def loader(notes, broken=None, late=None):
    """Four rows a day; notes the days it is asked for. The third day is empty."""

    def load(segment):
        with open(f"{notes}/{segment.name}", "w"):
            pass
        if segment.name == broken:
            raise OSError("no such page")
        rows = range(0 if segment.name == "d2" else 4)
        shift = timedelta(days=1) if segment.name == late else timedelta(0)
        yield pa.RecordBatch.from_pydict({"k": ["a"] * len(rows), "ts": pa.array([segment.low + shift + timedelta(hours=6 * i) for i in rows], pa.timestamp("us")), "v": pa.array(list(rows), pa.int64())})

    return load


def test_only_asked_segments_are_loaded(spark, tmp_path):
    rows = [("a", d.low + timedelta(hours=6 * i), i) for d in DAYS if d.name != "d2" for i in range(4)]
    noon, midnight = T0 + timedelta(days=1, hours=12), T0 + timedelta(days=3)
    cases = [
        ("true", lambda t: True, {0, 1, 2, 3, 4}),
        (f"ts >= timestamp_ntz '{noon}'", lambda t: t >= noon, {1, 2, 3, 4}),
        (f"ts > timestamp_ntz '{noon}' and ts < timestamp_ntz '{midnight}'", lambda t: noon < t < midnight, {1, 2}),
        (f"ts <= timestamp_ntz '{midnight}' and v = 0", lambda t: t <= midnight and t.hour == 0, {0, 1, 2, 3}),
        (f"ts = timestamp_ntz '{midnight}'", lambda t: t == midnight, {3}),
        (f"ts > timestamp_ntz '{T0 + timedelta(days=9)}'", lambda t: False, set()),
        (f"v < 2 or ts < timestamp_ntz '{noon}'", lambda t: t.hour < 12 or t < noon, {0, 1, 2, 3, 4}),
    ]
    for i, (where, right, days) in enumerate(cases):
        (notes := tmp_path / str(i)).mkdir()
        got = read_segments(spark, DAYS, loader(notes), SCHEMA, "ts").where(where).collect()
        assert sorted(map(tuple, got)) == [r for r in rows if right(r[1])], where
        assert {p.name for p in notes.iterdir()} == {f"d{d}" for d in days}, where
    assert read_segments(spark, [], loader(tmp_path), SCHEMA, "ts").count() == 0


def test_errors_name_the_segment(spark, tmp_path):
    for kind, says in (({"broken": "d3"}, "no such page"), ({"late": "d3"}, "times from 2000-01-05")):
        with pytest.raises(Exception, match=rf"segment d3 \[2000-01-04 00:00:00, 2000-01-05 00:00:00\).*{says}"):
            read_segments(spark, DAYS, loader(tmp_path, **kind), SCHEMA, "ts").collect()
        early = read_segments(spark, DAYS, loader(tmp_path, **kind), SCHEMA, "ts").where(f"ts < timestamp_ntz '{DAYS[3].low}'")
        assert early.count() == 12 - 4  # what isn't asked for isn't loaded


def test_a_missing_folder_has_no_rows(spark, tmp_path):
    spark.createDataFrame([("a", T0, 1)], SCHEMA).withColumn("segment", F.lit("d0")).write.partitionBy("segment").parquet(str(tmp_path / "rows"))
    got = read_segments(spark, DAYS, stored_segments(str(tmp_path / "rows"), ["k", "ts", "v"]), SCHEMA, "ts").collect()
    assert list(map(tuple, got)) == [("a", T0, 1)]
