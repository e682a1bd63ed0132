"""The registered queries, each over whole tables, and the SQL each must equal."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import arrays, bitmaps
from chronolith.functions.segments import Segments
from chronolith.operators import range_table as rt
from chronolith.operators import relational as rel
from chronolith.operators import segmented, series, staging
from chronolith.operators.series import Series
from chronolith.sources import bucketed, store
from chronolith.sources.scratch import scratch
from chronolith.sources.segment_source import Segment, read_segments, stored_segments
from chronolith.sources.segment_store import SegmentStore
from chronolith.streaming import live
from chronolith.streaming.ingest import Ingest, expired
from chronolith.streaming.rollover import Rollover

EVENTS = Series(key="user_id", end="ts", seq="event_id")
ORDERS = Series(key="o_custkey", end="o_orderdate", seq="o_orderkey", bucket="year")
#: Written in another order than time's: the sequence number is the id with its lowest six bits flipped.
FLIPPED = Series(key="user_id", end="ts", seq="seq")
LOW, HIGH = datetime(2024, 1, 8), datetime(2024, 1, 20)
ROW = ["event_id", "ts", "value"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


def flipped(spark, sf_dir):
    return events(spark, sf_dir).withColumn("seq", F.col("event_id").bitwiseXOR(F.lit(63)))


def probes(spark, sf_dir):
    """Each event asks for its user's state twelve hours before."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), "user_id", F.expr("ts - interval 12 hours").alias("at"))


def located(spark, sf_dir):
    return series.locate(events(spark, sf_dir), EVENTS, probes(spark, sf_dir), "user_id", "at")


BETWEEN = f"between timestamp '{LOW}' and timestamp '{HIGH}'"
PLACED = "s as (select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events)"
LOCATED = (
    f"with {PLACED}, p as (select event_id as probe_id, user_id, ts - interval 12 hour as at from events), "
    "c as (select p.probe_id, p.user_id, p.at, count(*) filter (s.ts < p.at) as lt, count(*) filter (s.ts <= p.at) as le, count(*) as n "
    "from p join s on s.user_id = p.user_id group by all) "
)
LATEST = "greatest(0, le - 1)"
FETCHED = "select c.probe_id, c.user_id, s.event_id, s.ts, s.value from c join s on s.user_id = c.user_id and s.pos = "


def back(n: int) -> str:
    exact = "when le > lt then greatest(0, lt - 1) " if n == 1 else ""
    return f"case when lt = 0 then 0 {exact}else greatest(0, le - 1 - {n}) end"


def on(n: int) -> str:
    return f"least(c.n - 1, (case when le > lt then le - 1 else le end) + {n})"


def fetched(spark, sf_dir, position):
    rows = series.fetch(events(spark, sf_dir), EVENTS, located(spark, sf_dir), "user_id", position, ROW)
    return rows.select("probe_id", "user_id", *ROW)


# ---------------------------------------------------------------- lookups


@query("ts_range", f"select user_id, ts, event_id, value from events where ts {BETWEEN}")
def ts_range(spark, sf_dir):
    return series.range_rows(events(spark, sf_dir), EVENTS, LOW, HIGH)


@query("ts_range_reverse", f"select user_id, ts, event_id, value, row_number() over (order by user_id, ts desc, event_id desc) - 1 as nth from events where ts {BETWEEN}")
def ts_range_reverse(spark, sf_dir):
    return store.with_places(series.range_rows(events(spark, sf_dir), EVENTS, LOW, HIGH, reverse=True), "nth")


@query("ts_full_scan", "select user_id, ts, event_id, value from events where ts is not null and user_id is not null")
def ts_full_scan(spark, sf_dir):
    return series.range_rows(events(spark, sf_dir), EVENTS)


@query("ts_latest", LOCATED + FETCHED + LATEST)
def ts_latest(spark, sf_dir):
    return series.latest(events(spark, sf_dir), EVENTS, probes(spark, sf_dir), "user_id", "at", ROW).select("probe_id", "user_id", *ROW)


@query("ts_latest_key", LOCATED + f"select c.probe_id, s.ts from c join s on s.user_id = c.user_id and s.pos = {LATEST}")
def ts_latest_key(spark, sf_dir):
    return ts_latest(spark, sf_dir).select("probe_id", "ts")


@query("ts_latest_index", LOCATED + f"select probe_id, user_id, lt, le, n, {LATEST} as position from c")
def ts_latest_index(spark, sf_dir):
    return located(spark, sf_dir).select("probe_id", "user_id", "lt", "le", "n", series.latest_position().alias("position"))


@query(
    "ts_at_index",
    f"with {PLACED}, p as (select event_id as probe_id, user_id, event_id % 50 - 10 as idx from events) "
    "select p.probe_id, p.user_id, p.idx, s.event_id, s.ts, s.value from p join s on s.user_id = p.user_id and s.pos = least(greatest(p.idx, 0), s.n - 1)",
)
def ts_at_index(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), "user_id", (F.col("event_id") % 50 - 10).alias("idx"))
    return series.at_index(events(spark, sf_dir), EVENTS, asked, "user_id", "idx", ROW).select("probe_id", "user_id", "idx", *ROW)


@query("ts_at_index_key", f"with {PLACED} select e.event_id as probe_id, s.ts from events e join s on s.user_id = e.user_id and s.pos = least(greatest(e.event_id % 50 - 10, 0), s.n - 1)")
def ts_at_index_key(spark, sf_dir):
    return ts_at_index(spark, sf_dir).select("probe_id", "ts")


@query("ts_count", "select user_id, count(*) as n from events where ts is not null group by user_id")
def ts_count(spark, sf_dir):
    return series.counts(events(spark, sf_dir), EVENTS)


@query("ts_count_range", f"select user_id, count(*) as n from events where ts {BETWEEN} group by user_id")
def ts_count_range(spark, sf_dir):
    return series.counts(events(spark, sf_dir), EVENTS, LOW, HIGH)


@query("ts_previous", LOCATED + FETCHED + back(1))
def ts_previous(spark, sf_dir):
    return fetched(spark, sf_dir, series.previous_position(1))


@query("ts_previous_3", LOCATED + FETCHED + back(3))
def ts_previous_3(spark, sf_dir):
    return fetched(spark, sf_dir, series.previous_position(3))


@query("ts_next", LOCATED + FETCHED + on(1))
def ts_next(spark, sf_dir):
    return fetched(spark, sf_dir, series.next_position(1))


@query("ts_next_3", LOCATED + FETCHED + on(3))
def ts_next_3(spark, sf_dir):
    return fetched(spark, sf_dir, series.next_position(3))


@query("ts_previous_key", LOCATED + f"select c.probe_id, s.ts from c join s on s.user_id = c.user_id and s.pos = {back(1)}")
def ts_previous_key(spark, sf_dir):
    return ts_previous(spark, sf_dir).select("probe_id", "ts")


@query("ts_next_key", LOCATED + f"select c.probe_id, s.ts from c join s on s.user_id = c.user_id and s.pos = {on(1)}")
def ts_next_key(spark, sf_dir):
    return ts_next(spark, sf_dir).select("probe_id", "ts")


#: Orders of a day tie: each order asks at its own day.
TIES = (
    "with s as (select o_custkey, o_orderdate, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as pos from orders), "
    "c as (select p.o_orderkey as probe_id, p.o_custkey, count(*) filter (s.o_orderdate < p.o_orderdate) as lt, count(*) filter (s.o_orderdate <= p.o_orderdate) as le, count(*) as n "
    "from orders p join s on s.o_custkey = p.o_custkey group by all) select c.probe_id, s.o_orderkey, s.o_totalprice from c join s on s.o_custkey = c.o_custkey and s.pos = "
)


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


def order_days(spark, sf_dir):
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"))


@query("ts_latest_ties", TIES + LATEST)
def ts_latest_ties(spark, sf_dir):
    return series.latest(orders(spark, sf_dir), ORDERS, order_days(spark, sf_dir), "cust", "at", ["o_orderkey", "o_totalprice"]).select("probe_id", "o_orderkey", "o_totalprice")


def _ties(position):
    def run(spark, sf_dir):
        found = series.locate(orders(spark, sf_dir), ORDERS, order_days(spark, sf_dir), "cust", "at")
        return series.fetch(orders(spark, sf_dir), ORDERS, found, "cust", position(), ["o_orderkey", "o_totalprice"]).select("probe_id", "o_orderkey", "o_totalprice")

    return run


query("ts_previous_ties", TIES + back(1))(_ties(lambda: series.previous_position(1)))
query("ts_next_ties", TIES + on(1))(_ties(lambda: series.next_position(1)))


@query(
    "ts_edges",
    f"with {PLACED} select a.user_id, a.event_id as first_event_id, a.ts as first_ts, a.value as first_value, b.event_id as last_event_id, b.ts as last_ts, b.value as last_value "
    "from s a join s b on a.user_id = b.user_id and a.pos = 0 and b.pos = b.n - 1",
)
def ts_edges(spark, sf_dir):
    return series.edges(events(spark, sf_dir), EVENTS, ROW)


VIOLATIONS = "v as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by xor(event_id, 63)) as previous_end from events)"


@query("ts_violations", f"with {VIOLATIONS} select user_id, event_id, ts, previous_end from v where ts < previous_end")
def ts_violations(spark, sf_dir):
    return series.violations(flipped(spark, sf_dir), FLIPPED).select("user_id", "event_id", "ts", "previous_end")


@query(
    "ts_states",
    f"with {VIOLATIONS}, k as (select distinct user_id from events union select distinct user_id + 100000 from events) "
    "select k.user_id, count(v.user_id) as n, count(*) filter (ts < previous_end) as violations, count(v.user_id) = 0 as empty, count(*) filter (ts < previous_end) > 0 as inconsistent from k left join v on v.user_id = k.user_id group by k.user_id",
)
def ts_states(spark, sf_dir):
    """Of all users, and of as many that have no rows."""
    rows = flipped(spark, sf_dir)
    asked = rows.select("user_id").unionByName(rows.select((F.col("user_id") + 100_000).alias("user_id")))
    return series.series_states(rows, FLIPPED, asked)


@query("ts_delete", "select user_id, ts, event_id, value from events where user_id not in (1, 2, 3)")
def ts_delete(spark, sf_dir):
    return store.without_series(events(spark, sf_dir), EVENTS, [1, 2, 3])


# ---------------------------------------------------------------- historical queries


@query("hist_previous_value", LOCATED + f"select c.probe_id, case when s.ts <= c.at then s.event_id end as event_id, coalesce(case when s.ts <= c.at then s.ts end, c.at) as key from c join s on s.user_id = c.user_id and s.pos = {back(2)}")
def hist_previous_value(spark, sf_dir):
    rows = series.fetch(events(spark, sf_dir), EVENTS, located(spark, sf_dir), "user_id", series.previous_position(2), ROW)
    held = F.col("ts") <= F.col("at")
    return rows.select("probe_id", F.when(held, F.col("event_id")).alias("event_id"), F.coalesce(F.when(held, F.col("ts")), "at").alias("key"))


@query("hist_next_value", LOCATED + f"select c.probe_id, case when s.ts >= c.at then s.event_id end as event_id from c join s on s.user_id = c.user_id and s.pos = {on(2)}")
def hist_next_value(spark, sf_dir):
    rows = series.fetch(events(spark, sf_dir), EVENTS, located(spark, sf_dir), "user_id", series.next_position(2), ROW)
    return rows.select("probe_id", F.when(F.col("ts") >= F.col("at"), F.col("event_id")).alias("event_id"))


@query("hist_previous_values", LOCATED + "select c.probe_id, s.pos as position, s.event_id, s.ts from c join s on s.user_id = c.user_id and s.pos between le - 4 and le - 1")
def hist_previous_values(spark, sf_dir):
    return series.neighbours(events(spark, sf_dir), EVENTS, located(spark, sf_dir), "user_id", 4, ROW).select("probe_id", "position", "event_id", "ts")


@query("hist_next_values", LOCATED + "select c.probe_id, s.pos as position, s.event_id, s.ts from c join s on s.user_id = c.user_id and s.pos between lt and lt + 3")
def hist_next_values(spark, sf_dir):
    return series.neighbours(events(spark, sf_dir), EVENTS, located(spark, sf_dir), "user_id", -4, ROW).select("probe_id", "position", "event_id", "ts")


@query("hist_same_value", f"select user_id, event_type, max(ts) as ts from events where ts {BETWEEN} group by user_id, event_type")
def hist_same_value(spark, sf_dir):
    return series.same_value(table(spark, sf_dir, "events"), EVENTS, "event_type", LOW, HIGH)


@query("hist_adjusted", LOCATED.replace("ts - interval 12 hour as at", f"least(ts - interval 12 hour, timestamp '{HIGH}') as at") + FETCHED + LATEST)
def hist_adjusted(spark, sf_dir):
    pinned = series.adjusted(probes(spark, sf_dir), "at", HIGH)
    return series.latest(events(spark, sf_dir), EVENTS, pinned, "user_id", "at", ROW).select("probe_id", "user_id", *ROW)


# ---------------------------------------------------------------- segments


def _segments(spec: Segments):
    def run(spark, sf_dir):
        low, high = spec.columns(F.col("ts"))
        return events(spark, sf_dir).select("event_id", low.alias("segment_from"), high.alias("segment_to"))

    return run


def _segment_sql(low: str, high: str) -> str:
    return f"with b as (select event_id, ts, date_trunc('year', ts) as y from events) select event_id, {low} as segment_from, {high} as segment_to from b"


DAYS10 = "y + to_days(cast(floor(date_diff('day', y, ts) / 10.0) * 10 as integer))"
MONDAY = "date_trunc('week', y)"
WEEKS2 = f"{MONDAY} + to_days(cast(floor(date_diff('day', {MONDAY}, ts) / 14.0) * 14 as integer))"
YEAR_END = "y + interval 1 year"
query("seg_month", _segment_sql("cast(date_trunc('month', ts) as timestamp)", "cast(date_trunc('month', ts) + interval 1 month as timestamp)"))(_segments(Segments("month")))
query("seg_hours_6", _segment_sql("time_bucket(interval 6 hour, ts)", "time_bucket(interval 6 hour, ts) + interval 6 hour"))(_segments(Segments("hour", 6)))
query("seg_months_3", _segment_sql("cast(date_trunc('quarter', ts) as timestamp)", "cast(date_trunc('quarter', ts) + interval 3 month as timestamp)"))(_segments(Segments("month", 3)))
query("seg_days_10", _segment_sql(f"cast({DAYS10} as timestamp)", f"cast(least({DAYS10} + interval 10 day, {YEAR_END}) as timestamp)"))(_segments(Segments("day", 10)))
query("seg_weeks_2", _segment_sql(f"cast(greatest(y, {WEEKS2}) as timestamp)", f"cast(least({WEEKS2} + interval 14 day, {YEAR_END}) as timestamp)"))(_segments(Segments("week", 2)))
query("seg_years_5", _segment_sql("make_timestamp(year(ts) // 5 * 5, 1, 1, 0, 0, 0)", "make_timestamp(year(ts) // 5 * 5 + 5, 1, 1, 0, 0, 0)"))(_segments(Segments("year", 5)))
query("seg_day_zone", _segment_sql("cast(date_trunc('day', ts + interval 9 hour) as timestamp) - interval 9 hour", "cast(date_trunc('day', ts + interval 9 hour) as timestamp) + interval 15 hour"))(_segments(Segments("day", zone="Asia/Tokyo")))

def _neighbour_segments(spark, sf_dir):
    after, before = segmented.next_segment(Segments("month"), F.col("ts")), segmented.previous_segment(Segments("day", 10), F.col("ts"))
    return events(spark, sf_dir).select("event_id", after[0].alias("next_from"), after[1].alias("next_to"), before[0].alias("previous_from"), before[1].alias("previous_to"))


query(
    "seg_neighbours",
    "with e as (select event_id, ts, date_trunc('year', ts) as y, cast(floor((dayofyear(ts) - 1) / 10.0) * 10 as integer) as k from events), "
    "f as (select *, y + to_days(k) - interval 1 microsecond as b from e), g as (select *, date_trunc('year', b) as z, cast(floor((dayofyear(b) - 1) / 10.0) * 10 as integer) as j from f) "
    "select event_id, cast(date_trunc('month', ts) + interval 1 month as timestamp) as next_from, cast(date_trunc('month', ts) + interval 2 month as timestamp) as next_to, cast(z + to_days(j) as timestamp) as previous_from, cast(y + to_days(k) as timestamp) as previous_to from g",
)(_neighbour_segments)


@query("seg_ever", "select event_id, cast(1 as integer) as first_year, cast(9999 as integer) as last_year from events")
def seg_ever(spark, sf_dir):
    low, high = Segments("ever").columns(F.col("ts"))
    return events(spark, sf_dir).select("event_id", F.year(low).alias("first_year"), F.year(high).alias("last_year"))


COUNTED = (
    "h as (select user_id, cast(date_trunc('day', ts) as timestamp) as segment_from, cast(date_trunc('day', ts) + interval 1 day as timestamp) as segment_to, count(*) as rows_in_segment from events group by all), "
    "k as (select *, cast(coalesce(sum(rows_in_segment) over (partition by user_id order by segment_from rows between unbounded preceding and 1 preceding), 0) as bigint) as preceding from h)"
)


@query("seg_counts", f"with {COUNTED} select * from k")
def seg_counts(spark, sf_dir):
    return segmented.segment_counts(events(spark, sf_dir), EVENTS, Segments("day"))


@query(
    "seg_of_position",
    f"with {COUNTED}, p as (select event_id as probe_id, user_id as uid, event_id % 40 as idx from events) "
    "select p.probe_id, p.uid, p.idx, k.segment_from, k.segment_to, p.idx - k.preceding as position_in_segment from p join k on k.user_id = p.uid and p.idx >= preceding and p.idx < preceding + rows_in_segment",
)
def seg_of_position(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("uid"), (F.col("event_id") % 40).alias("idx"))
    return segmented.segment_of_position(seg_counts(spark, sf_dir), EVENTS, asked, "uid", "idx")


@query("seg_enumerate", "select o_custkey, m.m as segment_from, row_number() over (partition by o_custkey order by m.m) - 1 as nth, row_number() over (partition by o_custkey order by m.m desc) - 1 as nth_back from (select o_custkey, date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from orders group by 1), unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 month)) as m(m)")
def seg_enumerate(spark, sf_dir):
    windows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
    return segmented.enumerate_segments(windows, Segments("month"), "low", "high", "20 days").select("o_custkey", "segment_from", "nth", "nth_back")


NEEDED = "n as (select distinct user_id, cast(date_trunc('day', ts) as timestamp) as segment_from from events)"


def _ensured(spark, sf_dir):
    """Days of users are needed; those of every third user are there, and every seventh user's source is empty."""
    low, high = Segments("day").columns(F.col("ts"))
    source = events(spark, sf_dir).withColumns({"segment_from": low, "segment_to": high})
    needed = source.select("user_id", "segment_from", "segment_to").distinct()
    status = needed.where("user_id % 3 = 0").select("user_id", "segment_from", "segment_to", F.lit("COMPLETE").alias("status"))
    load = lambda absent: source.where("user_id % 7 <> 0").join(absent, ["user_id", "segment_from", "segment_to"], "left_semi")
    return segmented.ensure_segments(needed, status, "user_id", load, "ts")


@query("seg_ensure_rows", "select user_id, event_id, ts from events where user_id % 3 <> 0 and user_id % 7 <> 0")
def seg_ensure_rows(spark, sf_dir):
    return _ensured(spark, sf_dir)[0].select("user_id", "event_id", "ts")


@query("seg_ensure_status", f"with {NEEDED} select user_id, segment_from, case when user_id % 3 <> 0 and user_id % 7 = 0 then 'COMPLETE_EMPTY' else 'COMPLETE' end as status from n")
def seg_ensure_status(spark, sf_dir):
    return _ensured(spark, sf_dir)[1].select("user_id", "segment_from", "status")


@query("seg_outside", "select event_id from events where ts >= date_trunc('day', ts) + interval 12 hour")
def seg_outside(spark, sf_dir):
    """Rows in the second half of a day don't belong to a segment that is its first half."""
    low, _ = Segments("day").columns(F.col("ts"))
    rows = events(spark, sf_dir).withColumns({"low": low, "high": F.timestamp_add("HOUR", F.lit(12), low)})
    return segmented.outside_segment(rows, "ts", "low", "high").select("event_id")


# ---------------------------------------------------------------- live ingest and updates


#: Arrival in the order of ``seq``; every 97th event starts a second after its own end.
LIVE = (
    "with a as (select user_id as key, xor(event_id, 63) as seq, ts, value, event_id % 97 = 0 as bad from events), "
    "b as (select *, max(case when not bad then ts end) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as m from a), "
    "c as (select *, case when bad then 'malformed' when m is null or ts >= m then 'accepted' else 'late' end as status from b), "
    "d as (select key, seq, date_trunc('day', ts) > lag(date_trunc('day', ts)) over (partition by key order by seq) as rolled from c where status = 'accepted') "
    "select c.key, c.seq, c.ts as end_ts, c.value, c.status, coalesce(d.rolled, false) as rolled_over from c left join d on d.key = c.key and d.seq = c.seq"
)
LANDED = 2  # parts that arrive one after another


ARRIVING = Series(key="user_id", end="ts", seq="seq", start="start")


def _run(spark, sf_dir, start) -> None:
    """Streams the events in the order of ``seq``: ``start`` makes a query of the stream, which goes on when more files have landed."""
    source = flipped(spark, sf_dir).withColumn("start", F.when(F.col("event_id") % 97 == 0, F.timestamp_add("SECOND", F.lit(1), F.col("ts"))).otherwise(F.col("ts")))
    landing, state = scratch(spark, "landing"), scratch(spark, "live-state")
    top = source.agg(F.max("seq")).first()[0] or 0
    for i in range(LANDED):  # each trigger takes one part, so a state call sees a slice of a key's rows
        part = source.where((F.col("seq") * LANDED >= (top + 1) * i) & (F.col("seq") * LANDED < (top + 1) * (i + 1)))
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(source.schema).parquet(landing)
        start(stream).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _ingest(spark, sf_dir, then=None) -> Ingest:
    sink = Ingest(scratch(spark, "ingest"), ARRIVING, Segments("day"), "value", then=then)
    _run(spark, sf_dir, lambda stream: stream.writeStream.foreachBatch(sink.persist))
    return sink


@query("live_ingest", LIVE)
def live_ingest(spark, sf_dir):
    return _ingest(spark, sf_dir).rows(spark).select("key", "seq", "end_ts", "value", "status", "rolled_over")


@query("live_ingest_stateful", LIVE)
def live_ingest_stateful(spark, sf_dir):
    """The same by the engine's own state, as a stream that other streaming operators can follow."""
    out = scratch(spark, "live")
    rows = lambda stream: live.live_ingest(stream, ARRIVING, Segments("day"), "value")
    _run(spark, sf_dir, lambda stream: rows(stream).writeStream.format("parquet").option("path", out))
    return spark.read.parquet(out).select("key", "seq", F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "value", "status", "rolled_over")


@query("live_expired", f"with r as ({LIVE}) select key, max(end_ts) as last_end, cast(date_trunc('day', max(end_ts)) as timestamp) as segment_from, max(end_ts) < timestamp '2024-01-30' as expired from r where status = 'accepted' group by key")
def live_expired(spark, sf_dir):
    """States of the keys, and whether they are older than two days at the first of February."""
    return expired(_ingest(spark, sf_dir).states(spark), F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"), 2 * 86_400)


def _two_tables(spark, sf_dir):
    """History, and a live table whose values are larger by 1."""
    rows = events(spark, sf_dir)
    return rows, rows.withColumn("value", F.col("value") + 1)


@query("live_union", f"select user_id, ts, event_id, case when ts < timestamp '{LOW}' then value else value + 1 end as value from events")
def live_union(spark, sf_dir):
    return live.unified(*_two_tables(spark, sf_dir), "ts", F.lit(LOW).cast("timestamp_ntz"))


@query("live_latest", LOCATED + f"select c.probe_id, s.event_id, case when s.ts < timestamp '{LOW}' then s.value else s.value + 1 end as value from c join s on s.user_id = c.user_id and s.pos = {LATEST}")
def live_latest(spark, sf_dir):
    return live.latest_of_both(*_two_tables(spark, sf_dir), EVENTS, LOW, probes(spark, sf_dir), "user_id", "at", ROW).select("probe_id", "event_id", "value")


@query("update_resume", f"with r as (select user_id, max(ts) as at from events where ts <= timestamp '{LOW}' group by user_id) select e.user_id, e.ts, e.event_id, case when r.at is null or e.ts >= r.at then value + 1 else value end as value from events e left join r on r.user_id = e.user_id")
def update_resume(spark, sf_dir):
    stored, source = _two_tables(spark, sf_dir)
    return store.resumed(store.until(stored, EVENTS, F.lit(LOW).cast("timestamp_ntz")), source, EVENTS)


@query("update_load", SQL["update_resume"])
def update_load(spark, sf_dir):
    """The source is asked for rows from each key's resume point on."""
    stored, source = _two_tables(spark, sf_dir)

    def load(points):
        asked = source.join(points, "user_id", "left")
        return asked.where(F.col("resume_at").isNull() | (F.col("ts") >= F.col("resume_at"))).drop("resume_at")

    return store.update(store.until(stored, EVENTS, F.lit(LOW).cast("timestamp_ntz")), load, EVENTS)


@query("live_rollover_guard", f"select exists (select 1 from events where ts >= timestamp '{LOW}') as refused, count(*) filter (ts < timestamp '{LOW}') as history, count(*) filter (ts >= timestamp '{LOW}') as live from events")
def live_rollover_guard(spark, sf_dir):
    """History that reaches into the live segment is refused; history that ends before it is taken."""
    rows = events(spark, sf_dir)
    before = rows.where(F.col("ts") < F.lit(LOW).cast("timestamp_ntz"))
    live.check_rollover(before, EVENTS, LOW)
    try:
        live.check_rollover(rows, EVENTS, LOW)
        refused = False
    except ValueError:
        refused = True
    whole = live.unified(before, rows, "ts", F.lit(LOW).cast("timestamp_ntz"))
    old = F.col("ts") < F.lit(LOW).cast("timestamp_ntz")
    return whole.agg(F.count_if(old).alias("history"), F.count_if(~old).alias("live")).withColumn("refused", F.lit(refused))


@query("update_progress", f"select user_id, count(*) as rows, min(ts) as first, max(ts) as last, least(100.0, greatest(0.0, round(100.0 * date_sub('second', timestamp '{LOW}', max(ts)) / date_sub('second', timestamp '{LOW}', timestamp '{HIGH}'), 6))) as percent from events group by user_id")
def update_progress(spark, sf_dir):
    return store.progress(events(spark, sf_dir), EVENTS, LOW, HIGH)


@query("update_gaps", "select user_id, max(ts) as last, date_sub('second', max(ts), timestamp '2024-02-01') as missing_seconds from events group by user_id having date_sub('second', max(ts), timestamp '2024-02-01') > 172800")
def update_gaps(spark, sf_dir):
    return store.gaps(events(spark, sf_dir), EVENTS, datetime(2024, 2, 1), 172_800)


@query("collection_reverse", "select o_orderkey, o_totalprice, row_number() over (order by o_orderkey desc) as nth from orders")
def collection_reverse(spark, sf_dir):
    path = scratch(spark, "collection")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for part in (rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1")):
        store.append_rows(part, path, "o_orderkey")
    return store.with_places(store.iterate(spark, path, "o_orderkey", reverse=True), "nth", 1)


@query(
    "arrays_typed",
    "select l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') as bits, count(distinct l_linenumber) as n, max(case when l_linenumber = 2 then 1 else 0 end) = 1 as second from lineitem group by l_orderkey",
)
def arrays_typed(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("at"))  # a handful of lines an order
    made = held.withColumn("flags", arrays.bit_set(F.col("at"), F.array_max("at") + 1))
    three = arrays.put(arrays.new_array("boolean", 3), F.lit(2), F.coalesce(arrays.get(F.col("flags"), 2), F.lit(False)))
    return made.select("l_orderkey", F.array_join(arrays.set_bits(F.col("flags")).cast("array<string>"), ",").alias("bits"), F.size(arrays.set_bits(F.col("flags"))).cast("long").alias("n"), arrays.get(three, 2).alias("second"))


def _order_sets(spark, sf_dir) -> list[DataFrame]:
    """Per supplier the orders with a returned line, and those with a line that isn't the first."""
    rows = table(spark, sf_dir, "lineitem")
    return [bitmaps.build(rows.where(test), ["l_suppkey"], "l_orderkey") for test in ("l_returnflag = 'R'", "l_linenumber > 1")]


BITMAPS = "with a as (select distinct l_suppkey, l_orderkey from lineitem where l_returnflag = 'R'), b as (select distinct l_suppkey, l_orderkey from lineitem where l_linenumber > 1) "


@query(
    "bitmap_counts",
    BITMAPS + "select l_suppkey, count(*) filter (k = 1) as returned, count(*) filter (k = 2) as later, count(*) filter (k = 3) as both, count(*) filter (k = 4) as either from ("
    "select l_suppkey, 1 as k from a union all select l_suppkey, 2 from b union all select l_suppkey, 3 from a join b using (l_suppkey, l_orderkey) union all select l_suppkey, 4 from (select * from a union select * from b)) group by l_suppkey",
)
def bitmap_counts(spark, sf_dir):
    a, b = _order_sets(spark, sf_dir)
    key = ["l_suppkey"]
    named = {"returned": a, "later": b, "both": bitmaps.intersection([a, b], key), "either": bitmaps.union([a, b], key)}
    sized = [bitmaps.sizes(held, key).select("l_suppkey", F.lit(name).alias("which"), "n") for name, held in named.items()]
    together = sized[0].unionByName(sized[1]).unionByName(sized[2]).unionByName(sized[3])
    return together.groupBy("l_suppkey").agg(*[F.coalesce(F.sum(F.when(F.col("which") == name, F.col("n"))), F.lit(0)).alias(name) for name in named])


@query("bitmap_members", BITMAPS + "select l_suppkey, l_orderkey, true as both from a join b using (l_suppkey, l_orderkey) union all select l_suppkey, l_orderkey, false from (select * from a except select * from b)")
def bitmap_members(spark, sf_dir):
    a, b = _order_sets(spark, sf_dir)
    key = ["l_suppkey"]
    met = bitmaps.members(bitmaps.intersection([a, b], key), key, "l_orderkey").withColumn("both", F.lit(True))
    return met.unionByName(bitmaps.difference(a, b, key, "l_orderkey").withColumn("both", F.lit(False)))


@query("store_round_trip", "select o_custkey, o_orderdate, o_orderkey, o_totalprice from orders")
def store_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    path = scratch(spark, "store")
    store.write(rows, ORDERS, Segments("year"), path)
    return store.read(spark, path).drop("segment")


def event_store(spark, rows: DataFrame) -> SegmentStore:
    made = SegmentStore(scratch(spark, "segments"), EVENTS, Segments("day"), "user_id long, ts timestamp_ntz, event_id long, value double")
    made.write(rows)
    return made


#: Up to LOW, then up to HIGH with values larger by 1, then all with values larger by 2.
UPDATED = (
    f"with a as (select user_id, max(ts) as at from events where ts <= timestamp '{LOW}' group by user_id), b as (select user_id, max(ts) as at from events where ts <= timestamp '{HIGH}' group by user_id), "
    f"u as (select e.user_id, e.ts, e.event_id, case when b.at is null or e.ts >= b.at then value + 2 when a.at is null or e.ts >= a.at then value + 1 else value end as value "
    "from events e left join a on a.user_id = e.user_id left join b on b.user_id = e.user_id) "
)


def _updated(spark, sf_dir) -> SegmentStore:
    rows = events(spark, sf_dir)
    made = event_store(spark, store.until(rows, EVENTS, F.lit(LOW).cast("timestamp_ntz")))
    made.update(store.until(rows, EVENTS, F.lit(HIGH).cast("timestamp_ntz")).withColumn("value", F.col("value") + 1))
    made.update(rows.withColumn("value", F.col("value") + 2))
    return made


@query("store_update", UPDATED + "select user_id, ts, event_id, value, cast(date_trunc('day', ts) as timestamp) as day from u")
def store_update(spark, sf_dir):
    return _updated(spark, sf_dir).rows(spark).select("user_id", "ts", "event_id", "value", F.to_timestamp_ntz("segment", F.lit("yyyy-MM-dd'T'HHmmss")).alias("day"))


@query(
    "store_summary",
    UPDATED + "select user_id, cast(date_trunc('day', ts) as timestamp) as segment_from, count(*) as n, min(ts) as low, max(ts) as high, "
    "arg_min(value, struct_pack(a := ts, b := event_id)) as first_value, arg_max(value, struct_pack(a := ts, b := event_id)) as last_value from u group by all",
)
def store_summary(spark, sf_dir):
    """After two updates, the summary is that of all rows."""
    return _updated(spark, sf_dir).summary(spark).select("user_id", "segment_from", "n", "low", "high", F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"))


#: Users with the customer keys of some orders go, and then all from the hundredth on.
DELETED = "from events where user_id not in (select o_custkey from orders where o_orderkey % 40 = 0) and user_id < 100"


@query("store_delete", "select user_id, ts, event_id, value " + DELETED)
def store_delete(spark, sf_dir):
    made = event_store(spark, events(spark, sf_dir))
    made.delete(table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("user_id")))
    made.delete(events(spark, sf_dir).where("user_id >= 100"))
    return made.rows(spark).drop("segment")


@query("store_counts", f"select user_id, count(*) as n from events where ts {BETWEEN} group by user_id")
def store_counts(spark, sf_dir):
    """The ends of the range lie within days, which are read; the days between are counted by the summary."""
    return event_store(spark, events(spark, sf_dir)).counts(spark, LOW, HIGH)


@query("store_edges", SQL["ts_edges"])
def store_edges(spark, sf_dir):
    return event_store(spark, events(spark, sf_dir)).edges(spark, ROW)


@query("store_preceding", SQL["seg_counts"])
def store_preceding(spark, sf_dir):
    return event_store(spark, events(spark, sf_dir)).segment_counts(spark)


@query("store_latest", SQL["ts_latest"])
def store_latest(spark, sf_dir):
    return event_store(spark, events(spark, sf_dir)).latest(probes(spark, sf_dir), "user_id", "at", ROW).select("probe_id", "user_id", *ROW)


@query("store_latest_few", LOCATED.replace("from events), c as", "from events where event_id % 5 = 0 and ts between timestamp '2024-01-11' and timestamp '2024-01-12'), c as") + FETCHED + LATEST)
def store_latest_few(spark, sf_dir):
    """Probes of one day's events, at times a half day before: two folders of rows are read."""
    asked = table(spark, sf_dir, "events").where("event_id % 5 = 0 and ts between timestamp_ntz '2024-01-11' and timestamp_ntz '2024-01-12'")
    asked = asked.select(F.col("event_id").alias("probe_id"), "user_id", F.expr("ts - interval 12 hours").alias("at"))
    return event_store(spark, events(spark, sf_dir)).latest(asked, "user_id", "at", ROW).select("probe_id", "user_id", *ROW)


@query("seg_source", f"select user_id, ts, event_id, value from events where ts {BETWEEN}")
def seg_source(spark, sf_dir):
    """Segments loaded one by one, only those that the asked times lie in."""
    made = event_store(spark, events(spark, sf_dir))
    days = made.summary(spark).select("segment", "segment_from", "segment_to").distinct().collect()  # one row a folder
    load = stored_segments(f"{made.path}/rows", made.columns)
    return read_segments(spark, [Segment(*d) for d in sorted(days)], load, made.schema, "ts").where(F.col("ts").between(F.lit(LOW).cast("timestamp_ntz"), F.lit(HIGH).cast("timestamp_ntz")))


ROLLED = LIVE.replace("select c.key, c.seq, c.ts as end_ts", "select c.key, c.seq, c.ts as end_ts, date_trunc('day', c.ts) as day", 1)


def _rolled(spark, sf_dir) -> Rollover:
    """The live ingest's rows, two micro-batches, into history, status and live tables."""
    sink = Rollover(scratch(spark, "rollover"))
    _ingest(spark, sf_dir, sink.persist)
    return sink


@query("live_rollover_history", f"with r as ({ROLLED}), n as (select key, max(day) as newest from r where status = 'accepted' group by key) select r.key, r.seq, r.end_ts, r.value, case when day < newest then 'history' else 'live' end as place from r join n on n.key = r.key where status = 'accepted'")
def live_rollover_history(spark, sf_dir):
    sink = _rolled(spark, sf_dir)
    cols = ["key", "seq", "end_ts", "value"]
    return sink.history(spark).select(*cols, F.lit("history").alias("place")).unionByName(sink.live(spark).select(*cols, F.lit("live").alias("place")))


@query("live_rollover_status", f"with r as ({ROLLED}) select key, cast(day as timestamp) as segment_from, count(*) as n, min(end_ts) as first_ts, max(end_ts) as last_ts, 'COMPLETE' as status from r where status = 'accepted' group by key, day")
def live_rollover_status(spark, sf_dir):
    """After the stream's end, with the last open segments closed, too."""
    sink = _rolled(spark, sf_dir)
    sink.finish(spark)
    return sink.status(spark).drop("batch", "segment")


# ---------------------------------------------------------------- ordered tables and maps

LINES = rt.Table("l_orderkey", "l_linenumber")
PRICE = "select l_orderkey, l_linenumber, l_extendedprice from lineitem"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("rt_apply_changes", "select user_id, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def rt_apply_changes(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))
    return rt.apply_changes(changes, rt.Table("user_id"), "event_id")


@query("rt_put", "select o_custkey, o_orderkey, case when o_orderstatus = 'F' then 0.0 else o_totalprice end as o_totalprice from orders")
def rt_put(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    keyed = rows.select("o_custkey", "o_orderkey", "o_totalprice")
    filled = rows.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.lit(0.0).alias("o_totalprice"))
    return rt.put(keyed, filled, rt.Table("o_custkey", "o_orderkey"))


@query("rt_get", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, 1 from orders)")
def rt_get(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return rt.get(lines(spark, sf_dir), keys, LINES)


@query("rt_get_bucketed", SQL["rt_get"])
def rt_get_bucketed(spark, sf_dir):
    """Lines stored in 16 buckets by order: the orders asked for are dealt to them."""
    name = f"lines_{uuid.uuid4().hex}"
    bucketed.save(lines(spark, sf_dir), name, ["l_orderkey"], 16, ["l_orderkey", "l_linenumber"], scratch(spark, "lines"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return bucketed.get(spark, name, asked, LINES.keys)


@query("rt_join_bucketed", "select o_orderkey, count(l_linenumber) as n, max(l_extendedprice) as most from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def rt_join_bucketed(spark, sf_dir):
    """Neither table is shuffled, for the join or for the groups."""
    made = [f"{t}_{uuid.uuid4().hex}" for t in ("orders", "lines")]
    bucketed.save(table(spark, sf_dir, "orders").select("o_orderkey"), made[0], ["o_orderkey"], 16, path=scratch(spark, "orders"))
    bucketed.save(lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), made[1], ["o_orderkey"], 16, path=scratch(spark, "lines"))
    met = bucketed.joined(spark, made[1], spark.table(made[0]), ["o_orderkey"], "left")
    return met.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"), F.max("l_extendedprice").alias("most"))


@query("rt_delete", PRICE + " where (l_orderkey, l_linenumber) not in (select o_orderkey, 1 from orders)")
def rt_delete(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return rt.delete(lines(spark, sf_dir), keys, LINES)


#: Orders by customer and order key; probes lie on, between, before and after rows.
KEYED = rt.Table("o_custkey", "o_orderkey", bucket=4096)
BEFORE, AFTER = (f"(select {f}(o_orderkey) from orders r where r.o_custkey = p.cust and r.o_orderkey {o} p.place)" for f, o in (("max", "<="), ("min", ">=")))
ASKED = "with p as (select l_orderkey * 8 + l_linenumber as id, l_suppkey as cust, l_orderkey + l_linenumber - 4 as place from lineitem) "


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("cust"), (F.col("l_orderkey") + F.col("l_linenumber") - 4).alias("place"))


def _order_table(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")


@query("rt_last_rows", "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
def rt_last_rows(spark, sf_dir):
    return rt.last_rows(_order_table(spark, sf_dir), KEYED)


@query("rt_first_rows", "select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
def rt_first_rows(spark, sf_dir):
    return rt.first_rows(_order_table(spark, sf_dir), KEYED)


@query("rt_latest", ASKED + f", q as (select id, cust, place, coalesce({BEFORE}, (select min(o_orderkey) from orders r where r.o_custkey = p.cust)) as k from p) select id, cust, place, o_orderkey, o_totalprice from q left join orders on o_custkey = cust and o_orderkey = k")
def rt_latest(spark, sf_dir):
    return rt.latest(_order_table(spark, sf_dir), KEYED, _asked(spark, sf_dir), "cust", "place")


@query("rt_prev", ASKED + f", q as (select id, cust, place, {BEFORE} as k from p) select id, cust, place, o_orderkey, o_totalprice from q left join orders on o_custkey = cust and o_orderkey = k")
def rt_prev(spark, sf_dir):
    return rt.previous(_order_table(spark, sf_dir), KEYED, _asked(spark, sf_dir), "cust", "place")


@query("rt_next", ASKED + f", q as (select id, cust, place, {AFTER} as k from p) select id, cust, place, o_orderkey, o_totalprice from q left join orders on o_custkey = cust and o_orderkey = k")
def rt_next(spark, sf_dir):
    return rt.following(_order_table(spark, sf_dir), KEYED, _asked(spark, sf_dir), "cust", "place")


@query("rt_contains", "select o_custkey + 100 as c_custkey, o_custkey + 100 in (select c_custkey from customer) as there from orders group by all")
def rt_contains(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"))
    return rt.contains_keys(table(spark, sf_dir, "customer"), keys, rt.Table("c_custkey"))


@query("rt_put_if_absent", "select c_custkey, c_acctbal from customer union all select distinct o_custkey + 100, 0.0 from orders where o_custkey + 100 not in (select c_custkey from customer)")
def rt_put_if_absent(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")).distinct()
    return rt.put_if_absent(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), new, rt.Table("c_custkey"))


@query("rt_replace_if", "select c_custkey, case when c_nationkey % 2 = 0 then 1.0 else c_acctbal end as c_acctbal from customer")
def rt_replace_if(spark, sf_dir):
    """Every customer gets a change, made from the right value if the nation's number is even."""
    rows = table(spark, sf_dir, "customer")
    new = rows.select("c_custkey", F.lit(1.0).alias("c_acctbal"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal")).otherwise(F.lit(1e9)).alias("seen"))
    return rt.replace_if(rows.select("c_custkey", "c_acctbal"), new, rt.Table("c_custkey"), "c_acctbal", "seen")


@query("rt_contains_values", "select o_orderpriority || case when o_orderkey % 2 = 0 then '' else '?' end as o_orderpriority, o_orderkey % 2 = 0 as there from orders group by all")
def rt_contains_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    asked = rows.select(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("?")).alias("o_orderpriority"))
    return rt.contains_values(rows, asked, "o_orderpriority")


@query("rt_remove_if", "select c_custkey, c_acctbal from customer where not (c_nationkey % 2 = 0 and c_custkey % 3 = 0)")
def rt_remove_if(spark, sf_dir):
    """Every third customer is to go, if the balance is the one named: that of even nations is, others' is a wrong one."""
    rows = table(spark, sf_dir, "customer")
    expected = rows.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal")).otherwise(F.lit(1e9)).alias("c_acctbal"))
    return rt.remove_if(rows.select("c_custkey", "c_acctbal"), expected, rt.Table("c_custkey"), "c_acctbal")


@query(
    "rt_compute",
    "select c_custkey, case when c_custkey in (select o_custkey + 50 from orders) then c_acctbal * 2 else c_acctbal end as c_acctbal from customer where not (c_custkey in (select o_custkey + 50 from orders) and c_acctbal < 0) "
    "union all select distinct o_custkey + 50, 1.0 from orders where o_custkey + 50 not in (select c_custkey from customer)",
)
def rt_compute(spark, sf_dir):
    """Asked customers' balances are doubled, negative ones removed, and unknown customers get one."""
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 50).alias("c_custkey"))
    new = lambda old, stored: F.when(~stored, F.lit(1.0)).when(old >= 0, old * 2)
    return rt.compute(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), keys, rt.Table("c_custkey"), "c_acctbal", new)


@query("rt_append_only", "select c_custkey, c_acctbal from customer union all select c_custkey + 1000000, c_acctbal from customer")
def rt_append_only(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rt.append_only(rows, rows.withColumn("c_custkey", F.col("c_custkey") + 1_000_000), rt.Table("c_custkey"))


@query("rt_append_refused", "select c_custkey, c_acctbal, exists (select 1 from customer where c_custkey = 7) as refused from customer")
def rt_append_refused(spark, sf_dir):
    """A batch of new keys but for one that is there already."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = rows.withColumn("c_custkey", F.when(F.col("c_custkey") == 7, 7).otherwise(-F.col("c_custkey") - 1))
    try:
        held, refused = rt.append_only(rows, new, rt.Table("c_custkey")), False
    except ValueError:
        held, refused = rows, True
    return held.withColumn("refused", F.lit(refused))


@query("rt_remove_all", PRICE + " where not (l_linenumber > 3 or l_orderkey % 5 = 0)")
def rt_remove_all(spark, sf_dir):
    return rt.remove_all(lines(spark, sf_dir), F.expr("l_linenumber > 3 or l_orderkey % 5 = 0"))


@query("rt_range_values", "select l_extendedprice from lineitem where l_linenumber between 2 and 4")
def rt_range_values(spark, sf_dir):
    return rt.range_of(lines(spark, sf_dir), LINES, low=2, high=4).select("l_extendedprice")


@query("rt_younger", "select event_id, ts from events where ts >= timestamp '2024-01-20' - interval 5 day")
def rt_younger(spark, sf_dir):
    return rt.younger_than(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(datetime(2024, 1, 20)), 5 * 86_400)


@query("rt_purge", "select event_id, ts from events where (select min(ts) from events) >= timestamp '2024-01-20' - interval 25 day")
def rt_purge(spark, sf_dir):
    return rt.purge(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(datetime(2024, 1, 20)), 25 * 86_400)


@query("rt_purge_ages", "select d.days, event_id from events, (values (5), (19), (20), (40)) as d(days) where (select min(ts) from events) >= timestamp '2024-01-20' - to_days(d.days)")
def rt_purge_ages(spark, sf_dir):
    """A table that expires as a whole after 5, 19, 20 and 40 days; its first row is 18 to 19 days old."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    kept = [rt.purge(rows, "ts", F.lit(datetime(2024, 1, 20)), days * 86_400).select(F.lit(days).alias("days"), "event_id") for days in (5, 19, 20, 40)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])


@query("rt_range", PRICE + " where l_orderkey = 7 and l_linenumber between 1 and 3")
def rt_range(spark, sf_dir):
    return rt.range_of(lines(spark, sf_dir), LINES, 7, 1, 3)


@query("rt_range_reverse", "select l_orderkey, l_linenumber, l_extendedprice, rank() over (order by l_orderkey, l_linenumber desc) - 1 as nth from lineitem where l_linenumber >= 2")
def rt_range_reverse(spark, sf_dir):
    """Of equal keys, the place of the first."""
    placed = store.with_places(rt.range_of(lines(spark, sf_dir), LINES, low=2, reverse=True), "nth")
    return placed.withColumn("nth", F.min("nth").over(Window.partitionBy("l_orderkey", "l_linenumber")))


@query("rt_delete_range", PRICE + " where not (l_orderkey = 7 and l_linenumber >= 2)")
def rt_delete_range(spark, sf_dir):
    return rt.delete_range(lines(spark, sf_dir), LINES, 7, 2)


@query("rt_get_or_load", "select c_custkey as key, c_acctbal as value from customer where c_acctbal > 0 union all select c_custkey, 0.0 from customer where not c_acctbal > 0")
def rt_get_or_load(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return rt.get_or_load(rows.where("value > 0"), rows.select("key"), rt.Table("key"), lambda absent: absent.withColumn("value", F.lit(0.0)))


@query("rt_unexpired", "select event_id, ts from events where date_trunc('month', ts) = timestamp '2024-01-01'")
def rt_unexpired(spark, sf_dir):
    return rt.unexpired(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(datetime(2024, 1, 20)), "month")


# ---------------------------------------------------------------- entities


@query("rel_by_example_and", "select * from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def rel_by_example_and(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(rel.by_example({"c_mktsegment": "BUILDING", "c_nationkey": 3, "c_name": None}))


@query("rel_by_example_or", "select * from customer where c_mktsegment = 'BUILDING' or c_nationkey = 3")
def rel_by_example_or(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(rel.by_example({"c_mktsegment": "BUILDING", "c_nationkey": 3}, any_of=True))


@query("rel_page", "select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as row_number, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def rel_page(spark, sf_dir):
    return rel.with_total(rel.page(table(spark, sf_dir, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 50), table(spark, sf_dir, "orders"))


@query("rel_page_after", "with t as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders) select o_orderkey, o_totalprice from t where n between 41 and 80")
def rel_page_after(spark, sf_dir):
    """The second page of 40, from the last row of the first one on."""
    rows, order = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)]
    first = rel.page_after(rows, order, None, 40).orderBy(F.asc("o_totalprice"), F.desc("o_orderkey")).first()
    return rel.page_after(rows, order, first.asDict() if first else None, 40)


@query("rel_find_all", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 20 offset 5")
def rel_find_all(spark, sf_dir):
    return rel.find_all(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"}, [F.col("c_custkey")], 5, 20).select("c_custkey", "c_name")


@query("rel_find_by_id", "select * from customer where c_custkey = 11")
def rel_find_by_id(spark, sf_dir):
    return rel.find_by_id(table(spark, sf_dir, "customer"), 11, "c_custkey")


@query("rel_find_one", "select * from customer where c_custkey = 12")
def rel_find_one(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    found = rel.find_one(rows, {"c_custkey": 12}, "c_custkey")
    return spark.createDataFrame([found] if found else [], rows.schema)


@query("rel_exists", "select exists (select 1 from customer where c_nationkey = 3) as has_three, exists (select 1 from customer where c_nationkey = 99) as has_ninety_nine")
def rel_exists(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return spark.createDataFrame([(rel.exists(rows, {"c_nationkey": 3}), rel.exists(rows, {"c_nationkey": 99}))], "has_three boolean, has_ninety_nine boolean")


@query("rel_compare", "select c_custkey from customer where c_acctbal <= 5000 and c_nationkey >= 10")
def rel_compare(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(rel.at_most("c_acctbal", 5000) & rel.at_least("c_nationkey", 10)).select("c_custkey")


@query("rel_delete_by_ids", "select * from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 40 = 0)")
def rel_delete_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return rel.delete_by_ids(table(spark, sf_dir, "customer"), ids, "c_custkey")


@query("rel_audited", f"select c_custkey, case when c_custkey < 1000000 then timestamp '{LOW}' else timestamp '{HIGH}' end as created, timestamp '{HIGH}' as updated from (select c_custkey from customer union all select c_custkey + 1000000 from customer)")
def rel_audited(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(LOW).cast("timestamp_ntz").alias("created"), F.lit(LOW).cast("timestamp_ntz").alias("updated"))
    changed = rows.select("c_custkey").unionByName(rows.select((F.col("c_custkey") + 1_000_000).alias("c_custkey")))
    return rel.audited(rows, changed, "c_custkey", F.lit(HIGH).cast("timestamp_ntz"))


@query("rel_bulk_insert", "select c_custkey, c_name, (select count(*) from customer) as inserted from customer")
def rel_bulk_insert(spark, sf_dir):
    path = scratch(spark, "bulk")
    n = rel.bulk_insert(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return spark.read.parquet(path).withColumn("inserted", F.lit(n).cast("long"))


@query("rel_stage_csv", "select count(*) filter (c_custkey % 10 not in (3, 7, 9)) as staged, count(*) filter (c_custkey % 10 in (3, 7)) as malformed, count(*) filter (c_custkey % 10 = 9) as missing, count(*) filter (c_custkey % 10 not in (3, 7, 9)) as inserted, coalesce(sum(c_custkey) filter (c_custkey % 10 not in (3, 7, 9)), 0) as keys from customer")
def rel_stage_csv(spark, sf_dir):
    """Customers as lines of text; some have no number for a balance, some end too early, and some have no name."""
    rows = table(spark, sf_dir, "customer")
    last = F.col("c_custkey") % 10
    balance = F.when(last == 3, "none").otherwise(F.col("c_acctbal").cast("string"))
    name = F.when(last == 9, "").otherwise(F.col("c_name"))
    line = F.when(last == 7, F.col("c_custkey").cast("string")).otherwise(F.concat_ws(",", "c_custkey", name, balance))
    csv, path = scratch(spark, "csv"), scratch(spark, "loaded")
    rows.select(line.alias("value")).write.text(csv)
    staged, rejected = staging.stage_csv(spark, csv, "c_custkey long, c_name string, c_acctbal double", ["c_custkey", "c_name"])
    staging.insert_unique(staged, path, ["c_custkey"])
    kept = spark.read.parquet(path).agg(F.count("*").alias("inserted"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("keys"))
    seen = rejected.agg(F.count_if(F.col("reason") == "malformed").alias("malformed"), F.count_if(F.col("reason") == "missing").alias("missing"))
    return staged.agg(F.count("*").alias("staged")).join(seen).join(kept)  # one row each


@query("rel_insert_unique", "select c_custkey, c_name, (select count(*) from customer) as inserted, true as refused from customer")
def rel_insert_unique(spark, sf_dir):
    """Customers in two batches; a third one, with a key that is stored, is refused and leaves the table alone."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch(spark, "unique")
    n = sum(staging.insert_unique(rows.where(F.col("c_custkey") % 2 == i), path, ["c_custkey"]) for i in range(2))
    try:
        staging.insert_unique(rows.withColumn("c_custkey", F.when(F.col("c_custkey") == 1, 1).otherwise(-F.col("c_custkey"))), path, ["c_custkey"])
        refused = False
    except staging.NotUnique:
        refused = True
    return spark.read.parquet(path).withColumns({"inserted": F.lit(n).cast("long"), "refused": F.lit(refused)})


@query("rel_find_by_ids", "select * from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def rel_find_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.find_by_ids(table(spark, sf_dir, "customer"), ids, "c_custkey").select(*table(spark, sf_dir, "customer").columns)


@query("rel_save_all", "select c_custkey, c_name, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal, case when c_acctbal < 0 then 2 else 1 end as version from customer")
def rel_save_all(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("version"))
    return rel.save_all(rows, rows.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey", "version")


@query("rel_delete_by_example", "select * from customer where not (c_mktsegment = 'BUILDING' and c_nationkey = 3)")
def rel_delete_by_example(spark, sf_dir):
    return rel.delete_by_example(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3})


@query("rel_cascade", "select o_orderkey, o_custkey from orders where o_custkey is null or o_custkey in (select c_custkey from customer where c_acctbal >= 0)")
def rel_cascade(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return rel.cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")


@query("rel_duplicates", "select o_custkey, o_orderstatus, count(*) as n from orders group by all having count(*) > 1")
def rel_duplicates(spark, sf_dir):
    return rel.duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("rel_merge_from", "select s_suppkey, s_name, coalesce(c_acctbal, s_acctbal) as s_acctbal from supplier left join customer on c_custkey = s_suppkey")
def rel_merge_from(spark, sf_dir):
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return rel.merge_from(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), other, "s_suppkey", ["s_acctbal"])


@query("rel_with_ids", "select c_custkey, 999 + row_number() over (order by c_mktsegment, c_custkey) as id from customer")
def rel_with_ids(spark, sf_dir):
    return rel.with_ids(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"], "id", 1000).select("c_custkey", "id")


@query("rel_count", "select i as example, count(*) filter (c_nationkey = i + 3 and (i = 0 or c_mktsegment = 'BUILDING')) as n from customer, (values (0), (1)) as v(i) group by i")
def rel_count(spark, sf_dir):
    return rel.count_like(table(spark, sf_dir, "customer"), [{"c_nationkey": 3}, {"c_nationkey": 4, "c_mktsegment": "BUILDING"}])


# ---------------------------------------------------------------- the benchmarks' query shapes


@query("bench_ordered_scan", "select ts, value from events order by ts, event_id")
def bench_ordered_scan(spark, sf_dir):
    return events(spark, sf_dir).orderBy("ts", "event_id").select("ts", "value")


@query("bench_point_lookups", "select o_orderkey, l_linenumber, l_extendedprice from orders join lineitem on l_orderkey = o_orderkey")
def bench_point_lookups(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey")
    return asked.join(lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("bench_latest_as_of", f"select user_id, max(ts) as ts from events where ts <= timestamp '{HIGH}' group by user_id")
def bench_latest_as_of(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("ts") <= HIGH).groupBy("user_id").agg(F.max("ts").alias("ts"))


@query("bench_latest_ordered", f"select ts, value from events where ts <= timestamp '{HIGH}' order by ts desc, event_id desc limit 1")
def bench_latest_ordered(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("ts") <= HIGH).orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("ts", "value")


@query("bench_millis", "select event_id, epoch_us(ts) // 1000 as millis, make_timestamp(epoch_us(ts) // 1000 * 1000) as back from events")
def bench_millis(spark, sf_dir):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select("event_id", millis.alias("millis"), F.timestamp_millis(millis).cast("timestamp_ntz").alias("back"))
