"""What each filter removes, in every order of the filters.

Documents that fail the same filters count alike, so they are first counted by part and failure flags. One CUBE over the
flags and the part then holds, for each subset of the filters, a row whose flags are all false: those documents survive
the subset. A step of an order is a pair of subsets, before and after its filter, and everything else follows from the
steps: the first step of an order shows all that fail its filter, the last one those that fail no other.

Only DataFrame functions are used. Texts never leave the scan: a row is a doc_id, a digest, a part and flags from there on,
copies are combined before each shuffle, and no join meets a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import written

WORD = r"([^\x20\x09-\x0D]+)"
#: All orders of the filters are listed, so there can't be many.
MOST_FILTERS = 6
#: Rows without a doc_id are spread over so many join keys.
SPREAD = 1024


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD))) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer distinct words than a share of all."""
    words = F.regexp_extract_all(text, F.lit(WORD))
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * percent


def shouting(text: Column, percent: int = 2) -> Column:
    """More characters A-Z than a share of the code points."""
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * percent


def with_signs(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


TESTS: dict[str, Callable[[Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": with_signs}
COUNTS = ("n", "good", "toxic")


def _judged(docs: DataFrame, labels: DataFrame, tests: dict[str, Callable[[Column], Column]], part: str) -> DataFrame:
    """(doc_id, digest, part, flags, is_good, is_toxic) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *[test(text).alias(letter) for letter, test in tests.items()],
    )
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SPREAD))).otherwise(0)
    judged = judged.withColumn("spread", spread)
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    known = said.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    known = written(known, "labels").withColumn("spread", F.lit(0))  # written, so that a hot doc_id's side of the join can be split
    yes = lambda c: F.coalesce(c, F.lit(0)) == 1
    return judged.join(known, ["doc_id", "spread"], "left").withColumns({"is_good": yes(F.col("is_good")), "is_toxic": yes(F.col("is_toxic"))}).drop("spread")


def _counted(judged: DataFrame, letters: list[str], repeat: str) -> DataFrame:
    """(part, flags, ``repeat``, n, good, toxic): documents by part and by the filters they fail.

    Of equal texts, the rows with the smallest doc_id pass ``repeat`` and the others fail it. So rows are counted by
    doc_id and text, then by text, part and labels with the smallest doc_id's rows beside them; the latter are a few rows a
    part for each text, however many copies there are.
    """
    alike = ["digest", "part", *letters, "is_good", "is_toxic"]
    rows = judged.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    texts = rows.groupBy(*alike).agg(
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("low"),
    )
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    ahead = F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("ahead", ahead).withColumn("_", F.explode(F.array(F.struct(F.lit(False).alias("fails"), (F.col("nameless") + F.col("ahead")).alias("n")), F.struct(F.lit(True).alias("fails"), (F.col("named") - F.col("ahead")).alias("n")))))
    n = F.col("_.n")
    only = lambda flag: F.sum(F.when(F.col(flag), n).otherwise(0))
    return split.where(n > 0).groupBy("part", *letters, F.col("_.fails").alias(repeat)).agg(F.sum(n).alias("n"), only("is_good").alias("good"), only("is_toxic").alias("toxic"))


def subset_survivors(counted: DataFrame, letters: list[str]) -> DataFrame:
    """(part, whole, subset, n, good, toxic): documents of each part that fail none of a subset of the filters.

    Bit i of ``subset``, from the highest, stands for letter i. ``whole``: all parts together, ``part`` is null. Subsets
    that nothing survives are there, with zeros.
    """
    cubed = counted.cube("part", *letters).agg(F.grouping_id().alias("rolled"), *[F.sum(c).alias(c) for c in COUNTS])
    passed = cubed.where(~F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in letters]))
    every = (1 << len(letters)) - 1
    held = passed.select("part", (F.shiftright("rolled", len(letters)) == 1).alias("whole"), F.bitwise_not("rolled").bitwiseAND(F.lit(every)).cast("int").alias("subset"), *COUNTS)
    parts = counted.select("part", F.lit(False).alias("whole")).distinct().unionByName(counted.limit(1).select(F.lit(None).cast("string").alias("part"), F.lit(True).alias("whole")))
    grid = parts.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(every))))
    other = held.select(F.col("part").alias("p"), F.col("whole").alias("w"), F.col("subset").alias("s"), *COUNTS)
    joined = grid.join(other, F.col("part").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")) & (F.col("subset") == F.col("s")), "left")
    return joined.select("part", "whole", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def steps(spark: SparkSession, letters: list[str]) -> DataFrame:
    """(filter_order, step, filter, before, after) of every order: the subsets applied before and after the step."""
    bit = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << (len(letters) - 1 - i)))])
    orders = spark.range(1).select(F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order"))
    placed = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    until = lambda n: F.aggregate(F.transform(F.split(F.substring("filter_order", F.lit(1), n), ""), lambda c: F.coalesce(F.try_element_at(bit, c), F.lit(0))), F.lit(0), lambda a, b: a + b)
    return placed.select("filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), until(F.col("step") - 1).alias("before"), until(F.col("step")).alias("after"))


def filter_audit(docs: DataFrame, labels: DataFrame, tests: dict[str, Callable[[Column], Column]] = TESTS, repeat: str = "E", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``tests`` makes a failure condition from a text column for each letter; ``repeat`` is the letter of a further filter,
    which fails all rows whose text a smaller doc_id has, too. Parts are the values of a column, and one more with
    ``whole`` true and a null part is all of them together. ``shapley`` is what a filter removes, summed over all orders.

    A null text is empty, a null part the empty string. Rows without a doc_id are no copies and have none; repeated rows
    (equal doc_id and text) count each and aren't copies of one another. A doc_id is good or toxic if any of its labels says
    so, and neither without a label (as rows without a doc_id are). An empty table has no parts, so no rows. Other columns are ignored.
    """
    letters = [*tests, repeat]
    if len(set(letters)) < len(letters) or len(letters) > MOST_FILTERS or any(len(c) != 1 for c in letters):
        raise ValueError(f"filters need different letters, {MOST_FILTERS} at most: {letters}")
    counted = written(_counted(_judged(docs, labels, tests, part), [*tests], repeat), "failures")
    held = subset_survivors(counted, letters)
    before = held.select("part", "whole", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS])
    after = held.select(F.col("part").alias("p"), F.col("whole").alias("w"), F.col("subset").alias("after"), *COUNTS)
    order = F.broadcast(steps(docs.sparkSession, letters))  # n! * n rows: 600 for five filters
    at = before.join(order, "before").join(after.withColumnRenamed("after", "s"), F.col("part").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")) & (F.col("after") == F.col("s")))
    at = at.withColumn("removed", F.col("n_before") - F.col("n"))
    own = Window.partitionBy("part", "whole", "filter")
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(own)
    alone = F.max(F.when(F.col("step") == len(letters), F.col("removed"))).over(own)
    return at.select(
        "part",
        "whole",
        "filter_order",
        "step",
        "filter",
        F.col("n").alias("kept"),
        "removed",
        (fails - F.col("removed")).alias("redundant"),
        alone.alias("unique_fails"),
        (F.col("good_before") - F.col("good")).alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
        F.sum("removed").over(own).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.where("not whole").drop("whole")


_LETTERS = "(values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
  + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > first then 16 else 0 end as m
  from w left join l on l.doc_id = w.doc_id),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.v, b.v, c.v, d.v, e.v] as bits
  from {_LETTERS} as a(c, v), {_LETTERS} as b(c, v), {_LETTERS} as c(c, v), {_LETTERS} as d(c, v), {_LETTERS} as e(c, v) where a.v + b.v + c.v + d.v + e.v = 31
  and a.v <> b.v and a.v <> c.v and a.v <> d.v and a.v <> e.v and b.v <> c.v and b.v <> d.v and b.v <> e.v and c.v <> d.v and c.v <> e.v and d.v <> e.v),
t as (select filter_order, s as step, filter_order[s] as filter, bits[s] as own, cast(coalesce(list_sum(bits[1:s - 1]), 0) as integer) as earlier from o, (select unnest([1, 2, 3, 4, 5]) as s)),
g as (select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, m),
r as (select part, filter_order, step, filter,
  sum(case when m & (earlier | own) = 0 then n else 0 end) as kept,
  sum(case when m & earlier = 0 and m & own > 0 then n else 0 end) as removed,
  sum(case when m & earlier > 0 and m & own > 0 then n else 0 end) as redundant,
  sum(case when m = own then n else 0 end) as unique_fails,
  sum(case when m & earlier = 0 and m & own > 0 then good else 0 end) as good_lost,
  sum(case when m & earlier = 0 and m & own > 0 then toxic else 0 end) as toxic_lost
  from g, t group by part, filter_order, step, filter)
select part, filter_order, cast(step as integer) as step, filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r
"""
