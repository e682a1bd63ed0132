"""Entity tables: query by example, paging, merging, deletion, ids and uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_example(example: dict, any_of: bool = False, id_column: str = "id") -> Column:
    """Equality on every set (not None) field, joined by AND or OR; an empty example holds for all rows."""
    if example.get(id_column) is not None:
        raise ValueError("an example must not carry an id")
    tests = [F.col(c) == F.lit(v) for c, v in example.items() if v is not None]
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), tests) if tests else F.lit(True)


def find_one(df: DataFrame, example: dict, id_column: str = "id"):
    """The row with the example's id, else the one row like it, else None; more than one is an error."""
    if example.get(id_column) is not None:
        found = df.where(F.col(id_column) == F.lit(example[id_column])).take(2)
    else:
        found = df.where(by_example(example, id_column=id_column)).take(2)
    if len(found) > 1:
        raise ValueError("more than one row matches the example")
    return found[0] if found else None


def find_all(df: DataFrame, example: dict, order: list[Column] | None = None, offset: int = 0, limit: int | None = None, any_of: bool = False, id_column: str = "id") -> DataFrame:
    """Rows like the example, ordered, from ``offset`` on and at most ``limit``."""
    found = df.where(by_example(example, any_of, id_column))
    found = found.orderBy(*order) if order else found
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def find_by_id(df: DataFrame, id_value, id_column: str) -> DataFrame:
    return df.where(F.col(id_column) == F.lit(id_value))


def exists(df: DataFrame, example: dict, any_of: bool = False, id_column: str = "id") -> bool:
    return not df.where(by_example(example, any_of, id_column)).isEmpty()


def count_like(df: DataFrame, examples: list[dict], id_column: str = "id") -> DataFrame:
    """(example, n): how many rows are like each of some examples (by its place in the list), in one pass."""
    counted = df.agg(*[F.count_if(by_example(e, id_column=id_column)).alias(str(i)) for i, e in enumerate(examples)])
    pairs = F.array(*[F.struct(F.lit(i).alias("example"), F.col(str(i)).alias("n")) for i in range(len(examples))])
    return counted.select(F.inline(pairs))


def at_most(column: str, value) -> Column:
    return F.col(column) <= F.lit(value)


def at_least(column: str, value) -> Column:
    return F.col(column) >= F.lit(value)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows, with ``row_number`` (from 0, in all rows)."""
    rows = df.orderBy(*order).offset(number * size).limit(size)
    return rows.withColumn("row_number", F.row_number().over(W.orderBy(*order)) - 1 + number * size)  # ``size`` rows


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: dict | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row ``after`` (its order columns; None: from the start), in order.

    ``order`` names columns that tell rows apart and aren't null, each with whether it descends. Nothing before the page is
    sorted or counted: the bound of the first column reaches the scan, and each task keeps ``size`` rows.
    """
    rows = df
    if after is not None:
        beyond = lambda c, falls: F.col(c) < F.lit(after[c]) if falls else F.col(c) > F.lit(after[c])
        follows = F.lit(False)
        for c, falls in reversed(order):
            follows = beyond(c, falls) | ((F.col(c) == F.lit(after[c])) & follows)
        first, falls = order[0]
        bound = F.col(first) <= F.lit(after[first]) if falls else F.col(first) >= F.lit(after[first])
        rows = rows.where(bound & follows)
    return rows.orderBy(*[F.desc(c) if falls else F.asc(c) for c, falls in order]).limit(size)


def with_total(paged: DataFrame, df: DataFrame) -> DataFrame:
    """A page with ``total``, the number of all rows."""
    return paged.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def find_by_ids(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids.select(id_column), id_column, "left_semi")


def save_all(df: DataFrame, changed: DataFrame, id_column: str, version: str | None = None) -> DataFrame:
    """Upsert by id. With ``version``, a change is taken only if it was made from the stored version, which then grows by one."""
    if version is None:
        return df.join(changed, id_column, "left_anti").unionByName(changed)
    held = df.select(F.col(id_column), F.col(version).alias("_held"))
    current = changed.join(held, id_column, "left").where(F.col("_held").isNull() | (F.col("_held") == F.col(version)))
    current = current.withColumn(version, F.coalesce(F.col("_held") + 1, F.lit(0))).drop("_held")
    return df.join(current, id_column, "left_anti").unionByName(current.select(*df.columns))


def audited(df: DataFrame, changed: DataFrame, id_column: str, at: Column, created: str = "created", updated: str = "updated") -> DataFrame:
    """``changed`` with its audit times: ``created`` as stored, or ``at`` for new rows, and ``updated`` set to ``at``."""
    held = df.select(F.col(id_column), F.col(created).alias("_created"))
    return changed.join(held, id_column, "left").withColumns({created: F.coalesce("_created", at), updated: at}).drop("_created")


def bulk_insert(staged: DataFrame, path: str) -> int:
    """Appends the staged rows to the table at ``path`` in one write; how many there were."""
    seen = Observation()
    staged.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def stale_changes(df: DataFrame, changed: DataFrame, id_column: str, version: str) -> DataFrame:
    """Changes made from another version than the stored one."""
    held = df.select(F.col(id_column), F.col(version).alias("_held"))
    return changed.join(held, id_column).where(F.col("_held") != F.col(version)).drop("_held")


def delete_by_ids(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids, id_column, "left_anti")


def delete_by_example(df: DataFrame, example: dict, any_of: bool = False, id_column: str = "id") -> DataFrame:
    return df.where(~F.coalesce(by_example(example, any_of, id_column), F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, foreign_key: str, id_column: str) -> DataFrame:
    """Children whose parent is still there, or that have none."""
    held = parents.select(F.col(id_column).alias("_id")).distinct()
    return children.join(held, children[foreign_key] == F.col("_id"), "left_semi").unionByName(children.where(F.col(foreign_key).isNull()))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of a unique index that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def merge_from(df: DataFrame, other: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``columns`` taken from ``other`` where set there; ids and all else stay."""
    theirs = other.select(id_column, *[F.col(c).alias(f"_{c}") for c in columns])
    merged = df.join(theirs, id_column, "left")
    return merged.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


#: Values of the first order column that the driver sees to cut it into ranges.
SAMPLED = 10_000


def with_ids(new: DataFrame, order: list[str], id_column: str, first: int, groups: int | None = None) -> DataFrame:
    """New rows with consecutive ids from ``first`` in the order of ``order``, whose columns must tell rows apart.

    The first column is cut into ``groups`` ranges (by default as many as there are shuffle partitions) at quantiles of a
    sample; ranges are counted, and rows numbered within. Where the cuts lie doesn't matter to the ids.
    """
    groups = groups or int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = order[0]
    total = max(1, new.count())
    some = sorted(r[0] for r in new.where(F.col(key).isNotNull()).select(key).sample(min(1.0, SAMPLED / 2 / total), 1).limit(SAMPLED).collect())
    cuts = sorted({some[i * len(some) // groups] for i in range(1, groups)}) if some else []
    kind = new.schema[key].dataType
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(key))), F.lit(0)) if cuts else F.lit(0)
    parts = new.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(part))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    base = sizes.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(F.broadcast(base), "_part").withColumn(id_column, F.lit(first) + F.col("_base") + F.col("_local") - 1).drop("_part", "_base", "_local")
