"""Quality by importance resampling: generative models of target and raw text over hashed n-grams, Gumbel top-k.

Words and runs of signs, and pairs of neighbours, are hashed to 2**BITS slots. Two unigram-over-slots models are
counted: the raw one over all texts, the target one over all labelled good texts. A text's log importance weight is the sum of log(target / raw) over its n-grams. Documents are
resampled without replacement by Gumbel top-k: key = mean weight / temperature + Gumbel noise drawn from the hash of
doc_id and text, and the k largest keys are taken. Weights are means per n-gram, so that length doesn't decide. k defaults to the
number of documents that weigh at least as much as all but SPARED of the target texts: as many as look like the target.
Which ones they are, the keys decide; the temperature tells how far below that weight a document may still be drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from chronolith.llm.common import (
    COUNTS,
    bounded_share,
    chunks_of,
    columns_guarded,
    counts_batch,
    counts_summed,
    mapped,
    mix,
    small_enough,
    text_buffers,
    words_of,
    written,
)

BITS, TEMPERATURE, SPARED = 18, 0.02, 0.002
CHUNK = 1 << 20
U64 = np.uint64


def _slots(data, offsets):
    """(slot, row) of every word, run of signs and pair of neighbours."""
    words, rows = words_of(data, offsets, signs_apart=True)
    slots = mix(words) >> U64(64 - BITS)
    if len(words) > 1:
        same = rows[1:] == rows[:-1]
        pairs = mix(words[:-1] * U64(0x9FB21C651E98DF25) + mix(words[1:]))[same] >> U64(64 - BITS)
        slots, rows = np.concatenate([slots, pairs]), np.concatenate([rows, rows[1:][same]])
    return slots.astype(np.int64), rows


def _count_pass(name):
    def run(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in chunks_of(offsets, CHUNK):
                counts += np.bincount(_slots(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0], minlength=1 << BITS)
        yield counts_batch(counts, name)

    return run


def _weigh_pass(shared):
    def run(batches):
        table = np.frombuffer(shared.value, np.float64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi in chunks_of(offsets, CHUNK):
                slots, rows = _slots(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total[lo:hi] = np.bincount(rows, table[slots], hi - lo)
                n[lo:hi] = np.bincount(rows, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(total, pa.float64())], [*batch.schema.names, "n_grams", "log_weight"])

    return run


def log_ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log(target / raw) for each slot, with one count added everywhere; zero where neither model has seen a text."""
    kind = "name string, " + COUNTS
    rows = docs.select("text").mapInArrow(mapped(_count_pass("raw")), kind).unionByName(target.select("text").mapInArrow(mapped(_count_pass("target")), kind))
    counts = counts_summed(rows, 1 << BITS)
    raw, good = (counts.get(k, np.zeros(1 << BITS, np.int64)) for k in ("raw", "target"))
    if not good.sum():
        return np.zeros(1 << BITS)
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_grams and log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.tobytes())
    return docs.mapInArrow(mapped(_weigh_pass(shared)), StructType([*docs.schema.fields, StructField("n_grams", LongType()), StructField("log_weight", DoubleType())]))


def gumbel(seed: int):
    """Gumbel noise of a row (doc_id, text), drawn from their hash; rows without a doc_id have their own each."""
    copy = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed), "text", copy), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _around(rows: DataFrame, key: str, k: int, n: int):
    """(lo, hi, above): the k-th largest ``key`` of ``n`` rows (a written table) lies from lo to hi, and ``above`` rows beyond hi.

    Found by counting, so no task sorts more than the rows between two close values.
    """
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    above, inside = 0, n  # rows over hi, rows from lo to hi
    while inside > 10_000 and hi > lo:
        at = F.least(F.lit(31), F.floor((F.col(key) - lo) / (hi - lo) * 32)).cast("int")
        parts = dict(rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("at")).agg(F.struct(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))).collect())
        for i in sorted(parts, reverse=True):
            if above + parts[i].n >= k:
                break
            above += parts[i].n
        if (parts[i].lo, parts[i].hi, parts[i].n) == (lo, hi, inside):
            break
        lo, hi, inside = parts[i].lo, parts[i].hi, parts[i].n
    return lo, hi, above


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``rows`` (a written table) with ``selected``: whether ``key`` is among the k largest; of equal keys smaller doc_ids."""
    n = rows.count()
    if k >= n or k <= 0:
        return rows.withColumn("selected", F.lit(k >= n and n > 0))
    lo, hi, above = _around(rows, key, k, n)
    edge = rows.where(F.col(key).between(lo, hi)).select(key, "doc_id").orderBy(F.desc(key), F.asc_nulls_first("doc_id")).limit(k - above)
    last = edge.orderBy(F.asc(key), F.desc_nulls_last("doc_id")).first()
    here = (F.col(key) > last[0]) | ((F.col(key) == last[0]) & (F.coalesce(F.col("doc_id") <= F.lit(last[1]), F.lit(True)) if last[1] is not None else F.col("doc_id").isNull()))
    return rows.withColumn("selected", here)


def quantile(rows: DataFrame, key: str, share: float) -> float | None:
    """The exact quantile of all ``rows`` (a written table), between two values in proportion, as ``percentile`` gives it."""
    n = rows.count()
    if not n:
        return None
    at = share * (n - 1)

    def nth(i: int) -> float:
        """The i-th smallest, from 0."""
        lo, hi, above = _around(rows, key, n - i, n)
        if lo == hi:
            return lo
        return rows.where(F.col(key).between(lo, hi)).select(key).orderBy(F.desc(key)).limit(n - i - above).agg(F.min(key)).first()[0]

    low = int(at)
    return nth(low) if at == low else (low + 1 - at) * nth(low) + (at - low) * nth(low + 1)


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = 1, target_rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_grams, log_weight, mean_weight, key, selected.

    ``labels`` (doc_id, quality 0/1): quality 1 is the target (of several labels of a document the smallest counts). A
    null or empty text has no n-grams and weight 0. Of equal keys smaller doc_ids come first. Without target texts all
    weights are 0 and everything is selected. All target texts count, for the model and for k; ``target_rows`` bounds them. Only rows equal in doc_id and text share their noise. An empty table gives an empty
    one; columns named in ``carry`` go along as carried_<name>, others are ignored.
    """
    carried = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"})
    known = columns_guarded(labels, {"doc_id": "long", "quality": "int"}).where("doc_id is not null and quality is not null")
    known = written(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality-labels")
    good = written(known.where("quality = 1").select("doc_id"), "quality-target")
    few = good if target_rows is None else bounded_share(good, target_rows)
    target = docs.join(small_enough(few), "doc_id", "left_semi")
    if target_rows is not None:  # many rows may share an id
        target = bounded_share(target, target_rows, ("doc_id", "text"))
    weighed = weigh(whole, log_ratios(docs, target)).withColumn("mean_weight", F.col("log_weight") / F.greatest("n_grams", F.lit(1)))
    rows = written(weighed.withColumn("key", F.col("mean_weight") / temperature + gumbel(seed)).drop("text"), "quality-weights")
    if k is None:
        own = written(rows.join(small_enough(few), "doc_id", "left_semi").select("doc_id", "log_weight", "n_grams", "mean_weight"), "quality-own")
        if target_rows is not None:
            own = bounded_share(own, target_rows, ("doc_id", "log_weight", "n_grams"))
        least = quantile(own, "mean_weight", SPARED)
        k = rows.count() if least is None else rows.where(F.col("mean_weight") >= least).count()
    return top_k(rows, "key", k)


def op5_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
