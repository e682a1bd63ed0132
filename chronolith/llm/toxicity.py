"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, pairs of neighbours and pairs with one word between, in 2**BITS slots; each
of a text's n distinct features has the value n ** -0.25, so that long texts dilute a word less than unit vectors would. The optimiser keeps a rate per coordinate, and its L1 term leaves at zero every feature
that few documents speak for, so the weights are a small sparse vector that is broadcast. The optimiser is sequential:
it runs in one task over at most TRAIN_ROWS labelled rows (a documented bound; the share is drawn by hash), small
samples more often than large ones. Features are extracted, and all texts scored, in parallel passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolith.llm.common import bounded_share, chunks_of, columns_guarded, give_back, mapped, mix, text_buffers, words_of, written

BITS, TRAIN_ROWS, UPDATES = 18, 16_384, 100_000
ALPHA, BETA, L1, L2 = 10.0, 1.0, 1.5, 0.1
CHUNK = 1 << 20
U64 = np.uint64


def _features(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every word, pair and skip pair."""
    slots, at = [mix(words) >> U64(64 - BITS)], [rows]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xA0761D6478BD642F)):
        if len(words) > gap:
            same = rows[gap:] == rows[:-gap]
            both = mix(words[:-gap] * U64(salt) + mix(words[gap:]))[same] >> U64(64 - BITS)
            slots.append(both)
            at.append(rows[gap:][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(at)


def _feature_pass(batches):
    """Rows (label, text, nth) as (label, nth, the distinct slots and the intercept's)."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        out = []
        for lo, hi in chunks_of(offsets, CHUNK):
            slots, rows = _features(*words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            pairs = np.unique((rows << BITS) | slots)
            cuts = np.searchsorted(pairs >> BITS, np.arange(hi - lo + 1))
            out += [np.append(pairs[a:b] & ((1 << BITS) - 1), 1 << BITS).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["label", "nth", "slots"])


def value_of(n):
    """The value of each of ``n`` distinct features of a text."""
    return np.maximum(n, 1) ** -0.25


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of the proximal step; the last coordinate, the intercept, has no L1 term."""
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows) -> None:
    """One pass of updates of the state in place; ``rows`` yields (label, slots), the intercept's slot last."""
    for label, slots in rows:
        zs, ns = z[slots], n[slots]
        l1 = np.full(len(slots), L1)
        x = np.full(len(slots), value_of(len(slots) - 1))
        l1[-1], x[-1] = 0, 1
        w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
        g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -30, 30))) - label) * x
        z[slots] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
        n[slots] += g * g


def _train(table: pa.Table) -> pa.Table:
    """Weights from rows (label, nth, slots); the slots stay in Arrow's buffers, so a task holds the sample once."""
    rows = []
    for part in table.column("slots").chunks:
        data, offsets = text_buffers(part)
        rows += np.split(data.view(np.int32), offsets[1:-1] // 4) if len(part) else []
    label, nth = table.column("label").to_numpy(), table.column("nth").to_numpy()
    order = np.lexsort((label, nth))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(max(6, min(16, UPDATES // len(order)))):
        ftrl_pass(z, n, ((label[i], rows[i]) for i in order))
    w = weights_of(z, n)
    at = np.flatnonzero(w)
    del rows
    give_back()
    return pa.table({"slot": pa.array(at, pa.int32()), "weight": pa.array(w[at])})


def fit(labelled: DataFrame) -> np.ndarray | None:
    """Weights learnt from ``labelled`` (doc_id, text, label 0/1), a bounded sample; None if it is empty."""
    rows = labelled.select(F.col("label").cast("double"), "text", F.xxhash64("doc_id", "text").alias("nth"))
    data = written(rows.mapInArrow(mapped(_feature_pass), "label double, nth long, slots binary"), "toxic-features")
    if data.isEmpty():
        return None
    learnt = data.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_train, "slot int, weight double").toPandas()  # 2**BITS rows at most
    w = np.zeros((1 << BITS) + 1)
    w[learnt.slot] = learnt.weight
    return w


def _score_pass(shared):
    def run(batches):
        at, values, intercept, given = shared.value
        w = np.zeros(1 << BITS)
        w[at] = values
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            size = np.ones(batch.num_rows)
            for lo, hi in chunks_of(offsets, CHUNK):
                slots, rows = _features(*words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                pairs = np.unique((rows << BITS) | slots)
                out[lo:hi] = np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], hi - lo)
                size[lo:hi] = np.bincount(pairs >> BITS, minlength=hi - lo)
            out = out * value_of(size) + intercept
            score = 1 / (1 + np.exp(-np.clip(out, -500, 500))) if given else np.zeros(len(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return run


def score_texts(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a score between 0 and 1; without weights all scores are 0."""
    w = weights if weights is not None else np.zeros(1)
    at = np.flatnonzero(w[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((at, w[at], float(w[-1]), weights is not None))
    return docs.mapInArrow(mapped(_score_pass(shared)), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from ``labels`` (doc_id, toxic) that are not null and whose crc32(doc_id as text) mod 4 is not 2; of several
    labels of a document the largest counts. A null text is empty and still gets a score; a null doc_id is never held
    out. Without any labelled text all scores are 0. Repeated rows get equal scores; an empty table gives an empty one;
    columns named in ``carry`` go along as carried_<name>; others are ignored.
    """
    carried = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"})
    known = columns_guarded(labels, {"doc_id": "long", "toxic": "int"}).where("doc_id is not null and toxic is not null").where(~held_out())
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("label")), "toxic-labels")
    sample = bounded_share(known, train_rows)
    labelled = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")  # ``train_rows`` ids at most
    labelled = bounded_share(labelled, train_rows, ("doc_id", "text"))  # and rows: many may share an id
    scored = score_texts(whole, fit(labelled))
    return scored.select("doc_id", "text", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[f"carried_{c}" for c in carry])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("text")
