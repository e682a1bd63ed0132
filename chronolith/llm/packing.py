"""Best-fit packing by minimum bin slack.

How documents can be packed depends on how many pieces there are of each length, 1 to ``size``, and on nothing else.
So the pieces are counted by length; bins are filled one after another, each with the longest piece left and the
combination of the others that leaves the least slack, found by subset sums in a bitset over available lengths; a
combination is used as often as its lengths last. The plan has a few thousand combinations at most, whatever the input.
Pieces then find their place by their rank among those of their length, which comes from counts per task and length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.byte_bpe import REMEMBERED, from_path
from chronolith.llm.common import columns_guarded, mapped, written


def fullest(cap: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """Of ``available`` (length, count), longest first: {length: how many} with the largest sum up to ``cap``."""
    mask, reach, steps = (1 << (cap + 1)) - 1, 1, []
    for length, count in available:
        if length > cap:
            continue
        count, k = min(count, cap // length), 1
        while count > 0:
            take = min(k, count)
            before = reach
            reach |= reach << (take * length) & mask
            if reach != before:
                steps.append((before, length, take))
            count -= take
            k *= 2
        if reach >> cap & 1:
            break
    left = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + take
            left -= take * length
    return out


def bin_plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """[(how many bins, {length: how many in each})] that hold all pieces counted by length."""
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n > 0}
    plan = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        combination = fullest(size - longest, [(k, n) for k, n in left.items() if n > 0])
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, combination))
    return plan


def _blocks(plan):
    """Per length: starts of rank ranges, and for each the first bin, pieces per bin and offset of the first."""
    blocks: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for times, combination in plan:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            start = rank.get(length, 0)
            blocks.setdefault(length, []).append((start, first, n, offset))
            rank[length] = start + times * n
            offset += n * length
        first += times
    return {k: np.array(v, np.int64).T for k, v in blocks.items()}


def _pieces(tokenizer, size: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        bpe, task, seen = tokenizer(), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                lo, hi = 0, (len(ids) - 1) % size + 1
                piece = 0
                while lo < len(ids):
                    part = ids[lo:hi].tobytes()
                    rows.append((doc, piece, lo, hi - lo, zlib.crc32(part), task, int(seen[hi - lo]), part if with_ids else None))
                    seen[hi - lo] += 1
                    piece, lo, hi = piece + 1, hi, hi + size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def pack(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece of a row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Documents of more than ``size``
    ids are cut into pieces of ``size``, of which the first may be shorter; others stay whole. Sequences hold at most
    ``size`` ids and have no gaps. Repeated rows are packed each; a null doc_id stays null; an empty table gives an empty
    one; other columns are ignored. ``with_ids`` adds the ids (binary, little-endian unsigned 32-bit). ``remembered`` is how many
    words a worker remembers, twice at most (200 bytes each).
    """
    spark = docs.sparkSession
    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"})
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"
    pieces = docs.mapInArrow(mapped(_pieces(from_path(spark, tokenizer_file, remembered), size, end_id, with_ids)), kinds)
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    counted = written(pieces.groupBy("length", "task").count(), "piece-counts")
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # ``size`` rows at most
    blocks = spark.sparkContext.broadcast(_blocks(bin_plan(counts, size)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        bins, offsets = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for one in np.unique(n):
            mine = n == one
            start, first, each, offset = blocks.value[int(one)]
            b = np.searchsorted(start, r[mine], "right") - 1
            q = r[mine] - start[b]
            bins[mine], offsets[mine] = first[b] + q // each[b], offset[b] + q % each[b] * one
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), remembered=600_000)
