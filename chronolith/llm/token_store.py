"""Token ids of documents in ORC files, in the order of doc_id.

A row of a file is a document: ``doc_id``, ``part`` (the number of the file's task), ``local_start`` (ids of the part before
it), ``n_tokens`` and ``ids``. ORC run-length encodes whole numbers (ids take as many bits as they need), cuts a file into
stripes that tasks read on their own, and keeps the least and greatest doc_id of each stripe and of every ROWS_PER_GROUP
rows, with a Bloom filter of the doc_ids there. So a few documents, or a range of them, are read without the rest.

Documents are dealt out by ranges of (doc_id, hash of the text), so a doc_id that many rows share has many parts; each task
sorts its range, encodes it in this order and writes it. What comes before a part is a sum over the parts, one small row
each, in a manifest beside the files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.byte_bpe import REMEMBERED, from_path
from chronolith.llm.common import columns_guarded, mapped, scratch_path, shuffle_partitions

#: Rows of an index entry and of a Bloom filter.
ROWS_PER_GROUP = 1_000
STRIPE_BYTES = 16 << 20
#: Ids of a batch that goes to the writer.
BATCH_IDS = 1 << 20
STORED = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
MANIFEST = "manifest"


def _encoded(tokenizer, end_id: int):
    names = ["doc_id", "part", "local_start", "n_tokens", "ids"]

    def batch_of(docs: list, part: int, start: int, ids: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(i) for i in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.full(len(docs), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(lengths), lists], names)

    def run(batches):
        bpe, part, start, end = tokenizer(), TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        docs, held, size = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(texts)):
                docs.append(doc)
                held.append(np.concatenate((ids, end)))
                size += len(ids) + 1
                if size >= BATCH_IDS:
                    yield batch_of(docs, part, start, held)
                    docs, held, start, size = [], [], start + size, 0
        if docs:
            yield batch_of(docs, part, start, held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, remembered: int = REMEMBERED, parts: int | None = None) -> None:
    """Writes ids of ``docs`` (doc_id, text) to ORC files below ``path``, with a manifest of the parts.

    A document is the ids of its text and then ``end_id``; a null or empty text is ``end_id`` alone. Rows are in the order
    of doc_id (null first), rows under one doc_id in an order that follows from their texts alone; repeated rows are written each. An
    empty table gives files without rows; other columns are ignored. ``parts``: ranges of documents, the session's number of
    shuffle partitions unless given.
    """
    spark = docs.sparkSession
    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"}).withColumn("_h", F.xxhash64("text"))
    ranged = docs.repartitionByRange(parts or shuffle_partitions(spark), F.asc_nulls_first("doc_id"), "_h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_h", "text")
    stored = ranged.select("doc_id", "text").mapInArrow(mapped(_encoded(from_path(spark, tokenizer_file, remembered), end_id)), STORED)
    options = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.create.index": True,
        "orc.row.index.stride": ROWS_PER_GROUP,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": 0.01,
    }
    stored.write.options(**options).orc(f"{path}/documents")
    sums = spark.read.schema(STORED).orc(f"{path}/documents").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_part_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums.withColumn("base", F.coalesce(F.sum("n_part_tokens").over(before), F.lit(0))).write.orc(f"{path}/{MANIFEST}")


def read_tokens(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of what ``write_tokens`` wrote; ``start`` counts the ids of all documents before.

    ``which``, a condition on doc_id, is pushed down: files, stripes and groups of rows whose doc_ids can't meet it are left
    out by their indexes and Bloom filters. Columns that aren't used aren't read.
    """
    rows = spark.read.schema(STORED).orc(f"{path}/documents")
    bases = spark.read.schema("part int, base long").orc(f"{path}/{MANIFEST}")
    rows = rows if which is None else rows.where(which)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def at_places(spark: SparkSession, path: str, places: DataFrame, place: str) -> DataFrame:
    """``places`` with the document that holds each place of the whole sequence of ids, and the id there (inner).

    Each place finds its part in the manifest and then its document by the ids before it, among the rows of that part.
    """
    parts = spark.read.orc(f"{path}/{MANIFEST}").select("part", "base", (F.col("base") + F.col("n_part_tokens")).alias("_until"))
    asked = places.join(F.broadcast(parts), (F.col(place) >= F.col("base")) & (F.col(place) < F.col("_until"))).withColumn("_local", F.col(place) - F.col("base"))
    rows = spark.read.schema(STORED).orc(f"{path}/documents")
    met = asked.join(rows, (asked["part"] == rows["part"]) & (F.col("_local") >= F.col("local_start")) & (F.col("_local") < F.col("local_start") + F.col("n_tokens")))
    return met.select(*places.columns, "doc_id", F.get("ids", (F.col("_local") - F.col("local_start")).cast("int")).alias("id"))


def checksums(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids_crc32``, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, for their ids."""
    kept = [f for f in rows.schema.fields if f.name != ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long"

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], pa.array(crcs, pa.int64())], [*[f.name for f in kept], "ids_crc32"])

    return rows.mapInArrow(mapped(run), schema)


def op13_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), remembered=600_000)
    return checksums(read_tokens(spark, path))
