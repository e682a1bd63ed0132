"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; between stages the rows
are written as Parquet and read again. Filters judge rows, not doc_ids, which
may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import numbered, small_enough, written
from chronolith.llm.ngram_join import ngram_join
from chronolith.llm.packing import pack
from chronolith.llm.quality import importance_resample
from chronolith.llm.suffix_dedup import suffix_dedup
from chronolith.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Learnt models and packing have no SQL equivalent.
ORACLE_SQL = None


#: What the filters carry along besides doc_id; the text goes twice, as some operators drop theirs.
CARRIED = tuple(c for c in COLUMNS if c != "doc_id")


def _rows(judged: DataFrame) -> DataFrame:
    """The rows of ``documents`` that an operator has carried along."""
    return judged.select("doc_id", *[F.col(f"carried_{c}").alias(c) for c in CARRIED])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=CARRIED)
    return _rows(scored.where("predicted = 0"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes."""
    weighed = importance_resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=CARRIED)
    return _rows(weighed.where("selected"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest doc_id; of texts under that, one by its digest.

    Rows are compared under numbers of their own, so different texts under one doc_id are judged apart. Rows equal in
    doc_id and text count once. Rows without a doc_id link with nothing, as in the operator.
    """
    docs = numbered(docs).withColumn("number", F.when(F.col("doc_id").isNotNull(), F.col("number")))
    groups = ngram_join(docs.select(F.col("number").alias("doc_id"), "text"))
    gone = small_enough(written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("number")).distinct(), "rejected"))
    kept = docs.join(gone, "number", "left_anti")
    n, distinct = kept.agg(F.count("number"), F.countDistinct("number")).first()
    if n > distinct:  # repeated rows
        kept = kept.where("number is not null").dropDuplicates(["number"]).unionByName(kept.where("number is null"))
    return kept.select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that occurred before; bytes of characters that a cut split go, too."""
    out = suffix_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), F.col("carried_lang").alias("lang"), F.col("carried_source").alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
