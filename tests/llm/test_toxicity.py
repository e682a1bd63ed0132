import numpy as np

from chronolith.llm.toxicity import op1_toxicity, toxicity


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    p = label == 1
    return (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = op1_toxicity(spark, sf).toPandas()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    m = out.merge(texts, on="doc_id").merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    words = m.text.str.contains(r"\b(?:idiot|clown|moron|worthless|pathetic|disgusting)\b", case=False)
    assert out.score.between(0, 1).all() and len(out) == len(texts)
    assert auc(m.score, m.toxic) > 0.9
    assert auc(m.score, words.astype(int)) > 0.95
    # the words are English ones: of rows without them, those labelled toxic (in other languages) may be predicted
    assert (m.predicted[~words & (m.toxic == 0)] == 1).mean() < 0.01
    assert (m.predicted[m.toxic == 1] == 1).mean() > 0.65
    assert (m.predicted[words] == 1).mean() > 0.8


def test_edges(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "x " * 5000)]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.score == 0 for r in toxicity(docs, labels.limit(0)).collect())
    assert toxicity(docs.limit(0), labels).count() == 0


def test_training_rows_are_bounded(spark, monkeypatch):
    """One labelled doc_id that 15,000 rows share."""
    from pyspark.sql import functions as F

    from chronolith.llm import toxicity as T

    seen = []
    real = T.fit
    monkeypatch.setattr(T, "fit", lambda labelled: seen.append(labelled.count()) or real(labelled))
    docs = spark.range(15_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert T.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), train_rows=40).count() == 15_000
    assert 0 < seen[0] <= 40
