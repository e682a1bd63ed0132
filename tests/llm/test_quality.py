import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm.quality import BITS, SPARED, TEMPERATURE, gumbel, importance_resample, op5_importance_resampling, top_k


def test_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.1"
    out = op5_importance_resampling(spark, sf).toPandas()
    m = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert m.selected[m.quality == 1].mean() > 0.99
    assert m.selected[m.quality == 0].mean() < 0.05
    order = np.argsort(np.argsort(m.mean_weight)) + 1
    p = m.quality == 1
    assert (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()) > 0.98


def grams(text):
    """Words, runs of signs, and pairs of neighbours, with repeats."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+|[^\x20\x09-\x0D0-9a-z_\x80-\U0010ffff]+", low)
    return [*w, *zip(w, w[1:])]


def plain(rows, good, noise, temperature, k=None):
    """{doc_id: (n_grams, log_weight, key, selected)} by counting and sorting."""
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for d, t in rows if d in good for g in grams(t))
    share = lambda c, g: (c[g] + 1) / (sum(c.values()) + 2**BITS)
    weight = {d: sum(math.log(share(target, g)) - math.log(share(raw, g)) for g in grams(t)) for d, t in rows}
    mean = {d: weight[d] / max(1, len(grams(t))) for d, t in rows}
    key = {d: mean[d] / temperature + noise[d] for d in mean}
    if k is None:
        least = np.quantile([mean[d] for d in good], SPARED)
        k = sum(v >= least - 1e-12 for v in mean.values())
    taken = set(sorted(key, key=lambda d: (-key[d], d))[:k])
    return {d: (len(grams(t)), weight[d], key[d], d in taken) for d, t in rows}


def test_equals_a_plain_version_and_the_seed_decides(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.choices(vocab, weights=range(1, 13) if i % 2 else range(12, 0, -1), k=rnd.randrange(0, 25))) + rnd.choice(["", " !!", "."])) for i in range(200)]
    rows[7] = (7, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = set(range(1, 100, 4))
    labels = spark.createDataFrame([(d, 1) for d in good] + [(2, 0)], "doc_id long, quality int")
    seen = []
    for seed, temperature, k in ((1, TEMPERATURE, None), (1, 1.0, 60), (2, 1.0, 60)):
        noise = {r.doc_id: r.g for r in docs.select("doc_id", gumbel(seed).alias("g")).collect()}
        want = plain(rows, good, noise, temperature, k)
        got = {r.doc_id: r for r in importance_resample(docs, labels, k=k, temperature=temperature, seed=seed).collect()}
        for d, (n, weight, key, taken) in want.items():
            assert (got[d].n_grams, got[d].selected) == (n, taken)
            assert abs(got[d].log_weight - weight) < 1e-9 and abs(got[d].key - key) < 1e-6
        seen.append({d for d, r in got.items() if r.selected})
    assert len(seen[1]) == len(seen[2]) == 60 and seen[1] != seen[2]


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(0)
    keys = np.r_[rnd.standard_normal(30_000), np.full(15_000, 0.5), np.full(5_000, 1e6)]
    rows = spark.createDataFrame(list(zip(range(len(keys)), keys.tolist())), "doc_id long, key double").repartition(5)
    for k in (0, 1, 4_999, 5_001, 12_000, 20_000, 49_999, 60_000):
        want = set(sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k])
        assert {r.doc_id for r in top_k(rows, "key", k).where("selected").collect()} == want


def test_gumbel_sampling_follows_weights(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).select(gumbel(3).alias("g")).toPandas()
    assert abs(rows.g.mean() - 0.5772) < 0.02  # the mean of the Gumbel distribution


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (1, "a b c", 9), (2, None, 9), (None, "zz " * 3000, 9)], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert importance_resample(docs, labels).count() == 4
    assert importance_resample(docs, labels, k=2).where("selected").count() == 2
    assert all(r.selected and r.log_weight == 0 for r in importance_resample(docs, labels.limit(0)).collect())
    assert importance_resample(docs.limit(0), labels).count() == 0


def test_rows_without_a_doc_id_are_drawn_one_by_one(spark):
    """A third of the rows have no doc_id, another third share one; each row has its own luck."""
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("word "), F.col("id") % 3)).otherwise("word 1").alias("text"), F.col("id"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(" "), "id")).otherwise(F.col("text")))
    labels = spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int")
    out = importance_resample(docs, labels, k=1_000, temperature=1e9).toPandas()
    for mine in (out[out.doc_id.isna()], out[out.doc_id == 7], out[out.doc_id != 7].dropna()):
        assert 0.25 < mine.selected.mean() < 0.42 and mine.key.nunique() > 900


def test_target_rows_are_bounded(spark):
    from chronolith.llm import common

    docs = spark.range(15_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert 0 < common.bounded_share(docs, 100, ("doc_id", "text")).count() <= 100
    assert common.bounded_share(docs.unionByName(docs.limit(10)).limit(50), 60).count() == 50
    same = spark.range(5_000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    assert common.bounded_share(same, 100, ("doc_id", "text")).count() == 1
    out = importance_resample(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), target_rows=100)
    assert out.count() == 15_000


def test_all_target_texts_count(spark):
    """More of them than the 16,384 that once were the bound; the threshold is that of all, too."""
    import numpy as np

    from chronolith.llm.quality import log_ratios, quantile, weigh

    n = 17_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 991, F.lit(" "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    out = importance_resample(docs, labels).toPandas()
    all_of = weigh(docs, log_ratios(docs, docs)).toPandas().set_index("doc_id")
    mine = out.set_index("doc_id").log_weight
    assert np.array_equal(mine.to_numpy(), all_of.log_weight.loc[mine.index].to_numpy())
    assert not mine.any()  # target and raw texts are the same, so no n-gram weighs anything
    rows = spark.range(30_001).select((F.pow(F.col("id") - 9_000, F.lit(3)) / 7).alias("w")).cache()
    held = np.sort([r.w for r in rows.collect()])
    for share in (0.0, 0.002, 0.37, 0.99999, 1.0):
        assert np.isclose(quantile(rows, "w", share), np.quantile(held, share), rtol=1e-12)
    assert quantile(rows.where("w is null"), "w", 0.5) is None
