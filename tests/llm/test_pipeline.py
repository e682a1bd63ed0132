import random
from collections import Counter

from test_ngram_join import brute as groups
from test_packing import check as check_packing

import corpus_pipeline as P
from chronolith.llm.common import written
from chronolith.llm.quality import importance_resample
from chronolith.llm.toxicity import toxicity


def cut(rows, width=100):
    """Texts without repeated strings, plainly."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        out[doc] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_take_effect(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    docs = written(P.without_toxic(spark, docs, sf), "t")
    assert docs.columns == P.COLUMNS and {r.doc_id for r in docs.collect()} == set(kept) - toxic
    poor = {r.doc_id for r in importance_resample(docs, labels).where("not selected").collect()}
    docs = written(P.good_quality(spark, docs, sf), "t")
    rest = {d: t for d, t in kept.items() if d not in toxic | poor}
    assert docs.columns == P.COLUMNS and {r.doc_id: r.text for r in docs.collect()} == rest
    docs = written(P.without_near_copies(spark, docs, sf), "t")
    rest = {d: rest[d] for d, _, c in groups(list(rest.items())) if d == c}
    assert docs.columns == P.COLUMNS and {r.doc_id: r.text for r in docs.collect()} == rest
    docs = written(P.without_repeats(spark, docs, sf), "t")
    rest = cut(rest.items())
    assert docs.columns == P.COLUMNS and {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in rest.items()}
    out = P.packed(spark, docs, sf).collect()
    check_packing(out, list(rest.items()))
    again = P.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_repeated_rows_and_empty_table(spark, sf):
    text = "some words that are said here and then nothing more is said at all"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " now", "en", "s", 9), (3, None, None, None, None), (None, "x y", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.without_near_copies(spark, df, sf).collect()) == ["1", "3", "None"]
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0


def test_filters_judge_rows(spark, tmp_path):
    """Bad rows take no others with them that share their doc_id or have none either."""
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choices("river stone garden music letter window bread winter".split(), k=30))
    bad = lambda: " ".join(rnd.choices("vile scum hate idiot filth stupid trash loser".split(), k=30))
    rows = [(i, bad() if i % 2 else good()) for i in range(400)]
    spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [(d, text()) for d in (None, -7) for text in (good, good, good, bad)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    count = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for stage in (P.without_toxic, P.good_quality):
        kept = count(stage(spark, df, str(tmp_path)))
        for doc in (None, -7):
            mine = [t for d, t in rows if d == doc]
            assert Counter(t for d, t in kept.elements() if d == doc) == Counter(mine[:3])
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (2, c), (None, a), (None, c), (None, c)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert count(P.without_near_copies(spark, df, str(tmp_path))) == Counter([(1, a), (1, b), (2, c), (None, a), (None, c), (None, c)])
