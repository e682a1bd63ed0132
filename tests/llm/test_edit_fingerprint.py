import hashlib
import random

from chronolith.llm.edit_fingerprint import DIGITS, LOWEST, edit_fingerprints, edited, fingerprint_texts, fingerprints, level_of, likeness, near_duplicates, op6_edit_fingerprints


def check(rows, got):
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)]
        e = edited(t or "", following[1] or "")
        r = by[d]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints([t or "", e])
        assert r.near_edited == likeness([r.fingerprint], [r.edited_fingerprint])[0]
        assert r.near_next == likeness([r.fingerprint], [by[following[0]].fingerprint])[0]


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_edit_fingerprints(spark, sf).collect()
    check(rows, got)
    near = [r.near_edited for r in got if r.n_chars > 60]
    far = sorted(r.near_next for r in got)
    assert sum(near) / len(near) > 0.5 and far[int(0.8 * len(far))] < 0.3


def walk_by_hand(text, level):
    """The emitted symbols by a plain loop, to compare the arrays' walk with."""
    from chronolith.llm import edit_fingerprint as E
    import numpy as np

    at, out = 0, {}
    marks = {j: (s, k) for s in (0, 1) for k, j in enumerate(E._places(level + s)[0].tolist())}
    both = [dict((j, k) for k, j in enumerate(E._places(level + s)[0].tolist())) for s in (0, 1)]
    digits = [["0"] * DIGITS for _ in (0, 1)]
    for j in range(max(marks) + 1):
        for s in (0, 1):
            if j in both[s] and at < len(text):
                digits[s][both[s][j]] = "0123456789abcdef"[int(E.mix(np.array([ord(text[at]) + (j << 24)], np.uint64))[0] % np.uint64(15)) + 1]
        if at < len(text):
            word = int(E.mix(np.array([j + (E.SEED << 40)], np.uint64))[0])
            at += word >> int(E.mix(np.array([ord(text[at]) + 1], np.uint64))[0] % np.uint64(63)) & 1
    return f"{level:02x}" + "".join(digits[0]) + "".join(digits[1])


def test_walk_and_edits():
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij é中") for _ in range(n))
    texts = ["", "a", word(31), word(500), word(1500)]
    assert fingerprints(texts) == [walk_by_hand(t, level_of(len(t))) for t in texts]
    assert level_of(0) == LOWEST and level_of(1024) == 10 and level_of(1025) == 11
    base = word(2000)
    few = base[:700] + "x" + base[700:1300] + base[1302:]
    f = fingerprints([base, few, base + word(200), word(2000), base])
    assert f[0] == f[4]
    near = likeness([f[0]] * 4, [f[1], f[2], f[3], f[4]])
    assert near[0] > 0.6 and near[1] > 0.7 and near[2] < 0.2 and near[3] == 1


def test_edges_and_near_duplicates(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij é中") for _ in range(n))
    base = [word(1500) for _ in range(4)]
    rows = [(10 * i + j, b if j == 0 else b[: 200 * j] + "#" + b[200 * j :]) for i, b in enumerate(base) for j in range(6)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(3)
    check(rows, edit_fingerprints(df).collect())
    got = {r.doc_id: r.component_id for r in near_duplicates(fingerprint_texts(df), 0.4).select("doc_id", "component_id").collect()}
    assert all(v // 10 == d // 10 for d, v in got.items())
    assert sum(v == d // 10 * 10 for d, v in got.items()) >= 20
    odd = spark.createDataFrame([(1, "same"), (1, "same"), (None, None), (2, "")], "doc_id long, text string")
    assert edit_fingerprints(odd).count() == 4
    assert edit_fingerprints(odd.limit(0)).count() == 0
    assert near_duplicates(fingerprint_texts(odd.limit(0))).count() == 0


def reached(prints, links):
    """{doc_id: smallest doc_id that links reach}, by brute force."""
    least = {d: d for d in prints}
    for _ in prints:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_recall_at_the_default_threshold(spark, monkeypatch):
    """All pairs by brute force; once in one block, once in many."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefghij é中") for _ in range(n))
    texts = []
    for _ in range(40):
        base = word(rnd.randrange(100, 1500))
        for _ in range(8):
            t = base
            for _ in range(rnd.randrange(0, 4)):
                at = rnd.randrange(len(t))
                t = t[:at] + rnd.choice(["", "x", "yz"]) + t[at + rnd.randrange(0, 2) :]
            texts.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fingerprints(texts)
    links = [(i, j) for i in range(len(texts)) for j, near in enumerate(likeness([prints[i]] * i, prints[:i])) if near >= 0.75]
    want = reached(range(len(texts)), links)
    for block in (2048, 40):
        monkeypatch.setattr("chronolith.llm.edit_fingerprint.BLOCK", block)
        got = {r.doc_id: r.component_id for r in near_duplicates(fingerprint_texts(df)).collect()}
        kept = sum(got[a] == got[b] for a, b in links)
        assert len(links) > 150 and kept >= 0.97 * len(links)
        assert all(want[d] == want[c] for d, c in got.items())  # nothing is linked that isn't near


def test_a_doc_id_that_most_rows_share(spark):
    """Rows of one doc_id, or of none, follow each other by hash through several ranges, each with one next document."""
    rnd = random.Random(13)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} " + "".join(rnd.choice("abc ") for _ in range(90))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = sorted((d or 0, hashlib.sha256(edited(t, order[i - 1][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in edit_fingerprints(df).collect()) == want


def test_strangers_do_not_become_candidates(spark, monkeypatch):
    """Texts of one language meet in bands by chance; what goes on from the buckets is near, or nearly nothing."""
    from chronolith.llm import edit_fingerprint as E

    rnd = random.Random(14)
    words = ["".join(rnd.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rnd.randrange(2, 7))) for _ in range(60)]
    texts = [" ".join(rnd.choices(words, k=90)) for _ in range(3000)]
    texts += [t + " zz" for t in texts[:20]]
    sizes = []

    def counted(edges, f=E.components):
        sizes.append(edges.where("a <> b").selectExpr("explode(array(a, b)) as n").distinct().count())
        return f(edges)

    monkeypatch.setattr(E, "components", counted)
    got = near_duplicates(fingerprint_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(got) == len(texts) and max(sizes) < 600  # 20 pairs, and few strangers; 2573 when all that share a band went on
    assert sum(r.component_id == r.doc_id - 3000 for r in got if r.doc_id >= 3000) == 20
