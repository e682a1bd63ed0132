import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm.ngram_join import chained, ngram_join, op10_ngram_join, trie_links


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    at, links = {}, {d: set() for d in sets}
    for d, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e in {e for g in s for e in at[g]} - {d}:
            if 100 * len(s & sets[e]) >= 75 * len(s | sets[e]):
                links[d].add(e)
    out = {}
    for d in sorted(sets):
        if d not in out:
            seen, todo = {d}, [d]
            while todo:
                for e in links[todo.pop()] - seen:
                    seen.add(e)
                    todo.append(e)
            out |= dict.fromkeys(seen, min(seen))
    return sorted((d, len(sets[d]), out[d]) for d in sets)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_ngram_join(spark, sf).collect())) == brute(rows)


def test_near_groups_and_edges(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = [rnd.choice(vocab) for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(0, 7)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w[rnd.randrange(0, 9) :]))
    rows += [None, "", " \t\n", "A b", "a B", "a b c", "É é x y z", "é é x y z", "x\x1cy z a b c"]
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id long, text string, gram string, n int").repartition(3)
    assert sorted(map(tuple, ngram_join(df).collect())) == brute(rows)
    assert ngram_join(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join(again).collect()) == [(0, 0), (1, 1), (1, 1)]


def joined(n, links):
    """Of each of ``n`` numbers the smallest that links reach."""
    least = list(range(n))
    for _ in range(n):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20), min_size=1), min_size=1, max_size=12), st.data())
def test_trie(sets, data):
    n = len(sets)
    labels = data.draw(st.none() | st.lists(st.integers(0, n), min_size=n, max_size=n))
    near = {(i, j) for i in range(n) for j in range(n) if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    same = [(i, j) for i in range(n) for j in range(i) if labels and labels[i] == labels[j]]
    links, group, _ = trie_links([np.array(sorted(s), np.uint64) for s in sets], 75, np.array(labels) if labels else None)
    assert set(links) <= near
    want = joined(n, [*near, *same])
    assert joined(n, links + same) == want
    assert [(group == g).argmax() for g in group] == want


def test_many_near_copies_in_blocks(spark, monkeypatch):
    """A component of many blocks: copies of copies, so most pairs aren't similar, and one link of two groups."""
    monkeypatch.setattr("chronolith.llm.ngram_join.BLOCK", 900)
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    base = [rnd.choice(vocab) for _ in range(60)]
    rows, last = [], list(base)
    for i in range(120):
        w = list(last if i % 3 == 0 else base)
        w[rnd.randrange(len(w))] = rnd.choice(vocab)
        last = w if i % 3 == 0 else last
        rows.append((i * 3 % 121, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join(df).collect())) == brute(rows)


def test_texts_of_one_doc_id_and_long_ones(spark):
    rnd = random.Random(6)
    words = lambda n: [f"u{rnd.randrange(5000)}" for _ in range(n)]
    a, b, c = words(80), words(80), words(60_000)
    rows = [(1, a), (2, a), (1, b), (3, b[:-1]), (7, c), (8, c[:-900]), (9, words(70)), (None, b)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join(df).collect())
    size = lambda w: len(shingles(" ".join(w)))
    assert got == sorted([(1, 76, 1), (2, 76, 1), (1, 76, 1), (3, 75, 1), (7, size(c), 7), (8, size(c[:-900]), 7), (9, 66, 9), (0, 76, 0)])


def test_words_that_powers_of_two_cannot_tell_apart(spark):
    """One word in the Thue-Morse order of two letters, and with the letters exchanged; also within longer texts."""
    order = "".join("ab"[bin(i).count("1") % 2] for i in range(2_048))
    other = order.translate(str.maketrans("ab", "ba"))
    rows = [(1, order), (2, other), (3, f"x {order} y z w v u"), (4, f"x {other} y z w v u"), (5, order.upper())]
    got = {r.doc_id: r.component_id for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \tabABé", max_size=40), max_size=6))
def test_telling_hashes_are_equal_for_equal_words_only(texts):
    from chronolith.llm.common import words_of

    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, rows = words_of(data, np.cumsum([0, *map(len, raw)]), telling=True)
    words = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))]
    assert [i for i, _ in words] == rows.tolist()
    assert len(set(zip(hashes.tolist(), (w for _, w in words)))) == len(set(hashes.tolist())) == len({w for _, w in words})


def test_chains_join_what_may_be_similar_and_no_more():
    """Against all pairs of a list."""
    rnd = random.Random(31)
    for _ in range(300):
        rows = sorted((rnd.randrange(3), n := rnd.randrange(1, 40), rnd.randrange(max(1, n - 12), n + 1)) for _ in range(rnd.randrange(0, 30)))
        g, n, left = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        pairs = [(i, j) for j in range(len(rows)) for i in range(j) if g[i] == g[j] and 75 * (n[i] + n[j]) <= 175 * min(left[i], left[j])]
        got = list(zip(*(a.tolist() for a in chained(g, n, left, 75))))
        assert set(got) <= set(pairs) and len(got) < max(1, len(rows))

        def groups(links):
            name = list(range(len(rows)))
            for a, b in links:
                name = [name[a] if x == name[b] else x for x in name]
            return [name.index(x) for x in name]

        assert groups(got) == groups(pairs)


@pytest.mark.parametrize("own", [24, 10])
def test_documents_of_one_template(spark, own, monkeypatch):
    """Many documents that share most words of a template: with 24 own words of 120 none are similar, with 10 all are."""
    import chronolith.llm.ngram_join as m

    rnd = random.Random(7)
    template = [f"t{i}" for i in range(120 - own)]
    rows = [(i, " ".join(template + [f"w{rnd.randrange(10**9)}" for _ in range(own)])) for i in range(400)]
    seen = []
    monkeypatch.setattr(m, "_in_blocks", lambda member, *rest, old=m._in_blocks: (seen.append(member.count()), old(member, *rest))[1])
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)
    assert seen == [0 if own == 24 else 400]  # documents that can't be similar aren't compared
