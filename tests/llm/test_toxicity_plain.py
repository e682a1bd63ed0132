"""The optimiser and the features against plain versions with dictionaries."""

import math
import random

import numpy as np

from chronolith.llm import toxicity as T
from chronolith.llm.common import words_of


def features(text):
    """Distinct words, pairs and skip pairs, as tuples."""
    w = text.lower().split()
    return {(a,) for a in w} | {(1, a, b) for a, b in zip(w, w[1:])} | {(2, a, b) for a, b in zip(w, w[2:])}


def plain_ftrl(rows, passes):
    """Weights by feature; None is the intercept."""
    z, n = {}, {}

    def weight(f):
        l1 = 0 if f is None else T.L1
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else -(zf - math.copysign(l1, zf)) / ((T.BETA + math.sqrt(nf)) / T.ALPHA + T.L2)

    for _ in range(passes):
        for label, fs in rows:
            x = dict.fromkeys(fs, max(1, len(fs)) ** -0.25) | {None: 1.0}
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) - label
            for f, v in x.items():
                old = n.get(f, 0.0)
                n[f] = old + (g * v) ** 2
                z[f] = z.get(f, 0.0) + g * v - (math.sqrt(n[f]) - math.sqrt(old)) / T.ALPHA * w[f]
    return {f: weight(f) for f in z}


def test_weights_and_scores_equal_plain_ones():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 40))) for _ in range(120)]
    labels = [float("w3" in t.split() or "w7" in t.split()) for t in texts]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    slots, rows = T._features(*words_of(np.frombuffer(b"".join(raw), np.uint8), offsets))
    mine = [np.append(np.unique(slots[rows == i]), 1 << T.BITS) for i in range(len(texts))]
    theirs = [features(t) for t in texts]
    assert [len(m) - 1 for m in mine] == [len(f) for f in theirs]  # no two features of these share a slot
    z, n = np.zeros((1 << T.BITS) + 1), np.zeros((1 << T.BITS) + 1)
    for _ in range(5):
        T.ftrl_pass(z, n, zip(labels, mine))
    w = T.weights_of(z, n)
    want = plain_ftrl(list(zip(labels, theirs)), 5)
    assert abs(w[-1] - want[None]) < 1e-9 and np.count_nonzero(w) == sum(v != 0 for v in want.values())
    assert 0 < np.count_nonzero(w) < len(want) / 2  # L1 leaves most at zero
    for m, f in zip(mine, theirs):
        assert abs(w[m[:-1]].sum() - sum(want[x] for x in f)) < 1e-9
