import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm.suffix_dedup import PIECE, _Chunk, op4_suffix_dedup, settle, suffix_dedup


def brute(rows, width=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix_dedup(spark, sf).collect()}
    assert got == brute(rows)


def test_planted_and_edges(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, long = word(300), word(20_000)
    rows = [(9, "x" * 500), (1, ""), (2, None), (3, passage), (4, word(50) + passage[20:180] + word(90)), (5, word(10) + passage[100:199]), (6, long), (7, long[3000:9000] + long[2000:3200]), (8, passage + passage), (10, "ab" * 400), (-4, long[100:400])]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, lo string, bucket int").repartition(3)
    assert found(suffix_dedup(df)) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdef ") for _ in range(400))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:200]), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(df).collect())
    assert got == [(0, 0), (1, 200), (1, 200), (2, 400)]
    assert suffix_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(df, 60)


def test_texts_without_or_with_one_doc_id_are_apart(spark):
    """Each row against brute force over rows in the order (doc_id, digest): nothing unique goes, no copy stays."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    for ids in ((None, None), (None, 5), (5, 5)):
        rows = [(ids[0], word(500) + passage + word(200)), (ids[1], word(1000)), (ids[0], passage + word(900)), (ids[1], word(100) + passage), (9, passage)]
        rows += [rows[1]] * 2 if ids[1] is None else []
        key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
        ordered = sorted(rows, key=key)
        want = brute(list(enumerate(t for _, t in ordered)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup(df).collect()]
        assert sorted(map(str, got)) == sorted(str((d, *want[i])) for i, (d, _) in enumerate(ordered))


def test_a_text_of_several_pieces(spark):
    """A text over PIECE bytes, with repeats over the ends of pieces, and null bytes."""
    rnd = random.Random(21)
    long = bytearray(rnd.randbytes(PIECE + 300_000).translate(bytes(range(97, 113)) * 16))
    long[PIECE - 700 : PIECE + 500] = long[1000:2200]
    long[PIECE - 40_000 : PIECE - 39_800] = b"\0" * 200
    rows = [(1, long.decode()), (2, "q" + long[PIECE - 300 : PIECE + 200].decode() + "q"), (3, "q" * 99), (4, "\0" * 150)]
    got = {r.doc_id: (r.n_removed, list(zip(r.starts, r.ends))) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = PIECE - 700, PIECE + 500
    while long[a - 1] == long[1000 - (PIECE - 700 - a) - 1]:
        a -= 1
    while long[b] == long[2200 + b - PIECE - 500]:
        b += 1
    nulls = (PIECE - 40_000 + 1, PIECE - 39_800)  # the second of the equal strings on
    assert got[1] == (b - a + 199, sorted([(a, b), nulls]))
    assert got[2] == (500, [(1, 501)]) and got[3] == (0, []) and got[4] == (150, [(0, 150)])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 330), st.binary(max_size=120)), min_size=2, max_size=7), st.sampled_from([b"ab", b"abcdefgh", b"\0x"]), st.integers(0, 999))
def test_samples_settle_every_tie(parts, letters, seed):
    rnd = random.Random(seed)
    base = bytes(rnd.choice(letters) for _ in range(420))
    docs = [more[: len(more) // 2] + base[at : at + n] + more[len(more) // 2 :] for at, n, more in parts]
    data = np.frombuffer(b"".join(docs), np.uint8)
    chunk = _Chunk(data, np.cumsum([0, *map(len, docs)]), np.arange(len(docs)), 0, 100)
    (doc, lo, hi), leads = settle(*chunk.around(chunk.cover), chunk.docs[chunk.row_of(chunk.cover)], chunk.at[chunk.cover], 44)
    seen, want = set(), set()
    for i, text in enumerate(docs):
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                want.add((i, p))
            seen.add(text[p : p + 100])
    assert {(int(d), p) for d, a, b in zip(doc, lo, hi) for p in range(a, b)} == want
    # occurrences that come first nowhere may stay away: what the others tell is the same to a text that comes later
    assert leads.any() or not len(leads)


def test_columns_that_go_along(spark):
    """Names that the operator uses itself don't clash."""
    rnd = random.Random(2)
    t = "".join(rnd.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, t, "a", 7, b"x"), (2, t, "b", 8, b"y"), (2, t + "z", None, 9, None)], "doc_id long, text string, number string, lo long, kept binary")
    got = sorted((r.carried_lo, r.carried_number or "", r.n_removed, bytes(r.carried_kept or b"")) for r in suffix_dedup(df, carry=("number", "lo", "kept")).collect())
    assert got == [(7, "a", 0, b"x"), (8, "b", 300, b"y"), (9, "", 300, b"")]


def test_texts_that_powers_of_two_cannot_tell_apart(spark):
    """Two texts without cuts that differ in every 64th letter, in the Thue-Morse order: polynomials modulo 2**64 are equal."""
    from chronolith.llm.common import _BASES, PrimeRolling, Rolling

    rnd, powers = random.Random(4), [pow(_BASES[0], k, 1 << 64) for k in range(16)]
    cut = lambda w: len(w) == 16 and sum((ord(c) + 1) * p for c, p in zip(w, powers)) % (1 << 64) >> 58 == 0
    one, two = [], []
    while len(one) < 16_384:
        i = len(one)
        x, y = ("ab" if bin(i // 64).count("1") % 2 else "ba") if i % 64 == 0 else rnd.choice("cdefghijklmnop") * 2
        one.append(x)
        two.append(y)
        if cut(one[-16:]) or cut(two[-16:]):
            keep = i if i % 64 else i - 8  # a marker stays, so what is before it changes
            del one[keep:], two[keep:]
    one, two = "".join(one), "".join(two)
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in (one, two))
    whole = np.array([0]), np.array([16_384])
    assert Rolling(a).span(*whole) == Rolling(b).span(*whole) and PrimeRolling(a).span(*whole) != PrimeRolling(b).span(*whole)
    rows = [(1, one), (2, two)]
    assert found(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_prime_hashes_are_polynomials_of_the_span():
    from chronolith.llm import common

    data = np.random.default_rng(1).integers(0, 256, 70_000).astype(np.uint8)
    prime, roll = (1 << 31) - 1, common.PrimeRolling(data)
    for s, e in ((0, 1), (0, 10), (17, 400), (69_000, 70_000)):
        high, low = (sum((x + 1) * pow(base, k, prime) for k, x in enumerate(data[s:e].tolist())) % prime for base in common._PRIME_BASES)
        assert int(roll.span(np.array([s]), np.array([e]))[0]) == high << 31 | low
