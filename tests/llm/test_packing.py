import math
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm.byte_bpe import ByteBpe
from chronolith.llm.packing import bin_plan, fullest, op9_best_fit_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True


def ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t\x1c\x85\xa0 ab'sé1²<|endoftext|>!", max_size=60)))
def test_ids_equal_library(text):
    own = test_ids_equal_library.own
    assert own.encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


test_ids_equal_library.own = ByteBpe(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), max_size=7, unique_by=lambda x: x[0]))
def test_fullest(cap, available):
    sums = {0}
    for length, n in available:
        sums = {s + k * length for s in sums for k in range(n + 1)}
    got = fullest(cap, sorted(available, reverse=True))
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= cap)
    assert all(n <= dict(available)[k] for k, n in got.items())


def check(rows, docs, size=1024):
    want = {}
    for d, t in docs:
        a = ids(t)
        first = (len(a) - 1) % size + 1
        cuts = [0, *range(first, len(a) + 1, size)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((d, i, lo, hi - lo, zlib.crc32(np.array(a[lo:hi], "<u4").tobytes())), []).append(1)
    got = {}
    bins = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r.length for r in rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check(op9_best_fit_packing(spark, sf).collect(), docs)
    assert n <= math.ceil(total / 1024) * 1.006


def test_edges(spark):
    texts = [None, "", "dup", "dup", "word " * 5000, "x", "y" * 3000, "one two three " * 146]
    docs = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int").repartition(3)
    check(pack(df, PATH).collect(), docs)
    assert pack(df.limit(0), PATH).count() == 0
    assert len(pack(df, PATH, with_ids=True).first().ids) % 4 == 0


def test_plan_uses_every_piece():
    rnd = np.random.default_rng(2)
    counts = {int(k): int(n) for k, n in zip(rnd.choice(np.arange(1, 1025), 600, False), rnd.integers(1, 50, 600))}
    used = {}
    for times, combination in bin_plan(counts, 1024):
        assert sum(k * n for k, n in combination.items()) <= 1024
        for k, n in combination.items():
            used[k] = used.get(k, 0) + times * n
    assert used == counts


def test_library_with_its_default_options(spark):
    """Special tokens within a text, and runs of white space that are too long for some regex engines."""
    lib = Tokenizer.from_file(PATH)
    special = [t.content for t in lib.get_added_tokens_decoder().values()]
    assert special
    texts = ["a " + special[0] + " b" + special[0] * 2, " " * 1_000_000, "\n" * 1_000_000, "x" + " " * 300_000 + "y"]
    own = ByteBpe(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    want = {}
    for i, text in enumerate(texts):
        a = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == a
        want[i] = zlib.crc32(np.array([*a, 2], "<u4").tobytes())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(pack(rows, PATH, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = zlib.crc32(r.ids, got.get(r.doc_id, 0))
    assert got == want
