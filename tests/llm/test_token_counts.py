import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm.token_counts import allocate, op3_token_counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True


def lines(text):
    out, at = [], 0
    for part in text.split("\n"):
        end = min(len(text), at + len(part) + 1)
        if end > at:
            out.append((at, end))
        at = end
    return out


def test_lines_against_library_offsets(spark):
    """The library's offsets are characters: a token's first character decides, as its first byte does."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        e = LIB.encode(r.text, add_special_tokens=False)
        secs = lines(r.text)
        counts = [0] * len(secs)
        starts = np.array([s for s, _ in secs])
        for a, _ in e.offsets:
            counts[int(np.searchsorted(starts, a, "right")) - 1] += 1
        want[r.doc_id, -1] = (0, len(r.text), len(e.ids))
        for i, ((a, b), n) in enumerate(zip(secs, counts)):
            want[r.doc_id, i] = (a, b, n)
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in op3_token_counts(spark, sf).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 6)), max_size=6), st.sampled_from(("first", "last", "most")))
def test_allocate(sizes, gaps, rule):
    ends = np.cumsum(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
    lo, hi, at = [], [], 0
    for gap, size in gaps:
        lo.append(at + gap)
        hi.append(at + gap + size)
        at = hi[-1]
    counted, _ = allocate(ends, np.array(lo, np.int64), np.array(hi, np.int64), rule)
    want = [0] * len(lo)
    for end, size in zip(ends.tolist(), sizes):
        shares = [max(0, min(end, h) - max(end - size, l)) for l, h in zip(lo, hi)]
        byte = end - size if rule == "first" else end - 1
        if rule == "most":
            if shares and max(shares):
                want[shares.index(max(shares))] += 1
        else:
            for k, (l, h) in enumerate(zip(lo, hi)):
                want[k] += l <= byte < h
    assert counted.tolist() == want


def test_edges(spark):
    rows = [(1, "héllo wörld again", [(0, 3), (3, 8), None, (12, 99)]), (2, None, None), (3, "", [(0, 1)]), (None, "a\n\nb", [(5, 9)]), (1, "héllo wörld again", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = token_counts(df, PATH, "most", "spans").collect()
    assert sum(r.section == -1 for r in got) == 5 and sum(r.section >= 0 for r in got) == 3
    assert [r.n_tokens for r in got if r.section == -1 and r.doc_id in (2, 3)] == [0, 0]
    assert sorted((r.start, r.end) for r in token_counts(df, PATH).where("doc_id is null and section >= 0").collect()) == [(0, 2), (2, 3), (3, 4)]
    assert token_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, PATH, "all")


def test_special_tokens_and_long_white_space(spark):
    """The library with its default options; a token belongs to the line of its first character."""
    lib = Tokenizer.from_file(PATH)
    special = next(iter(lib.get_added_tokens_decoder().values())).content
    texts = [f"é {special}\n{special} and\nmore", " " * 1_000_000 + "\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for doc, text in enumerate(texts):
        e = lib.encode(text, add_special_tokens=False)
        want[doc, -1] = len(e.ids)
        for i, (lo, hi) in enumerate(lines(text)):
            want[doc, i] = sum(lo <= a < hi for a, _ in e.offsets)
    assert {(r.doc_id, r.section): r.n_tokens for r in token_counts(df, PATH).collect()} == want


def test_sections_that_overlap(spark):
    """The part that two sections share belongs to the one that starts first; a section within another is left out."""
    df = spark.createDataFrame([(4, "abcdefghij", [(3, 9), (0, 6), (2, 4)])], "doc_id long, text string, spans array<struct<start:int,end:int>>")
    assert sorted((r.section, r.start, r.end) for r in token_counts(df, PATH, "most", "spans").collect()) == [(-1, 0, 10), (0, 0, 6), (1, 6, 9)]
