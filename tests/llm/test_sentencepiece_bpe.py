import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm.sentencepiece_bpe import Model, decode_ids, encode_texts, op8_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = Model(open(PATH, "rb").read())
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="the inga\n.,!?|*_'\"()0129éß▁中ⁿ́\t<>sx/", max_size=60))


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_equals_library(text):
    ids = LIB.encode(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids + [2]) == LIB.decode(ids + [2])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=20))
def test_decode_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids)


def test_long_words():
    for word in ("a" * 700, "hello" * 200, "=-" * 300, "internationalisation" * 20, " " * 99 + "x", "0" * 500):
        assert OWN.encode(word) == LIB.encode(word)


def test_very_long_words():
    """A word of 300,000 characters, and one that makes the search step back often."""
    for word in ("ab" * 150_000, "intern" * 50_000):
        assert OWN.encode(word) == LIB.encode(word)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op8_sentencepiece(spark, sf).collect():
        ids = LIB.encode(rows[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids)))


def test_edges(spark):
    texts = [None, "", " ", "  two  ", "▁", "a\x00b", "x" * 20000, "dup", "dup"]
    df = spark.createDataFrame([(i if i else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = encode_texts(df, PATH)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = LIB.encode(t or "", add_eos=True)
        r = got[i if i else None]
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == LIB.decode(ids)
    assert {r.doc_id: r.text for r in decode_ids(out, PATH).collect()} == {i: r.decoded for i, r in got.items()}
    assert encode_texts(df.limit(0), PATH).count() == 0
    with pytest.raises(OSError):
        encode_texts(df, "/no/such/file")
