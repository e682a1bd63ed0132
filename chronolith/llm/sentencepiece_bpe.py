"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A sequence of pieces is what merging yields exactly if every two neighbours are *compatible*: merging their joined text
gives the two back. So a text is encoded from the left: an Aho-Corasick automaton lists the pieces that match at each
place; the longest is taken if it is compatible with the piece before, else the next shorter; where none is left, the
place is struck from a bitfield and the search steps back one piece. Compatibility is found by merging the two pieces'
text and remembered per pair. Characters in no piece become byte pieces.

Before that, texts are cut where no piece of the vocabulary has such two characters side by side (before a space mark,
and between letters and signs, as far as the vocabulary shows it to be safe), so equal words are encoded once per task.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import columns_guarded

SPACE = "▁"
REMEMBERED, LONG = 400_000, 60  # words (some 250 bytes each; longer ones not), and pairs of pieces, that a worker process remembers


class Model:
    """A BPE model file of the sentencepiece library: identity normalisation, space mark first, byte fallback."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(raw)
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix or not m.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with identity normalisation, a leading space mark and byte fallback")
        kind = pb.ModelProto.SentencePiece
        self.piece = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == kind.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, p in enumerate(m.pieces) if p.type == kind.CONTROL}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN), None)
        self.end = next(i for i, p in enumerate(m.pieces) if p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merged(p) == [p]:  # others never result from merging
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.automaton), None) for p in self.ids}
        self.said = {p: str(i) for p, i in self.ids.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cutter = self._cutter()

    def _cutter(self):
        extra: set[str] = set()
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if a != SPACE}
        letter = lambda c: c in extra or c.isalnum()
        while more := {(b if letter(a) else a) for a, b in pairs if letter(a) != letter(b) and b != SPACE}:
            extra |= more
        self.cut_at_space = all(b != SPACE for _, b in pairs)
        also = "".join(map(re.escape, sorted(extra)))
        one = f"(?:[^\\W_]|[{also}])" if also else "[^\\W_]"
        other = f"(?:(?!{one})[^{SPACE}])"
        return re.compile(f"{SPACE}*{one}+|{SPACE}*{other}+|{SPACE}+", re.S) if self.cut_at_space else None

    def merged(self, text: str) -> list[str]:
        """What merging yields: the best adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def longest(self, text: str, at: int) -> str:
        for end, size in self.automaton.iter_long(text, at):
            return text[at : at + size] if end - size + 1 == at else text[at]
        return text[at]

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text`` (space marks in place); characters outside the vocabulary stand alone."""
        n, at, out = len(text), 0, []
        if not n:
            return out
        struck = bytearray(n // 8 + 1)  # a bit for each place; setting one doesn't copy the rest
        fits, shorter, longest = self.fits, self.shorter, self.longest
        token = longest(text, 0)
        while True:
            end = at + len(token)
            if not struck[end >> 3] >> (end & 7) & 1:
                fit = True
                if out:
                    fit = fits.get((out[-1], token))
                    if fit is None:
                        fit = self.compatible(out[-1], token)
                if fit:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest(text, at)
                    continue
            token = shorter.get(token)
            while token is None:  # no match fits here: strike the place, step back, and try what is shorter there
                struck[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                token = shorter.get(last)

    def word_ids(self, word: str) -> list[int]:
        pieces = self.pieces(word)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")])]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.cutter.findall(text) if self.cutter else [text]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.word_ids(w)]

    def decode(self, ids) -> str:
        """The text of ids: control ids are silent, runs of byte pieces are UTF-8 (bad bytes become U+FFFD)."""
        out, held, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is None or i in self.silent:
                continue
            text = " ⁇ " if i == self.unknown else self.piece[i].replace(SPACE, " ")
            out.append(text[1:] if first and text.startswith(" ") and i != self.unknown else text)
            first = False
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Words(dict):
    """word -> (ids as decimal text with leading spaces, its text decoded)."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        said, pieces = self.model.said, self.model.pieces(word)
        try:
            got = " ".join([said[p] for p in pieces]), "".join(pieces).replace(SPACE, " ")
        except KeyError:  # byte pieces; a word never splits a character, so they decode by themselves
            ids = self.model.word_ids(word)
            got = " ".join(map(str, ids)), (" " if word.startswith(SPACE) else "") + self.model.decode(ids)
        if len(word) <= LONG:
            self[word] = got
        return got


_loaded: dict[bytes, _Words] = {}


def _words_of(raw: bytes) -> _Words:
    """The words that this worker process has met, by model; kept from task to task."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _Words(Model(raw))
    return _loaded[key]


def encode_texts(docs: DataFrame, model_file: str, outputs=("n_tokens", "ids", "decoded")) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and the ``outputs``.

    n_tokens, ids (array<int>) and ids_sha256 (of decimal ids joined by one space) count the end id; decoded and
    decoded_sha256 are of decode(ids). A null text is empty: the end id alone. Rows stay as they are, repeated or not;
    an empty table gives an empty one, and other columns are ignored. The model file is read by the driver and sent out.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
    raw = docs.sparkSession.sparkContext.broadcast(open(model_file, "rb").read())  # half a megabyte

    def run(batches):
        words = _words_of(raw.value)
        model = words.model
        end = str(model.end)
        for batch in batches:
            got = {k: [] for k in outputs}
            for text in batch.column(1).to_pylist():
                found = [words[w] for w in model.words(text or "")]
                said = " ".join([*[f[0] for f in found], end])
                if "n_tokens" in got:
                    got["n_tokens"].append(said.count(" ") + 1)
                if "ids" in got:
                    got["ids"].append(np.array(said.split(), np.int32))
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                if "decoded" in got or "decoded_sha256" in got:
                    decoded = "".join([f[1] for f in found])[1:]
                    if "decoded" in got:
                        got["decoded"].append(decoded)
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[k], arrow.get(k, pa.string())) for k in outputs]], ["doc_id", *outputs])

    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"})
    return docs.mapInArrow(run, ", ".join(["doc_id long", *[f"{k} {kinds[k]}" for k in outputs]]))


def decode_ids(rows: DataFrame, model_file: str) -> DataFrame:
    """Per row of ``rows`` (doc_id, ids): doc_id and its text, by decode(ids). Null ids give a null text."""
    raw = rows.sparkSession.sparkContext.broadcast(open(model_file, "rb").read())

    def run(parts):
        model = Model(raw.value)
        for pdf in parts:
            yield pdf.assign(text=[None if i is None else model.decode([int(x) for x in i]) for i in pdf.ids])[["doc_id", "text"]]

    return columns_guarded(rows, {"doc_id": "long", "ids": "array<int>"}).mapInPandas(run, "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
