"""Byte-level BPE ids of a tokenizer file, and the bytes of each id."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

#: How such files write the bytes that are no printable characters.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _bytes_of() -> dict[str, int]:
    table = {chr(b): b for b in _SHOWN}
    rest = [b for b in range(256) if b not in set(_SHOWN)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


#: Letters, digits and white space up to U+024F, on which every Unicode version agrees.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t\\n\\r \xa0"
#: How the byte-level splitter of such files cuts a text of these characters into words.
_WORDS = f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_SPACED = re.compile(f" [^{_S}]").match
_PLAIN = "[\\t\\n\\r\x20-\x7e\xa0-\u024f]*"
REMEMBERED, LONG = 250_000, 60  # words (some 200 bytes each; longer ones not) in each of two generations that a worker remembers
CHUNK = 1 << 21  # characters of texts that are encoded together, by a worker that remembers REMEMBERED words; in proportion by others


class _Ids:
    """Words and the bytes of their ids, by the library; of two generations the older one is forgotten.

    Words that begin with a space are encoded as one text: a space starts a new word, whatever comes before it. The ids of
    each are told by their ``lengths`` in bytes.
    """

    def __init__(self, tokenizer, remembered: int, lengths: np.ndarray):
        self.tokenizer, self.remembered, self.lengths, self.young, self.old = tokenizer, remembered, lengths, {}, {}

    def learn(self, words: set[str]) -> list[str]:
        """Makes sure that all of ``words`` are in ``young``; those that were encoded for it."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.remembered:
            self.old, self.young, new = self.young, {}, words
        fresh = []
        for w in new:
            got = self.old.get(w)
            if got is None:
                fresh.append(w)
            else:
                self.young[w] = got
        spaced = [w for w in fresh if _SPACED(w)]
        self._learn_together(spaced)
        rest = [w for w in fresh if not _SPACED(w)]
        for w, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.young[w] = array("I", found.ids).tobytes()
        return fresh

    def _learn_together(self, words: list[str]) -> None:
        if not words:
            return
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(w.encode()) for w in words])
        till = np.cumsum(self.lengths[ids])
        at = np.searchsorted(till, ends)
        if till[-1] != ends[-1] or (till[at] != ends).any():
            raise ValueError("a token that reaches over words")
        raw, lo = ids.tobytes(), 0
        for w, hi in zip(words, ((at + 1) * 4).tolist()):
            self.young[w] = raw[lo:hi]
            lo = hi

    def forget(self, fresh: list[str]) -> None:
        """Long words aren't remembered."""
        for w in fresh:
            if len(w) > LONG:
                self.young.pop(w, None)


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE file, with its default options: special tokens are found in texts.

    Words never share a token, so the library encodes each word once per worker process. Texts with special tokens, or
    with characters that Unicode versions may class differently, go to the library whole, and so do files whose splitter
    isn't the usual byte-level one. ``pattern`` isn't needed, as the file names its splitter.
    """

    def __init__(self, raw: bytes, pattern: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        model = json.loads(raw)
        table = _bytes_of()
        vocab = model["model"]["vocab"]
        added = {t["id"]: t["content"] for t in model.get("added_tokens", [])}
        self.lengths = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        self.added = np.zeros(len(self.lengths), bool)
        self.added[list(added)] = True
        for token, i in vocab.items():
            if i not in added:
                self.lengths[i] = len(bytes(table[c] for c in token))
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.known = _Ids(self.tokenizer, remembered, self.lengths)
        self.chunk = CHUNK * remembered // REMEMBERED
        split = model.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not model.get("normalizer")
        self.words = re.compile(_WORDS).findall if usual else None
        self.plain = re.compile(_PLAIN).fullmatch
        self.special = list(added.values())

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]):
        """The ids of each of some texts; they are taken ``chunk`` characters at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= self.chunk):
                size += len(texts[hi])
                hi += 1
            cut = [self.words(t) if self.words and self.plain(t) and not any(x in t for x in self.special) else None for t in texts[lo:hi]]
            met = set().union(*(c for c in cut if c))
            fresh = self.known.learn(met)
            said = self.known.young.__getitem__
            for text, words in zip(texts[lo:hi], cut):
                if words is None:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield np.frombuffer(b"".join(map(said, words)), "<u4")
            self.known.forget(fresh)
            lo = hi

    def ends(self, text: str, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where each of the ``ids`` of a text ends, in bytes; ``place`` has the byte offset of each character and of the end.

        The library's offsets are characters, and tokens may split one; so byte lengths are summed up. Added tokens
        may take white space around them, so theirs come from the offsets.
        """
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        special = np.flatnonzero(self.added[ids])
        if len(special):
            bounds = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64)[special]
            sizes[special] = place[bounds[:, 1]] - place[bounds[:, 0]]
        return np.cumsum(sizes)


@functools.lru_cache(2)
def _known(raw: bytes, remembered: int) -> ByteBpe:
    return ByteBpe(raw, remembered=remembered)


def from_path(spark, path: str, remembered: int = REMEMBERED):
    """A function that gives, on executors, the tokenizer of ``path`` (read by the driver, some megabytes).

    A worker remembers up to twice ``remembered`` words: more of them take memory and save encoding.
    """
    shared = spark.sparkContext.broadcast(open(path, "rb").read())
    return lambda: _known(shared.value, remembered)
