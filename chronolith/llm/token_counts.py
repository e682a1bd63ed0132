"""Token counts of fields or sections by offsets.

A document is encoded once, whole. Byte-level BPE loses nothing, so the tokens' byte lengths give their spans (those of
added tokens come from the library's offsets); spans and
sections are both sorted, and a token goes to its section by a sorted interval join. A token that crosses a boundary is
allocated by a rule: ``first`` (the section of its first byte), ``last`` (of its last byte) or ``most`` (the section
with most of its bytes, the earlier of equals).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.byte_bpe import from_path

RULES = ("first", "last", "most")


def allocate(token_ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross into or out of each), all bounds in bytes; sections sorted and disjoint.

    Tokens whose place by the rule lies in no section are counted nowhere.
    """
    n = len(section_starts)
    starts = np.r_[0, token_ends[:-1]] if len(token_ends) else token_ends
    at_first = np.searchsorted(section_starts, starts, "right") - 1
    at_last = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    inside = lambda at, place: np.where((at >= 0) & (place < np.where(at >= 0, section_ends[at] if n else 0, 0)), at, -1)
    first, last = inside(at_first, starts), inside(at_last, token_ends - 1)
    if rule == "first":
        home = first
    elif rule == "last":
        home = last
    else:
        home = first.copy()
        for i in np.flatnonzero(at_first != at_last).tolist():  # tokens over a boundary only
            lo, hi = starts[i], token_ends[i]
            some = range(max(0, at_first[i]), at_last[i] + 1)
            shares = [max(0, min(hi, section_ends[k]) - max(lo, section_starts[k])) for k in some]
            best = int(np.argmax(shares)) if shares else 0
            home[i] = some[best] if shares and shares[best] else -1
    crosses = (at_first != at_last) | (first != last)
    counted = np.bincount(home[home >= 0], minlength=n)
    crossing = np.bincount(first[crosses & (first >= 0)], minlength=n) + np.bincount(last[crosses & (last >= 0) & (last != first)], minlength=n)
    return counted, crossing


def _char_to_byte(raw: np.ndarray) -> np.ndarray:
    """Byte offset of each character and of the end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def token_counts(docs: DataFrame, tokenizer_file: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """Per section of a row of ``docs`` (doc_id, text[, sections]): doc_id, section, start, end, n_tokens, n_crossing.

    ``sections`` names an array<struct<start long, end long>> column of character spans, which are cut to the text; one
    that starts within an earlier one begins where that ends, and empty or null ones are left out. Without it sections are the lines, each with its newline. ``section``
    numbers them in the order of their starts, from 0. Each document also has the row section = -1 for the whole text,
    which is all that a null or empty text has. Rows stay apart when repeated; an empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokenizer = from_path(docs.sparkSession, tokenizer_file)
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def run(batches):
        bpe = tokenizer()
        for batch in batches:
            out = [[] for _ in names]
            spans = batch.column(2).to_pylist() if sections else None
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for r, (doc, text, ids) in enumerate(zip(batch.column(0).to_pylist(), texts, bpe.encode_all(texts))):
                raw = np.frombuffer(text.encode(), np.uint8)
                place = _char_to_byte(raw)
                ends = bpe.ends(text, place, ids)
                if spans is None:
                    cuts = np.flatnonzero(raw == 10) + 1
                    edges = np.unique(np.r_[0, cuts, len(raw)])
                    lo, hi = edges[:-1], edges[1:]
                    first, last = np.searchsorted(place, lo), np.searchsorted(place, hi)
                else:
                    n = len(place) - 1
                    fixed = sorted((max(0, s["start"]), min(n, s["end"])) for s in spans[r] or [] if s and s["start"] is not None and s["end"] is not None and s["end"] > s["start"] and s["start"] < n and s["end"] > 0)
                    first, last = (np.array([f[i] for f in fixed], np.int64) for i in (0, 1))
                    first = np.maximum(first, np.r_[0, np.maximum.accumulate(last)[:-1]]) if len(first) else first
                    first, last = first[first < last], last[first < last]
                    lo, hi = place[first], place[last]
                counted, crossing = allocate(ends, lo, hi, rule)
                for to, value in zip(out, ([doc] * (len(lo) + 1), range(-1, len(lo)), [0, *first.tolist()], [len(place) - 1, *last.tolist()], [len(ends), *counted.tolist()], [0, *crossing.tolist()])):
                    to.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<start:bigint,end:bigint>>").alias("sections"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
