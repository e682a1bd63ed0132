"""Removal of repeated byte strings by blockwise sorting of cover-sample suffixes.

A string of ``width`` bytes is a repeat if it also starts earlier. The steps:

1. *Filter.* Positions whose remainder modulo 57 lies in a perfect difference cover are sampled. For any two positions
   there is an offset below 57 at which both are sampled, so two equal strings of 100 bytes hold an equal 44-byte sample
   at an offset that they share. A second, sparser sample is taken where the next 16 bytes say so; equal strings have all
   of it in common. Hashes of sample strings, dealt by bucket, tell which occur again; these verdicts go into a table of
   bits. In the same pass the text is cut where its content says so, and a cut piece (with the bytes that its last window
   needs) that equals an earlier one, by a 64-bit and a 62-bit hash of different kinds, is settled whole: copied documents
   end here.
2. *Buckets.* A window can be a repeat only if a cover sample and all of the second sample within it occur again. The
   cover samples of such windows are dealt out with the 56 bytes before and after them. One bucket at a time, samples are
   sorted by their bytes, which ranks them; occurrences of one rank are sorted by the bytes before, read backwards, and by
   the bytes after. Two windows that hold samples of one rank at offset k are equal if k bytes before and 56 - k bytes
   after agree: for each k, all but the first of such a group are repeats. So every tie is settled by bytes, and none is
   longer than a rank and 56 bytes. Within a map task the same is done before the shuffle, and an occurrence that comes
   first at no offset stays there.
3. The repeats of each document are merged to runs and cut out.

Memory: a task holds one bucket, or 2 to 5 MB of text at a time; a longer text is taken in overlapping pieces. The table of
verdicts has a bit for two bytes of text, and 2**MOST_BITS at most, so that it can be broadcast (128 MB); if it fills up,
more samples are sorted and results stay the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import (
    BROADCAST_BYTES,
    PrimeRolling,
    Rolling,
    bucket_bits,
    cat,
    chunks_of,
    grouped,
    mapped,
    mix,
    numbered,
    planes,
    text_buffers,
    unplanes,
    written,
)

COVER_MOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # every difference modulo 57 occurs
SPARSE = 32  # bytes of a string of the second sample
MOST_BITS = 30
CHUNK, FLUSH, SORT_FLUSH, PIECE = 1 << 19, 5 << 20, 2 << 20, 4 << 20
REACH = COVER_MOD - 1
_COVERED = np.zeros(COVER_MOD, bool)
_COVERED[list(COVER)] = True
U64 = np.uint64

MARKS = "dbucket int, docs binary, counts binary, lo binary, hi binary"
FOUND = "bucket int, samples binary, again binary, skey binary, skey2 binary, sdoc binary, slo binary, slen binary"
SORTED = "bucket int, kind int, around binary, before binary, after binary, docs binary, counts binary, lo binary, hi binary"


class _Chunk:
    """Some whole texts, or one piece of a long one, with the positions that the steps need."""

    def __init__(self, data, offsets, docs, base, width):
        self.data, self.docs, self.offsets, self.width, self.sample = data, docs, offsets, width, width - COVER_MOD + 1
        self.lens = np.diff(offsets)
        self.roll = Rolling(data)
        n = len(data)
        self.at = np.arange(n) - np.repeat(offsets[:-1], self.lens) + base  # position within the document
        left = np.repeat(offsets[1:], self.lens) - np.arange(n)
        self.ok = left >= width  # a window starts here
        long = np.repeat(self.lens >= width, self.lens)
        self.cover = np.flatnonzero(_COVERED[self.at % COVER_MOD] & (left >= self.sample) & long)
        self.cover_keys = self.roll.span(self.cover, self.cover + self.sample)
        self.next16 = np.full(n, ~U64(0))
        if n >= 16:
            c, q = self.roll.c, self.roll.q
            self.next16[: n - 15] = (c[16:] - c[:-16]) * q[: n - 15]
        self.sparse = np.flatnonzero(((self.next16 >> U64(54)) & U64(15) == 0) & (left >= SPARSE) & long)
        self.sparse_keys = self.roll.span(self.sparse, self.sparse + SPARSE)

    def row_of(self, positions):
        return np.searchsorted(self.offsets, positions, "right") - 1

    def around(self, positions):
        """(matrix of samples with REACH bytes on either side, how many of these lie in the text before and after)."""
        row = self.row_of(positions)
        before = np.minimum(REACH, positions - self.offsets[row])
        after = np.minimum(REACH, self.offsets[row + 1] - positions - self.sample)
        wide = np.zeros(len(self.data) + 2 * REACH + self.sample, np.uint8)
        wide[REACH : REACH + len(self.data)] = self.data
        shown = np.lib.stride_tricks.sliding_window_view(wide, 2 * REACH + self.sample)[positions]
        return shown, before.astype(np.uint8), after.astype(np.uint8)

    def segments(self):
        """(start, end) of runs of window starts between cuts that depend on the next 16 bytes alone."""
        n = len(self.ok)
        cut = self.next16 >> U64(58) == 0
        cut[self.offsets[:-1][self.lens > 0]] = True
        start = np.flatnonzero(cut & self.ok)
        if not len(start):
            return start, start
        last = self.offsets[1:][self.row_of(start)] - self.width + 1
        end = np.minimum(np.append(start[1:], n), last)
        return start, end


def _chunks(batches, width, sort=False):
    """The texts of Arrow batches (number, text, ...) as chunks; between them, True where a flush is due."""
    held = 0
    for batch in batches:
        docs = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        if sort:
            order = np.argsort(docs, kind="stable")
            batch, docs = batch.take(pa.array(order)), docs[order]
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in chunks_of(offsets, CHUNK):
            size = int(offsets[hi] - offsets[lo])
            held += size
            if size <= PIECE:
                yield _Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], docs[lo:hi], 0, width), batch, lo
            else:
                for base in range(0, size, PIECE):
                    piece = data[offsets[lo] + base : min(offsets[lo] + base + PIECE + width - 1, offsets[hi])]
                    yield _Chunk(piece, np.array([0, len(piece)]), docs[lo:hi], base, width), batch, lo
            if held >= (SORT_FLUSH if sort else FLUSH):
                held = 0
                yield None, None, None
        if sort:  # ties are resolved among documents in order, so not across batches
            held = 0
            yield None, None, None
    yield None, None, None


def _split(keys, bits):
    """Order of ``keys`` and the bounds of each bucket of top ``bits``."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, ordered, np.searchsorted(ordered, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits))


def _pack_marks(docs, lo, hi, bits):
    """Marks sorted by (doc, lo) as one row for each bucket of documents."""
    bucket = (mix(docs.view(U64)) >> U64(64 - bits)).astype(np.int64)
    order = np.lexsort((lo, docs, bucket))
    bucket, docs, lo, hi = bucket[order], docs[order], lo[order], hi[order]
    for b, e in zip(*_runs(bucket)):
        d = docs[b:e]
        s, t = _runs(d)
        yield int(bucket[b]), planes(d[s]), planes((t - s).astype(np.uint32)), planes(lo[b:e].astype(np.uint32)), planes(hi[b:e].astype(np.uint32))


def _runs(a, b=None):
    """Starts and ends of runs of equal values (of pairs, if ``b`` is given)."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = a[1:] != a[:-1]
    if b is not None:
        change |= b[1:] != b[:-1]
    s = np.flatnonzero(np.r_[True, change])
    return s, np.r_[s[1:], len(a)]


def _batch(rows, names, kinds):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


def _cover_pass(bits, width):
    def run(batches):
        got = {k: [] for k in ("h", "k", "k2", "d", "s", "n")}
        for chunk, _, _ in _chunks(batches, width):
            if chunk is not None:
                got["h"] += [chunk.cover_keys, chunk.sparse_keys]
                start, end = chunk.segments()
                if len(start):
                    got["k"].append(chunk.roll.span(start, end + width - 1))
                    got["k2"].append(PrimeRolling(chunk.data).span(start, end + width - 1))
                    got["d"].append(chunk.docs[chunk.row_of(start)])
                    got["s"].append(chunk.at[start])
                    got["n"].append(end - start)
                continue
            h, k = cat(got["h"], U64), cat(got["k"], U64)
            if not len(h) and not len(k):
                continue
            low = (h << U64(bits)) >> U64(32)  # the 32 bits below the bucket's
            order, hs, hb = _split(h, bits)
            low = low[order]
            korder, ks, kb = _split(k, bits)
            ks2 = cat(got["k2"], U64)[korder]
            d, s, n = (cat(got[x], np.int64)[korder] for x in "dsn")
            rows = []
            for b, (lo, hi, klo, khi) in enumerate(zip(np.r_[0, hb], np.r_[hb, len(h)], np.r_[0, kb], np.r_[kb, len(k)])):
                if lo == hi and klo == khi:
                    continue
                part = low[lo:hi].astype(np.uint32)
                at, to = _runs(part)
                one, many = part[at[to - at == 1]], part[at[to - at > 1]]
                rows.append((b, planes(np.diff(one, prepend=np.uint32(0))), planes(many), planes(ks[klo:khi]), planes(ks2[klo:khi]), planes(d[klo:khi]), planes(s[klo:khi].astype(np.uint32)), planes(n[klo:khi].astype(np.uint32))))
            yield _batch(rows, ["bucket", "samples", "again", "skey", "skey2", "sdoc", "slo", "slen"], [_I, *[_B] * 7])
            got = {x: [] for x in got}

    return run


def _cover_bucket(bits, dbits, filter_bits):
    """One bucket of sample and piece keys: bits of sample strings that occur again, marks of pieces that occurred earlier."""

    @grouped
    def run(key, batches):
        one, many, k, k2, d, s, n = [], [], [], [], [], [], []
        for t in batches:
            for r in t.to_pylist():
                one.append(np.cumsum(unplanes(r["samples"], np.uint32), dtype=np.uint32))
                many.append(unplanes(r["again"], np.uint32))
                for to, name, kind in ((k, "skey", U64), (k2, "skey2", U64), (d, "sdoc", np.int64), (s, "slo", np.uint32), (n, "slen", np.uint32)):
                    to.append(unplanes(r[name], kind))
        ones = np.sort(cat(one, np.uint32))
        again = np.r_[ones[1:][ones[1:] == ones[:-1]], cat(many, np.uint32)]
        shift = np.uint32(32 - (filter_bits - bits))
        slots = np.zeros(1 << (filter_bits - bits), np.uint8)
        slots[again >> shift] = 1
        bucket = int(key[0].as_py())
        yield _batch([(bucket, zlib.compress(np.packbits(slots).tobytes(), 1), None, None, None)], ["dbucket", "docs", "counts", "lo", "hi"], [_I, *[_B] * 4])
        k, k2, d, s, n = cat(k, U64), cat(k2, U64), cat(d, np.int64), cat(s, np.uint32).astype(np.int64), cat(n, np.uint32)
        order = np.lexsort((s, d, k2, k))
        k, k2, d, s, n = k[order], k2[order], d[order], s[order], n[order]
        a, b = _runs(k, k2)
        first = np.repeat(a, b - a)
        later = (d != d[first]) | (s != s[first])
        if later.any():
            d, s, n = d[later], s[later], n[later]
            yield _batch(list(_pack_marks(d, s, s + n, dbits)), ["dbucket", "docs", "counts", "lo", "hi"], [_I, *[_B] * 4])

    return run


@grouped
def _merge_marks(key, batches):
    """Of one bucket of documents: their marks as disjoint runs of window starts."""
    d, lo, hi = [], [], []
    for t in batches:
        for r in t.to_pylist():
            d.append(np.repeat(unplanes(r["docs"], np.int64), unplanes(r["counts"], np.uint32)))
            lo.append(unplanes(r["lo"], np.uint32))
            hi.append(unplanes(r["hi"], np.uint32))
    d, lo, hi = cat(d, np.int64), cat(lo, np.uint32).astype(np.int64), cat(hi, np.uint32).astype(np.int64)
    order = np.lexsort((lo, d))
    d, lo, hi = d[order], lo[order], hi[order]
    rows = []
    for b, e in zip(*_runs(d)):
        far = np.maximum.accumulate(hi[b:e])
        new = np.r_[True, lo[b + 1 : e] > far[:-1]]
        rows.append((int(d[b]), planes(lo[b:e][new].astype(np.uint32)), planes(far[np.r_[new[1:], True]].astype(np.uint32))))
    yield _batch(rows, ["doc_id", "lo", "hi"], [_L, _B, _B])


def _nested(rank, strings):
    """A function of a depth: numbers that are equal for equal ``rank`` and equal first bytes of ``strings`` to that depth."""
    whole = np.empty((len(rank), 4 + strings.shape[1]), np.uint8)
    whole[:, :4] = rank.astype(">u4").view(np.uint8).reshape(-1, 4)
    whole[:, 4:] = strings
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    differ = whole[order[1:]] != whole[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), whole.shape[1]) - 4  # negative between ranks

    def numbers(depth):
        out = np.empty(len(rank), np.int64)
        out[order] = np.cumsum(np.r_[0, shared < depth])
        return out

    return numbers


def settle(shown, before, after, doc, pos, sample):
    """(runs of repeated windows as doc, lo, hi; which occurrences come first at some offset).

    ``shown`` holds samples with REACH bytes on either side, of which ``before`` and ``after`` are text.
    """
    text = np.ascontiguousarray(shown[:, REACH : REACH + sample]).view(f"S{sample}").ravel()
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[True, text[order[1:]] != text[order[:-1]]])[: len(order)]
    leads = np.bincount(rank, minlength=1)[rank] == 1
    some = np.flatnonzero(~leads)
    some = some[np.lexsort((pos[some], doc[some]))]  # so that of equals the first comes first
    if not len(some):
        return (doc[:0], pos[:0], pos[:0]), leads
    rank, d, p, before, after = rank[some], doc[some], pos[some], before[some].astype(np.int64), after[some].astype(np.int64)
    left, right = _nested(rank, shown[some, REACH - 1 :: -1]), _nested(rank, shown[some, REACH + sample :])
    repeat = np.zeros((len(some), REACH + 3), np.int8)
    for k in range(REACH + 1):
        here = np.flatnonzero((before >= k) & (after >= REACH - k))
        if len(here):
            _, at, group = np.unique(left(k)[here] * len(some) + right(REACH - k)[here], return_index=True, return_inverse=True)
            first = here[at][group]
            later = (d[here] != d[first]) | (p[here] != p[first])
            repeat[here, k + 1] = later
            leads[some[here[~later]]] = True
    step = np.diff(repeat, axis=1)
    who, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return (d[who], p[who] - high + 1, p[who] - low + 1), leads


def _sort_pass(bits, dbits, width, verdicts):
    names = ["bucket", "kind", "around", "before", "after", "docs", "counts", "lo", "hi"]

    def run(batches):
        table = np.frombuffer(verdicts.value, np.uint8)
        filter_bits = int(len(table) * 8).bit_length() - 1
        got = [[] for _ in range(6)]
        for chunk, batch, row in _chunks(batches, width, sort=True):
            if chunk is not None:
                n = len(chunk.ok)
                again = _again(table, filter_bits, chunk.cover_keys)
                till = _till(chunk.cover[again], n + width)
                may = chunk.ok & (till[COVER_MOD : COVER_MOD + n] > till[:n])
                till = _till(chunk.sparse[~_again(table, filter_bits, chunk.sparse_keys)], n + width)
                reach = width - SPARSE + 1
                may &= till[reach : reach + n] == till[:n]
                del till
                _unset(may, chunk, batch, row)
                # samples that occur again and lie in such a window at an offset of at most REACH
                till = _till(np.flatnonzero(may), n + 1)
                again &= till[chunk.cover + 1] > till[np.maximum(chunk.cover - REACH, 0)]
                here = chunk.cover[again]
                for to, part in zip(got, (chunk.cover_keys[again], *chunk.around(here), chunk.docs[chunk.row_of(here)], chunk.at[here])):
                    to.append(part)
                continue
            if not sum(map(len, got[0])):
                got = [[] for _ in range(6)]
                continue
            key, shown, before, after, d, p = (np.concatenate(g) for g in got)
            got = [[] for _ in range(6)]
            repeats, leads = settle(shown, before, after, d, p, width - COVER_MOD + 1)
            rows = [(m[0], 1, None, None, None, *m[1:]) for m in _pack_marks(*repeats, dbits)] if len(repeats[0]) else []
            leads = np.flatnonzero(leads)
            order, _, edges = _split(key[leads], bits)
            order = leads[order]
            for n, (lo, hi) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(order)])):
                if hi > lo:
                    own = order[lo:hi]
                    own = own[np.lexsort((p[own], d[own]))]
                    s, t = _runs(d[own])
                    rows.append((n, 0, shown[own].tobytes(), before[own].tobytes(), after[own].tobytes(), planes(d[own][s]), planes((t - s).astype(np.uint32)), planes(p[own].astype(np.uint32)), None))
            yield _batch(rows, names, [_I, _I, *[_B] * 7])

    return run


def _again(table, filter_bits, keys):
    slot = keys >> U64(64 - filter_bits)
    return (table[(slot >> U64(3)).astype(np.int64)] >> (U64(7) - (slot & U64(7))).astype(np.uint8)) & np.uint8(1) > 0


def _till(positions, n):
    """How many of ``positions`` lie before each place."""
    out = np.zeros(n + 1, np.int32)
    out[positions + 1] = 1
    return np.cumsum(out, dtype=np.int32)


def _unset(may, chunk, batch, row):
    """Window starts that step 1 has settled need no sorting."""
    lo_col, hi_col = batch.column(2), batch.column(3)
    base = int(chunk.at[0]) if len(chunk.at) else 0
    for r in range(len(chunk.docs)):
        if lo_col[row + r].is_valid:
            o, n = int(chunk.offsets[r]), int(chunk.lens[r])
            for lo, hi in zip(unplanes(lo_col[row + r].as_py(), np.uint32).tolist(), unplanes(hi_col[row + r].as_py(), np.uint32).tolist()):
                shift = base if len(chunk.docs) == 1 else 0
                lo, hi = max(0, lo - shift), min(n, hi - shift)
                if hi > lo:
                    may[o + lo : o + hi] = False


def _sort_bucket(dbits, width):
    """One bucket of cover samples, sorted: marks of the windows that repeat earlier ones."""
    sample = width - COVER_MOD + 1

    @grouped
    def run(key, batches):
        shown, before, after, d, p, rows = [], [], [], [], [], []
        for t in batches:
            for r in t.to_pylist():
                if r["kind"]:
                    rows.append((r["bucket"], r["docs"], r["counts"], r["lo"], r["hi"]))
                else:
                    shown.append(np.frombuffer(r["around"], np.uint8))
                    before.append(np.frombuffer(r["before"], np.uint8))
                    after.append(np.frombuffer(r["after"], np.uint8))
                    d.append(np.repeat(unplanes(r["docs"], np.int64), unplanes(r["counts"], np.uint32)))
                    p.append(unplanes(r["lo"], np.uint32))
        if shown:
            shown = cat(shown, np.uint8).reshape(-1, 2 * REACH + sample)
            repeats, _ = settle(shown, cat(before, np.uint8), cat(after, np.uint8), cat(d, np.int64), cat(p, np.uint32).astype(np.int64), sample)
            rows += list(_pack_marks(*repeats, dbits)) if len(repeats[0]) else []
        yield _batch(rows, ["dbucket", "docs", "counts", "lo", "hi"], [_I, *[_B] * 4])

    return run


def _with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks beside the texts: broadcast if they are measured to be small, else a join on the rows' numbers."""
    total = marks.agg(F.coalesce(F.sum(F.octet_length("lo") * 2 + 64), F.lit(0))).first()[0]
    known = marks.select(F.col("doc_id").alias("marked"), "lo", "hi")
    known = F.broadcast(known) if total <= BROADCAST_BYTES else known
    joined = docs.join(known, docs.number == F.col("marked"), "left")
    return joined.select(docs.columns[0], "text", "lo", "hi", *[c for c in docs.columns[1:] if c not in ("text", "number")])


def _cut(width):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n_bytes, n_removed, starts, ends, kept, shown = [], [], [], [], [], []
            for r in range(batch.num_rows):
                a, b = int(offsets[r]), int(offsets[r + 1])
                text, lo = data[a:b], batch.column(2)[r]
                if lo.is_valid:
                    lo = unplanes(lo.as_py(), np.uint32).astype(np.int64)
                    hi = np.minimum(unplanes(batch.column(3)[r].as_py(), np.uint32).astype(np.int64) + width - 1, b - a)
                    lo, hi = lo[lo < hi], hi[lo < hi]
                    far = np.maximum.accumulate(hi) if len(hi) else hi
                    new = np.r_[True, lo[1:] > far[:-1]] if len(lo) else np.empty(0, bool)
                    lo, hi = lo[new], far[np.r_[new[1:], True]] if len(lo) else far
                    cuts = np.c_[np.r_[0, hi], np.r_[lo, b - a]]
                    kept.append(b"".join(text[x:y].tobytes() for x, y in cuts))
                else:
                    lo = hi = np.empty(0, np.int64)
                    kept.append(text.tobytes())
                shown.append(kept[-1].decode("utf-8", "ignore"))
                n_bytes.append(b - a)
                n_removed.append(int((hi - lo).sum()))
                starts.append(lo)
                ends.append(hi)
            listed = pa.list_(_L)
            carried = list(zip(batch.schema.names, batch.columns))[4:]
            columns = [batch.column(0), pa.array(n_bytes, _L), pa.array(n_removed, _L), pa.array(starts, listed), pa.array(ends, listed), pa.array(kept, _B), pa.array(shown, pa.string()), *[c for _, c in carried]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept", "kept_text", *[n for n, _ in carried]])

    return run


def suffix_dedup(docs: DataFrame, width: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, starts and ends of the removed runs (bytes), kept (binary),
    and kept_text, without the bytes of characters that a cut has split.

    A byte goes if a ``width``-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. A null text is empty; a null doc_id comes before all others. Different texts that share a doc_id, and
    all rows without one, are documents of their own, in the order of their texts' digests. Rows equal in text and in a
    doc_id that isn't null are one document: they lose the same bytes and don't repeat each other. An empty table gives an empty one. ``width`` is at least 73. Columns named in
    ``carry`` go along as carried_<name>; others are ignored.
    """
    spark = docs.sparkSession
    carried = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    if width < COVER_MOD + 16:
        raise ValueError("width must leave at least 17 bytes for a cover sample")
    whole = numbered(whole)
    docs = whole.select("number", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    filter_bits = min(MOST_BITS, max(22, (total // 2).bit_length()))
    bits, dbits = min(bucket_bits(spark, 2), filter_bits - 6), bucket_bits(spark, 1)
    found = docs.mapInArrow(mapped(_cover_pass(bits, width)), FOUND)
    step1 = written(found.groupBy("bucket").applyInArrow(_cover_bucket(bits, dbits, filter_bits), MARKS), "suffix-cover")
    slices = step1.where("counts is null").select("dbucket", "docs").toPandas()  # 2**MOST_BITS bits at most in all, compressed
    size = (1 << (filter_bits - bits)) >> 3
    table = np.zeros((1 << filter_bits) >> 3, np.uint8)
    for b, bits_of in zip(slices.dbucket, slices.docs):
        table[b * size : (b + 1) * size] = np.frombuffer(zlib.decompress(bytes(bits_of)), np.uint8)
    verdicts = spark.sparkContext.broadcast(table.tobytes())
    del table, slices
    marked = step1.where("counts is not null")
    merged = "doc_id long, lo binary, hi binary"
    early = written(marked.groupBy("dbucket").applyInArrow(_merge_marks, merged), "suffix-early")
    ordered = _with_marks(docs, early).mapInArrow(mapped(_sort_pass(bits, dbits, width, verdicts)), SORTED)
    step2 = ordered.groupBy("bucket").applyInArrow(_sort_bucket(dbits, width), MARKS)
    marks = written(marked.unionByName(step2).groupBy("dbucket").applyInArrow(_merge_marks, merged), "suffix-marks")
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[2:-1])
    return _with_marks(whole, marks).mapInArrow(mapped(_cut(width)), "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary, kept_text string" + more)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
