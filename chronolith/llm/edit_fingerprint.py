"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All documents share one random walk: at step j a text emits the character it stands on, and moves on or stays by a
random bit drawn for (j, character). After an edit two walks drift and meet again, so texts at a small edit distance
emit strings at a small Hamming distance. The walk crosses the whole text. A fingerprint holds DIGITS sampled places of
the emitted string, each as a hexadecimal digit (0 past the end of the text), at two scales: places spread over walks of
texts of up to 2**level characters, and of twice as many; so texts whose lengths differ by less than a factor of two
share a scale. The likeness of two fingerprints is the share of equal digits at the scale they share (places past both
ends left out), corrected for chance. Walks of all texts of a level run in step, as arrays.

Near fingerprints are found by banding: sampled digits of a band are a bucket key. Those that meet compare a sketch of other
digits, so that strangers part there, and pass on a forest of pairs (no row for each pair that is near). Likenesses verify
these pairs. Only what isn't joined by then to its component of candidates meets the rest of it, in blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import bucket_bits, cat, columns_guarded, grouped, mix, planes, shuffle_partitions, unplanes, written
from chronolith.llm.components import components, forest

DIGITS, LOWEST, SEED = 128, 5, 11
GROUP_CHARS = 6 << 20  # characters of texts whose walks run together
BLOCK, MISS = 2048, 0.01
SKETCH, MISS_SKETCH = 16, 0.001  # digits of a sketch; the share of near ones whose sketches may differ by too much
CHANCE = 0.15  # that a digit of two unrelated texts agrees: by its value, or as both stand on a common letter
#: Shares of a walk that every text of a level, and of the level below, still crosses: only those digits make bands.
CROSSED = (0.44, 0.22)
U64 = np.uint64
_plans: dict[int, tuple[np.ndarray, int]] = {}


def _places(level: int) -> tuple[np.ndarray, int]:
    """The sampled places of a scale in order, and the length of its walk."""
    if level not in _plans:
        steps = int(2.25 * (1 << level)) + 32
        _plans[level] = np.sort(np.random.default_rng([SEED, level]).choice(steps, min(DIGITS, steps), replace=False)), steps
    return _plans[level]


def level_of(n: int) -> int:
    return max(LOWEST, (n - 1).bit_length() if n > 1 else 0)


def _walks(texts: list[str], level: int) -> list[str]:
    """Fingerprints of texts of one level."""
    codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(lens + 1) - 1
    kinds = (mix(codes.astype(U64) + U64(1)) % U64(63)).astype(np.uint8)
    kinds[end] = 63  # never moves on
    at = end - lens
    wanted: dict[int, list[tuple[int, int]]] = {}
    for scale in (0, 1):
        for k, j in enumerate(_places(level + scale)[0].tolist()):
            wanted.setdefault(j, []).append((scale, k))
    out = np.zeros((2, DIGITS, len(texts)), np.uint8)
    last = max(wanted)
    for lo in range(0, last + 1, 4096):
        words = mix(np.arange(lo, min(lo + 4096, last + 1)).astype(U64) + U64(SEED << 40))
        moves = ((words[:, None] >> np.arange(64, dtype=U64)) & U64(1)).astype(np.int64)
        moves[:, 63] = 0
        for j in range(len(words)):
            if lo + j in wanted:
                sign = (mix(codes[at].astype(U64) + U64((lo + j) << 24)) % U64(15)).astype(np.uint8) + 1
                sign[at == end] = 0
                for scale, k in wanted[lo + j]:
                    out[scale, k] = sign
            at += moves[j].take(kinds.take(at))
        if (at == end).all():
            break
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[out].transpose(2, 0, 1).reshape(len(texts), -1)
    return [f"{level:02x}" + row.tobytes().decode() for row in digits]


def fingerprints(texts: list[str]) -> list[str]:
    """Of each text: two digits of its level, then DIGITS digits for each of the two scales."""
    first: dict[str, int] = {}
    for t in texts:
        first.setdefault(t, len(first))
    unique = list(first)
    order = sorted(range(len(unique)), key=lambda i: level_of(len(unique[i])))
    done: list[str] = [""] * len(unique)
    lo = 0
    while lo < len(order):
        level, size, hi = level_of(len(unique[order[lo]])), 0, lo
        while hi < len(order) and level_of(len(unique[order[hi]])) == level and (hi == lo or size < GROUP_CHARS):
            size += len(unique[order[hi]])
            hi += 1
        for i, f in zip(order[lo:hi], _walks([unique[i] for i in order[lo:hi]], level)):
            done[i] = f
        lo = hi
    return [done[first[t]] for t in texts]


def _parts(f: list[str]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer("".join(f).encode(), np.uint8).reshape(len(f), -1)
    return np.array([int(x[:2], 16) for x in f]), a[:, 2:].reshape(len(f), 2, DIGITS)


def _like(lf, df, lg, dg) -> np.ndarray:
    a = np.where((lf < lg)[:, None], df[:, 1], df[:, 0])
    b = np.where((lg < lf)[:, None], dg[:, 1], dg[:, 0])
    some = (a != 48) | (b != 48)
    n = some.sum(axis=1)
    share = np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), 1.0)
    return np.where(np.abs(lf - lg) <= 1, np.clip((share - 1 / 15) / (1 - 1 / 15), 0, 1), 0.0)


def likeness(f: list[str], g: list[str]) -> np.ndarray:
    """Of pairs of fingerprints, 0 (nothing in common, or lengths too far apart) to 1 (equal)."""
    return _like(*_parts(f), *_parts(g)) if f else np.empty(0)


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars and fingerprint of the whole text; a null text is empty."""

    def run(parts):
        for pdf in parts:
            texts = [t or "" for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_chars": [len(t) for t in texts], "fingerprint": fingerprints(texts)})

    return columns_guarded(docs, {"doc_id": "long", "text": "string"}).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` whose last third of characters is replaced by as many of the first of ``following``, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare_pass(parts):
    """Rows (part, own, doc_id, text) sorted by part, own, doc_id: each own row with the row before it as the next document."""
    before = (None, "", "")  # part, text, fingerprint
    for pdf in parts:
        texts = [t or "" for t in pdf.text]
        previous = [before[1], *texts[:-1]]
        same = [before[0] == pdf.part.iloc[0] if len(pdf) else False, *(pdf.part.to_numpy()[1:] == pdf.part.to_numpy()[:-1])]
        changed = [edited(t, p if s else t) for t, p, s in zip(texts, previous, same)]
        both = fingerprints(texts + changed)
        own, other = both[: len(texts)], both[len(texts) :]
        following = [p if s else f for p, s, f in zip([before[2], *own[:-1]], same, own)]
        if len(pdf):
            before = (pdf.part.iloc[-1], texts[-1], own[-1])
        out = pd.DataFrame(
            {
                "doc_id": pdf.doc_id,
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": own,
                "edited_fingerprint": other,
                "near_edited": likeness(own, other),
                "near_next": likeness(own, following),
            }
        )
        yield out[pdf.own.to_numpy() == 1]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document has the next smaller doc_id (after the smallest, the largest). A null text is empty; a null doc_id
    is the smallest; rows that share a doc_id follow each other by their text's hash, and equal rows follow each other.
    A single row is its own next. An empty table gives an empty one; other columns are ignored.

    Texts are shuffled once, to ranges of doc_ids; a doc_id that many rows share is cut into ranges of text hashes. What a
    range needs from the range before is one document, which is sent to both: so nothing needs a global order in one task.
    """
    spark = docs.sparkSession
    docs = columns_guarded(docs, {"doc_id": "long", "text": "string"})
    order, low = F.coalesce("doc_id", F.lit(-(1 << 63))), -(1 << 63)
    ranges = 8 * shuffle_partitions(spark)
    found = docs.select(order.cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    at = np.array([min(int(c), (1 << 63) - 1) for c in found or []], np.int64)
    # cuts are pairs (doc_id, hash): a doc_id that is several quantiles is cut by hash as often
    cuts, times = np.unique(at, return_counts=True)
    steps = [[low + (j << 64) // n for j in range(n)] for n in times.tolist()]
    first = np.cumsum(times) - times

    @F.pandas_udf("long")
    def part_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        k, h = key.to_numpy(np.int64), digest.to_numpy(np.int64)
        place = np.searchsorted(cuts, k, "left")
        part = np.r_[first, len(at)][place]
        same = (place < len(cuts)) & (np.r_[cuts, 0][place] == k)
        for i in np.unique(place[same]):
            mine = same & (place == i)
            part[mine] = first[i] + np.searchsorted(np.array(steps[i], np.int64), h[mine], "right")
        return pd.Series(part)

    numbered = docs.withColumns({"order": order, "hash": F.xxhash64("text")}).withColumn("part", part_of("order", "hash"))
    ends = sorted(written(numbered.groupBy("part").agg(F.max(F.struct("order", "hash")).alias("last")), "fingerprint-ranges").select("part", "last.order", "last.hash").collect())  # one row a range
    gives = {(o, h): ends[(i + 1) % len(ends)][0] for i, (_, o, h) in enumerate(ends)}

    @F.pandas_udf("array<long>")
    def sent(part: pd.Series, key: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([[2 * p + 1] + ([2 * gives[k]] if k in gives else []) for p, k in zip(part.tolist(), zip(key.tolist(), digest.tolist()))])

    rows = numbered.select("doc_id", "text", "order", "hash", F.explode(sent("part", "order", "hash")).alias("to"))
    rows = rows.select(F.shiftright("to", 1).alias("part"), F.pmod("to", F.lit(2)).cast("int").alias("own"), "doc_id", "text", "order", "hash")
    rows = rows.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "own", "order", "hash")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("part", "own", "doc_id", "text").mapInPandas(_compare_pass, kinds)


def band_shape(n: int, threshold: float) -> tuple[int, int]:
    """(digits of a band, bands) for ``n`` fingerprints: strangers meet about once in all, a likeness at the threshold is missed with MISS."""
    width = max(4, math.ceil(math.log(max(n, 2)) / -math.log(CHANCE)) + 2)
    share = threshold * 14 / 15 + 1 / 15
    return width, math.ceil(math.log(MISS) / math.log1p(-(share**width)))


def sketch_need(digits: int, threshold: float) -> int:
    """Digits of a sketch that must agree: a likeness at the threshold has fewer with probability MISS_SKETCH at most."""
    share, below = threshold * 14 / 15 + 1 / 15, 0.0
    for need in range(digits + 1):
        below += math.comb(digits, need) * share**need * (1 - share) ** (digits - need)
        if below > MISS_SKETCH:
            return need
    return digits


def _band_pass(width: int, bands: int, bits: int):
    """Rows (node, fingerprint) as one row for each bucket group: band keys, sketches and nodes."""
    rnd = np.random.default_rng(SEED)
    drawn = [np.array([rnd.choice(int(DIGITS * share), width, replace=False) for _ in range(bands)]) for share in CROSSED]
    other = [[rnd.permutation(np.setdiff1d(np.arange(int(DIGITS * share)), d))[:SKETCH] for d in of] for share, of in zip(CROSSED, drawn)]

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            level, digits = _parts(batch.column(1).to_pylist())
            keys, marks, who = [], [], []
            for scale in (0, 1):
                base = mix((level + scale).astype(U64) + U64(1))
                values = (digits[:, scale] & 15) + 9 * (digits[:, scale] >> 6)
                for band in range(bands):
                    some = digits[:, scale, drawn[scale][band]]
                    h = base + U64(band << 8)
                    for i in range(width):
                        h = mix(h * U64(0x9E3779B97F4A7C15) + some[:, i])
                    mark = np.zeros(len(h), U64)
                    for i in other[scale][band]:
                        mark = (mark << U64(4)) | values[:, i]
                    real = np.flatnonzero((some != 48).all(axis=1))
                    keys.append(h[real])
                    marks.append(mark[real])
                    who.append(node[real])
            keys, marks, who = cat(keys, U64), cat(marks, U64), cat(who, np.int64)
            order = np.argsort(keys, kind="stable")
            keys, marks, who = keys[order], marks[order], who[order]
            edges = np.searchsorted(keys, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits))
            out = [(g, planes(keys[i:j]), planes(marks[i:j]), planes(who[i:j])) for g, (i, j) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int32(), *[pa.binary()] * 3))], ["bucket", "keys", "marks", "nodes"])

    return run


def sketch_pairs(keys: np.ndarray, marks: np.ndarray, apart: int) -> np.ndarray:
    """Rows of two places that join, within equal ``keys``, all whose sketches differ in at most ``apart`` digits.

    ``keys`` and, within them, ``marks`` are sorted. Equal sketches are chained; of different ones, each probes those that
    aren't in its group yet, and those of the first one's group don't probe.
    """
    same = np.flatnonzero((keys[1:] == keys[:-1]) & (marks[1:] == marks[:-1]))
    pairs = [np.c_[same, same + 1]]
    own = np.setdiff1d(np.arange(len(keys)), same + 1)  # the first of each sketch
    k, m = keys[own], marks[own]

    def near(x, y):
        x = x ^ y
        x |= x >> U64(2)
        x |= x >> U64(1)
        return np.bitwise_count(x & U64(0x1111111111111111)) <= apart

    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    long = np.diff(np.r_[start, len(k)])
    two = start[long == 2]
    two = two[near(m[two], m[two + 1])]
    pairs.append(np.c_[own[two], own[two + 1]])
    for lo, n in zip(start[long > 2].tolist(), long[long > 2].tolist()):
        group, some = np.arange(n), m[lo : lo + n]
        for i in range(n):
            if i and group[i] == group[0]:
                continue
            rest = np.flatnonzero(group != group[i])
            if not len(rest):
                break
            hit = rest[near(some[rest], some[i])]
            if len(hit):
                others, first = np.unique(group[hit], return_index=True)
                pairs.append(own[np.c_[np.full(len(first), lo + i), lo + hit[first]]])
                group[np.isin(group, others)] = group[i]
    return np.concatenate(pairs)


def _chains(apart: int):
    """Of the buckets of a group: a forest of pairs that share a key and have like sketches."""

    @grouped
    def run(key, tables):
        cols = [[], [], []]
        for t in tables:
            for r in t.to_pylist():
                for to, name, kind in zip(cols, ("keys", "marks", "nodes"), (U64, U64, np.int64)):
                    to.append(unplanes(r[name], kind))
        keys, marks, node = (cat(c, kind) for c, kind in zip(cols, (U64, U64, np.int64)))
        order = np.lexsort((node, marks, keys))
        keys, marks, node = keys[order], marks[order], node[order]
        met = node[sketch_pairs(keys, marks, apart)]
        names, ends = np.unique(met.T.ravel(), return_inverse=True)
        links = forest(np.unique(ends.reshape(2, -1).T, axis=0), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[links[:, i]], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_links(level: np.ndarray, digits: np.ndarray, threshold: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all fingerprints whose likeness reaches the threshold; those of the first probe's group don't probe.

    Those of equal ``labels`` are joined before; then those of the largest group don't probe.
    """
    group, links = np.arange(len(level)), []
    anchor = 0
    if labels is not None and len(labels):
        group = np.unique(labels, return_inverse=True)[1]
        anchor = int(np.flatnonzero(group == np.bincount(group).argmax())[0])
    for i in range(len(level)):
        if group[i] == group[anchor] and (i or labels is not None):
            continue
        rest = np.flatnonzero(group != group[i])
        if not len(rest):
            break
        near = rest[_like(np.repeat(level[i], len(rest)), np.broadcast_to(digits[i], (len(rest), 2, DIGITS)), level[rest], digits[rest]) >= threshold]
        other, first = np.unique(group[near], return_index=True)
        links += [(i, int(j)) for j in near[first]]
        group[np.isin(group, other)] = group[i]
    return links


def _near_pairs(threshold: float):
    """Rows (a, b, left, right) with two fingerprints: those pairs that are near."""

    def run(batches):
        for batch in batches:
            near = likeness(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= threshold
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return run


def _verify(threshold: float):
    """Cells, each with rows of one component, packed into a task: links that join what is near and has different labels."""

    @grouped
    def run(key, tables):
        t = pa.concat_tables(tables)
        node, comp, cell, label = (t.column(c).to_numpy() for c in ("node", "comp", "cell", "label"))
        prints = t.column("fingerprint").to_pylist()
        order = np.lexsort((node, cell, comp))
        start = np.flatnonzero(np.r_[True, (comp[order][1:] != comp[order][:-1]) | (cell[order][1:] != cell[order][:-1])])
        a, b = [], []
        for lo, hi in zip(start, np.r_[start[1:], len(order)]):
            own = order[lo:hi]
            links = near_links(*_parts([prints[i] for i in own]), threshold, label[own])
            a += [int(node[own[i]]) for i, _ in links]
            b += [int(node[own[j]]) for _, j in links]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _unsettled_links(met: DataFrame, found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Written links between what ``found`` hasn't joined of the components of ``met`` (both a, b).

    What is outside a component's largest group meets that group, and itself, in blocks; what is of one group isn't compared.
    """
    known = components(found).withColumnRenamed("component", "label")
    now = written(components(met).withColumnRenamed("component", "comp").join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "print-candidates")
    mass = now.groupBy("comp", "label").count()
    top = mass.groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.max("count").alias("most"), F.sum("count").alias("all")).where("most < all")
    x, y = F.ceil(F.col("most") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    open_ = now.join(top, "comp").withColumns({"x": x, "y": y, "rest": F.col("label") != F.col("top")})
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("y")).otherwise(F.col("x"))).cast("int"))
    own = ["node", "comp", "label"]
    a = open_.where("not rest").select(*own, F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"))
    b = open_.where("rest").select(*own, F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i"), F.col("part").alias("j"))
    c = open_.where("rest").select(*own, "part", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("other")).where("part <> other")
    c = c.select(*own, (-1 - F.least("part", "other")).alias("i"), F.greatest("part", "other").alias("j"))
    cells = written(a.unionByName(b).unionByName(c).select(*own, F.xxhash64("comp", "i", "j").alias("cell")), "print-cells")
    bins = max(2 * cells.sparkSession.sparkContext.defaultParallelism, math.ceil(cells.count() / BLOCK))
    dealt = cells.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins))).join(classes.select("node", "fingerprint"), "node")
    return written(dealt.groupBy("bin").applyInArrow(_verify(threshold), "a long, b long"), "print-links")


def near_duplicates(prints: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Rows of ``prints`` (doc_id, fingerprint, ...) with component_id, the smallest doc_id that links reach.

    Equal fingerprints are one class. Classes that agree on all sampled digits of a band, at a scale they share, may be
    near; a likeness of at least ``threshold`` links them (one at the threshold, spread evenly over the texts, is missed by
    all bands with probability MISS). In a bucket, sketches of digits outside the band decide which of them are candidates
    (one at the threshold is missed with MISS_SKETCH): so strangers don't grow into components that grow with the table.
    Bands and sketches lie in the part of the walk that all texts of a level cross; texts of less than half the lowest
    level's length link only if their fingerprints are equal. Null doc_ids or fingerprints link with nothing and have
    their doc_id as component_id; an empty table gives an empty one.
    """
    spark = prints.sparkSession
    prints = prints.withColumns({"_d1": F.xxhash64("fingerprint"), "_d2": F.xxhash64("fingerprint", F.lit(1))})
    real = prints.where("doc_id is not null and fingerprint is not null")
    classes = real.groupBy("_d1", "_d2").agg(F.min("doc_id").alias("least"), F.min("fingerprint").alias("fingerprint"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "print-classes")
    width, bands = band_shape(classes.count(), threshold)
    bits = bucket_bits(spark, 2)
    digits = min(SKETCH, int(DIGITS * min(CROSSED)) - width)
    dealt = classes.select("node", "fingerprint").mapInArrow(_band_pass(width, bands, bits), "bucket int, keys binary, marks binary, nodes binary")
    met = written(dealt.groupBy("bucket").applyInArrow(_chains(digits - sketch_need(digits, threshold)), "a long, b long"), "print-chains").distinct()
    left, right = (classes.select(F.col("node").alias(n), F.col("fingerprint").alias(f)) for n, f in (("a", "left"), ("b", "right")))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    found = written(pairs.mapInArrow(_near_pairs(threshold), "a long, b long"), "print-pairs")
    links = found.unionByName(_unsettled_links(met, found, classes, threshold))
    joined = components(links).join(classes.select("node", "least"), "node")
    found = joined.join(joined.groupBy("component").agg(F.min("least").alias("_found")), "component").select("node", "_found")
    known = classes.join(found, "node", "left").select("_d1", "_d2", F.coalesce("_found", "least").alias("_found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_found", "doc_id"))
    return prints.join(known, ["_d1", "_d2"], "left").withColumn("component_id", component).drop("_d1", "_d2", "_found")


def near_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The banding and its verification over all documents."""
    prints = written(fingerprint_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    return near_duplicates(prints).select("doc_id", "n_chars", "component_id")


def op6_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
