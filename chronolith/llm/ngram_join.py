"""Jaccard self-join of word n-gram sets by prefix trees.

1. Rows get numbers of their own; equal sets collapse to one class.
2. Document frequencies: the sets' n-grams are dealt out by n-gram, packed (40 bits each), and counted. What occurs in
   one set only is dropped there; the rest goes back to its document with its frequency class. The global order is
   (frequency class, n-gram), so n-grams of one set only come first. A wrongly shared 40-bit key adds a candidate, no more.
3. If two sets of sizes a and b are similar, they share at least one of the first a - ceil(0.75 a) + 1 n-grams of the
   order, and at least 0.75 a of each set's n-grams are shared ones; other sets leave here. The shared part of each
   prefix is dealt out by n-gram, with the number of n-grams from it to the end of the order. If it is the first that two
   sets share, they overlap by no more than the smaller of the two numbers. The sets of one n-gram's list, ordered by
   size, are chained where that bound and the sizes allow it; a bucket of lists passes on a forest of its chains. So two
   similar sets always end up in one component of the chains, and nothing is written for each pair.
4. Each set goes once to its component (small ones share a task), where the sets, in one order (most frequent n-grams
   first), form a trie. It is traversed for one probe at a time: sets below a node share the overlap so far, a subtree is
   left where the n-grams that remain can't reach the bound, or where all its sets are in the probe's group already. The
   first probe is the most central set; after it only sets outside the largest group probe. What comes out is a forest.
5. A component of more than BLOCK n-grams is cut into blocks. Blocks are joined within; then the most central sets of
   their groups with each other; then what is outside the largest group with all blocks, and with itself. Sets of one
   group are not compared again: they lose no link between groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import (
    bucket_bits,
    cat,
    chunks_of,
    columns_guarded,
    grouped,
    mapped,
    mix,
    numbered,
    planes,
    shingles_of,
    small_enough,
    text_buffers,
    unplanes,
    words_of,
    written,
)
from chronolith.llm.components import components, forest

BLOCK = 1 << 20  # n-grams of the sets that meet in a task
CHUNK = 1 << 20
U64 = np.uint64
_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


def _sets(batch, width):
    """(numbers, list of sets) of pieces of an Arrow batch (number, text)."""
    ids = batch.column(0).to_pylist()
    data, offsets = text_buffers(batch.column(1))
    for lo, hi in chunks_of(offsets, CHUNK):
        o = offsets[lo : hi + 1] - offsets[lo]
        words, rows = words_of(data[offsets[lo] : offsets[hi]], o, telling=True)
        yield ids[lo:hi], shingles_of(words, rows, hi - lo, width)


def _digest_pass(width):
    """Per row (number, text, doc_id) its set's size and digest."""

    def run(batches):
        for batch in batches:
            docs, at = batch.column(2), 0
            for ids, sets in _sets(batch, width):
                rows = [(i, len(s), int(mix(s).sum(dtype=U64).view(np.int64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64))) for i, s in zip(ids, sets)]
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(ids)), *[pa.array(c, _L) for c in zip(*rows)]], ["doc_id", "number", "n", "d1", "d2"])
                at += len(ids)

    return run


def _at_least(percent, a, b):
    """The overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def _runs(a):
    """Starts and ends of runs of equal values."""
    s = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return s, np.r_[s[1:], len(a)][: len(s)]


def _keys_pass(width, bits):
    """All sets by n-gram, packed: one row for each bucket of n-grams and some thousand documents."""
    names = ["bucket", "keys", "docs", "counts", "sizes"]

    def flush(docs, sets):
        tokens = cat(sets, U64)
        lens = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), lens)
        bucket = (tokens >> U64(64 - bits)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        low, row, bucket = ((tokens << U64(bits)) >> U64(32)).astype(np.uint32)[order], row[order], bucket[order]
        docs, rows = np.array(docs, np.int64), []
        for lo, hi in zip(*_runs(bucket)):
            s, t = _runs(row[lo:hi])
            who = row[lo:hi][s]
            rows.append((int(bucket[lo]), planes(low[lo:hi]), planes(docs[who]), planes((t - s).astype(np.uint32)), planes(lens[who].astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, (_I, _B, _B, _B, _B))], names)

    def run(batches):
        docs, sets, held = [], [], 0
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")  # near ids pack well
            for ids, some in _sets(batch.take(pa.array(order)), width):
                for i, s in zip(ids, some):
                    if len(s):
                        docs.append(i)
                        sets.append(s)
                        held += len(s)
                if held > 600_000:
                    yield flush(docs, sets)
                    docs, sets, held = [], [], 0
        yield flush(docs, sets)

    return run


def _shared_keys(dbits):
    """Of one bucket of n-grams: those of several sets, back by document with the frequency's class."""
    names = ["dbucket", "grams", "kinds", "docs", "counts", "sizes"]

    @grouped
    def run(key, batches):
        k, d, n = [], [], []
        for t in batches:
            for r in t.to_pylist():
                times = unplanes(r["counts"], np.uint32)
                k.append(unplanes(r["keys"], np.uint32))
                d.append(np.repeat(unplanes(r["docs"], np.int64), times))
                n.append(np.repeat(unplanes(r["sizes"], np.uint32), times))
        k, d, n = cat(k, np.uint32), cat(d, np.int64), cat(n, np.uint32)
        order = np.argsort(k, kind="stable")
        s, t = _runs(k[order])
        often = np.empty(len(k), np.int64)
        often[order] = np.repeat(t - s, t - s)
        keep = often > 1
        k, d, n, often = k[keep].astype(U64) | U64(int(key[0].as_py()) << 32), d[keep], n[keep], np.log2(often[keep]).astype(np.uint8)
        home = (mix(d.view(U64)) >> U64(64 - dbits)).astype(np.int64)
        order = np.lexsort((d, home))
        k, d, n, often, home = k[order], d[order], n[order], often[order], home[order]
        rows = []
        for lo, hi in zip(*_runs(home)):
            s, t = _runs(d[lo:hi])
            rows.append((int(home[lo]), planes(k[lo:hi]), often[lo:hi].tobytes(), planes(d[lo:hi][s]), planes((t - s).astype(np.uint32)), planes(n[lo:hi][s])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, (_I, *[_B] * 5))], names)

    return run


def _prefixes(percent, bits):
    """Of one bucket of documents: the shared part of their prefixes, by n-gram, packed, with what remains from there."""
    names = ["bucket", "grams", "docs", "sizes", "rests"]

    @grouped
    def run(key, batches):
        cols = [[], [], [], []]
        for t in batches:
            for r in t.to_pylist():
                times = unplanes(r["counts"], np.uint32)
                cols[0].append(unplanes(r["grams"], U64))
                cols[1].append(np.frombuffer(r["kinds"], np.uint8))
                cols[2].append(np.repeat(unplanes(r["docs"], np.int64), times))
                cols[3].append(np.repeat(unplanes(r["sizes"], np.uint32), times))
        g, often, d, n = (cat(c, k) for c, k in zip(cols, (U64, np.uint8, np.int64, np.uint32)))
        n = n.astype(np.int64)
        order = np.lexsort((g, often, d))
        g, d, n = g[order], d[order], n[order]
        s, t = _runs(d)
        shared = np.repeat(t - s, t - s)
        own = n - shared
        place = own + np.arange(len(d)) - np.repeat(s, t - s)
        need = -(-percent * n // 100)
        # one n-gram of slack, should two of a set have fallen on one key
        keep = (shared + 1 >= need) & (place < n - need + 2)
        g, d, n, left = g[keep], d[keep], n[keep], (n - place)[keep]
        home = (mix(g) >> U64(64 - bits)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        g, d, n, left, home = (a[order] for a in (g, d, n.astype(np.uint32), left.astype(np.uint32), home))
        rows = [(int(home[lo]), *(planes(a[lo:hi]) for a in (g, d, n, left))) for lo, hi in zip(*_runs(home))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (_I, *[_B] * 4))], names)

    return run


def chained(g: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join what may be similar in lists sorted by (n-gram, size), at most one for each place.

    A set of size a with ``left`` n-grams from here on can only be similar to sets of up to most = left * (100 + percent) /
    percent - a; sets may be similar if neither is larger than the other's most. Of the smaller sets within its most, each
    set takes the one with the largest most, if that reaches it. Any other smaller set that may be similar to it may be
    similar to the one taken, too: both are of its size at most, and the most of both reaches it. So the pairs join just
    what pairs of all that may be similar would join.
    """
    at, wide = np.arange(len(g)), U64(32)
    most = np.clip(left * (100 + percent) // percent - n, 0, (1 << 32) - 1)
    start, end = _runs(g)
    long = end - start
    run = np.repeat(np.arange(len(start)), long).astype(U64) << wide
    top = run | most.astype(U64)
    best = np.maximum.accumulate(top)
    holder = np.maximum.accumulate(np.where(np.r_[True, best[1:] > best[:-1]], at, 0)) if len(g) else at
    until = np.minimum(at, np.searchsorted(run | n.astype(U64), top, "right"))
    some = np.flatnonzero(until > np.repeat(start, long))
    taken = holder[until[some] - 1]
    near = most[taken] >= n[some]
    return taken[near], some[near]


def _chains(percent):
    """Of one bucket of n-grams: a forest of the chains of its lists."""

    @grouped
    def run(key, batches):
        cols = [[], [], [], []]
        for t in batches:
            for r in t.to_pylist():
                for to, name, kind in zip(cols, ("grams", "docs", "sizes", "rests"), (U64, np.int64, np.uint32, np.uint32)):
                    to.append(unplanes(r[name], kind))
        g, d, n, left = cat(cols[0], U64), cat(cols[1], np.int64), cat(cols[2], np.uint32), cat(cols[3], np.uint32)
        order = np.lexsort((d, n, g))
        g, d, n, left = g[order], d[order], n[order].astype(np.int64), left[order].astype(np.int64)
        one, two = chained(g, n, left, percent)
        one, two = d[one], d[two]
        names, ends = np.unique(np.r_[one, two][np.tile(one != two, 2)], return_inverse=True)
        links = forest(np.unique(ends.reshape(2, -1).T, axis=0), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[links[:, i]], _L) for i in (0, 1)], ["a", "b"])

    return run


def _tokens_pass(width):
    def run(batches):
        for batch in batches:
            for ids, sets in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(ids, _L), pa.array([s.tobytes() for s in sets], _B)], ["node", "grams"])

    return run


class Trie:
    """Sequences of whole numbers in ascending order, as a tree with the unbranched stretches as single nodes.

    A node holds the stretch from ``start`` to ``end`` of the sequences ``lo`` to ``hi`` (in sorted order); the numbers
    of its stretch stand at ``at``. ``least`` and ``longest`` are the smallest set and the longest sequence below it.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sequences)), key=[s.astype(">u4").tobytes() for s in sequences].__getitem__), np.int64)
        seqs = [sequences[i] for i in self.order]
        sizes = sizes[self.order].tolist()
        lens = [len(s) for s in seqs]
        self.tokens = cat(seqs, np.int64)
        base = np.cumsum([0, *lens]).tolist()
        nodes = []  # start, end, lo, hi, least, longest, children
        stack = [[0, 0, 0, 0, 1 << 62, 0, []]]  # branches still open, the root first

        def attach(node):
            """To the innermost open branch."""
            top = stack[-1]
            node[0] = top[1]
            top[6].append(len(nodes))
            nodes.append(node)
            top[3], top[4], top[5] = node[3], min(top[4], node[4]), max(top[5], node[5])

        for i, s in enumerate(seqs):
            shared = 0  # with the next
            if i + 1 < len(seqs):
                m = min(lens[i], lens[i + 1])
                differ = np.flatnonzero(s[:m] != seqs[i + 1][:m])
                shared = int(differ[0]) if len(differ) else m
            if shared > stack[-1][1]:
                stack.append([0, shared, i, 0, 1 << 62, 0, []])
            attach([0, lens[i], i, i + 1, sizes[i], lens[i], []])
            while shared < stack[-1][1]:
                node = stack.pop()
                if shared > stack[-1][1]:
                    stack.append([0, shared, node[2], 0, 1 << 62, 0, []])
                attach(node)
        self.roots = np.array(stack[0][6], np.int64)
        self.start, self.end, self.lo, self.hi, self.least, self.longest = (np.array([n[k] for n in nodes], np.int64) for k in range(6))
        self.at = np.array(base, np.int64)[self.lo] + self.start
        counts = np.array([len(n[6]) for n in nodes], np.int64)
        self.first = np.cumsum(counts) - counts
        self.children, self.counts = np.array([c for n in nodes for c in n[6]], np.int64), counts
        self.leaf = counts == 0
        self.inside = np.zeros(int(self.tokens.max(initial=0)) + 1, bool)  # the probe's numbers, while one is on its way

    def near(self, probe: np.ndarray, size: int, percent: int, done) -> np.ndarray:
        """Places of the sequences whose sets are similar to the ``probe``, one of them, of a set of ``size``; ``done(nodes)`` are left out."""
        inside = self.inside
        inside[probe] = True
        nodes, overlap, found = self.roots, np.zeros(len(self.roots), np.int64), []
        while len(nodes):
            keep = ~done(nodes)
            nodes, overlap = nodes[keep], overlap[keep]
            long = self.end[nodes] - self.start[nodes]
            stop = np.cumsum(long)
            place = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.at[nodes] - stop + long, long)
            passed = np.r_[0, np.cumsum(inside[self.tokens[place]])]
            overlap = overlap + passed[stop] - passed[stop - long]
            last = np.where(self.end[nodes] > 0, self.tokens[self.at[nodes] + long - 1] if len(self.tokens) else 0, -1)
            left = len(probe) - np.searchsorted(probe, last, "right")
            keep = overlap + np.minimum(self.longest[nodes] - self.end[nodes], left) >= _at_least(percent, size, self.least[nodes])
            nodes, overlap = nodes[keep], overlap[keep]
            leaf = self.leaf[nodes]
            found.append(self.lo[nodes[leaf]])
            nodes, overlap = nodes[~leaf], overlap[~leaf]
            counts = self.counts[nodes]
            stop = np.cumsum(counts)
            place = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.first[nodes] - stop + counts, counts)
            nodes, overlap = self.children[place], np.repeat(overlap, counts)
        inside[probe] = False
        return cat(found, np.int64)


def trie_links(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links that join all similar ``sets`` (sorted, distinct), the groups they make, and how central each set is.

    Sets of equal ``labels`` are joined before. Only links between sets of different groups are found, each by one probe.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, number, often = np.unique(cat(sets, U64), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -often))] = np.arange(len(values))
    central = np.bincount(owner, often[number], n) / np.maximum(sizes, 1)
    shared = often[number] > 1
    token, owner = rank[number[shared]], owner[shared]
    order = np.lexsort((token, owner))
    token, bounds = token[order], np.searchsorted(owner[order], np.arange(n + 1))
    sequences = [token[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    trie = Trie(sequences, sizes)
    group = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(n)
    links: list[tuple[int, int]] = []
    anchor = int(np.flatnonzero(group == np.bincount(group).argmax())[0]) if labels is not None else -1
    there = None  # the group of each place, and where its run of places of one group ends
    for i in np.argsort(-central, kind="stable").tolist() if n > 1 else []:
        if anchor < 0:
            anchor = i  # probes, and gathers the group whose other sets needn't
        elif group[i] == group[anchor]:
            continue
        if there is None:
            if (group == group[0]).all():
                break
            there = group[trie.order]
            change = np.flatnonzero(np.r_[there[1:] != there[:-1], True])
            until = change[np.searchsorted(change, np.arange(n))] + 1
        mine = group[i]
        hit = trie.order[trie.near(sequences[i], int(sizes[i]), percent, lambda k: (there[trie.lo[k]] == mine) & (until[trie.lo[k]] >= trie.hi[k]))]
        hit = hit[group[hit] != mine]
        if len(hit):
            other, first = np.unique(group[hit], return_index=True)
            links += [(i, int(j)) for j in hit[first]]
            group[np.isin(group, other)] = mine
            there = None
    return links, group, central


def _meet(percent):
    """Whole components, or blocks of a large one, packed into a task: links, and the most central set of each group."""

    @grouped
    def run(key, tables):
        t = pa.concat_tables(tables)
        node, comp, label = (t.column(c).to_numpy() for c in ("node", "comp", "label"))
        cells = t.column("cell").to_numpy()
        raw = t.column("grams").to_pylist()
        order = np.lexsort((node, comp, cells))
        out = []
        for lo, hi in zip(*_runs(cells[order])):
            own = order[lo:hi]
            links, group, central = trie_links([np.frombuffer(raw[i], U64) for i in own], percent, label[own])
            out += [(int(node[own[i]]), int(node[own[j]])) for i, j in links]
            best = own[np.lexsort((node[own], -central, group))]
            heads = best[_runs(np.sort(group))[0]]
            out += [(int(node[i]), int(node[i])) for i in heads]
        yield pa.RecordBatch.from_arrays([pa.array(c, _L) for c in (zip(*out) if out else ([], []))], ["a", "b"])

    return run


def _met(cells: DataFrame, sets: DataFrame, percent: int, tokens: int) -> DataFrame:
    """Written (a, b): links found in ``cells`` (cell, node, comp, label), and (a, a) for the most central sets of groups.

    Rows of a cell meet in one task; ``tokens`` in all cells tell how many tasks share them.
    """
    bins = max(2 * cells.sparkSession.sparkContext.defaultParallelism, -(-tokens // BLOCK))
    dealt = cells.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins)).cast("int"))
    return written(dealt.join(sets, "node").groupBy("bin").applyInArrow(_meet(percent), "a long, b long"), "ngram-links")


def _in_blocks(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``member`` (node, comp, n): all components as in the module's docstring."""
    sizes = member.groupBy("comp").agg(F.sum("n").alias("tokens"))
    total = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    blocks = F.ceil(F.col("tokens") / BLOCK).cast("int")
    placed = written(member.join(sizes, "comp").withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int")), "ngram-members")
    within = placed.select(F.xxhash64("comp", "part").alias("cell"), "node", "comp", F.col("node").alias("label"))
    found = _met(within, sets, percent, total[0] or 0)
    if (total[1] or 0) <= BLOCK:
        return found.where("a <> b")
    large = placed.where("blocks > 1").drop("blocks", "part", "tokens")

    def labelled(links: DataFrame) -> DataFrame:
        known = components(links.where("a <> b")).select("node", F.col("component").alias("label"))
        return large.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # the most central sets of the groups of all blocks, in blocks again if they are many
    hubs = labelled(found).join(found.where("a = b").select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    size = hubs.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("tokens"))
    hubs = hubs.join(size, "comp").select(F.xxhash64("comp", F.pmod(F.xxhash64("node", F.lit(6)), "blocks")).alias("cell"), "node", "comp", "label")
    found = written(found.where("a <> b").unionByName(_met(hubs, sets, percent, total[0]).where("a <> b")), "ngram-links")
    # what is outside the largest group: blocks of it with blocks of the largest, and with each other
    now = labelled(found)
    mass = now.groupBy("comp", "label").agg(F.sum("n").alias("tokens"))
    top = mass.groupBy("comp").agg(F.max_by("label", F.struct("tokens", "label")).alias("top"), F.max("tokens").alias("most"), F.sum("tokens").alias("all")).where("most < all")
    outside = written(now.join(top, "comp").withColumn("rest", F.col("label") != F.col("top")), "ngram-outside")
    x, y = F.ceil(F.col("most") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    outside = outside.withColumn("x", x).withColumn("y", y).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("rest"), F.col("y")).otherwise(F.col("x"))).cast("int"))
    own = ["node", "comp", "label", "n"]
    a = outside.where("not rest").select(*own, F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"))
    b = outside.where("rest").select(*own, F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i"), F.col("part").alias("j"))
    c = outside.where("rest").select(*own, "part", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("other")).where("part <> other")
    c = c.select(*own, (-1 - F.least("part", "other")).alias("i"), F.greatest("part", "other").alias("j"))
    cells = written(a.unionByName(b).unionByName(c).withColumn("cell", F.xxhash64("comp", "i", "j")).drop("i", "j"), "ngram-cells")
    more = _met(cells.drop("n"), sets, percent, cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return found.unionByName(more.where("a <> b"))


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles and component_id.

    A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D. A set holds the distinct sequences of
    ``width`` words; of a shorter text, the one sequence of all its words; of a text without words or null, nothing, and
    it links with nothing. Rows link when 100 * overlap >= percent * union. component_id is the smallest doc_id that
    links reach. Rows that share a doc_id link as any rows do, each by its own text; a row with a null doc_id gets its
    n_shingles, links with nothing and has a null component_id. An empty table gives an empty one. Other columns are
    ignored. N-grams are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = numbered(columns_guarded(docs, {"doc_id": "long", "text": "string"}))
    rows = written(docs.select("number", "text", "doc_id").mapInArrow(mapped(_digest_pass(width)), "doc_id long, number long, n long, d1 long, d2 long"), "ngram-digests")
    real = rows.where("n > 0 and doc_id is not null")
    classes = written(real.groupBy("n", "d1", "d2").agg(F.min("number").alias("rep"), F.min("doc_id").alias("least")), "ngram-classes")
    # a row goes on if it is its set's first: copies are left out by number
    copies = written(real.join(classes, ["n", "d1", "d2"]).where("number <> rep").select("number").distinct(), "ngram-copies")
    reps = docs.where("doc_id is not null").join(small_enough(copies), "number", "left_anti").select("number", "text")
    if not real.groupBy("number").count().where("count > 1").isEmpty():  # equal rows would stand for two documents
        reps = reps.dropDuplicates(["number"])
    bits, dbits = bucket_bits(spark, 2), bucket_bits(spark, 1)
    keys = reps.mapInArrow(mapped(_keys_pass(width, bits)), "bucket int, keys binary, docs binary, counts binary, sizes binary")
    shared = keys.groupBy("bucket").applyInArrow(_shared_keys(dbits), "dbucket int, grams binary, kinds binary, docs binary, counts binary, sizes binary")
    prefixes = shared.groupBy("dbucket").applyInArrow(_prefixes(percent, bits), "bucket int, grams binary, docs binary, sizes binary, rests binary")
    chains = written(prefixes.groupBy("bucket").applyInArrow(_chains(percent), "a long, b long"), "ngram-chains")
    sized = classes.select(F.col("rep").alias("node"), "n")
    member = written(components(chains).select("node", F.col("component").alias("comp")).join(sized, "node"), "ngram-candidates")
    needed = small_enough(member.select(F.col("node").alias("number")))
    sets = written(reps.join(needed, "number", "left_semi").mapInArrow(mapped(_tokens_pass(width)), "node long, grams binary"), "ngram-sets")
    linked = components(_in_blocks(member, sets, percent)).select(F.col("node").alias("rep"), "component")
    known = written(classes.join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "ngram-known")
    reach = known.groupBy("component").agg(F.min("least").alias("found"))
    of_class = known.join(reach, "component").select("n", "d1", "d2", "found")
    out = rows.join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
