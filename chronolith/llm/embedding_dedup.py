"""Near-duplicate embeddings: quantised p-stable projections bucket unit vectors, exact cosines decide.

Each table draws ``k`` Gaussian projections; a vector's bucket is the tuple of floor((a.v + b) / WIDTH). One projection
of two unit vectors at the threshold agrees with probability p1 (0.90 at cosine 0.93), of two random ones with p2 (0.63).
``k`` grows with the logarithm of the largest label's vectors, so that a vector meets about one stranger in a table, and
there are as many tables as miss a pair at the threshold with probability MISS; closer pairs are missed less.

1. Equal unit vectors of a label are one class, counted by its size.
2. Signatures are dealt out by bucket, packed, with SIGNS signs of projections of each vector. Inside a bucket, signs tell
   strangers from neighbours, and a forest of those that may be near is passed on: no row per pair, and no vector yet.
3. The forest's components hold every candidate pair. Each vector goes once to its component (or, if that has more than
   BLOCK vectors, to each pair of blocks), where matrix products give all exact cosines. Small components share a task.

Joins are sort-merge joins by hint, as in ``components``: nothing that grows with the table goes through the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import bucket_bits, cat, columns_guarded, grouped, mix, planes, unplanes, written
from chronolith.llm.components import components, with_key

WIDTH, MISS, BLOCK, SEED = 3.0, 1e-3, 4096, 7
SIGNS, NEAR, CORE = 256, 64, 32  # at cosine 0.93 two vectors differ in 31 of 256 signs, give or take 5; strangers in 128, give or take 8
PAIRS = 1 << 18  # of signs compared at once
FLUSH = 8192  # vectors whose signatures are packed together
U64 = np.uint64
_I, _L, _B, _F = pa.int32(), pa.int64(), pa.binary(), pa.float64()


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that a quantised projection of two vectors so far apart agrees."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors of a label."""
    near, far = agreement(math.sqrt(2 - 2 * threshold)), agreement(math.sqrt(2))
    k = max(8, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so no square overflows or vanishes. -0.0 becomes 0.0."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _unit_pass(batches):
    """Rows (vec_id, embedding, label) as (vec_id, label, key, vec): unit vector and its digest, null if it links with nothing."""
    for batch in batches:
        lists = batch.column(1).cast(pa.list_(_F))
        values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
        start, end = (np.asarray(a) for a in (lists.offsets[:-1], lists.offsets[1:]))
        usable = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(2).is_valid()) & (end > start)
        label = batch.column(2).fill_null(0).to_pylist()
        vec, key = [None] * batch.num_rows, [None] * batch.num_rows
        for dim in np.unique((end - start)[usable]):
            rows = np.flatnonzero(usable & (end - start == dim))
            x = values[start[rows][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            for i, u in zip(rows[good].tolist(), units(x[good])):
                vec[i] = u.astype("<f8").tobytes()
                key[i] = hashlib.blake2b(vec[i] + str(label[i]).encode(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(key, _B), pa.array(vec, _B)], ["vec_id", "label", "key", "vec"])


def _signature_pass(k: int, tables: int, bits: int):
    """Rows (node, label, vec) as one row for each bucket group: signatures, nodes and signs."""

    def run(batches):
        drawn = {}
        for batch in batches:
            nodes, label = (batch.column(i).to_numpy() for i in (0, 1))
            size = np.array([len(v) // 8 for v in batch.column(2).to_pylist()], np.int64)
            for dim in np.unique(size).tolist():
                if dim not in drawn:
                    rnd = np.random.default_rng([SEED, dim])
                    drawn[dim] = rnd.standard_normal((dim, tables * k)), rnd.uniform(0, WIDTH, tables * k), rnd.standard_normal((dim, SIGNS))
                a, b, c = drawn[dim]
                of_dim = np.flatnonzero(size == dim)
                for lo in range(0, len(of_dim), FLUSH):
                    rows = of_dim[lo : lo + FLUSH]
                    x = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), dim)
                    signs = np.packbits(x @ c > 0, axis=1).view(U64)
                    own = mix(label[rows].astype(np.int64).view(U64) + U64(dim))
                    sig = np.empty((tables, len(rows)), U64)
                    for t in range(tables):
                        cell = np.floor((x @ a[:, t * k : t * k + k] + b[t * k : t * k + k]) / WIDTH).astype(np.int64).view(U64)
                        h = own + U64(t + 1)
                        for i in range(k):
                            h = mix(h * U64(0x9E3779B97F4A7C15) + cell[:, i] + U64(i + 1))
                        sig[t] = h
                    flat, who = sig.reshape(-1), np.tile(np.arange(len(rows)), tables)
                    order = np.argsort(flat, kind="stable")
                    flat, who = flat[order], who[order]
                    edges = np.searchsorted(flat, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits))
                    out = [(g, planes(flat[i:j]), planes(nodes[rows[who[i:j]]]), signs[who[i:j]].tobytes()) for g, (i, j) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(flat)])) if j > i]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (_I, _B, _B, _B))], ["bucket", "sigs", "nodes", "signs"])

    return run


class _Forest:
    """Union-find over numbers 0 to n - 1 that remembers the links it needed."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.links.append((i, j))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


@grouped
def _bucket_forest(key, tables):
    """Of the buckets of a group: links that join what may be near.

    Only vectors within NEAR signs of each other are joined, and any two such end up joined: a centre takes out of the race
    what lies within CORE signs of it, so that a bucket of close copies is passed once, and what waits within CORE + NEAR of
    the centre meets those taken out, until it is joined. Strangers that share a bucket stay apart.
    """
    sig, node, signs = [], [], []
    for t in tables:
        for r in t.to_pylist():
            sig.append(unplanes(r["sigs"], U64))
            node.append(unplanes(r["nodes"], np.int64))
            signs.append(np.frombuffer(r["signs"], U64).reshape(-1, SIGNS // 64))
    sig, node = cat(sig, U64), cat(node, np.int64)
    signs = np.concatenate(signs)
    order = np.lexsort((node, sig))
    sig, node, signs = sig[order], node[order], signs[order]
    names, number = np.unique(node, return_inverse=True)
    forest = _Forest(len(names))
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[start, len(sig)])
    two = start[size == 2]
    for i in two[_differ(signs[two], signs[two + 1]) <= NEAR].tolist():
        forest.join(int(number[i]), int(number[i + 1]))
    for lo, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        own, mine = signs[lo : lo + n], number[lo : lo + n]
        waiting = np.arange(n)
        while len(waiting) > 1:
            centre = int(waiting[0])
            apart = _differ(own[waiting], own[centre])
            core, ring = waiting[apart <= CORE], waiting[(apart > NEAR) & (apart <= CORE + NEAR)]
            for j in waiting[1:][apart[1:] <= NEAR].tolist():
                forest.join(int(mine[centre]), int(mine[j]))
            at = 1  # the first is the centre
            while len(ring) and at < len(core):
                some = core[at : at + max(1, PAIRS // len(ring))]
                near = _differ(own[ring][:, None], own[some][None]) <= NEAR
                hit = near.any(axis=1)
                for i, j in zip(ring[hit].tolist(), some[near[hit].argmax(axis=1)].tolist()):
                    forest.join(int(mine[j]), int(mine[i]))
                ring, at = ring[~hit], at + len(some)
            waiting = waiting[apart > CORE]
    ends = names[np.array(forest.links, np.int64).reshape(-1, 2)]
    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0], _L), pa.array(ends[:, 1], _L)], ["a", "b"])


def _compare(threshold: float):
    """Whole small components, or one pair of blocks of a large one: link counts of each vector, and a forest of the links."""

    @grouped
    def run(key, tables):
        rows = [t.select(["node", "comp", "part", "weight", "vec"]) for t in tables]
        t = pa.concat_tables(rows)
        node, comp, part, weight = (t.column(c).to_numpy() for c in ("node", "comp", "part", "weight"))
        vec = t.column("vec").to_pylist()
        order = np.lexsort((node, part, comp))
        links = np.zeros(len(order), np.int64)
        forest = _Forest(len(order))
        start = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1]])
        for lo, hi in zip(start, np.r_[start[1:], len(order)]):
            own = order[lo:hi]
            x = np.frombuffer(b"".join([vec[i] for i in own]), np.float64).reshape(len(own), -1)
            parts = part[own]
            left = np.flatnonzero(parts == parts[0])
            right = left if parts[-1] == parts[0] else np.flatnonzero(parts == parts[-1])
            for at in range(0, len(left), 256):
                some = left[at : at + 256]
                near = x[some] @ x[right].T >= threshold
                if left is right:
                    near &= right[None, :] != some[:, None]
                links[own[some]] += near @ weight[own[right]]
                if left is not right:
                    links[own[right]] += near.T @ weight[own[some]]
                for i, row in zip(own[some].tolist(), near):
                    for j in own[right[np.flatnonzero(row)]].tolist():
                        if forest.parent[i] != forest.parent[j]:
                            forest.join(i, j)
        got = np.flatnonzero(links)
        ends = node[np.array(forest.links, np.int64).reshape(-1, 2)]
        a, b = np.r_[node[got], ends[:, 0]], np.r_[node[got], ends[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(a, _L), pa.array(b, _L), pa.array(np.r_[links[got], np.zeros(len(ends), np.int64)], _L)], ["a", "b", "links"])

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Rows link when labels are equal and not null, both vectors have one length and their cosine in double precision is
    at least ``threshold``. Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing. component_id is the smallest vec_id that links reach. Rows that share a vec_id are vectors of their own:
    they link as any two rows do, and the id stands for each of them. A null vec_id never links. An empty table gives an
    empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = columns_guarded(vectors, {"vec_id": "long", "embedding": "array<double>", "label": "long"})
    rows = rows.mapInArrow(_unit_pass, "vec_id long, label long, key binary, vec binary")
    classes = rows.where("key is not null").groupBy("label", "key", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = shape(most, threshold)
    bits = bucket_bits(spark, 2)
    dealt = classes.select("node", "label", "vec").mapInArrow(_signature_pass(k, tables, bits), "bucket int, sigs binary, nodes binary, signs binary")
    met = written(dealt.groupBy("bucket").applyInArrow(_bucket_forest, "a long, b long"), "vector-forest")
    member = components(met).withColumnRenamed("component", "comp")
    sizes = member.groupBy("comp").count()
    count = member.count()
    placed = with_key(member, sizes, "comp").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = F.col("blocks") > 1
    bins = max(1, math.ceil(count / BLOCK), 2 * spark.sparkContext.defaultParallelism)
    placed = placed.select(
        "node",
        "comp",
        "part",
        F.when(large, F.col("comp")).otherwise(F.lit(-1)).alias("alone"),
        F.when(large, F.least("part", "other")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("int")).alias("p"),
        F.when(large, F.greatest("part", "other")).otherwise(F.lit(-1)).alias("q"),
    )
    cells = placed.join(classes.select("node", "weight", "vec").hint("merge"), "node")
    seen = written(cells.groupBy("alone", "p", "q").applyInArrow(_compare(threshold), "a long, b long, links long"), "vector-links")
    degree = seen.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    joined = components(seen.where("links = 0").select("a", "b"))
    reach = joined.join(classes.select("node", "least").hint("merge"), "node")
    reach = with_key(reach, reach.groupBy("component").agg(F.min("least").alias("found")), "component").select("node", "found")
    known = classes.select("key", "node", "least", "weight").join(degree.hint("merge"), "node", "left").join(reach.hint("merge"), "node", "left")
    known = known.select("key", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("found", "least").alias("found"))
    out = rows.select("vec_id", "key").join(known.hint("merge"), "key", "left")
    component = F.coalesce("found", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.a = c.c AS kept FROM c LEFT JOIN n ON n.a = c.a
"""
