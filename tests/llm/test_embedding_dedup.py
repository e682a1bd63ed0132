import duckdb
import numpy as np
import pyarrow as pa

from chronolith.llm.common import planes, written
from chronolith.llm.components import forest
from chronolith.llm.embedding_dedup import NEAR, ORACLE, _bucket_forest, agreement, embedding_dedup, op2_embedding_dedup, shape, units


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    got = sorted(map(tuple, op2_embedding_dedup(spark, sf).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == want


def test_hot_group_and_edges(spark, monkeypatch):
    monkeypatch.setattr("chronolith.llm.embedding_dedup.BLOCK", 16)
    rnd = np.random.default_rng(0)
    base = rnd.standard_normal(32)
    near = [(i, (base + 0.15 * rnd.standard_normal(32)).tolist(), 1) for i in range(60)]
    same = [(100 + i, base.tolist(), 1) for i in range(20)]
    odd = [(200, None, 1), (201, [0.0] * 32, 1), (202, [float("nan")] + base.tolist()[1:], 1), (203, base.tolist(), None), (204, base.tolist(), 2), (205, [], 1), (206, (base * 3).tolist(), 1), (207, base.tolist()[:16], 1), (208, [None] + base.tolist()[1:], 1)]
    rows = near + same + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for i, v, l in good:
        for j, w, m in good:
            if i != j and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(s) for i, s in links.items()}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    assert {i: r.component_id for i, r in got.items()} == {i: reach(i) for i in links}
    assert embedding_dedup(df.limit(0)).count() == 0


def test_repeated_ids_and_extreme_sizes(spark):
    """Rows of one vec_id are vectors of their own; sizes of 1e200 and 1e-200 don't matter to a cosine."""
    rnd = np.random.default_rng(1)
    a, b = rnd.standard_normal((2, 24))
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (6, (a * 1.01).tolist(), 1), (7, (b + 0.01).tolist(), 1)]
    rows += [(10, [1e200, 1e200, 0.0], 2), (11, [1e200, 1.1e200, 0.0], 2), (12, [1e-200, 1e-200, 0.0], 2), (13, [1e-200, 0.0, 1e-200], 2), (None, a.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup(df).collect())
    assert got == [(0, 0, 0), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (10, 2, 10), (11, 2, 10), (12, 2, 10), (13, 0, 13)]
    assert np.allclose((units(np.array([[1e308, -1e308, 0], [5e-324, 0, 0]])) ** 2).sum(axis=1), 1)


def test_shape():
    assert 0.89 < agreement(0.3742) < 0.91 and 0.62 < agreement(2**0.5) < 0.64
    k, tables = shape(50_000, 0.93)
    assert (1 - agreement(0.14**0.5) ** k) ** tables <= 1e-3 and 50_000 * agreement(2**0.5) ** k <= 1


def test_recall(spark):
    """Chains of vectors near the threshold: ids divisible by 10 against all rows by brute force."""
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((400, 48))
    x = units(np.repeat(centres, 10, axis=0) + 0.26 * rnd.standard_normal((4000, 48)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup(df).collect()}
    want = (x[::10] @ x.T >= 0.93).sum(axis=1) - 1
    have = np.array([got[i] for i in range(0, 4000, 10)])
    assert want.sum() > 500 and (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_nothing_is_broadcast(spark, monkeypatch):
    """Written tables of ids are far smaller than their rows, so their files' sizes must not send them through the driver."""
    plans = []

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr("chronolith.llm.components.written", told)
    monkeypatch.setattr("chronolith.llm.embedding_dedup.written", told)
    rnd = np.random.default_rng(4)
    x = np.repeat(rnd.standard_normal((20, 16)), 3, axis=0) + 0.01 * rnd.standard_normal((60, 16))
    out = embedding_dedup(spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and sum("SortMergeJoin" in p for p in plans) > 4
    assert not [p for p in plans if "Broadcast" in p]


def test_strangers_in_a_bucket():
    """Of one bucket, just those end up joined that chains of vectors within NEAR signs of each other join."""
    rnd = np.random.default_rng(5)
    groups = [c + noise * rnd.standard_normal((40, 32)) for c, noise in zip(rnd.standard_normal((6, 32)), (0.05, 0.2, 0.4, 0.5, 0.6, 0.7))]
    x = np.concatenate([rnd.standard_normal((300, 32)), *groups, groups[1] * 2])
    signs = np.packbits(x @ rnd.standard_normal((32, 256)) > 0, axis=1).view(np.uint64)
    apart = np.bitwise_count(signs[:, None] ^ signs[None]).sum(axis=-1)
    nodes = rnd.permutation(len(x)).astype(np.int64) + 100

    def groups_of(links):
        same = np.arange(len(x))
        for a, b in links:
            same[same == same[b]] = same[a]
        return {frozenset(np.flatnonzero(same == g).tolist()) for g in np.unique(same)}

    row = {"bucket": [0], "sigs": [planes(np.zeros(len(x), np.uint64))], "nodes": [planes(nodes)], "signs": [signs.tobytes()]}
    got = _bucket_forest((0,), pa.table(row)).to_pydict()
    place = np.argsort(nodes)
    links = [(place[a - 100], place[b - 100]) for a, b in zip(got["a"], got["b"])]
    want = groups_of(forest(np.argwhere(apart <= NEAR), len(x)))
    assert groups_of(links) == want and len(want) > 300 and max(map(len, want)) > 60
    assert all(apart[a, b] <= NEAR for a, b in links)
