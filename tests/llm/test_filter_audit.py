import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.llm.filter_audit import ORACLE, filter_audit, op11_filter_audit, steps

SF = "/root/testdata/sf0.01"
LETTERS = "ABCDE"
KEYS = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE)
    names = [d[0] for d in want.description]
    got = op11_filter_audit(spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def plain(docs, labels):
    """Document by document, one order after another."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = {}
    for d, t, s in docs:
        t, s = t or "", s or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        judged.setdefault(s, []).append(({c for c in LETTERS if fails[c]}, d))
    out = []
    for part, rows in judged.items():
        made, all_removed = [], dict.fromkeys(LETTERS, 0)
        for p in permutations(LETTERS):
            left = rows
            for i, c in enumerate(p):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                all_removed[c] += len(gone)
                failing = sum(c in f for f, _ in rows)
                made.append((part, "".join(p), i + 1, c, len(left), len(gone), failing - len(gone), sum(f == {c} for f, _ in rows), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)))
        out += [(*m, all_removed[m[3]]) for m in made]
    return sorted(out)


def tables(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, True) for r in docs], "doc_id long, text string, source string, n int, A boolean").repartition(4)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


def test_against_plain_version(spark):
    words = lambda n, k: " ".join(f"w{i % k}" for i in range(n))
    texts = ["", None, "A", words(199, 199), words(200, 200), words(200, 100), words(200, 99), words(300, 10) + " #", "ABC" + "d" * 97, "AB" + "d" * 98, "é　\x85\xa0 x" * 100, "x|y", "a\tb\x0bc\rd", words(20_000, 11_000)]
    docs = [(i, t, ("web", "book", None, "")[i % 4]) for i, t in enumerate(texts * 3)]
    docs += [(None, "x|y", "web"), (None, None, None), (7, "x|y", "web"), (7, "x|y", "book"), (7, "x|y", "web"), (2, "copy", "s"), (2, "copy", "s"), (2, "other", "s"), (-5, "x|y", "s")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 3)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (2, None, None), (999, 1, 1)]
    got = filter_audit(*tables(spark, docs, labels))
    rows = sorted(tuple(r[k] for k in KEYS) for r in got.where("not whole").collect())
    assert rows == plain(docs, labels)
    whole = sorted(tuple("all" if k == "part" else r[k] for k in KEYS) for r in got.where("whole").collect())
    merged = plain([(d, t, "all") for d, t, _ in docs], labels)
    assert whole == merged


def test_hot_texts_and_doc_ids(spark):
    """A third of the rows are copies of one text, another third share a doc_id, the rest have none."""
    docs = [(i, "the copy", "hot") for i in range(700)] + [(5, f"text {i}", "hot") for i in range(700)] + [(None, f"none {i % 9}", "cold") for i in range(700)]
    labels = [(5, 1, 1), (6, 0, 1), (6, 1, 0)]
    got = filter_audit(*tables(spark, docs, labels)).where("not whole").collect()
    assert sorted(tuple(r[k] for k in KEYS) for r in got) == plain(docs, labels)


def test_empty_and_wrong_letters(spark):
    d, labels = tables(spark, [(1, "a", "s")], [(1, 1, 0)])
    assert filter_audit(d.limit(0), labels).collect() == []
    assert len(filter_audit(d, labels.limit(0)).where("not whole").collect()) == 600
    for tests in ({"E": lambda t: t == "a"}, {"AB": lambda t: t == "a"}, {c: (lambda t: t == "a") for c in "ABCDFG"}):
        with pytest.raises(ValueError, match="letters"):
            filter_audit(d, labels, tests)


def test_other_filters(spark):
    d, labels = tables(spark, [(1, "short", "s"), (2, "a longer text", "s"), (3, "short", "s")], [(3, 1, 0)])
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost) for r in filter_audit(d, labels, {"L": lambda t: F.length(t) > 5}, "R").where("not whole").collect()}
    assert got == {("LR", 1): (2, 1, 0), ("LR", 2): (1, 1, 1), ("RL", 1): (2, 1, 1), ("RL", 2): (1, 1, 0)}


def test_orders(spark):
    rows = steps(spark, list("XYZ")).collect()
    assert len(rows) == 18 and {r.filter_order for r in rows} == {"".join(p) for p in permutations("XYZ")}
    assert [(r.before, r.after) for r in sorted(rows, key=lambda r: r.step) if r.filter_order == "ZXY"] == [(0, 1), (1, 5), (5, 7)]
