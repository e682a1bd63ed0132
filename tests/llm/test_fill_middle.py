import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.llm.fill_middle import ORACLE, fill_middle, op12_fill_in_middle, restored

SF = "/root/testdata/sf0.01"


def plain(doc_id, text, seed=7, percent=100, spm=50):
    """The same, by plain Python."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h4 % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, op12_fill_in_middle(spark, SF).select(*names).collect()))) == sorted(map(str, want.fetchall()))


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "\r\n\r\nx\r", "é \u0085z\n\U0001f600\nq", "x <P> y\nz", "<S>", "ends <\n>M> <M\n>", "P>\n<\nS>\n<<P\n><M\n", "line\n" * 20_000, "no line feed " * 50_000, "\x00\n\t \n"]


@pytest.mark.parametrize(("seed", "percent", "spm"), [(7, 100, 50), (8, 60, 0), (9, 100, 100), (1, 0, 50)])
def test_edges(spark, seed, percent, spm):
    rows = [(i * 31 - 40, t) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc\n"), (3, "x\ny\n"), (3, "x\ny\n"), (3, "other\n")]
    df = spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    out = fill_middle(df, seed, percent, spm).withColumn("back", restored(F.col("output"), F.col("form")))
    got = out.collect()
    want = [plain(d, t, seed, percent, spm) for d, t in rows]
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(map(str, want))
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(d), t or "") for d, t in rows)
    assert fill_middle(df.limit(0)).collect() == []


def test_other_sentinels(spark):
    df = spark.createDataFrame([(i, f"one {i}\ntwo <P>\nthree\n") for i in range(50)], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = fill_middle(df, sentinels=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == f"one {r.doc_id}\ntwo <P>\nthree\n" for r in got)
    for bad in (("<a>", "<a>", "<b>"), ("a", "<b>", "<c>"), ("<a<>", "<b>", "<c>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle(df, sentinels=bad)


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = op12_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
