import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm.common import scratch_path
from chronolith.llm.token_store import at_places, checksums, op13_token_orc, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 0]


def crc(a):
    return zlib.crc32(np.array(a, "<u4").tobytes())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for d in docs:
        a = ids(d.text)
        want.append((d.doc_id, start, len(a), crc(a)))
        start += len(a)
    assert sorted(map(tuple, op13_token_orc(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


@pytest.fixture(scope="module")
def stored(spark):
    """Documents 0, 3, 6, ... of many ids, in a few files."""
    rows = [(3 * i, f"the {i}th of these documents " * 20) for i in range(6_000)]
    path = scratch_path(spark, "t")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, parts=3)
    return path, rows


def scanned(df):
    """Rows that the scan of the documents gave, by the plan's own count."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan orc") and "ids" in node.schema().simpleString():
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return found[0]


def test_stripes_and_groups_are_pruned(spark, stored):
    path, rows = stored
    one = read_tokens(spark, path, F.col("doc_id") == 9_000)
    assert "EqualTo(doc_id,9000)" in one._jdf.queryExecution().toString()
    got = one.collect()
    assert [(r.doc_id, r.ids) for r in got] == [(9_000, ids(rows[3_000][1]))]
    assert got[0].start == sum(len(ids(t)) for _, t in rows[:3_000])
    assert scanned(read_tokens(spark, path, F.col("doc_id") == 9_000)) <= 2_000  # of 6,000
    assert scanned(read_tokens(spark, path, F.col("doc_id") == 9_001)) <= 1_000  # within the range, but the Bloom filter knows better
    assert scanned(read_tokens(spark, path, F.col("doc_id").between(0, 30))) <= 2_000


def test_files_have_stripes_indexes_and_bloom_filters(spark, stored):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{stored[0]}/documents")
    files = sorted((f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")), key=lambda p: p.getName())
    assert len(files) == 3
    last = -1
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1_000
        assert list(reader.getSchema().getFieldNames()) == ["doc_id", "part", "local_start", "n_tokens", "ids"]
        low, high = reader.getStatistics()[1].getMinimum(), reader.getStatistics()[1].getMaximum()
        assert last < low <= high  # files follow one another
        last = high
        kinds = {s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList() if s.getColumn() == 1}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_places(spark, stored):
    path, rows = stored
    flat, owner = [], []
    for d, t in rows[:50]:
        a = ids(t)
        flat += a
        owner += [d] * len(a)
    asked = spark.createDataFrame([(i,) for i in range(0, len(flat), 37)] + [(-1,), (1 << 40,)], "place long")
    got = {r.place: (r.doc_id, r.id) for r in at_places(spark, path, asked, "place").collect()}
    assert got == {i: (owner[i], flat[i]) for i in range(0, len(flat), 37)}


def test_edges(spark):
    long = "word " * 300_000
    rows = [(5, "b"), (None, "n"), (5, "a"), (5, "b"), (7, None), (1, ""), (None, "m"), (-2, long), (9, "<|endoftext|> é中")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, ids string").repartition(4)
    path = scratch_path(spark, "t")
    write_tokens(df, path, PATH)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -2, 1, 5, 5, 5, 7, 9]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), ids(t)) for d, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert sorted(r.ids_crc32 for r in checksums(read_tokens(spark, path)).collect()) == sorted(crc(ids(t)) for _, t in rows)
    again = scratch_path(spark, "t")
    write_tokens(df.repartition(2), again, PATH)
    assert read_tokens(spark, again).orderBy("start").collect() == got
    empty = scratch_path(spark, "t")
    write_tokens(df.limit(0), empty, PATH)
    assert checksums(read_tokens(spark, empty)).collect() == []


def test_one_doc_id_of_many_rows_has_many_parts(spark):
    df = spark.range(4_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(77).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = scratch_path(spark, "t")
    write_tokens(df, path, PATH, parts=8)
    sizes = [r.n_docs for r in spark.read.orc(f"{path}/manifest").collect()]
    assert sum(sizes) == 4_000 and max(sizes) < 1_000
