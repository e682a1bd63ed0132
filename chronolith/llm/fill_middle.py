"""Fill-in-the-middle arrangements of documents, cut between lines, and the texts read back from them.

Only Spark's own functions are used and no row is shuffled: one regular expression makes the array of lines, the groups of
a sha256 of seed and doc_id decide the cuts and the form, slices of the array are joined to the three pieces, and the
sentinels of an arrangement tell where its pieces are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"([^\n]*\n|[^\n]+)"


def _checked(sentinels: Sequence[str]) -> Sequence[str]:
    """A sentinel is <...> without further angle brackets, so none can arise where a text and a sentinel meet."""
    if len(set(sentinels)) != 3 or not all(re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError(f"three different sentinels of the form <...> are needed: {sentinels}")
    return sentinels


def draw(seed: int, doc_id: Column, nth: int) -> Column:
    """The ``nth`` (from 0) eight-digit group of the sha256 of seed and doc_id, as a whole number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` arranges."""
    p, s, m = _checked(sentinels)
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    # psm: <P>prefix<S>suffix, spm: <S>suffix<P>prefix
    left = lambda opening, closing: F.substring_index(F.substring_index(head, closing, 1), opening, -1)
    psm = F.concat(left(p, s), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, left(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are arranged, ``spm_percent`` of these with the suffix first; others, empty texts and texts
    that hold a sentinel are ``plain``: the output is the text, and prefix_chars and middle_chars are null. The same seed
    and doc_id always give the same cuts. A null text is empty; a null doc_id counts as an empty string in the draw and stays
    null. A line ends with its line feed; carriage returns are ordinary characters. Repeated rows give repeated rows, an
    empty table gives an empty one, other columns are ignored.
    """
    p, s, m = (F.lit(x) for x in _checked(sentinels))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT)).alias("units"), *[draw(seed, F.col("doc_id").cast("long"), i).alias(f"h{i + 1}") for i in range(4)])
    places = F.size("units").cast("long") + 1
    cut = cut.withColumns({"n": places - 1, "one": F.col("h1") % places, "two": F.col("h2") % places})
    plain = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.least("one", "two").cast("int"), F.greatest("one", "two").cast("int")
    joined = lambda start, length: F.array_join(F.slice("units", start + 1, length), "")
    parts = cut.select("doc_id", "text", "n", form.alias("form"), joined(F.lit(0), low).alias("prefix"), joined(low, high - low).alias("middle"), joined(high, F.size("units") - high).alias("suffix"))
    arranged = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    moved = F.col("form") != "plain"
    return parts.select("doc_id", "n", "form", F.when(moved, F.length("prefix").cast("long")).alias("prefix_chars"), F.when(moved, F.length("middle").cast("long")).alias("middle_chars"), arranged.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
with u as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
v as (select *, len(units) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from u),
w as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from v),
x as (select *, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m, coalesce(array_to_string(units[b + 1:], ''), '') as s from w)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from x
"""
