"""WARC archives: written by Spark's text writer, read by a Python data source.

A record is its header lines, a blank line, the block, and two line ends; a text row whose line separator is those two
line ends is a record, so ``df.write.text`` writes archives with Spark's committers on any file system. The data source
plans one partition per archive file (smaller ones are grouped), parses the header of each record first, and skips, by
its length, the block of a record whose type or header fails a pushed-down predicate or whose payload isn't asked for.
An archive may also be gzip with a member for each record (name ends in .gz); one archive is never split, as a payload
may hold what looks like a record. A record without a valid Content-Length is an error that names the file and byte; a
response without the blank line after its HTTP header has an empty payload.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronolith.llm.common import columns_guarded, scratch_path, written

END = "\r\n\r\n"
VERSION = "WARC/1.1"
MIN_REVISIT = 1000  # payloads under so many bytes are always written out
GROUP_BYTES = 64 << 20  # small archives are read together up to so many bytes
#: Header of each column. Fixed values of the format, and three fields of our own.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-ID",
    "refers_to_page": "X-Refers-To-Page-ID",
    "payload_length": "X-Payload-Length",
}
_NUMBERS = {"page_id", "refers_to_page", "payload_length"}
SCHEMA = StructType([StructField(c, LongType() if c in _NUMBERS else StringType()) for c in HEADERS] + [StructField("payload", StringType())])


class _Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema]
        unknown = [c for c in self.columns if c not in HEADERS and c != "payload"]
        if unknown:
            raise ValueError(f"a WARC record has no column {unknown}")
        self.root = options.get("path")
        self.want: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        """Equality, membership and not-null tests of header columns are decided before a block is read."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.want.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.want.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.want.append((column, None))
            else:
                yield f

    def partitions(self):
        fs, root = _file_system(self.root)
        from pyarrow.fs import FileSelector

        found = [i for i in fs.get_file_info(FileSelector(root, recursive=True)) if i.is_file and i.size and not re.match(r"[._]", i.base_name)]
        groups, held = [], GROUP_BYTES
        for i in sorted(found, key=lambda i: i.path):
            if held + i.size > GROUP_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(i.path)
            held += i.size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        fs, _ = _file_system(self.root)
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                try:
                    for member in _members(raw) if path.endswith(".gz") else [raw]:
                        yield from self.records(member)
                except ValueError as wrong:
                    raise ValueError(f"{path}: {wrong}") from wrong

    def records(self, raw):
        at = 0
        with_payload = "payload" in self.columns
        while head := _head(raw, at):
            fields, start = head
            said = fields.get("content-length", "")
            if not said.isdecimal():
                raise ValueError(f"the record at byte {at} has no valid Content-Length")
            length = int(said)
            row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            for c in _NUMBERS:
                row[c] = int(row[c]) if row[c] is not None and re.fullmatch(r"-?\d+", row[c]) else None
            at = start + length + len(END)
            if all(row[c] is not None if values is None else row[c] in values for c, values in self.want):
                row["payload"] = None
                if with_payload and row["warc_type"] == "response":
                    _, _, payload = raw.read_at(length, start).partition(END.encode())
                    row["payload"] = payload.decode("utf-8", "replace")
                yield tuple(row[c] for c in self.columns)


class _Held:
    """A record in memory, read like a file."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, at: int) -> bytes:
        return self.data[at : at + size]


def _members(raw):
    """The members of a gzip file, one after another."""
    import zlib

    unpack, out, rest = zlib.decompressobj(31), [], b""
    while part := rest or raw.read(1 << 20):
        out.append(unpack.decompress(part))
        rest = unpack.unused_data
        if unpack.eof:
            yield _Held(b"".join(out))
            unpack, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("cut gzip member")


def _head(raw, at: int):
    """(fields by lower-case name, where the block starts) of the record at ``at``; None at the end of the file."""
    size = 4096
    while True:
        part = raw.read_at(size, at)
        if not part:
            return None
        stop = part.find(END.encode())
        if stop >= 0:
            break
        if len(part) < size:
            raise ValueError(f"cut record at byte {at}")
        size *= 4
    first, *lines = part[:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, at + stop + len(END)


def _file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if re.match(r"\w+:", path) else (LocalFileSystem(), path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; ``.schema(...)`` with fewer columns skips what they don't need."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archives at ``path``. Predicates reach the reader by a setting of the session, which this call switches on."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default, and refused by sources that push down
    schema = StructType([f for f in SCHEMA if columns is None or f.name in columns])
    return spark.read.format("warc").schema(schema).load(path)


def _record_id(page):
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _field(name: str, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html): payload the html in UTF-8, null meaning empty.

    Of records with equal payloads of at least MIN_REVISIT bytes that with the largest page_id is a response, the others
    revisit it (rows that repeat that page_id are responses too); smaller ones are all responses. A row with a null
    page_id is a response and never revisited. Rows that share a page_id are judged by their own payloads. Line ends in a url are percent-encoded; a null url has no header line.
    """
    rows = columns_guarded(pages, {"page_id": "long", "url": "string", "html": "string"}).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # digests only: the payloads stay where they are until the join with the few digests that repeat
    ids = written(rows.select("page_id", "bytes", "sha1"), "warc-digests")
    again = ids.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    revisits = written(ids.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).join(again, "sha1").where("page_id <> first").select("page_id", "sha1", "first").distinct(), "warc-revisits")
    rows = rows.join(revisits, ["page_id", "sha1"], "left")
    revisit = F.col("first").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        _field("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:none>"))),
        _field("WARC-Target-URI", url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _field("WARC-Refers-To", _record_id(F.col("first"))),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("X-Refers-To-Page-ID", F.col("first").cast("string")),
        _field("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    told = ["warc_type", "page_id", "payload_digest", "refers_to_page", "payload_length"]
    # each type by a predicate that the reader decides on headers; of revisits no block is read
    responses = read_warc(spark, path, [*told, "payload"]).where("warc_type = 'response'")
    revisits = read_warc(spark, path, told).where("warc_type = 'revisit'")
    of_response = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
    of_revisit = revisits.select("page_id", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
    return of_response.unionByName(of_revisit)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first <> p.page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000
"""
