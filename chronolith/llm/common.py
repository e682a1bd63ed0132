"""What the training-data operators share: scratch tables, size-checked joins and numpy kernels over text bytes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of a (key, few bytes) table that may be broadcast: about 16-48 bytes each once hashed, so 100 MB at most.
BROADCAST_ROWS = 1_000_000
#: Bytes of a per-document table that may be broadcast.
BROADCAST_BYTES = 24_000_000


# ---------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_bits(spark: SparkSession, per_partition: int = 4) -> int:
    """Bits of a bucket number so that each shuffle partition gets some buckets; grows with the cluster's setting."""
    return max(6, int(np.ceil(np.log2(max(2, per_partition * shuffle_partitions(spark))))))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of ids) with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The size chooses the way of a join only; results are the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


def columns_guarded(docs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the ``wanted`` columns, cast. Columns beyond these can't clash with names used inside an operator."""
    return docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``number``, in the order of doc_id (null first), digest of the text and copy.

    Rows have numbers of their own, except that rows equal in text and in a doc_id that isn't null share one. Where
    doc_ids tell all rows apart, they are the numbers; else the rows are written in that order.
    """
    least = np.iinfo(np.int64).min
    n, known, distinct, low = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id"), F.min("doc_id")).first()
    if known == distinct and (n == known or (n == known + 1 and (low is None or low > least))):
        return docs.withColumn("number", F.coalesce("doc_id", F.lit(least)))
    wide = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("copy", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    order = ["doc_id", "digest", "copy"]

    def run(batches):
        at, before = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            numbers = []
            for key in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()):
                at += key[0] is None or key != before
                before = key
                numbers.append(at)
            kept = [c for c in batch.schema.names if c not in ("digest", "copy")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(numbers, pa.int64())], [*kept, "number"])

    ordered = wide.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(run, StructType([*docs.schema.fields, StructField("number", LongType())])), "numbered")


# ---------------------------------------------------------------- packing arrays into binary cells


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, lowest bytes of all values first; the shuffle's compression then finds the empty high bytes."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    n = len(b) // size
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, n).T).reshape(-1).view(kind) if n else np.empty(0, kind)


def cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def grouped(make):
    """For applyInArrow: ``make(key, [table])`` yields record batches, at least one."""

    def run(key, table):
        out = pa.Table.from_batches(list(make(key, [table])))
        give_back()
        return out

    return run


def mapped(make):
    """For mapInArrow: ``make(batches)``, and then freed memory goes back to the system."""

    def run(batches):
        yield from make(batches)
        give_back()

    return run


def give_back() -> None:
    """Workers are used again by later stages; what the allocator keeps after large arrays would add up in an executor."""
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- hashing

#: Bases of rolling hashes: odd, so they have inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables or len(_tables[which][0]) < n + 1:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            a = np.full(max(n + 1, 1 << 16), base, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _tables[which] = (made[0], made[1])
    return _tables[which]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit hashes of any spans of a byte array in constant time each, from one pass of prefix sums.

    ``which`` (0 or 1) chooses the base; both together are a 128-bit hash.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        p, self.q = _powers(n, which)
        self.c = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.c[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.q[start])

    def windows(self, width: int) -> np.ndarray:
        """Of each span of ``width`` bytes."""
        n = len(self.c) - width
        return mix((self.c[width:] - self.c[:n]) * self.q[:n]) if n > 0 else np.empty(0, np.uint64)


_P31 = (1 << 31) - 1
#: Bases of polynomials modulo 2**31 - 1.
_PRIME_BASES = (0x4C957F2D, 0x2545F491)
_prime_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**31 - 1, four bytes each, as workers keep them."""
    if which not in _prime_tables or len(_prime_tables[which][0]) < n + 1:
        size, made = max(n + 1, 1 << 16), []
        for base in (_PRIME_BASES[which], pow(_PRIME_BASES[which], -1, _P31)):
            a, k = np.ones(size, np.uint32), 1
            while k < size:
                more = min(k, size - k)
                a[k : k + more] = a[:more] * np.uint64(pow(base, k, _P31)) % np.uint64(_P31)
                k += more
            made.append(a)
        _prime_tables[which] = (made[0], made[1])
    return _prime_tables[which]


class PrimeRolling:
    """62-bit hashes of spans by two polynomials modulo the prime 2**31 - 1.

    Modulo a power of two, some texts collide for every base (those in which two words follow one another as in the
    Thue-Morse sequence); modulo a prime they don't. So what is decided by hashes alone takes these beside ``Rolling``'s.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.tables = []
        for which in range(2):
            p, q = _prime_powers(n, which)
            c = np.zeros(n + 1, np.uint64)
            terms = (data.astype(np.uint64) + np.uint64(1)) * p[:n]  # below 2**40
            np.cumsum((terms & np.uint64(_P31)) + (terms >> np.uint64(31)), out=c[1:])  # below 2**64 for 2**32 bytes
            self.tables.append((c, q))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        prime = np.uint64(_P31)
        high, low = ((c[end] - c[start]) % prime * q[start] % prime for c, q in self.tables)
        return (high << np.uint64(31)) | low


# ---------------------------------------------------------------- texts as bytes


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks_of(offsets: np.ndarray, size: int):
    """Ranges (lo, hi) of rows that hold about ``size`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


#: Classes of bytes: white space is 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits, '_' and all beyond ASCII, 2 other signs
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def words_of(data: np.ndarray, offsets: np.ndarray, signs_apart: bool = False, telling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the rows in order; A-Z count as a-z. ``signs_apart``: runs of signs are words of their own.

    ``telling``: hashes for those who take words of equal hashes as equal. Each byte is spread together with its place in the word
    before they are added up, so no structure of a word can make hashes meet.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = _KIND[data] if signs_apart else (~_SPACE[data]).astype(np.uint8)
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    rows = np.searchsorted(offsets, start, "right") - 1
    if not telling:
        return Rolling(_LOWER[data]).span(start, end), rows
    if not len(start):
        return np.empty(0, np.uint64), rows
    place = np.arange(len(data), dtype=np.uint64)
    place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data)))).astype(np.uint64)
    place <<= np.uint64(8)
    place |= _LOWER[data]
    place += np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(place), out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64)), rows


_K = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles_of(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> list[np.ndarray]:
    """Per row its sorted distinct hashes of ``width`` consecutive words; of fewer words, one hash of all; of none, nothing."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    m = len(words) - width + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for k in range(width if m > 0 else 0):
        grams += words[k : k + m] * _K[k]
    grams = mix(grams)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mix((words[lo:hi] * _K[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


# ---------------------------------------------------------------- counts in a table of fixed size

COUNTS = "block int, counts binary"


def counts_batch(counts: np.ndarray, name: str, block_bits: int = 14) -> pa.RecordBatch:
    """The table of a task as rows (name, block, counts) of its blocks that hold anything."""
    blocks = [(b, c) for b, c in enumerate(counts.reshape(-1, 1 << block_bits)) if c.any()]
    packed = [zlib.compress(planes(c.astype(np.int64)), 1) for _, c in blocks]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(blocks), pa.string()), pa.array([b for b, _ in blocks], pa.int32()), pa.array(packed, pa.binary())], ["name", "block", "counts"])


def counts_summed(rows: DataFrame, slots: int, block_bits: int = 14) -> dict[str, np.ndarray]:
    """Per name, the sum of all tasks' tables; the driver gets ``slots`` counts a name."""

    def add(key, pdf):
        total = sum(unplanes(zlib.decompress(c), np.int64) for c in pdf.counts)
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "counts": [zlib.compress(planes(total), 1)]})

    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("name", "block").applyInPandas(add, "name string, " + COUNTS).toPandas().itertuples():
        table = out.setdefault(r.name, np.zeros(slots, np.int64))
        table[r.block << block_bits : (r.block + 1) << block_bits] = unplanes(zlib.decompress(bytes(r.counts)), np.int64)
    return out


def bounded_share(rows: DataFrame, bound: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` if they are at most ``bound``, else those that are different in ``key`` and whose hash falls into a share.

    The share is smaller than ``bound`` by four times its spread, so that more of them are next to impossible.
    """
    n = rows.count()
    if n <= bound:
        return rows
    rows = rows.dropDuplicates([*key])
    n, aim = rows.count(), max(bound / 4, bound - 4 * bound**0.5)
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * aim / n))
