"""What the operators share: shared-folder staging, bounded semi-joins, connected components, and numpy
views of the words of Arrow text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys a semi-join may broadcast; beyond it both sides are shuffled.
BROADCAST_KEYS = 500_000
#: Links that a task of the component search reads.
LINKS_A_TASK = 100_000
#: Bytes of text that numpy works on at once.
CHUNK = 1 << 19
#: Space and the control characters tab to carriage return end a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where the session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None)
                            or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table: Parquet in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, times: int = 1):
    """Packed blocks grouped by their range of hashes. The number of partitions is stated, for blocks are
    denser than the rows that adaptive execution judges partitions by."""
    return df.repartition(times * shuffle_width(df.sparkSession), "bucket").groupBy("bucket")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in keys. Keys are broadcast up to BROADCAST_KEYS rows, else shuffled."""
    keys = keys.select(key).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_semi")


def held_out(id_column: str = "doc_id", modulus: int = 4) -> F.Column:
    """Rows kept out of training: crc32 of the id as text leaves 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (id, component), component the smallest id.

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes, so paths shrink
    by halves. A node with many links is only ever grouped for a minimum, which combines before the
    shuffle, and joined back. Links never grow in number, so a few are not read by more tasks than they need, each
    of which would leave files of its own for every shuffle. An empty table gives an empty table."""
    links = checkpoint(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = links.count() // LINKS_A_TASK + 1
    if tasks < links.rdd.getNumPartitions():
        links = links.coalesce(tasks)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))))
                         .alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        following = checkpoint(small.coalesce(tasks))
        left = links.select("u", "v", F.lit(1).alias("s")).unionByName(
            following.select("u", "v", F.lit(-1).alias("s")))
        changed = left.groupBy("u", "v").agg(F.sum("s").alias("s")).where("s <> 0").limit(1).count()
        links = following
        if not changed:
            roots = links.select(F.col("v").alias("id"), F.col("v").alias("component"))
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def released(task):
    """A task function for batches that gives memory back when it ends: workers wait, idle, for other tasks."""
    def run(batches):
        yield from task(batches)
        give_back()
    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def separator_table(bytes_: tuple[int, ...] = SPACES) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(bytes_)] = True
    return table


LOWER = lower_table()
IS_SPACE = separator_table()


@dataclass
class Texts:
    """Some rows of a batch: their bytes in one buffer, row i from offsets[i] to offsets[i + 1]."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def texts(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """A string column in pieces of about limit bytes, whole texts always; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Texts(at, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a Texts: byte ranges in buf (lower-cased A-Z), the row of each, a 64-bit hash of each;
    row i has the words first[i] to first[i + 1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(t: Texts, separators: np.ndarray = IS_SPACE) -> Words:
    buf = LOWER[t.buf]
    inside = ~separators[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[t.offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, t.offsets)
    row = np.repeat(np.arange(t.rows), np.diff(first))
    return Words(buf, starts, ends, row, first, span_hash(buf, starts, ends))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; the same bytes have the same hash anywhere."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
    size = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + size * np.uint64(0xD6E8FEB86659FD93))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that start at each word; the last k - 1 have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i, weight in enumerate(mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)):
        out += hashes[i: i + n] * weight
    return mix(out)


def phrase_hash(words_: list[str]) -> int:
    """The hash that runs() gives the same words in a row."""
    parts = [w.encode() for w in words_]
    ends = np.cumsum([len(p) for p in parts])
    hashes = span_hash(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    return int(runs(hashes, len(parts))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
