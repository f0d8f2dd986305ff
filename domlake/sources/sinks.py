"""Writers for batch tables and streams."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import latest_snapshot


def write_nodes(nodes: DataFrame, captures: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes partitioned by capture date and sorted by page inside each file."""
    day = captures.select("snapshot_id", F.to_date("captured_at").alias("capture_date"))
    out = nodes.join(day, "snapshot_id")
    keys = [c for c in ("page_id", "snapshot_id") if c in out.columns]
    # Spread a day over tasks by capture, so that one busy page does not become one file.
    out.repartition("capture_date", "snapshot_id").sortWithinPartitions(
        "capture_date", *keys).write.mode(mode).partitionBy("capture_date").parquet(path)


def write_digest(digests: DataFrame, path: str, mode: str = "append") -> None:
    digests.write.mode(mode).parquet(path)


def write_digest_text(digests: DataFrame, path: str, mode: str = "append") -> None:
    """Digests as plain text files, one capture after the other."""
    digests.select(F.col("digest").alias("value")).write.mode(mode).text(path)


#: Captures of a bucket from which the latest-capture table gets twice as many buckets.
BUCKET_ROWS = 1_000_000


class LostBatch(ValueError):
    """A stream's batch is missing, or another writer was faster."""


@dataclass
class Manifest:
    """A version of the latest-capture table: the folder and the rows of each bucket in use, how many buckets there are,
    and the last batch of each stream that is in it."""

    version: int = -1
    buckets: int = 64
    held: dict[int, tuple[str, int]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[int]:
    """Versions that have a manifest file, complete or not."""
    fs, root = _fs(spark, f"{path}/manifest")
    if not fs.exists(root):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(root))
    return sorted(int(n[2:-5]) for n in found if n.startswith("v=") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> Manifest | None:
    fs, at = _fs(spark, f"{path}/manifest/v={version}.json")
    stream = fs.open(at)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:  # its writer died
        return None
    finally:
        stream.close()
    return Manifest(version, found["buckets"], {int(b): tuple(v) for b, v in found["held"].items()}, found["streams"])


def _newest(spark: SparkSession, path: str) -> Manifest | None:
    for version in reversed(_names(spark, path)):
        if found := _manifest(spark, path, version):
            return found
    return None


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    """Publish a version. The file is created only if it is not there, so of two writers one fails."""
    fs, at = _fs(spark, f"{path}/manifest/v={m.version}.json")
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001 - py4j wraps what the file system throws
        if not fs.exists(at):
            raise
        raise LostBatch(f"{path}: version {m.version} was written meanwhile") from e
    body = {"buckets": m.buckets, "held": {str(b): list(v) for b, v in m.held.items()}, "streams": m.streams}
    out.write(bytearray(json.dumps(body).encode()))
    out.close()


def merge_latest(batch: DataFrame, path: str, batch_id: int, stream: str = "", buckets: int = 64,
                 bucket_rows: int = BUCKET_ROWS) -> bool:
    """Fold a batch of captures into the newest-per-page table kept as versions of page buckets. False, and nothing
    done, if the batch is in it already.

    A version takes the number after the newest there is, whatever the batch's, and writes only the buckets that the
    batch touches, into a folder of its own; then a manifest names the folder of every bucket and the last
    batch of every stream. Readers follow the newest complete manifest and never see a partial state, and nothing
    that a manifest names is written again. ``stream`` tells writers apart: a new checkpoint is a new stream
    and starts over at batch 0 without touching what is there; a batch that does not follow on its stream's
    last one is an error, so none is silently lost. Once buckets hold ``bucket_rows`` on average the table is
    rewritten with twice as many."""
    spark, names = batch.sparkSession, batch.columns
    old = _newest(spark, path) or Manifest(buckets=buckets)
    last = old.streams.get(stream, -1)
    if batch_id <= last:
        return False
    if batch_id != last + 1:
        raise LostBatch(f"{path}: batch {batch_id} of stream {stream!r} does not follow on {last}")
    m = Manifest(max([old.version, *_names(spark, path)]) + 1, old.buckets, dict(old.held), old.streams | {stream: batch_id})
    grown = sum(n for _, n in old.held.values()) > bucket_rows * old.buckets
    if grown:
        m.buckets, m.held = 2 * old.buckets, {}
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(m.buckets)).cast("int")
    touched = set(old.held) if grown else set()
    now = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
    touched |= set() if grown else set(now)
    if now or touched:
        current = batch
        files = [f"{path}/data/{old.held[b][0]}/bucket={b}" for b in sorted(touched) if b in old.held]
        if files:
            current = spark.read.schema(batch.schema).parquet(*files).select(*names).unionByName(batch)
        folder = f"v={m.version}-{uuid.uuid4().hex}"
        latest_snapshot(current).select(*names).withColumn("bucket", bucket).repartition(
            "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        for r in spark.read.parquet(f"{path}/data/{folder}").groupBy("bucket").count().collect():
            m.held[r["bucket"]] = (folder, r["count"])
    _commit(spark, path, m)
    return True


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest complete version of a latest-capture table."""
    m = _newest(spark, path)
    if m is None or not m.held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{f}/bucket={b}" for b, (f, _) in sorted(m.held.items())))


def vacuum_latest(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what no manifest of the newest ``keep`` names; returns what was removed. What a writer is
    still at has a higher version than the newest manifest and stays."""
    versions = _names(spark, path)
    complete = [m for m in (_manifest(spark, path, v) for v in versions) if m][-keep:]
    needed = {(b, f) for m in complete for b, (f, _) in m.held.items()}
    newest = complete[-1].version if complete else -1
    gone = [f"{path}/manifest/v={v}.json" for v in versions if v < newest and v not in {m.version for m in complete}]
    fs, root = _fs(spark, f"{path}/data/v=*/bucket=*")
    for status in fs.globStatus(root) or []:
        at = status.getPath()
        folder, b = at.getParent().getName(), int(at.getName().split("=")[1])
        if (b, folder) not in needed and int(folder[2:].split("-")[0]) <= newest:
            gone.append(at.toString())
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), True)
    return gone


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint, over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def latest_sink(captures: DataFrame, path: str, checkpoint: str):
    """Streaming upsert of the newest capture per page.  Returns the query."""
    return captures.writeStream.foreachBatch(
        lambda df, n: merge_latest(df, path, n, stream_id(df.sparkSession, checkpoint))).option(
        "checkpointLocation", checkpoint)


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Append-only file sink for network calls or observations.  Returns the writer."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
