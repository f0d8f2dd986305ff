"""Page corpora, captured accessibility trees, frame trees and finished snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATTRIBUTES, SNAPSHOT_FILE, node_struct

AX_NODE = (
    "struct<nodeId:string,ignored:boolean,role:struct<value:string>,name:struct<value:string>,"
    "properties:array<struct<name:string,value:struct<value:string>>>,backendDOMNodeId:bigint>"
)


def read_pages(spark: SparkSession, path: str, columns=("page_id", "url", "html"),
               min_partitions: int | None = None) -> DataFrame:
    """Page corpus.  Parsing is the heavy step, so an input of fewer splits than cores (small or
    badly split files) is spread out first; a large corpus keeps its scan partitions."""
    pages = spark.read.parquet(path).select(*columns)
    want = min_partitions or spark.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < want:
        pages = pages.repartition(want, columns[0])
    return pages


def ax_nodes(df: DataFrame, column: str, key: str = "snapshot_id") -> DataFrame:
    """Accessibility rows from JSON text {nodes: [...]}: ignored rows and rows without a document
    node are dropped; of several rows for one document node the last counts."""
    parsed = df.select(F.col(key).alias("snapshot_id"), F.from_json(
        column, f"struct<nodes:array<{AX_NODE}>>").alias("t"))
    rows = parsed.select("snapshot_id", F.posexplode("t.nodes").alias("ax_order", "n")).filter(
        ~F.coalesce("n.ignored", F.lit(False)) & F.col("n.backendDOMNodeId").isNotNull())
    props = F.map_from_entries(F.transform(
        F.filter(F.coalesce("n.properties", F.array().cast(
            "array<struct<name:string,value:struct<value:string>>>")),
            lambda p: p["name"].isNotNull()),
        lambda p: F.struct(p["name"], p["value"]["value"])))
    return rows.select(
        "snapshot_id", F.col("n.backendDOMNodeId").alias("id"),
        F.col("n.role.value").alias("role"), F.col("n.name.value").alias("name"),
        props.alias("properties"), "ax_order").groupBy("snapshot_id", "id").agg(
        F.max_by(F.struct("role", "name", "properties", "ax_order"), "ax_order").alias("a")
    ).select("snapshot_id", "id", "a.*").hint("merge")


def read_ax_json(spark: SparkSession, path: str) -> DataFrame:
    """Accessibility rows from files of one JSON object per capture with snapshot_id and nodes."""
    raw = spark.read.schema(f"snapshot_id string, nodes array<{AX_NODE}>").json(path)
    return ax_nodes(raw.select("snapshot_id", F.to_json(F.struct("nodes")).alias("j")), "j")


def read_snapshots_json(spark: SparkSession, path: str,
                        multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(captures, nodes) from finished snapshots, one JSON object each."""
    raw = spark.read.schema(SNAPSHOT_FILE).option("multiLine", multi_line).json(path)
    return split_snapshots(raw)


def split_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capture rows and node rows of a table with one nested ``nodes`` array per capture."""
    captures = raw.select(
        "snapshot_id", "page_id", "session_id", "step", "url", "title", "language", "captured_at",
        F.struct(F.col("viewport.width").alias("w"), F.col("viewport.height").alias("h"))
        .alias("viewport"), "scroll", "meta")
    n = raw.select("snapshot_id", "page_id", "step", F.posexplode("nodes").alias("pos", "n"))
    attrs = F.when(F.col("n.attributes").isNotNull(), F.col("n.attributes")).cast(ATTRIBUTES)
    nodes = n.select(
        "snapshot_id", "page_id", "step", "n.node_id",
        F.coalesce("n.backend_node_id", F.col("n.node_id").try_cast("bigint"))
        .alias("backend_node_id"), "n.frame_id", "n.loader_id", "n.kind",
        F.coalesce("n.label", F.lit("")).alias("label"), "n.where",
        node_struct("layout", {"bbox": F.col("n.layout.bbox"),
                               "display": F.col("n.layout.display"),
                               "screen_zone": F.col("n.layout.screen_zone"),
                               "z_index": F.col("n.layout.zIndex")}).alias("layout"),
        "n.state", "n.find", attrs.alias("attributes"),
        F.coalesce("n.implicitly_interactive", F.lit(False)).alias("implicitly_interactive"),
        F.col("pos").cast("bigint").alias("doc_order"))
    return captures, nodes


def frame_loaders(df: DataFrame, column: str, key: str = "snapshot_id") -> DataFrame:
    """(snapshot_id, frame_id, loader_id, is_main, error) from nested frame-tree JSON; the main frame is
    the one without a parent. A tree that cannot be read gives one row with its error and nothing else."""
    source = df.select(F.col(key).alias("snapshot_id"), F.col(column).alias("doc"))
    kind = source.schema["snapshot_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("snapshot_id", "frame_id", "loader_id",
                                                    "is_main", "error")}
            for k, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    todo = [json.loads(doc)] if doc else []
                    while todo:
                        tree = todo.pop()
                        frame = tree["frame"]
                        rows.append((k, frame["id"], frame.get("loaderId"), not frame.get("parentId"), None))
                        todo.extend(tree.get("childFrames") or [])
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows = [(k, None, None, None, f"{type(e).__name__}: {e}")]
                for row in rows:
                    for name, value in zip(out, row):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["snapshot_id"], batch.schema.field(0).type),
                 pa.array(out["frame_id"], pa.string()), pa.array(out["loader_id"], pa.string()),
                 pa.array(out["is_main"], pa.bool_()), pa.array(out["error"], pa.string())], names=list(out))

    return source.mapInArrow(
        run, f"snapshot_id {kind}, frame_id string, loader_id string, is_main boolean, error string").hint("merge")
