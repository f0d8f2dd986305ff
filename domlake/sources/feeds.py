"""Event feeds for batch and stream: network events and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NETWORK_EVENTS = ["request", "finished", "failed"]
MUTATION_TYPES = ["added", "removed", "text", "attribute"]


def network_source(df: DataFrame) -> DataFrame:
    """Request, finished and failed events; web sockets are left out."""
    return df.filter(F.col("event").isin(NETWORK_EVENTS)
                     & (F.coalesce("resource_type", F.lit("")) != "websocket"))


def mutation_source(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type").isin(MUTATION_TYPES))


def stream_files(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A directory of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
