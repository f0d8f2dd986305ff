"""Streaming forms of the log operators that need no custom state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_calls(requests: DataFrame, endings: DataFrame, delay: str = "10 minutes",
                   longest: str = "10 minutes") -> DataFrame:
    """Stream-stream left join of requests with their completions.

    Both sides have (page_id, request_id, navigation_id, ts, ...) and need event-time order only up
    to ``delay``.  A completion of an earlier navigation carries another navigation id and does not
    match.  Calls without completion appear once the watermark has passed ``longest``."""
    r = requests.withWatermark("ts", delay).alias("r")
    e = endings.select(
        F.col("page_id").alias("e_page"), F.col("request_id").alias("e_request"),
        F.col("navigation_id").alias("e_nav"), F.col("event").alias("outcome"),
        F.col("ts").alias("ended_at"), *[c for c in ("status",) if c in endings.columns]
    ).withWatermark("ended_at", delay).alias("e")
    cond = (
        (F.col("page_id") == F.col("e_page")) & (F.col("request_id") == F.col("e_request"))
        & (F.col("navigation_id") == F.col("e_nav")) & (F.col("ended_at") >= F.col("ts"))
        & (F.col("ended_at") <= F.col("ts") + F.expr(f"INTERVAL {longest}")))
    return r.join(e, cond, "leftOuter").drop("e_page", "e_request", "e_nav")


def call_stats(calls: DataFrame) -> DataFrame:
    """Running totals per page and resource type; write in update or complete mode."""
    pending = F.col("status").isNull() & ~F.col("failed")
    return calls.groupBy("page_id", "resource_type").agg(
        F.count("*").alias("total"), F.count_if(pending).alias("pending"),
        F.count_if("failed").alias("failed"))


def mutation_bursts(mutations: DataFrame, quiet: str = "100 milliseconds",
                    delay: str = "1 minute") -> DataFrame:
    """Bursts as session windows: one row per run of mutations once it fell quiet."""
    return (
        mutations.withWatermark("ts", delay)
        .groupBy("page_id", F.session_window("ts", quiet).alias("w"))
        .agg(F.count("*").alias("mutations"), F.min("ts").alias("start"),
             F.max("ts").alias("end"))
        .drop("w")
    )


def dependency_counts(edges: DataFrame) -> DataFrame:
    """Running dependency counts; write in update or complete mode."""
    return edges.groupBy("page_id", "source_eid", "target_eid", "type").agg(
        F.count("*").alias("observations"), F.max("step").alias("last_step"))
