"""Session logs: one JSON message per line, tool calls joined to their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "type string, message struct<content:array<struct<type:string,name:string,input:string,"
    "id:string,tool_use_id:string,content:string>>>"
)


def tool_calls(messages: DataFrame, scope: str = "session_id", order: str = "line_no",
               name_contains: str | None = None) -> DataFrame:
    """One row per tool call with its result.  ``messages`` has scope, order, type, message; a
    result's content may be text or an array of blocks with text."""
    blocks = messages.select(scope, order, "type", F.posexplode("message.content").alias("pos",
                                                                                        "b"))
    calls = blocks.filter((F.col("type") == "assistant") & (F.col("b.type") == "tool_use"))
    if name_contains:
        calls = calls.filter(F.contains("b.name", F.lit(name_contains)))
    content = F.col("b.content")
    parts = F.transform(F.from_json(content, "array<struct<text:string>>"),
                        lambda p: F.coalesce(p.text, F.lit("")))
    text = F.when(F.startswith(content, F.lit("[")), F.array_join(parts, "")).otherwise(content)
    results = blocks.filter((F.col("type") == "user") & (F.col("b.type") == "tool_result")
                            & F.col("b.tool_use_id").isNotNull()).groupBy(
        scope, F.col("b.tool_use_id").alias("call_id")).agg(
        F.max_by(text, F.struct(order, "pos")).alias("response"))
    return calls.select(
        scope, F.struct(order, "pos").alias("at"), F.col("b.name").alias("name"),
        F.col("b.id").alias("call_id"),
        # Spacing in the log file is not part of the input.
        F.coalesce(F.to_json(F.try_parse_json("b.input")), "b.input").alias("input")).join(
        results, [scope, "call_id"], "left")


def read_session_log(spark: SparkSession, path: str, name_contains: str | None = None
                     ) -> DataFrame:
    """Tool calls of every log file under ``path``; the file is the session."""
    raw = spark.read.schema(MESSAGE).json(path).select(
        F.col("_metadata.file_path").alias("session_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("line_no"),
        "type", "message")
    return tool_calls(raw, name_contains=name_contains)
