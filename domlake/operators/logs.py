"""Reports over session logs: token cost per call and region, ids repeated across full digests.

``tool_calls`` rows: (session_id, call_no, name, call_id, input, response).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

NO_RESPONSE = "(no response found)"
BASELINE_TOKENS = 500


def tool_token_report(tool_calls: DataFrame) -> DataFrame:
    """Tokens per call, per session (call_no null) and overall (session_id null)."""
    response = F.coalesce(F.nullif("response", F.lit("")), F.lit(NO_RESPONSE))
    rows = tool_calls.select(
        "session_id", "call_no", estimate_tokens("input").alias("i"),
        estimate_tokens(response).alias("r"), F.length(response).alias("c"))
    return rows.rollup("session_id", "call_no").agg(
        F.count("*").alias("calls"), F.sum("i").alias("input_tokens"),
        F.sum("r").alias("response_tokens"), F.sum("c").alias("response_chars"))


def is_baseline(response="response") -> Column:
    """Full digest: announced as such or with two regions, and more than 500 tokens."""
    r = F.col(response) if isinstance(response, str) else response
    full = F.contains(r, F.lit("<baseline ")) | (
        F.regexp_count(r, F.lit('<region name="')) >= 2)
    return F.coalesce(full & (estimate_tokens(r) > BASELINE_TOKENS), F.lit(False))


def split_digest(response="response") -> Column:
    """Array of (name, part): header, observations, each region with content, trailer."""
    r = F.col(response) if isinstance(response, str) else response
    header = F.regexp_extract(r, r"(?s)^(.*?)(?=<region |<observations|\z)", 1)
    seen = F.array_join(F.regexp_extract_all(
        r, F.lit(r"(?s)(<observations.*?</observations>)"), 1), "\n")
    regions = F.transform(
        F.regexp_extract_all(r, F.lit(r'(?s)(<region name="[^"]+">.*?</region>)'), 1),
        lambda t: F.struct(F.regexp_extract(t, '^<region name="([^"]+)"', 1).alias("name"),
                           t.alias("part")))
    trailer = F.regexp_extract(r, r"(?s)^.*</region>(.*)$", 1)
    named = lambda n, t: F.struct(F.lit(n).alias("name"), t.alias("part"))
    return F.filter(F.concat(F.array(named("_header", header)), F.array(
        named("_observations", seen)), regions, F.array(named("_trailer", trailer))),
        lambda x: F.trim(F.regexp_replace(x.part, r"\s+", " ")) != "")


def region_token_share(baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens, characters and share of every part of a full digest.  A region that occurs twice
    counts with its last occurrence."""
    total = estimate_tokens("response")
    rows = baselines.select(*keys, total.alias("total"),
                            F.posexplode(split_digest()).alias("pos", "x"))
    last = rows.groupBy(*keys, "total", F.col("x.name").alias("region")).agg(
        F.max_by("x.part", "pos").alias("part"))
    tokens = estimate_tokens("part")
    return last.select(*keys, "region", tokens.alias("tokens"), F.length("part").alias("chars"),
                       (tokens / F.col("total") * 100).alias("pct"))


def digest_eids(baselines: DataFrame, keys: list[str]) -> DataFrame:
    return baselines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(
        "response", F.lit(r'\bid="([^"]+)"'), 1))).alias("eid"))


def repeated_eids(eids: DataFrame, scope: list[str], step: str = "step") -> DataFrame:
    """Ids that occur in at least two steps of their scope, with the sorted steps."""
    return eids.groupBy(*scope, "eid").agg(
        F.array_sort(F.collect_set(step)).alias("steps")).withColumn(
        "n", F.size("steps")).filter("n >= 2")


def shared_step_combos(repeated: DataFrame, scope: list[str], samples: int = 4) -> DataFrame:
    """How many ids share exactly the same steps, with the first few of them.  The samples are
    reduced to ``samples`` ids before they are collected."""
    w = W.partitionBy(*scope, "steps", "_salt").orderBy("eid")
    few = repeated.withColumn("_salt", F.pmod(F.xxhash64("eid"), F.lit(64))).withColumn(
        "_r", F.row_number().over(w)).filter(F.col("_r") <= samples)
    shown = few.groupBy(*scope, "steps").agg(
        F.slice(F.array_sort(F.collect_list("eid")), 1, samples).alias("examples"))
    counts = repeated.groupBy(*scope, "steps").agg(F.count("*").alias("shared"))
    return counts.join(shown, [*scope, "steps"])


def repeated_cost(baselines: DataFrame, repeated: DataFrame, scope: list[str],
                  step: str = "step") -> DataFrame:
    """Tokens of each full digest spent on elements that other digests repeat."""
    keys = [*scope, step]
    line = F.regexp_extract_all("response", F.lit(
        r'(<[^<>]*\bid="[^"]+"[^>]*>[^<]*</[^>]+>)'), 1)
    items = baselines.select(*keys, F.posexplode(line).alias("pos", "line")).withColumn(
        "eid", F.regexp_extract("line", r'\bid="([^"]+)"', 1))
    items = items.groupBy(*keys, "eid").agg(F.min_by("line", "pos").alias("line"))
    kept = items.join(repeated.select(*scope, "eid"), [*scope, "eid"], "left_semi")
    cost = kept.groupBy(*keys).agg(
        (F.sum(F.length("line")) + F.count("*") - 1).alias("chars"),
        F.count("*").alias("repeated"))
    total = estimate_tokens("response")
    tokens = F.ceil(F.coalesce("chars", F.lit(0)) / 4).cast("long")
    return baselines.select(*keys, total.alias("total_tokens")).join(cost, keys, "left").select(
        *keys, F.coalesce("repeated", F.lit(0)).alias("repeated"),
        tokens.alias("repeated_tokens"), "total_tokens",
        F.when(F.col("total_tokens") > 0, tokens / F.col("total_tokens") * 100).otherwise(0.0)
        .alias("pct"))
