"""Compact text digest of a capture, one string per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import escape_xml, estimate_tokens, lookup
from .layers import shown_region, trim_regions


def _attr(name: str, value: Column) -> Column:
    """' name="value"', or nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def element_line() -> Column:
    """One element of a region; columns as made by ``format_actionables``."""
    tag = F.coalesce(lookup(F.lower("kind"), rules.KIND_TO_ELEMENT), F.lit("elt"))
    shown_kind = F.when((tag == "elt") & ~F.col("role").isin("none", "generic", ""),
                        escape_xml("role")).when(
        (tag == "alert") & (F.col("kind") != "alert"), escape_xml("kind"))
    on = lambda c: F.when(F.col(c), F.lit("true"))
    text = lambda c: F.when(F.length(c) > 0, escape_xml(c))
    return F.concat(
        F.lit("<"), tag, _attr("id", F.col("eid")), _attr("kind", shown_kind),
        _attr("enabled", F.when(~F.col("ena"), F.lit("false"))),
        _attr("visible", F.when(~F.col("vis"), F.lit("false"))),
        _attr("checked", F.col("chk")), _attr("selected", on("sel")), _attr("expanded", on("exp")),
        _attr("pressed", on("prs")), _attr("focused", on("foc")), _attr("val", text("val_hint")),
        _attr("type", text("type")), _attr("href", text("href")),
        F.lit(">"), escape_xml("name"), F.lit("</"), tag, F.lit(">"))


def render_regions(actionables: DataFrame, keys: tuple[str, ...] = ("snapshot_id",),
                   trim: bool = False, unchanged: DataFrame | None = None) -> DataFrame:
    """(keys, regions): the region blocks of a capture in order of their first element.
    ``unchanged`` has (keys, region, unchanged) for regions to name without content."""
    rows = trim_regions(actionables, keys) if trim else actionables.withColumn(
        "shown_region", shown_region()).withColumn("trimmed", F.lit(0)).withColumn(
        "in_region", F.lit(None).cast("bigint"))
    block = rows.groupBy(*keys, F.col("shown_region").alias("region")).agg(
        F.min("rank").alias("first_rank"), F.max("trimmed").alias("trimmed"),
        F.coalesce(F.max("in_region"), F.count("*")).alias("n"),
        F.array_sort(F.collect_list(F.struct("rank", element_line().alias("line"))))
        .getField("line").alias("lines"))
    if unchanged is not None:
        block = block.join(unchanged, [*keys, "region"], "left")
    else:
        block = block.withColumn("unchanged", F.lit(False))
    note = F.when(F.col("trimmed") > 0, F.concat(
        F.lit("    <!-- trimmed "), "trimmed", F.lit(" items. Use find with region="), "region",
        F.lit(" to see all -->\n"))).otherwise(F.lit(""))
    full = F.concat(
        F.lit('  <region name="'), "region", F.lit('">\n'),
        F.array_join(F.transform("lines", lambda x: F.concat(F.lit("    "), x, F.lit("\n"))), ""),
        note, F.lit("  </region>\n"))
    brief = F.concat(F.lit('  <region name="'), "region", F.lit('" unchanged="true" count="'), "n",
                     F.lit('" />\n'))
    return block.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(
            "first_rank", F.when(F.coalesce("unchanged", F.lit(False)), brief).otherwise(full)
            .alias("text")))).getField("text"), "").alias("regions"))


def dedup_observations(obs: DataFrame, keys: list[str], compared: int | None = None) -> DataFrame:
    """One observation per tag and text (its first ``compared`` characters, if given): the most significant, the first of
    equals.  Needs tag, text, significance and obs_order."""
    fields = [c for c in obs.columns if c not in keys]
    text = F.col("text") if compared is None else F.substring("text", 1, compared)
    key = F.concat("tag", F.lit(":"), F.trim(text))
    return obs.withColumn("_k", key).groupBy(*keys, "_k").agg(F.max_by(
        F.struct(*fields), F.struct(F.col("significance"), -F.col("obs_order"))).alias("o")
    ).select(*keys, "o.*")


def render_observations(obs: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """(keys, observations).  Needs when ('action' or 'prior'), type, tag, text, significance,
    obs_order, and optionally eid, role, delay_ms, age_ms, short_lived, children."""
    have = lambda c: F.col(c).cast("string") if c in obs.columns else F.lit(None).cast(
        "string")
    rows = dedup_observations(obs, [*keys, "when"])
    attrs = F.concat(
        _attr("when", F.col("when")), _attr("eid", have("eid")), _attr("role", have("role")),
        _attr("delay_ms", have("delay_ms")), _attr("age_ms", have("age_ms")),
        _attr("transient", F.when(have("short_lived") == "true", F.lit("true"))))
    body = escape_xml("text")
    if "children" in obs.columns:
        kids = F.array_join(F.transform("children", lambda c: F.concat(
            F.lit("      <"), c.tag, F.coalesce(F.concat(F.lit(' eid="'), c.eid, F.lit('"')),
                                                F.lit("")),
            F.lit(">"), escape_xml(c.text), F.lit("</"), c.tag, F.lit(">\n"))), "")
        body = F.when(F.size("children") > 0, F.concat(F.lit("\n"), kids, F.lit("    "))
                      ).otherwise(body)
    line = F.concat(F.lit("    <"), "type", attrs, F.lit(">"), body, F.lit("</"), "type",
                    F.lit(">\n"))
    order = F.struct(F.when(F.col("when") == "action", 0).otherwise(1).alias("w"), "obs_order",
                     line.alias("line"))
    return rows.groupBy(*keys).agg(F.concat(
        F.lit("  <observations>\n"),
        F.array_join(F.array_sort(F.collect_list(order)).getField("line"), ""),
        F.lit("  </observations>\n")).alias("observations"))


def render_diff(diff: DataFrame, keys: tuple[str, ...] = ("page_id", "step")) -> DataFrame:
    """(keys, diff_text) from the long diff table."""
    line = F.when(F.col("op") == "text_changed", F.concat(
        F.lit('    <text-changed id="'), "eid", F.lit('">'), escape_xml("from"), F.lit(" → "),
        escape_xml("to"), F.lit("</text-changed>\n"))).when(
        F.col("op") == "status_appeared", F.concat(
            F.lit('    <status id="'), "eid", F.lit('" role="'), "k", F.lit('">'),
            escape_xml("to"), F.lit("</status>\n")))
    agg = diff.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "doc", F.col("k"))).alias("nav"),
        F.count_if(F.col("op") == "added").alias("added"),
        F.count_if(F.col("op") == "removed").alias("removed"),
        F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(
            (F.col("op") == "status_appeared").alias("late"), "eid", line.alias("line")))))
        .getField("line").alias("lines"))
    some = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    head = F.concat(F.lit('  <diff type="mutation"'), _attr("nav", F.col("nav")),
                    _attr("added", some("added")), _attr("removed", some("removed")))
    return agg.select(*keys, F.when(F.size("lines") > 0, F.concat(
        head, F.lit(">\n"), F.array_join("lines", ""), F.lit("  </diff>\n"))).otherwise(
        F.concat(head, F.lit(" />\n"))).alias("diff_text"))


def render_state(captures: DataFrame, regions: DataFrame, diff_text: DataFrame | None = None,
                 observations: DataFrame | None = None,
                 keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """(keys, digest, tokens).  ``captures`` has step, title, url, view, scroll, layer and
    optionally mode, reason, error."""
    has = lambda c: c in captures.columns
    out = captures.join(regions, list(keys), "left")
    mode = F.col("mode") if has("mode") else F.lit("baseline")
    reason = F.coalesce("reason", F.lit("first")) if has("reason") else F.lit("first")
    error = escape_xml("error") if has("error") else F.lit(None).cast("string")
    change = F.lit('  <diff type="mutation" />\n')
    if diff_text is not None:
        out = out.join(diff_text, list(keys), "left")
        change = F.coalesce("diff_text", change)
    seen = F.lit("")
    if observations is not None:
        out = out.join(observations, list(keys), "left")
        seen = F.coalesce("observations", F.lit(""))
    digest = F.concat(
        F.lit('<state step="'), F.col("step").cast("string"), F.lit('" title="'),
        escape_xml("title"), F.lit('" url="'), escape_xml("url"), F.lit('">\n  <meta view="'),
        "view", F.lit('" scroll="'), "scroll", F.lit('" layer="'), "layer", F.lit('" />\n'),
        F.when(mode == "baseline", F.concat(F.lit('  <baseline reason="'), reason, F.lit('"'),
                                            _attr("error", error), F.lit(" />\n")))
        .otherwise(change),
        seen, F.coalesce("regions", F.lit("")), F.lit("</state>"))
    return out.select(*keys, digest.alias("digest")).withColumn("tokens", estimate_tokens("digest"))
