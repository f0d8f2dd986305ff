"""What actions change: observed effects and the learned dependency graph between fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from .diff import KEYS, pair_rows, step_links
from .scan import top_n

EFFECTS = ["enabled", "disabled", "appeared", "disappeared", "value_changed"]


def observed_effect(nodes: DataFrame, captures: DataFrame, actions: DataFrame) -> DataFrame:
    """Effect of the action that led to a capture.  ``actions`` has (page_id, step, trigger_eid,
    action_type), one per capture.  Actions without any effect are left out."""
    rows = nodes.select(
        *KEYS, "node_id", F.col("doc_order").alias("pos"),
        F.coalesce("state.enabled", F.lit(True)).alias("ena"),
        F.coalesce("state.visible", F.lit(False)).alias("vis"),
        F.col("attributes.value").alias("val"))
    pairs = pair_rows(rows, step_links(captures), ["node_id"], ["pos", "ena", "vis", "val"])
    pairs = pairs.join(actions.select(*KEYS, "trigger_eid", "action_type"), KEYS)
    old, new = F.col("prev").isNotNull(), F.col("curr").isNotNull()
    p = lambda f: F.col(f"prev.{f}")
    c = lambda f: F.col(f"curr.{f}")
    tests = {
        "enabled": new & c("ena") & (~old | ~p("ena")),
        "disabled": new & old & p("ena") & ~c("ena"),
        "appeared": new & c("vis") & (~old | ~p("vis")),
        "disappeared": old & p("vis") & (~new | ~c("vis")),
        "value_changed": new & c("val").isNotNull() & ~p("val").eqNullSafe(c("val"))
        & (F.col("node_id") != F.col("trigger_eid")),
    }
    order = F.struct(F.when(old, 0).otherwise(1).alias("late"),
                     F.coalesce(p("pos"), c("pos")).alias("pos"), "node_id")
    lists = [F.array_sort(F.collect_list(F.when(F.coalesce(t, F.lit(False)), order)))
             .getField("node_id").alias(name) for name, t in tests.items()]
    out = pairs.groupBy(*KEYS, "trigger_eid", "action_type").agg(*lists)
    total = sum((F.size(e) for e in EFFECTS[1:]), F.size(EFFECTS[0]))
    return out.withColumn("_n", total).filter("_n > 0").withColumn(
        "confidence", F.least(F.lit(1.0), F.lit(0.5) + F.col("_n") * 0.1)).drop("_n")


def effect_edges(effects: DataFrame) -> DataFrame:
    """One row per (page, step, source, target, type) an effect shows."""
    kind = {"enabled": "enables", "disabled": "enables", "appeared": "reveals",
            "disappeared": "reveals", "value_changed": "populates"}
    method = {"enables": "observed_state_change", "reveals": "observed_mutation",
              "populates": "observed_state_change"}
    items = [_typed(e, kind[e], method[kind[e]]) for e in EFFECTS]
    return effects.select(*KEYS, F.col("trigger_eid").alias("source_eid"),
                          F.inline(F.concat(*items)))


def _typed(column: str, kind: str, method: str):
    return F.transform(column, lambda t: F.struct(
        t.alias("target_eid"), F.lit(kind).alias("type"), F.lit(method).alias("method")))


def dependency_edges(effects: DataFrame) -> DataFrame:
    """Edge table with how often each dependency was seen and when last; the first method stays."""
    return effect_edges(effects).groupBy("page_id", "source_eid", "target_eid", "type").agg(
        F.count("*").alias("observations"), F.max("step").alias("last_step"),
        F.min_by("method", "step").alias("method"))


def with_confidence(edges: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    boost = F.coalesce(F.try_element_at(F.create_map(*[
        F.lit(x) for kv in rules.METHOD_BOOST.items() for x in kv]), F.col("method")), F.lit(0.0))
    seen = F.least(F.lit(1.0), F.col("observations") / 3)
    conf = F.least(F.lit(1.0), F.lit(0.3) + seen * 0.5 + boost)
    return edges.withColumn("confidence", conf).filter(F.col("confidence") >= min_confidence)


def dependencies_for(edges: DataFrame, target_eid: str) -> DataFrame:
    return edges.filter(F.col("target_eid") == target_eid)


def all_dependencies(edges: DataFrame) -> DataFrame:
    """In-edges grouped by target."""
    return edges.groupBy("page_id", "target_eid").agg(F.array_sort(F.collect_list(F.struct(
        "source_eid", "type", "confidence", "method"))).alias("depends_on"))


def dependents_of(edges: DataFrame) -> DataFrame:
    """Distinct targets grouped by source."""
    return edges.groupBy("page_id", "source_eid").agg(
        F.array_sort(F.collect_set("target_eid")).alias("dependents"))


def recent_effects(effects: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` effects of every trigger."""
    return top_n(effects, ["page_id", "trigger_eid"], [F.desc("step")], n, "age_rank")
