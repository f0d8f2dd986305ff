"""Content ids, hashes and the per-page element registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions.privacy import url_origin, url_path
from ..functions.text import WS, trim_ws
from .scan import Ranks, ordered_scan, rank_ranges


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(label, longest: int | None = None) -> Column:
    """Name with counters blanked out, so 'Inbox (3)' and 'Inbox (4)' agree."""
    s = F.regexp_replace(F.lower(trim_ws(label)), WS + "+", " ")
    s = F.regexp_replace(s, r"\([0-9]+\)", "(#)")
    s = F.regexp_replace(s, r" [0-9]+$", " #")
    return s if longest is None else F.substring(s, 1, longest)


def landmark_path(where="where") -> Column:
    w = _col(where)
    return F.concat(
        F.coalesce(w.region, F.lit("unknown")), F.lit("/"),
        F.concat_ws("/", w.group_path))


def position_hint(where="where") -> Column:
    path = _col(where).group_path
    return F.coalesce(F.get(path, F.size(path) - 1), F.lit(""))


def region_layer(where="where") -> Column:
    return F.when(_col(where).region == "dialog", "modal").otherwise("main")


def eid(layer: Column | None = None) -> Column:
    """Twelve hex digits from role, name, link, landmark, layer, position and shadow path."""
    parts = [
        F.coalesce("attributes.role", "kind"),
        normalize_name("label"),
        F.col("attributes.href"),
        landmark_path(),
        region_layer() if layer is None else layer,
        position_hint(),
        F.concat_ws("/", "find.shadow_path"),
    ]
    return F.substring(
        F.sha2(F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 12)


def is_tracked() -> Column:
    """Elements that get an id: interactive, implicitly interactive, live."""
    return F.col("kind").isin(rules.INTERACTIVE_KINDS + rules.LIVE_KINDS) | F.coalesce(
        "implicitly_interactive", F.lit(False))


def resolve_collisions(nodes: DataFrame, base: str = "base_eid",
                       keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """``eid``: the base id, with -2, -3 ... for repeats within a capture in document order."""
    n = F.row_number().over(W.partitionBy(*keys, base).orderBy("doc_order"))
    return nodes.withColumn("_n", n).withColumn("eid", F.when(F.col("_n") == 1, F.col(base))
                                                .otherwise(F.concat(base, F.lit("-"), "_n"))
                                                ).drop("_n")


def with_eids(nodes: DataFrame, layer: Column | None = None,
              keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Tracked elements with their collision-free ``eid``."""
    return resolve_collisions(nodes.filter(is_tracked()).withColumn("base_eid", eid(layer)),
                              keys=keys)


#: Captures that one row of a gap is expanded to at a time.
BLOCK = 1024


def capture_clock(eids: DataFrame, captures: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(page_id, step, is_capture, tick, last_tick): captures of a page numbered in step order, from 1. Steps that only
    ``eids`` has are numbered too."""
    steps = captures.select("page_id", "step", F.lit(True).alias("c")).unionByName(
        eids.select("page_id", "step", F.lit(False).alias("c"))).groupBy("page_id", "step").agg(F.max("c").alias("is_capture"))
    ranks = capture_ranks(captures) if ranks is None else ranks
    return ordered_scan(steps, ["page_id"], ["step"], {"tick": ("sum", F.lit(1)), "last_tick": ("total", F.lit(1))}, ranks)


def capture_ranks(captures: DataFrame) -> Ranks:
    """Cuts of the captures of busy pages; all tables with at most a row per capture of a page, or of something on it,
    share them."""
    return rank_ranges(captures.select("page_id", "step"), ["page_id"], ["step"])


def registry_intervals(eids: DataFrame, clock: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(page_id, eid, step, op, gone_from, gone_until): an id at each step that has it, added or updated, and the ticks
    after it at which it is gone (up to but not with ``gone_until``). One row per sighting, whatever the captures."""
    seen = eids.select("page_id", "step", "eid").distinct().join(clock, ["page_id", "step"])
    linked = ordered_scan(seen, ["page_id", "eid"], ["step"], {
        "_before": ("lag", F.col("step")), "_after": ("lead", F.col("tick"))}, ranks)
    return linked.select(
        "page_id", "eid", "step", F.when(F.col("_before").isNull(), "added").otherwise("updated").alias("op"),
        (F.col("tick") + 1).alias("gone_from"), F.coalesce("_after", F.col("last_tick") + 1).alias("gone_until"))


def registry_update(eids: DataFrame, captures: DataFrame) -> DataFrame:
    """added / updated / removed ids of every capture.

    ``eids`` has (page_id, step, eid), ``captures`` every (page_id, step).  An id is added at its
    first step and updated at later ones.  Once seen, an id stays known, so each capture without it
    reports it removed again. ``registry_intervals`` keeps that as ranges of captures; here they are written out, and
    numbers become steps again in a join on page and number, which spreads a busy page."""
    ranks = capture_ranks(captures)
    clock = capture_clock(eids, captures, ranks)
    rows = registry_intervals(eids, clock, ranks)
    first, last = F.col("gone_from"), F.col("gone_until") - 1
    gone = (
        rows.filter(first <= last)
        .select("page_id", "eid", first.alias("a"), last.alias("z"),
                F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("b"))
        .select("page_id", "eid", F.explode(F.sequence(
            F.greatest("a", F.col("b") * BLOCK), F.least("z", F.col("b") * BLOCK + BLOCK - 1))).alias("tick")))
    removed = gone.join(clock.filter("is_capture").select("page_id", "tick", "step"), ["page_id", "tick"]).select(
        "page_id", "step", "eid", F.lit("removed").alias("op"))
    return rows.select("page_id", "step", "eid", "op").unionByName(removed)


def last_seen(eids: DataFrame) -> DataFrame:
    return eids.groupBy("page_id", "eid").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def stale(eids: DataFrame, captures: DataFrame, max_steps: int = 2) -> DataFrame:
    """Ids with the number of captures since they were last seen, and whether that is too many."""
    clock = captures.select("page_id", "step").distinct()
    clock = ordered_scan(clock, ["page_id"], ["step"], {"tick": ("sum", F.lit(1))})
    now = clock.groupBy("page_id").agg(F.max("tick").alias("now"))
    seen = last_seen(eids).join(
        clock.withColumnRenamed("step", "last_step"), ["page_id", "last_step"])
    return seen.join(now, "page_id").select(
        "page_id", "eid", (F.col("now") - F.col("tick")).alias("age"),
        ((F.col("now") - F.col("tick")) > max_steps).alias("is_stale"))


def doc_id(url) -> Column:
    """Twelve hex digits for origin and path; null for a URL that cannot be parsed."""
    return F.substring(F.sha2(F.concat(url_origin(url), F.lit(":"), url_path(url)), 256), 1, 12)


def ui_hash(nodes: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Hash of the visible interactive ids of a capture in document order."""
    return (
        nodes.filter(F.col("kind").isin(rules.INTERACTIVE_KINDS) & F.col("state.visible"))
        .withColumn("_eid", eid())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("doc_order", "_eid"))).getField("_eid")
             .alias("_ids"))
        .select(*keys, F.substring(F.sha2(F.array_join("_ids", ","), 256), 1, 6).alias("ui_hash"))
    )


def layer_hash(stack) -> Column:
    return F.substring(F.sha2(F.array_join(_col(stack), ","), 256), 1, 6)


def latest_snapshot(captures: DataFrame, ttl_seconds: int | None = None,
                    now: Column | None = None) -> DataFrame:
    """Newest capture of each page, without those older than the limit.  ``captures`` has page_id
    and captured_at; max_by combines on the map side, so a busy page costs one row per task."""
    names = [c for c in captures.columns if c != "page_id"]
    order = F.struct("captured_at", *[c for c in ("step", "snapshot_id") if c in names])
    out = captures.groupBy("page_id").agg(
        F.max_by(F.struct(*names), order).alias("_c")).select("page_id", "_c.*")
    if ttl_seconds is None:
        return out
    now = F.current_timestamp() if now is None else now
    return out.filter(F.unix_micros(now) - F.unix_micros(F.col("captured_at").cast("timestamp"))
                      <= ttl_seconds * 1_000_000)


def store_stats(latest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Totals over the kept captures."""
    kept = nodes.join(latest.select("snapshot_id"), "snapshot_id", "left_semi")
    rows = latest.select("captured_at", F.lit(1).alias("c"), F.lit(0).alias("n")).unionByName(
        kept.select(F.lit(0).alias("c"), F.lit(1).alias("n")), allowMissingColumns=True)
    return rows.agg(
        F.sum("c").alias("snapshot_count"), F.min("captured_at").alias("oldest"),
        F.max("captured_at").alias("newest"), F.sum("n").alias("total_nodes"))
