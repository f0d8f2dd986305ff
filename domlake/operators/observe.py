"""Observations from a mutation log: significance, windows around actions, links to elements.

Mutations are rows (page_id, mut_id, ts, type, tag, role, aria_live, aria_modal, text, z_index,
width_pct, height_pct, has_interactives, is_fixed, is_body_child, is_visible).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import fuzzy_score, lookup, squeeze, tokenize, trim_ws
from .grid import points_in_boxes
from .scan import in_pieces, micros, ordered_scan, rank_ranges, top_n
from .staging import materialize


def mutation_signals(mutations: DataFrame) -> DataFrame:
    """Adds ``signals``, a struct of twelve flags."""
    have = set(mutations.columns)
    yes = lambda c: F.coalesce(c, F.lit(False))
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    signals = {
        "has_alert_role": yes(F.col("role").isin(rules.ALERT_ROLES)),
        "has_aria_live": yes(F.col("aria_live").isin("polite", "assertive")),
        "is_dialog": yes(F.col("role") == "dialog") | yes(F.col("tag") == "dialog")
        | yes(col("aria_modal", "string") == "true"),
        "is_fixed_or_sticky": yes(F.col("is_fixed")),
        "has_high_z_index": yes(F.col("z_index") > 1000),
        "covers_viewport": yes((F.col("width_pct") > 50) | (F.col("height_pct") > 30)),
        "is_body_child": yes(F.col("is_body_child")),
        "has_interactives": yes(F.col("has_interactives")),
        "is_visible": yes(F.col("is_visible")),
        "has_text": yes(F.length("text") >= 3),
        "after_delay": yes(col("after_delay", "boolean")),
        "short_lived": yes(col("short_lived", "boolean")),
    }
    return mutations.withColumn("signals", F.struct(*[c.alias(n) for n, c in signals.items()]))


def significance(temporal: bool = True, toast: Column | None = None) -> Column:
    """Weighted sum of the signals.  At capture time (``temporal=False``) the two time signals are
    not known yet and markup of a toast library counts extra."""
    total = F.lit(0)
    for name, weight in rules.SIGNIFICANCE_WEIGHTS.items():
        if temporal or name not in ("after_delay", "short_lived"):
            total = total + F.when(F.col(f"signals.{name}"), weight).otherwise(0)
    if toast is not None:
        total = total + F.when(F.coalesce(toast, F.lit(False)), rules.TOAST_LIBRARY_WEIGHT
                               ).otherwise(0)
    return total


def observations(mutations: DataFrame, threshold: int = 4) -> DataFrame:
    """Mutations that matter: 4 to be recorded, 5 to be attached to a response."""
    out = mutation_signals(mutations).withColumn("significance", significance())
    return out.filter(F.col("significance") >= threshold).withColumn(
        "change", F.when(F.col("type") == "added", "appeared").otherwise("disappeared"))


def action_windows(obs: DataFrame, actions: DataFrame, most: int | None = None) -> DataFrame:
    """Attach every observation to an action: 'during' from the action's start up to its report,
    else 'prior' to the next action, with its age at that action's report in ms.

    ``actions`` has (page_id, action_id, ts, end_ts); without an end an action lasts until the next.
    Both logs are merged in time order, so the as-of lookup needs no range join."""
    end = F.col("end_ts") if "end_ts" in actions.columns else F.lit(None).cast("timestamp")
    act = actions.select("page_id", micros("ts").alias("t"), F.lit(0).alias("side"),
                         F.col("action_id").alias("seq"), F.struct(
        F.col("action_id").alias("id"), micros("ts").alias("start"), micros(end).alias("end"))
        .alias("act"))
    rows = obs.select("page_id", micros("ts").alias("t"), F.lit(1).alias("side"),
                      F.col("mut_id").alias("seq"))
    both = act.unionByName(rows, allowMissingColumns=True)
    order = ["t", "side", "seq"]
    linked = ordered_scan(both, ["page_id"], order, {
        "prev_act": ("last", F.col("act")), "next_act": ("next", F.col("act"))},
        rank_ranges(both, ["page_id"], order, most))
    during = F.col("prev_act").isNotNull() & F.coalesce(
        F.col("t") <= F.col("prev_act.end"), F.lit(True))
    report = F.coalesce("next_act.end", "next_act.start")
    return linked.filter("side = 1").select(
        "page_id", F.col("seq").alias("mut_id"),
        F.when(during, "during").when(F.col("next_act").isNotNull(), "prior").otherwise("open")
        .alias("window"),
        F.when(during, F.col("prev_act.id")).otherwise(F.col("next_act.id")).alias("action_id"),
        F.when(~during, (report - F.col("t")) / 1000).alias("age_ms"))


def unreported(mutations: DataFrame, reported: DataFrame) -> DataFrame:
    """Rows after the last one reported for their page; ``reported`` has (page_id, last_mut_id), one
    row per page."""
    return mutations.join(reported, "page_id", "left").filter(
        F.col("mut_id") > F.coalesce("last_mut_id", F.lit(-1))).drop("last_mut_id")


def after_delay(ts, page_loaded) -> Column:
    return (micros(ts) - micros(page_loaded)) > 100_000


def short_lived(mutations: DataFrame, element: list[str], limit_ms: int = 3000,
                most: int | None = None) -> DataFrame:
    """Adds ``short_lived`` to both rows of an element that appeared and was removed again within
    the limit; ``element`` names the columns that identify an element on a page."""
    rows = mutations.withColumn("t", micros("ts"))
    here = F.struct("type", "t")
    order = ["t", "mut_id"]
    rows = ordered_scan(rows, ["page_id", *element], order, {"_after": ("lead", here), "_before": ("lag", here)},
                        rank_ranges(rows, ["page_id"], order, most))
    limit = limit_ms * 1000
    gone = (F.col("type") == "added") & (F.col("_after.type") == "removed") & (
        F.col("_after.t") - F.col("t") < limit)
    went = (F.col("type") == "removed") & (F.col("_before.type") == "added") & (
        F.col("t") - F.col("_before.t") < limit)
    return rows.withColumn("short_lived", F.coalesce(gone, F.lit(False)) | F.coalesce(
        went, F.lit(False))).drop("_after", "_before", "t")


def debounce(mutations: DataFrame, region: list[str], quiet_ms: int = 100, most: int | None = None) -> DataFrame:
    """Adds ``captured``: a change of a live region counts unless another one was captured less than
    ``quiet_ms`` before it.

    A region's log is walked in pieces of equal rank. What a piece does is a map from the last capture before it to
    the last one in it; maps of neighbouring pieces compose, so doubling the stretch they cover tells every
    piece what it starts from after as many rounds as the number of pieces has bits."""
    keys = ["page_id", *region]
    rows = mutations.select(*keys, "mut_id", micros("ts").alias("t"))
    gap = quiet_ms * 1000
    ranks = rank_ranges(rows, keys, ["t", "mut_id"], most)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    group = [*keys, "_piece"]
    if ranks.cuts is None:
        pieces = rows.withColumn("_piece", F.lit(None).cast("int")).withColumn("_from", F.lit(None).cast("bigint"))
    else:
        pieces = in_pieces(rows, ranks)
        entries = _entries(pieces.filter(F.col("_piece").isNotNull()), keys, gap, ranks.steps)
        pieces = pieces.join(entries, group, "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "mut_id"])
        t, before = pdf["t"].to_numpy(), pdf["_from"].iloc[0]
        captured = np.zeros(len(t), bool)
        at = 0 if pd.isna(before) else int(np.searchsorted(t, int(before) + gap))
        while at < len(t):
            captured[at] = True
            at = max(at + 1, int(np.searchsorted(t, t[at] + gap)))
        return pdf[[*keys, "mut_id"]].assign(captured=captured)

    return pieces.groupBy(*group).applyInPandas(walk, f"{kinds}, mut_id {dict(rows.dtypes)['mut_id']}, captured boolean")


def _trimmed(first: np.ndarray, last: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """No capture before a piece reaches beyond its first row by more than the pause, so the map ends there."""
    end = int(np.searchsorted(first, first[0] + gap)) + 1 if len(first) else 0
    return first[:end], last[:end]


def _entries(pieces: DataFrame, keys: list[str], gap: int, rounds: int) -> DataFrame:
    """(keys, _piece, _from): the time of the last capture before each piece but the first.

    A map is two lists: a first capture at ``first[i]`` has its last capture at ``last[i]``. A capture before the piece
    leads to the first row that is at least the pause later; beyond the list, nothing in the piece is captured."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in keys)
    schema = f"{schema}, _piece int, first array<bigint>, last array<bigint>"

    def map_of(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        after = np.maximum(np.searchsorted(t, t + gap), np.arange(len(t)) + 1)
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                last[i] = last[after[i]]
        first, last = _trimmed(t, last, gap)
        return pdf[[*keys, "_piece"]].head(1).assign(first=[first], last=[last])

    def compose(frames):
        for pdf in frames:
            out = []
            for a, b, c, d in zip(pdf["first"], pdf["last"], pdf["then_first"], pdf["then_last"]):
                if a is None or c is None:
                    out.append((c, d) if a is None else (a, b))
                    continue
                at = np.searchsorted(c, b + gap)
                reached = np.where(at < len(c), d[np.minimum(at, len(c) - 1)], b)
                more = c > a[-1]
                out.append(_trimmed(np.append(a, c[more]), np.append(reached, d[more]), gap))
            yield pdf[[*keys, "_piece"]].assign(first=[o[0] for o in out], last=[o[1] for o in out])

    maps = materialize(pieces.select(*keys, "_piece", "t").groupBy(*keys, "_piece").applyInPandas(map_of, schema))
    for i in range(rounds):  # a map now covers its piece and up to 2 ** i - 1 before it
        before = maps.select(*keys, (F.col("_piece") + (1 << i)).alias("_piece"), "first", "last")
        after = maps.select(*keys, "_piece", F.col("first").alias("then_first"), F.col("last").alias("then_last"))
        maps = materialize(after.join(before, [*keys, "_piece"], "left").mapInPandas(compose, schema))
    return maps.select(*keys, (F.col("_piece") + 1).alias("_piece"), F.get("last", F.lit(0)).alias("_from"))


def live_region_ancestor(dom: DataFrame) -> DataFrame:
    """(snapshot, text node) -> nearest element around it with a live role or aria-live.  Needs
    aria-live on the ancestor, so it looks the ancestors up in the node table."""
    live = dom.filter(
        F.try_element_at("attributes", F.lit("role")).isin(rules.LIVE_REGION_ROLES)
        | F.try_element_at("attributes", F.lit("aria-live")).isin("polite", "assertive")
    ).filter(F.upper("node_name") != "BODY").select(
        "snapshot_id", F.col("id").alias("live_id"))
    above = F.col("ancestor_ids") if "ancestor_ids" in dom.columns else F.transform("ancestors", lambda a: a.id)
    up = dom.filter(F.col("node_type") == 3).select("snapshot_id", "id", F.posexplode(above).alias("pos", "live_id"))
    return up.join(live, ["snapshot_id", "live_id"]).groupBy("snapshot_id", "id").agg(
        F.min_by("live_id", "pos").alias("live_id"))


def fifo_cap(mutations: DataFrame, size: int = 500) -> DataFrame:
    """The newest ``size`` rows of each page."""
    return top_n(mutations, ["page_id"], [F.desc("ts"), F.desc("mut_id")], size, "age_rank")


def candidate_kinds(tag, role) -> Column:
    """Element kinds a mutation may stand for."""
    tag = F.lower(F.col(tag) if isinstance(tag, str) else tag)
    role = F.lower(F.col(role) if isinstance(role, str) else role)
    pairs = [x for t, kinds in rules.OBS_TAG_KINDS.items()
             for x in (F.lit(t), F.array(*[F.lit(k) for k in kinds]))]
    empty = F.array().cast("array<string>")
    by_tag = F.coalesce(F.try_element_at(F.create_map(*pairs), tag), empty)
    by_role = F.array_compact(F.array(lookup(role, rules.OBS_ROLE_KIND)))
    kinds = F.array_union(by_tag, by_role)
    return F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("generic")))


def link_closeness(max_tokens: int | None = None) -> Column:
    """How well the words of an observation's text (``o``) occur in an element's label (``n``)."""
    text, label = F.lower(trim_ws("o.text")), F.lower(trim_ws("n.label"))
    return fuzzy_score(tokenize(squeeze(label), max_tokens, 2),
                       tokenize(squeeze(text), max_tokens, 2))


def link_score(close: Column, overlap: float = 0.5) -> Column:
    """Score of an observation (tag, role, text, is_dialog) against an element (kind, label, region)
    of one of its candidate kinds, given ``link_closeness``."""
    w = rules.LINK_SCORES
    role_kind = lookup(F.lower("o.role"), rules.OBS_ROLE_KIND)
    same = F.lower(trim_ws("o.text")) == F.lower(trim_ws("n.label"))
    worded = (F.length("o.text") > 0) & (F.length("n.label") > 0)
    score = F.lit(w["tag"]) + F.when(
        F.coalesce(role_kind == F.col("n.kind"), F.lit(False)), w["role"]).otherwise(0.0)
    score = score + F.when(F.coalesce(worded, F.lit(False)), F.when(same, w["text"]).when(
        close >= overlap, w["text"] * close).otherwise(0.0)).otherwise(0.0)
    score = score + F.when(F.col("o.is_dialog") & (F.col("n.region") == "dialog"), w["dialog"]
                           ).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def link_observations(obs: DataFrame, nodes: DataFrame, keys: list[str],
                      min_score: float = 0.5) -> DataFrame:
    """Best element for every appeared observation, if it scores above ``min_score``.

    Scores depend only on what the observation says, so equal ones are scored once per capture; the
    join is on (capture, kind)."""
    what = ["tag", "role", "text", "is_dialog"]
    said = obs.filter(F.col("change") == "appeared").withColumn("is_dialog",
                                                               F.col("signals.is_dialog"))
    distinct = said.select(*keys, *what).distinct()
    o = distinct.withColumn("kind", F.explode(candidate_kinds("tag", "role"))).alias("o")
    n = nodes.select(*keys, "kind", "label", F.col("where.region").alias("region"), "node_id",
                     "backend_node_id", "doc_order").alias("n")
    test = F.col("o.kind") == F.col("n.kind")
    for k in keys:
        test = test & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    first_kind = F.array_position(candidate_kinds("o.tag", "o.role"), F.col("n.kind"))
    best = (
        o.join(n, test).withColumn("_close", link_closeness())
        .withColumn("score", link_score(F.col("_close"))).filter(F.col("score") > min_score)
        .groupBy(*[F.col(f"o.{k}") for k in keys], *[F.col(f"o.{c}") for c in what])
        .agg(F.max_by(F.struct("n.node_id", "n.backend_node_id", "score"),
                      F.struct("score", -first_kind, -F.col("n.doc_order"))).alias("m"))
    ).alias("b")
    b, s = best, said.alias("s")
    cond = F.lit(True)
    for k in keys + what:
        cond = cond & F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}"))
    return s.join(b, cond, "left").select(
        *[F.col(f"s.{k}") for k in keys], "s.mut_id", F.col("m.node_id").alias("node_id"),
        F.col("m.score").alias("score"))


def link_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count("node_id").alias("linked"),
                     (F.count("*") - F.count("node_id")).alias("unlinked"),
                     F.count("*").alias("total"))


def boxes_inside(containers: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, container, node) pairs where the node's box lies inside the container's."""
    place = F.col("layout.bbox").alias("b")
    c = containers.select(*keys, "node_id", place)
    n = nodes.select(*keys, "node_id", "kind", "label", "doc_order", place)
    x, y, w, h = (F.col(f"b.{f}") for f in "xywh")
    outer, inner = (lambda f: F.col(f"box.b.{f}")), (lambda f: F.col(f"point.b.{f}"))
    fits = (inner("x") + inner("w") <= outer("x") + outer("w")) & (inner("y") + inner("h") <= outer("y") + outer("h"))
    return points_in_boxes(c, n, keys, (x, y), (x + w, y + h), (x, y)).filter(
        fits & (F.col("box.node_id") != F.col("point.node_id"))).select(
        *keys, F.col("box.node_id").alias("container_id"), *[F.col(f"point.{f}") for f in ("node_id", "kind", "label", "doc_order")])


def observation_children(containers: DataFrame, nodes: DataFrame, keys: list[str],
                         limit: int = 5) -> DataFrame:
    """The first labelled interactive or heading elements inside each container's box."""
    usable = nodes.filter((F.col("kind").isin(rules.INTERACTIVE_KINDS + ["heading"]))
                          & (F.coalesce(trim_ws("label"), F.lit("")) != ""))
    pairs = boxes_inside(containers, usable, keys)
    rank = F.row_number().over(W.partitionBy(*keys, "container_id").orderBy("doc_order"))
    return pairs.withColumn("child_rank", rank).filter(F.col("child_rank") <= limit).select(
        *keys, "container_id", "child_rank", "node_id",
        F.coalesce(lookup("kind", rules.CHILD_TAGS), F.lit("text")).alias("tag"),
        F.col("label").alias("text"))
