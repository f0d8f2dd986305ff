"""Overlay layers, ranked actionable elements, region lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions.privacy import mask_value, sanitize_href
from ..functions.text import contains_any, lookup, trim_ws
from . import identity


def _extra(name: str) -> Column:
    return F.try_element_at(F.col("attributes.extra"), F.lit(name))


def _on(name: str) -> Column:
    """A boolean attribute: present, with any value but 'false'."""
    return F.lower(_extra(name)) != "false"


def _class_has(parts: list[str]) -> Column:
    cls = F.lower(F.coalesce(_extra("class"), _extra("className")))
    return contains_any(cls, [p.lower() for p in parts])


def layer_of_node() -> Column:
    """struct(type, confidence, z) of the overlay a node opens, null for most nodes.  First match of
    modal, drawer, popover, toast; a candidate of low confidence still shadows later rules."""
    role = F.coalesce("attributes.role", F.lit(""))
    z = F.coalesce("layout.z_index", F.lit(0))
    box = F.col("layout.bbox")
    modal_attr = F.coalesce(_extra("aria-modal") == "true", F.lit(False))
    portal = (z >= 100) & (
        _class_has(rules.PORTAL_CLASSES)
        | F.coalesce(F.least(*[F.when(_on(f"data-{n}"), 1) for n in
                               ("portal", "overlay", "modal")]) == 1, F.lit(False))
        | F.coalesce((z > 500) & (box.w > 200) & (box.h > 200), F.lit(False)))
    edge = F.coalesce((box.x < 10) | ((box.x + box.w > 1200) & (box.x > 800)), F.lit(False))

    def layer(kind: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"),
                        z.alias("z"))

    live = F.col("kind").isin(rules.LIVE_KINDS)
    return (
        F.when(role.isin("dialog", "alertdialog") & modal_attr, layer("modal", 1.0))
        .when((F.col("kind") == "dialog") & F.coalesce(_on("open"), F.lit(False)),
              layer("modal", 0.95))
        .when(role == "alertdialog", layer("modal", 0.9))
        .when((role == "dialog") & (z > 1000), layer("modal", 0.8))
        .when(portal, layer("modal", 0.75))
        .when((role == "complementary") & (z > 100), layer("drawer", 0.7))
        .when((role == "navigation") & (z > 100) & edge, layer("drawer", 0.75))
        .when((z > 50) & _class_has(rules.DRAWER_CLASSES), layer("drawer", 0.7))
        .when((z > 100) & role.isin(rules.POPOVER_ROLES), layer("popover", 0.8))
        .when((z > 100) & (role == "dialog") & ~modal_attr, layer("popover", 0.6))
        .when((z > 100) & _class_has(rules.POPOVER_CLASSES), layer("popover", 0.65))
        .when((z > 100) & ~modal_attr & (role.isin(rules.TOAST_ROLES) | live),
              layer("toast", 0.7))
    )


def detect_layers(nodes: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Nodes that open a layer, with type, confidence, z and the id of the layer root."""
    out = nodes.withColumn("_l", layer_of_node()).filter(
        F.col("_l.confidence") > min_confidence)
    return out.withColumn("root_eid", identity.eid(F.col("_l.type"))).select(
        *[c for c in ("snapshot_id", "page_id", "step") if c in nodes.columns], "node_id",
        "doc_order", F.col("_l.type").alias("type"), F.col("_l.confidence").alias("confidence"),
        F.col("_l.z").alias("z"), "root_eid")


def layer_stack(nodes: DataFrame, keys: tuple[str, ...] = ("snapshot_id",),
                topmost: bool = False) -> DataFrame:
    """(keys, stack, active) of every capture.  The stack is 'main' and the layers by falling z.
    The active layer is the last entry that is not a toast, so the lowest overlay; ``topmost=True``
    picks the highest instead.  Only layer roots are collected."""
    kept = F.get(F.filter(F.array(layer_of_node()), lambda x: x.confidence > 0.6), F.lit(0))
    rows = nodes.select(*keys, "doc_order", kept.alias("l"))
    found = F.collect_list(F.when(F.col("l").isNotNull(), F.struct(
        (-F.col("l.z")).alias("z"), "doc_order", F.col("l.type").alias("type"))))
    out = rows.groupBy(*keys).agg(F.array_sort(found).alias("_f"))
    types = F.transform("_f", lambda x: x.type)
    solid = F.filter(types, lambda t: t != "toast")
    return out.select(
        *keys, F.concat(F.array(F.lit("main")), types).alias("stack"),
        F.coalesce(F.try_element_at(solid, F.lit(1 if topmost else -1)), F.lit("main"))
        .alias("active"))


def focused_eid(nodes: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    return nodes.filter("state.focused").groupBy(*keys).agg(
        F.min_by(identity.eid(), "doc_order").alias("focus_eid"))


def node_layer(active: Column | str | None = None) -> Column:
    """Layer a node belongs to, given the active layer of its capture."""
    active = F.lit(active) if isinstance(active, str) else active
    base = F.when(F.col("where.region") == "dialog", "modal")
    if active is not None:
        base = base.when(active.isin(rules.INCLUSIVE_LAYERS) & (F.col("layout.z_index") > 1),
                         active)
    return base.otherwise("main")


def score_actionable(primary: Column | None = None) -> Column:
    """Priority 0..1 of an element; invisible ones score 0."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    region = F.coalesce("where.region", F.lit("unknown"))
    score = F.lit(0.5) + F.when(yes(F.col("state.enabled")), 0.2).otherwise(0.0)
    score = score + F.coalesce(lookup("kind", rules.ACTIONABLE_KIND_WEIGHT), F.lit(0.1))
    score = score + F.when(region == "main", 0.15).when(region == "dialog", 0.2).otherwise(0.0)
    score = score + F.when(yes(F.contains(F.col("layout.screen_zone"), F.lit("above-fold"))),
                           0.1).otherwise(0.0)
    score = score + F.when(trim_ws("label") != "", 0.15).otherwise(0.0)
    if primary is not None:
        score = score + F.when(yes(primary), 0.3).otherwise(0.0)
    score = score + F.when(yes(F.col("state.focused")), 0.2).otherwise(0.0)
    return F.when(yes(F.col("state.visible")), F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))


def _actionable(active: Column) -> Column:
    interactive = F.col("kind").isin(rules.INTERACTIVE_KINDS)
    implicit = F.coalesce("implicitly_interactive", F.lit(False))
    return (
        (interactive | implicit | F.col("kind").isin(rules.LIVE_KINDS))
        & F.coalesce("state.visible", F.lit(False))
        & ~(implicit & ~interactive & (F.coalesce(trim_ws("label"), F.lit("")) == ""))
        & (active.isin(rules.INCLUSIVE_LAYERS) | (node_layer(active) == active))
    )


def with_active_layer(nodes: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    return nodes.join(layer_stack(nodes, keys).select(*keys, "active"), list(keys))


def select_actionables(nodes: DataFrame, max_count: int | None = None, active: str | Column = "active",
                       keys: tuple[str, ...] = ("snapshot_id",), primary: Column | None = None) -> DataFrame:
    """The best ``max_count`` (all, if None) actionable elements of each capture with ``score`` and ``rank``. ``primary``
    marks the main call to action."""
    act = F.col(active) if isinstance(active, str) else active
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_order"))
    out = nodes.filter(_actionable(act)).withColumn("score", score_actionable(primary)).withColumn(
        "rank", F.row_number().over(w))
    return out if max_count is None else out.filter(F.col("rank") <= max_count)


def focus_guarantee(nodes: DataFrame, max_count: int | None = None, active: str = "active",
                    keys: tuple[str, ...] = ("snapshot_id",), primary: Column | None = None) -> DataFrame:
    """Actionables with the focused element first, then up to two ways to close a modal, then the
    ranked rest."""
    act = F.col(active)
    in_layer = act.isin(rules.INCLUSIVE_LAYERS) | (node_layer(act) == act)
    usable = F.col("kind").isin(rules.INTERACTIVE_KINDS) & F.coalesce(
        "state.visible", F.lit(False)) & in_layer
    label = F.lower("label")
    closes = contains_any(label, ["close", "cancel", "dismiss"]) | label.isin("x", "×")
    focus = usable & F.coalesce("state.focused", F.lit(False))
    close = usable & (act == "modal") & closes
    upto = W.partitionBy(*keys).orderBy("doc_order").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    rows = (
        nodes.withColumn("_focus", focus & (F.count_if(focus).over(upto) == 1))
        .withColumn("_close", close & (F.count_if(close).over(upto) <= 2))
        .withColumn("_ranked", _actionable(act))
        .filter("_focus OR _close OR _ranked")
        .withColumn("score", score_actionable(primary))
        .withColumn("tier", F.when(F.col("_focus"), 0).when(F.col("_close"), 1).otherwise(2))
    )
    pick = F.when(F.col("tier") == 0, F.lit(0.0)).when(F.col("tier") == 1, F.lit(0.0)).otherwise(
        -F.col("score"))
    rank = F.row_number().over(whole.orderBy("tier", pick, "doc_order"))
    out = rows.withColumn("rank", rank).drop("_focus", "_close", "_ranked")
    return out if max_count is None else out.filter(
        (F.col("rank") <= max_count) | (F.col("tier") < 2))


def ax_locator(layer: Column) -> Column:
    name = F.substring(trim_ws("label"), 1, 40)
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    role = F.coalesce("attributes.role", "kind")
    scope = F.coalesce(lookup(layer, rules.AX_SCOPES), F.lit(""))
    return F.concat(scope, F.lit("role="), role, F.when(name == "", F.lit("")).otherwise(
        F.concat(F.lit('[name*="'), quoted, F.lit('"]'))))


def css_locator(layer: Column) -> Column:
    scope = F.coalesce(lookup(layer, rules.CSS_SCOPES), F.lit(""))

    def quoted(c):
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    return F.concat(scope, F.coalesce(
        F.concat(F.lit('[data-testid="'), quoted(_extra("data-testid")), F.lit('"]')),
        F.concat(F.lit('[name="'), quoted(F.col("attributes.name")), F.lit('"]')),
        F.concat(F.lit('[aria-label*="'), quoted(_extra("aria-label")), F.lit('"]'))))


def format_actionables(rows: DataFrame, active: str = "active",
                       keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Public record of each actionable; ``rows`` needs ``rank`` and may bring an ``eid``."""
    act = F.col(active)
    on = lambda flag: F.when(F.col(f"state.{flag}"), F.lit(True))
    own = F.col("eid") if "eid" in rows.columns else identity.eid(act)
    value = F.nullif("attributes.value", F.lit(""))
    return rows.select(
        *keys, "rank", own.alias("eid"), "node_id", "kind", F.col("label").alias("name"),
        F.coalesce("attributes.role", "kind").alias("role"),
        F.coalesce("state.visible", F.lit(False)).alias("vis"),
        F.coalesce("state.enabled", F.lit(False)).alias("ena"),
        F.nullif("state.checked", F.lit("false")).alias("chk"),
        on("selected").alias("sel"), on("expanded").alias("exp"), on("pressed").alias("prs"),
        on("focused").alias("foc"), on("required").alias("req"), on("invalid").alias("inv"),
        on("readonly").alias("rdo"),
        mask_value(value, F.col("attributes.input_type"), F.col("label")).alias("val_hint"),
        F.nullif("attributes.placeholder", F.lit("")).alias("placeholder"),
        sanitize_href(F.nullif("attributes.href", F.lit(""))).alias("href"),
        F.nullif("attributes.input_type", F.lit("")).alias("type"),
        ax_locator(act).alias("locator_ax"), css_locator(act).alias("locator_css"),
        node_layer(act).alias("layer"),
        F.coalesce("where.region", F.lit("unknown")).alias("region"))


def layer_counts(nodes: DataFrame, max_count: int | None = None, active: str = "active",
                 keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """shown, total_in_layer and whether the list was capped."""
    act = F.col(active)
    total = (
        F.col("kind").isin(rules.INTERACTIVE_KINDS + rules.LIVE_KINDS)
        & F.coalesce("state.visible", F.lit(False))
        & (act.isin(rules.INCLUSIVE_LAYERS) | (node_layer(act) == act)))
    return nodes.groupBy(*keys).agg(
        F.least(F.count_if(_actionable(act)), F.lit(max_count).cast("bigint")).alias("shown"),
        F.count_if(total).alias("total_in_layer"),
    ).withColumn("capped", F.coalesce(F.col("total_in_layer") > F.lit(max_count).cast("bigint"),
                                      F.lit(False)))


def shown_region(region="region") -> Column:
    r = F.col(region) if isinstance(region, str) else region
    return F.when(r == "unknown", "main").otherwise(r)


def region_groups(actionables: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Ordered ids per region."""
    return actionables.groupBy(*keys, shown_region().alias("region")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "eid"))).getField("eid").alias("eids"),
        F.min("rank").alias("first_rank"))


def region_unchanged(groups: DataFrame, links: DataFrame, modes: DataFrame) -> DataFrame:
    """Regions of baseline captures whose ordered ids equal those of the capture before."""
    from .diff import pair_rows

    pairs = pair_rows(groups.select("page_id", "step", "region", "eids"), links, ["region"],
                      ["eids"])
    return pairs.filter(F.col("curr").isNotNull()).join(
        modes.filter("mode = 'baseline'").select("page_id", "step"), ["page_id", "step"]).select(
        "page_id", "step", "region",
        F.coalesce(F.col("prev.eids") == F.col("curr.eids"), F.lit(False)).alias("unchanged"))


def trim_limits(region="region") -> tuple[Column, Column]:
    r = F.col(region) if isinstance(region, str) else region
    return tuple(
        F.coalesce(lookup(r, {k: v[i] for k, v in rules.TRIM_LIMITS.items()}),
                   F.lit(rules.TRIM_DEFAULT[i])) for i in (0, 1))


def trim_regions(actionables: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Head and tail of each region with the number of rows left out in between."""
    region = shown_region()
    w = W.partitionBy(*keys, "shown_region")
    head, tail = trim_limits("shown_region")
    return (
        actionables.withColumn("shown_region", region)
        .withColumn("pos", F.row_number().over(w.orderBy("rank")))
        .withColumn("in_region", F.count("*").over(w))
        .withColumn("trimmed", F.greatest(F.col("in_region") - head - tail, F.lit(0)))
        .filter((F.col("trimmed") == 0) | (F.col("pos") <= head)
                | (F.col("pos") > F.col("in_region") - tail))
    )


def diff_mode_filter(actionables: DataFrame, modes: DataFrame, diff: DataFrame) -> DataFrame:
    """In diff mode on the main layer keep only added or changed elements.  ``actionables`` has
    (page_id, step, eid, active)."""
    keys = ["page_id", "step"]
    touched = diff.filter(F.col("op").isin("added", "changed")).select(
        *keys, "eid", F.lit(True).alias("_touched")).distinct()
    out = actionables.join(modes.select(*keys, "mode"), keys).join(
        touched, [*keys, "eid"], "left")
    return out.filter((F.col("mode") == "baseline") | F.col("active").isin(rules.OVERLAY_LAYERS)
                      | F.col("_touched")).drop("_touched", "mode")
