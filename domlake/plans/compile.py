"""Documents to captures of semantic elements, as one lazily built plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import tree
from ..schema import node_struct


def _layout(el: DataFrame, layouts: DataFrame | None, viewport: tuple[int, int]):
    """Rows with their box, and the expressions for visibility and the layout struct."""
    if layouts is None:
        return el.withColumn("z_index", F.lit(None).cast("int")), None, {
            "bbox": F.expr(tree.EMPTY_BOX)}
    optional = ("display", "visibility", "clip_path", "z_index")
    box = layouts.select(
        "snapshot_id", "id",
        F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"]).alias("bbox"),
        *[F.col(c) if c in layouts.columns else F.lit(None).cast("string").alias(c)
          for c in optional]).hint("merge")  # a row for each node
    known = F.col("bbox").isNotNull()
    visible = F.when(known, tree.visibility("bbox.w", "bbox.h", "display", "visibility",
                                            "clip_path"))
    zone = F.when(known, tree.screen_zone("bbox", *viewport))
    return el.join(box, ["snapshot_id", "id"], "left"), visible, {
        "bbox": F.coalesce("bbox", F.expr(tree.EMPTY_BOX)), "display": F.col("display"),
        "screen_zone": zone, "z_index": F.col("z_index").cast("int")}


def compile_elements(
    dom: DataFrame,
    ax: DataFrame | None = None,
    layouts: DataFrame | None = None,
    listeners: DataFrame | None = None,
    frames: DataFrame | None = None,
    viewport: tuple[int, int] = (1280, 720),
    max_nodes: int | None = None,
    max_candidates: int | None = None,
    max_label: int | None = None,
    include_hidden: bool = False,
    internals: bool = False,
) -> DataFrame:
    """Element table of every capture.

    ``dom`` comes from the HTML or JSON source.  ``ax`` is a captured accessibility tree, derived
    from the markup when missing; ``layouts`` has (snapshot_id, id, x, y, w, h, display, visibility,
    clip_path, z_index, cursor), ``listeners`` (snapshot_id, id, type) and ``frames``
    (snapshot_id, frame_id, loader_id, is_main).  Every element is kept with its
    whole label unless ``max_nodes`` (elements of a capture), ``max_candidates`` (elements of unknown
    role that are considered) or ``max_label`` (characters) say otherwise.

    From markup alone the plan is one map stage, one exchange on the capture and one window stage:
    labels, regions, groups, states and locators are row-wise, and everything that looks at
    neighbours shares the exchange.
    """
    digested = ax is None and "parent_ax_name" in dom.columns  # ELEMENT_COLUMNS instead of every ancestor
    el = tree.with_derived_ax(tree.may_be_listed(dom)) if ax is None else tree.with_ax(dom, ax)
    el = tree.synthesize(tree.join_dom_ax(el))
    el = el.filter(F.coalesce(F.col("node_type") == 1, F.lit(False)) | F.col("listed"))
    styles = None
    if layouts is not None and "cursor" in layouts.columns:
        styles = layouts.select("snapshot_id", "id", "cursor")
    el = tree.interactivity_signals(el, listeners, styles)
    el = tree.with_grouping(el)
    if max_candidates is None:  # a limit counts candidates, so it has to see all of them
        el = tree.may_matter(el)
    el = tree.live_label_fallback(tree.resolve_label(el, compat=ax is not None, longest=max_label))
    el, visible, layout = _layout(el, layouts, viewport)
    if frames is not None:
        # One row per frame of a capture: few next to its nodes, but as many as there are captures.
        el = el.join(frames.filter("is_main").groupBy("snapshot_id").agg(
            F.min("frame_id").alias("_main")).hint("merge"), "snapshot_id", "left")
        el = el.withColumn("frame_id", F.coalesce("frame_id", "_main")).join(
            frames.select("snapshot_id", "frame_id", "loader_id").hint("merge"),
            ["snapshot_id", "frame_id"], "left")
    else:
        el = el.withColumn("loader_id", F.lit(None).cast("string"))

    # Rows that can still become elements carry their properties, the rest only their position.
    kind = tree.map_kind("ax_role", "tag")
    keep = F.col("listed") | F.col("has_click_listener") | F.col("has_cursor_pointer") | F.col(
        "has_tabindex")
    heavy = {
        "where_region": tree.resolve_region(F.col("region_above") if digested else None),
        "layout": node_struct("layout", layout),
        "state": tree.extract_state(visible),
        "find": tree.build_locators(F.col("_locators")),
        "attributes_out": tree.extract_attributes(kind),
        "parent_ax_name": F.col("parent_ax_name") if digested else F.get("anc", F.lit(0)).ax_name,
    }
    el = el.withColumn("_locators", F.when(keep, tree.locator_candidates())).select(
        "snapshot_id", "id", "parent_id", "tag", "pre",
        # Cast here, for a cast between the struct of places and what reads it keeps unread fields of the struct alive.
        F.col("pre").cast("bigint").alias("doc_order"), "post", "depth", "frame_path",
        "shadow_path", "listed", "has_ax", "ax_order", "ax_role", "ax_name", "is_container",
        tree.attr("aria-label").alias("aria_label"), tree.attr("id").alias("html_id"),
        "has_click_listener", "has_cursor_pointer", "has_tabindex", "z_index",
        F.coalesce("frame_id", F.lit("unknown")).alias("frame_id"),
        F.coalesce("loader_id", F.lit("")).alias("loader_id"),
        tree.heading_name().alias("heading_name"), kind.alias("kind"), "label", "label_source",
        F.when(keep, F.col("group")).alias("group"),
        F.when(keep, F.col("group_path")).alias("group_path"),
        *[F.when(keep, c).alias(name) for name, c in heavy.items()],
    )
    el = tree.implicit_context(el, "pre" if ax is None else "ax_order", max_candidates)
    if max_nodes is not None:
        el = tree.overlay_budget(el, max_nodes)
    nodes = el.select(
        "snapshot_id", "id", "parent_id", "tag", "post", "depth", "frame_path", "shadow_path",
        "parent_ax_name",
        F.col("id").cast("string").alias("node_id"),
        F.col("id").alias("backend_node_id"), "frame_id", "loader_id", "kind", "label",
        node_struct("where", {
            "region": F.col("where_region"), "group_id": F.col("group_id"),
            "group_path": F.col("group_path"), "heading_context": F.col("heading_context"),
        }).alias("where"),
        "layout", "state", "find", F.col("attributes_out").alias("attributes"),
        "implicitly_interactive", "doc_order",
        "label_source",
    )
    if visible is not None:  # without a layout nothing is hidden, and the state is read only by who asks for it
        nodes = tree.drop_hidden(nodes, include_hidden)
    nodes = tree.filter_noise(nodes)
    if internals:
        return nodes
    return nodes.drop("id", "parent_id", "tag", "post", "depth", "frame_path", "shadow_path",
                      "parent_ax_name")


def compile_captures(pages: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Capture rows with their counts for pages compiled into ``nodes``."""
    captures = pages.select(F.col(key).alias("snapshot_id"), F.col(key).alias("page_id"), "url")
    return tree.snapshot_stats(nodes, captures)
