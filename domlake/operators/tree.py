"""From document rows to semantic elements.

Everything here is expressed on one row per document node.  Regions and groups only look at the
``anc`` array that travels with each row, so they need no join; headings and the node budget are
windows inside one capture, whose size is that of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import privacy
from ..functions.text import (
    WS, blank_to_null, contains_any, is_in, lookup, nfkc, parse_bool, parse_checked, slugify, squeeze,
    squeeze_short, trim_ws, truncate,
)
from ..schema import ATTRIBUTES, BBOX, node_struct

# Role of an INPUT by its type; every other type is a text box.
INPUT_ROLE = {
    "search": "searchbox", "checkbox": "checkbox", "radio": "radio", "range": "slider",
    "number": "spinbutton", "button": "button", "submit": "button", "reset": "button",
    "image": "button",
}
NAME_FROM_CONTENT = ["link", "button", "heading", "listitem", "option", "tab", "menuitem",
                     "menuitemcheckbox", "menuitemradio", "treeitem", "cell", "columnheader",
                     "rowheader", "switch", "checkbox", "radio", "tooltip"]


def attr(name: str, column: str = "attributes") -> Column:
    return F.try_element_at(F.col(column), F.lit(name))


def has_attr(name: str, column: str = "attributes") -> Column:
    return F.coalesce(F.map_contains_key(F.col(column), name), F.lit(False))


def near_text(depth: int | None, column: str = "near_text") -> Column:
    """Text of a node from the pieces stored with it, down to ``depth``; null if none.  Elements that
    are named by their content have all pieces, others those down to 3; None takes what there is."""
    return blank_to_null(squeeze(_joined_text(depth, column)))


def _joined_text(depth: int | None, column: str = "near_text") -> Column:
    near = F.col(column) if depth is None else F.filter(F.col(column), lambda p: p.d <= depth)
    return F.array_join(near.getField("t"), " ")


# -- document structure -------------------------------------------------------------------------

def dom_order(dom: DataFrame) -> DataFrame:
    return dom.select("snapshot_id", "id", "pre")


def context_key(frame_path="frame_path", shadow_path="shadow_path") -> Column:
    """Scope of an html id: the chain of frames and of shadow hosts around the node."""
    def part(c, default):
        return F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), "/")).otherwise(
            F.lit(default))

    return F.concat(part(frame_path, "root"), F.lit("|"), part(shadow_path, "light"))


def id_map(dom: DataFrame) -> DataFrame:
    """(snapshot, context, html id) -> node; the last one in document order wins."""
    return (
        dom.select("snapshot_id", context_key().alias("context"), attr("id").alias("html_id"),
                   "id", "pre")
        .filter(F.length("html_id") > 0)
        .groupBy("snapshot_id", "context", "html_id")
        .agg(F.max_by("id", "pre").alias("id"))
    )


def adjacency(dom: DataFrame) -> DataFrame:
    """Shadow roots per host and documents per frame, in document order."""
    kind = F.when(F.col("node_name") == "#document-fragment", "shadow").when(
        F.col("node_name") == "#document", "document")
    return (
        dom.filter(F.col("parent_id").isNotNull())
        .filter(F.col("node_name").isin("#document", "#document-fragment"))
        .groupBy("snapshot_id", "parent_id", kind.alias("link"))
        .agg(F.array_sort(F.collect_list(F.struct("pre", "id"))).getField("id").alias("roots"))
    )


def ancestors(dom: DataFrame) -> DataFrame:
    """One row per (node, ancestor); distance 1 is the parent."""
    return dom.select("snapshot_id", "id", F.posexplode("ancestors").alias("pos", "a")).select(
        "snapshot_id", "id", (F.col("pos") + 1).alias("distance"),
        F.col("a.id").alias("ancestor_id"), F.col("a.tag").alias("ancestor_tag"))


def text_content(dom: DataFrame, max_depth: int | None = 2,
                 exclude_tags: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """(snapshot, element) -> text of the text nodes at most ``max_depth`` levels below, in document
    order.  Without ``max_depth`` the whole subtree counts.  ``exclude_tags`` skips text that sits
    inside such elements below the node, and the elements themselves."""
    texts = (
        dom.filter((F.col("node_type") == 3) & (trim_ws("node_value") != ""))
        .select("snapshot_id", "pre", "frame_path", "shadow_path",
                trim_ws("node_value").alias("t"),
                F.posexplode("ancestors").alias("pos", "a"),
                F.transform("ancestors", lambda a: a.tag).alias("tags"))
    )
    # Text of a frame or shadow tree belongs to that tree only.
    barrier = F.array_position(
        F.transform("tags", lambda t: t.isin("#document", "#document-fragment")), True)
    texts = texts.filter((barrier == 0) | (F.col("pos") < barrier))
    if max_depth is not None:
        texts = texts.filter(F.col("pos") < max_depth)
    if exclude_tags:
        inside = F.slice("tags", F.lit(1), F.col("pos") + 1)
        texts = texts.filter(~F.exists(inside, lambda t: F.upper(t).isin(exclude_tags)))
    return (
        texts.groupBy("snapshot_id", F.col("a.id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("pre", "t"))).getField("t").alias("parts"))
        .withColumn("text", F.array_join("parts", " "))
        .select("snapshot_id", "id", squeeze("text").alias("text") if normalize else "text")
        .filter(F.col("text") != "")
    )


def clean_text(dom: DataFrame, limit: int = 100) -> DataFrame:
    """Whole visible text under each element without style and script, cut to ``limit``."""
    return text_content(dom, None, rules.EXCLUDED_TEXT_TAGS, normalize=False).withColumn(
        "text", F.substring("text", 1, limit))


# -- accessibility ------------------------------------------------------------------------------

def classify_role(role) -> Column:
    r = F.lower(F.col(role) if isinstance(role, str) else role)
    return (
        F.when(is_in(r, rules.INTERACTIVE_ROLES), "interactive")
        .when(is_in(r, rules.READABLE_ROLES), "readable")
        .when(is_in(r, rules.STRUCTURAL_ROLES), "structural")
        .when(is_in(r, rules.LIVE_ROLES), "live")
        .otherwise("unknown")
    )


def derived_role(role: Column, tag: Column, attributes: Column | None = None) -> Column:
    """Role from the role attribute, else from the tag."""
    explicit = blank_to_null(F.lower(F.split_part(F.trim(role), F.lit(" "), F.lit(1))))
    if attributes is None:
        return F.coalesce(explicit, lookup(tag, rules.TAG_ROLE))
    kind = F.lower(F.coalesce(F.try_element_at(attributes, F.lit("type")), F.lit("text")))
    own = (
        F.when(tag == "A", F.when(F.map_contains_key(attributes, "href"), "link"))
        .when((tag == "INPUT") & (kind != "hidden"),
              F.coalesce(lookup(kind, INPUT_ROLE), F.lit("textbox")))
        .when(tag == "SELECT",
              F.when(F.map_contains_key(attributes, "multiple"), "listbox").otherwise("combobox"))
        .otherwise(lookup(tag, rules.TAG_ROLE))
    )
    return F.coalesce(explicit, own)


def with_derived_ax(dom: DataFrame, name_depth: int | None = None) -> DataFrame:
    """Give every element the role, name and properties a browser would report, from HTML alone.
    Nodes that a browser leaves out, in hidden elements and inert templates, are not in the result.
    Names come from aria-label, alt or the text of elements that are named by their content, all of
    it or down to ``name_depth``."""
    tag = F.upper("node_name")
    is_element = F.col("node_type") == 1
    role = F.when(is_element, derived_role(attr("role"), tag, F.col("attributes")))
    flag = lambda name: F.when(has_attr(name), F.lit("true"))
    aria = lambda name: attr(f"aria-{name}")
    checkable = F.col("ax_role").isin("checkbox", "radio", "switch", "menuitemcheckbox",
                                      "menuitemradio")
    pairs = {
        "disabled": F.coalesce(flag("disabled"), F.when(aria("disabled") == "true", "true")),
        "checked": F.coalesce(aria("checked"), F.when(checkable, F.coalesce(
            flag("checked"), F.lit("false")))),
        "expanded": aria("expanded"),
        "selected": F.coalesce(aria("selected"), F.when(
            F.col("ax_role") == "option", F.coalesce(flag("selected"), F.lit("false")))),
        "pressed": aria("pressed"),
        "invalid": aria("invalid"),
        "level": F.coalesce(aria("level"), F.nullif(
            F.regexp_extract("node_name", "^[Hh]([1-6])$", 1), F.lit(""))),
    }
    props = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
                  for k, v in pairs.items()]),
        lambda e: e.v.isNotNull()))
    named = is_in(F.col("ax_role"), NAME_FROM_CONTENT)
    name = F.coalesce(
        blank_to_null("_aria"),
        F.when(F.col("ax_role").isin("image", "img"), blank_to_null(squeeze(attr("alt")))),
        blank_to_null("_content"),
        F.when(tag.isin("INPUT", "SELECT", "TEXTAREA"), blank_to_null(squeeze("label_text"))),
    )
    style = F.lower(F.coalesce(attr("style"), F.lit("")))
    hidden = (
        (tag == "TEMPLATE") | has_attr("hidden")
        | (F.lower(F.coalesce(attr("aria-hidden"), F.lit(""))) == "true")
        | style.rlike(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)\b")
        | (F.col("in_hidden") if "in_hidden" in dom.columns else F.coalesce(
            F.array_contains(F.col("ancestors").getField("hidden"), True), F.lit(False))))
    up = {"anc": F.col("ancestors")} if "ancestors" in dom.columns else {}
    return (
        dom.filter(~F.coalesce(hidden, F.lit(False)))
        .withColumns({"tag": tag, "ax_role": role, **up, "ax_order": F.col("pre"), "has_ax": is_element})
        # What is read more than once is a column of its own, or it is worked out each time.
        .withColumn("_joined", F.when(named, _joined_text(name_depth)))
        .withColumns({"_aria": squeeze_short(attr("aria-label")), "_content": squeeze_short("_joined")})
        .withColumns({"ax_name": name, "ax_props": props}).drop("_aria", "_joined", "_content")
    )


def derive_ax(dom: DataFrame) -> DataFrame:
    """The derived accessibility tree as its own table."""
    return with_derived_ax(dom).filter(F.col("ax_role").isNotNull()).select(
        "snapshot_id", "id", F.col("ax_role").alias("role"), F.col("ax_name").alias("name"),
        F.col("ax_props").alias("properties"), F.col("ax_order"))


def with_ax(dom: DataFrame, ax: DataFrame) -> DataFrame:
    """Attach a captured accessibility tree, also to the ancestors of each row.  Captures that have
    no such tree at all are marked with ``has_ax`` false."""
    a = ax.select("snapshot_id", "id", F.lower("role").alias("ax_role"),
                  F.col("name").alias("ax_name"), F.col("properties").alias("ax_props"),
                  "ax_order")
    up = (
        dom.select("snapshot_id", "id", F.posexplode("ancestors").alias("pos", "a"))
        .join(a.select("snapshot_id", F.col("id").alias("aid"), F.col("ax_role").alias("ar"),
                       F.col("ax_name").alias("an")),
              (F.col("a.id") == F.col("aid")) & dom["snapshot_id"].eqNullSafe(a["snapshot_id"]),
              "left")
        .groupBy(dom["snapshot_id"], "id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.col("a.id").alias("id"), F.upper("a.tag").alias("tag"),
            "a.role", F.col("ar").alias("ax_role"),
            F.col("an").alias("ax_name"), "a.aria_label", "a.title", "a.html_id"))).alias("up"))
        .withColumn("anc", F.transform("up", lambda x: x.dropFields("pos"))).drop("up")
    )
    # All three sides grow with the captures, whatever their estimated size, so none is broadcast.
    present = a.select("snapshot_id").distinct().withColumn("has_ax", F.lit(True)).hint("merge")
    return (
        dom.join(up.hint("merge"), ["snapshot_id", "id"], "left")
        .join(a.hint("merge"), ["snapshot_id", "id"], "full")
        .join(present, "snapshot_id", "left")
        .withColumn("has_ax", F.coalesce("has_ax", F.lit(False)))
        .withColumn("tag", F.upper("node_name"))
    )


# -- which nodes become elements ----------------------------------------------------------------

def _listed(role: Column) -> Column:
    c = classify_role(role)
    return c.isin("interactive", "readable", "live") | F.coalesce(
        F.lower(role).isin(rules.ESSENTIAL_STRUCTURAL_ROLES), F.lit(False))


def is_toast(attributes: str = "attributes") -> Column:
    """Markup of a known toast library."""
    marked = F.lit(False)
    for name in rules.TOAST_DATA_ATTRS:
        marked = marked | has_attr(name, attributes)
    cls = F.coalesce(attr("class", attributes), attr("classname", attributes))
    return marked | contains_any(cls, rules.TOAST_CLASS_PARTS)


def may_be_listed(dom: DataFrame) -> DataFrame:
    """Document rows that can become elements without a captured tree: elements, and what carries attributes or one of the
    tags that are listed whatever the node is. Text and comments are most of a document, so they go first."""
    tags = [*rules.FALLBACK_TAGS, "OPTION"]
    return dom.filter(F.coalesce(F.col("node_type") == 1, F.lit(False)) | (F.size("attributes") > 0)
                      | F.upper("node_name").isin(tags))


def join_dom_ax(el: DataFrame) -> DataFrame:
    """Rows picked by role class; without any accessibility tree, a few interactive tags."""
    by_role = F.col("has_ax") & _listed(F.col("ax_role"))
    by_tag = ~F.col("has_ax") & F.coalesce(F.col("tag").isin(rules.FALLBACK_TAGS), F.lit(False))
    return el.withColumn("listed", F.coalesce(by_role | by_tag, F.lit(False)))


def synthesize(el: DataFrame) -> DataFrame:
    """Add what accessibility trees leave out: options of listed selects, canvases, toasts.  Each
    is a decision about a single row, so nothing is joined or unioned."""
    if "holder_tag" in el.columns:
        holder_tag, holder_role = F.col("holder_tag"), F.col("holder_role")
    else:
        holder = F.get(F.filter("anc", lambda a: F.upper(a.tag) != "OPTGROUP"), F.lit(0))
        holder_tag, holder_role = holder.tag, holder.ax_role
    select_listed = F.coalesce(
        (F.upper(holder_tag) == "SELECT") & F.when(F.col("has_ax"), _listed(holder_role)).otherwise(True),
        F.lit(False))
    option = (F.col("tag") == "OPTION") & ~F.col("listed") & select_listed
    canvas = (F.col("tag") == "CANVAS") & ~F.col("listed")
    toast = is_toast()
    made = F.coalesce(F.when(toast, F.lit("toast")).when(option, F.lit("option"))
                      .when(canvas, F.lit("canvas")), F.lit("none"))
    option_props = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.when(has_attr(k), F.lit("true")).alias("v"))
                  for k in ("selected", "disabled")]), lambda e: e.v.isNotNull()))
    empty = F.create_map().cast("map<string,string>")
    m = F.col("made")
    return el.withColumn("made", made).withColumns({
        "ax_role": F.when(m == "toast", "alert").when(m == "none", F.col("ax_role")).otherwise(m),
        "ax_name": F.when(m == "toast", "").when(
            m == "option", F.coalesce(near_text(2), F.lit(""))).when(
            m == "canvas", F.coalesce(attr("aria-label"), F.lit(""))).otherwise(F.col("ax_name")),
        "ax_props": F.when(m == "option", option_props).when(
            m == "none", F.col("ax_props")).otherwise(empty),
        "listed": F.col("listed") | (m != "none"),
    })


def interactivity_signals(el: DataFrame, listeners: DataFrame | None = None,
                          styles: DataFrame | None = None) -> DataFrame:
    """Signals that make an element clickable although its role is not: pointer cursor, tab index,
    or a click-type listener on itself or one of its nearest ancestors.  ``listeners`` has
    (snapshot_id, id, type), ``styles`` (snapshot_id, id, cursor)."""
    tab = F.regexp_extract(attr("tabindex"), r"^\s*([+-]?\d+)", 1)
    out = el.withColumn("has_tabindex", F.coalesce(tab.try_cast("int") >= 0, F.lit(False)))
    if styles is None and listeners is None:
        return out.withColumns({"has_cursor_pointer": F.lit(False), "listener_source":
                                F.lit("none"), "has_click_listener": F.lit(False)})
    if styles is not None:
        cursor = styles.groupBy("snapshot_id", "id").agg(
            F.bool_or(F.col("cursor") == "pointer").alias("has_cursor_pointer")).hint("merge")
        out = out.join(cursor, ["snapshot_id", "id"], "left").withColumn(
            "has_cursor_pointer", F.coalesce("has_cursor_pointer", F.lit(False)))
    else:
        out = out.withColumn("has_cursor_pointer", F.lit(False))
    if listeners is None:
        out = out.withColumn("listener_source", F.lit("none"))
    else:
        # The elements with a listener are few and of one capture, so they come to each of its rows: rows are read once.
        click = listeners.filter(F.col("type").isin(rules.CLICK_EVENTS)).groupBy("snapshot_id").agg(
            F.collect_set("id").alias("_clicked")).hint("merge")
        above = F.col("ancestor_ids") if "ancestor_ids" in el.columns else F.transform("anc", lambda a: a.id)
        reach = F.concat(F.array("id"), F.slice(F.coalesce(above, F.array().cast("array<bigint>")),
                                                1, rules.LISTENER_ANCESTORS))
        first = F.array_position(F.transform(reach, lambda i: F.array_contains("_clicked", i)), True) - 1
        out = out.join(click, "snapshot_id", "left").withColumn("_first", F.when(first >= 0, first)).drop("_clicked").withColumn(
            "pos", F.min("_first").over(W.partitionBy("snapshot_id", "id"))).drop("_first").withColumn(
            "listener_source",
            F.when(F.col("pos").isNull() | F.col("has_cursor_pointer") | F.col("has_tabindex"),
                   "none").when(F.col("pos") == 0, "self").otherwise("ancestor")).drop("pos")
    return out.withColumn("has_click_listener", F.col("listener_source") != "none")


def may_matter(el: DataFrame) -> DataFrame:
    """Rows that can become elements, or lend others their name: headings, and containers that hand theirs down. The rest
    of a document goes before its rows are named and brought together."""
    return el.filter(F.col("listed") | F.col("has_click_listener") | F.col("has_cursor_pointer") | F.col("has_tabindex")
                     | F.col("is_container") | is_heading())


def implicit_candidates(el: DataFrame, order: str = "ax_order", most: int | None = None
                        ) -> DataFrame:
    """Elements to keep beyond the listed ones: those of unknown role (the first ``most`` of a capture,
    if given) that carry a signal.  Signals only count for elements that are not interactive by role."""
    kind = F.coalesce(lookup(F.lower("ax_role"), rules.ROLE_TO_KIND), F.lit("generic"))
    unknown = ~F.col("listed") & F.col("has_ax") & F.col("ax_order").isNotNull() & (
        classify_role("ax_role") == "unknown")
    rank = F.count_if(unknown).over(W.partitionBy("snapshot_id").orderBy(
        F.asc_nulls_last(order)).rowsBetween(W.unboundedPreceding, 0))
    signal = F.col("has_click_listener") | F.col("has_cursor_pointer") | F.col("has_tabindex")
    extra = unknown & signal
    if most is not None:
        extra = extra & (F.col("_rank") <= most)
    counts = (F.col("listed") & ~is_in(kind, rules.INTERACTIVE_KINDS)) | extra
    return (
        el.withColumn("_rank", rank)
        .withColumn("implicitly_interactive", counts & signal)
        .filter(F.col("listed") | extra).drop("_rank")
    )


def overlay_budget(df: DataFrame, max_nodes: int, z: str = "z_index",
                   order: str = "pre") -> DataFrame:
    """Keep at most ``max_nodes`` rows per capture in their order; nodes above z 100 may take up to
    30 % of the slots ahead of later main nodes."""
    over = F.coalesce(F.col(z) > rules.OVERLAY_Z, F.lit(False))
    whole = W.partitionBy("snapshot_id")
    upto = whole.orderBy(F.asc_nulls_last(order)).rowsBetween(W.unboundedPreceding, 0)
    slots = F.least(F.col("_over"), F.floor(F.lit(max_nodes * rules.OVERLAY_RATIO + 1e-9)))
    return (
        df.withColumn("_is_over", over)
        .withColumn("_rank_over", F.count_if("_is_over").over(upto))
        .withColumn("_rank_main", F.count_if(~F.col("_is_over")).over(upto))
        .withColumn("_total", F.count("*").over(whole))
        .withColumn("_over", F.count_if("_is_over").over(whole))
        .filter((F.col("_total") <= max_nodes)
                | F.when(F.col("_is_over"), F.col("_rank_over") <= slots)
                .otherwise(F.col("_rank_main") <= max_nodes - slots))
        .drop("_is_over", "_rank_over", "_rank_main", "_total", "_over")
    )


# -- properties of one element ------------------------------------------------------------------

def map_kind(role, tag) -> Column:
    role = F.col(role) if isinstance(role, str) else role
    tag = F.col(tag) if isinstance(tag, str) else tag
    by_role = F.coalesce(lookup(F.lower(role), rules.ROLE_TO_KIND), F.lit("generic"))
    by_tag = F.coalesce(lookup(F.upper(tag), rules.TAG_TO_KIND), F.lit("generic"))
    return F.when(F.length(role) > 0, by_role).otherwise(by_tag)


def _role_region(role: Column) -> Column:
    return lookup(F.lower(role), rules.ROLE_TO_REGION)


def _tag_region(tag: Column) -> Column:
    return lookup(F.upper(tag), rules.TAG_TO_REGION)


def resolve_region(above: Column | None = None) -> Column:
    """Own role, own role attribute, own tag; then per ancestor role, tag, role attribute, unless ``above`` has that."""
    if above is None:
        above = F.get(F.filter(F.transform("anc", lambda a: F.coalesce(
            _role_region(a.ax_role), _tag_region(a.tag), _role_region(a.role))),
            lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(
        _role_region(F.col("ax_role")), _role_region(attr("role")), _tag_region(F.col("tag")),
        above, F.lit("unknown"))


def _is_container(a: Column) -> Column:
    def has(role):
        return F.coalesce(is_in(F.lower(role), rules.GROUPING_ROLES), F.lit(False))

    return has(a.ax_role) | F.coalesce(is_in(F.upper(a.tag), rules.GROUPING_TAGS), F.lit(False)) | has(
        a.role)


def group_id(container: Column, heading: Column) -> Column:
    """role-slug(name), else role-slug(heading), else role-node id."""
    role = F.coalesce(F.lower(container.ax_role), F.lower(container.role),
                      F.lower(F.upper(container.tag)), F.lit("group"))
    name = F.coalesce(container.ax_name, container.aria_label, container.html_id, F.lit(""))
    # Taken from an array, for a slug that is tested and then read would be worked out twice.
    own = lambda text: F.get(F.filter(F.array(slugify(text)), lambda s: F.length(s) > 0), F.lit(0))
    slug = F.coalesce(own(name), own(heading), container.id.cast("string"))
    return F.when(container.id.isNotNull(), F.concat(role, F.lit("-"), slug))


def with_grouping(el: DataFrame) -> DataFrame:
    """``group`` is the nearest grouping ancestor, ``group_path`` the names of all of them from the
    outside in."""
    path = F.reverse(F.filter(F.transform(
        "_containers", lambda a: F.coalesce(a.ax_name, a.aria_label, a.title)),
        lambda n: F.length(n) > 0))
    known = F.size("group_path") > 0
    own = F.struct("ax_role", "tag", attr("role").alias("role"))
    containers = F.col("containers") if "containers" in el.columns else F.filter("anc", _is_container)
    return el.withColumns({"_containers": containers, "is_container": _is_container(own)}).withColumns({
        "group": F.get("_containers", F.lit(0)), "group_path": path
    }).withColumn("group_path", F.when(known, F.col("group_path"))).drop("_containers", "containers")


def labelledby(dom: DataFrame) -> DataFrame:
    """(snapshot, id) -> text referenced by aria-labelledby, resolved inside the same frame and
    shadow scope; a referenced element contributes its aria-label."""
    refs = (
        dom.select("snapshot_id", context_key().alias("context"), "id",
                   attr("aria-labelledby").alias("ids"))
        .filter(F.length(squeeze("ids")) > 0)
        .select("snapshot_id", "context", "id",
                F.posexplode(F.split(squeeze("ids"), " ")).alias("pos", "html_id"))
    )
    targets = (
        dom.select("snapshot_id", context_key().alias("context"), attr("id").alias("html_id"),
                   "pre", F.coalesce(blank_to_null(squeeze(attr("aria-label"))),
                                     blank_to_null("node_value")).alias("part"))
        .filter(F.length("html_id") > 0)
        .groupBy("snapshot_id", "context", "html_id")
        .agg(F.max_by(F.struct("part"), "pre").alias("t"))
    )
    return (
        refs.join(targets, ["snapshot_id", "context", "html_id"])
        .filter(F.col("t.part").isNotNull())
        .groupBy("snapshot_id", "id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", F.col("t.part")
                                                               .alias("part")))).getField("part"),
                          " ").alias("labelledby"))
    )


def _label_choices() -> list[tuple[str, Column]]:
    """Naming sources in order; text that is empty does not count."""
    tag, kind = F.col("tag"), F.lower(attr("type"))
    def own(name):
        return squeeze_short(F.coalesce(attr(name, "compat_forms"), attr(name)))

    out = [
        ("ax-name", squeeze_short("ax_name")),
        ("labelledby", F.col("labelledby")),
        ("aria-label", own("aria-label")),
        ("title", own("title")),
        ("placeholder", F.when(tag.isin("INPUT", "TEXTAREA"), own("placeholder"))),
        ("alt", F.when(tag.isin("IMG", "IMAGE"), own("alt"))),
        ("value", F.when((tag == "INPUT") & kind.isin("submit", "button", "reset"),
                         own("value"))),
        ("name", F.when(tag.isin("INPUT", "SELECT", "TEXTAREA"), own("name"))),
    ]
    return out + [("test-id", own(name)) for name in rules.TEST_ID_ATTRS]


def resolve_label(el: DataFrame, compat: bool = True, longest: int | None = None) -> DataFrame:
    """Adds ``label`` and ``label_source``: the first naming source that has text.  Text and
    attributes from the document sources are NFKC already; ``compat`` also normalises names that
    came with a captured accessibility tree."""
    sources = {f"_label_{i}": choice for i, choice in enumerate(_label_choices())}
    choices = [F.when(F.length(c) > 0, F.struct(F.lit(s).alias("source"), F.col(c).alias("text")))
               for c, (s, _) in sources.items()]
    none = F.struct(F.lit("none").alias("source"), F.lit("").alias("text"))
    # Each source is a column of its own, or its text is worked out again for the test and the result.
    out = el.withColumns({c: text for c, (_, text) in sources.items()}).withColumn(
        "_label", F.coalesce(*choices, none)).drop(*sources)
    text = F.col("_label.text")
    if compat:
        text = squeeze(nfkc(text))
    return out.withColumns({"label": text if longest is None else truncate(text, longest),
                            "label_source": F.col("_label.source")}).drop("_label")


def live_label_fallback(el: DataFrame) -> DataFrame:
    """Live regions without a label take their text."""
    live = F.lower("ax_role").isin(rules.LIVE_ROLES)
    return el.withColumn("label", F.when(
        live & (F.col("label") == ""), F.coalesce(near_text(3), F.lit(""))).otherwise(
        F.col("label")))


def is_heading() -> Column:
    return F.coalesce(F.col("ax_role") == "heading", F.lit(False)) | F.coalesce(
        F.col("tag").rlike("^H[1-6]$"), F.lit(False))


def heading_name() -> Column:
    """Name of a heading element, null for anything else.  Needs ``label``, ``label_source``."""
    return F.when(is_heading(), F.coalesce(
        blank_to_null("ax_name"), F.when(F.col("label_source") != "none", F.col("label")),
        near_text(2)))


def heading_context(el: DataFrame) -> DataFrame:
    """Adds ``heading_context``: the most recent ``heading_name`` in document order.  Documents in
    frames start without one and do not pass theirs on."""
    w = W.partitionBy("snapshot_id", "frame_path").orderBy(F.asc_nulls_last("pre")).rowsBetween(
        W.unboundedPreceding, 0)
    return el.withColumn("heading_context", F.when(
        F.col("pre").isNotNull(), F.last("heading_name", ignorenulls=True).over(w)))


def heading_context_local(el: DataFrame) -> DataFrame:
    """Adds ``heading_local``: name of the nearest heading among the preceding siblings, else of the
    previous named heading in the element list.  ``listed`` marks list members."""
    head = F.col("listed") & is_heading()
    before = W.partitionBy("snapshot_id").orderBy(F.asc_nulls_last("pre")).rowsBetween(
        W.unboundedPreceding, -1)
    sib = W.partitionBy("snapshot_id", "parent_id").orderBy(F.asc_nulls_last("pre")).rowsBetween(
        W.unboundedPreceding, -1)
    previous = F.last(F.when(head & (F.length("ax_name") > 0), F.col("ax_name")),
                      ignorenulls=True).over(before)
    sibling = F.last(F.when(head, F.struct("ax_name")), ignorenulls=True).over(sib)
    return (
        el.withColumn("_prev", previous)
        .withColumn("_sib", F.when(F.col("parent_id").isNotNull(), sibling))
        .withColumn("heading_local", F.when(F.col("_sib").isNotNull(), F.col("_sib.ax_name"))
                    .when(F.col("listed") & F.col("parent_id").isNotNull(), F.col("_prev")))
        .drop("_sib", "_prev")
    )


def with_group_id(el: DataFrame) -> DataFrame:
    """Adds ``group_id``.  Containers without a name of their own hand their local heading to the
    nodes they group: such a container comes twice, once as itself and once among those nodes."""
    named = F.coalesce("ax_name", "aria_label", "html_id").isNotNull()
    gives = F.coalesce(F.col("is_container") & ~named & (F.length("heading_local") > 0), F.lit(False))
    rows = el.withColumn("_hands", F.explode(F.when(gives, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    family = W.partitionBy("snapshot_id", F.when(F.col("_hands"), F.col("id")).otherwise(F.col("group.id")))
    handed = F.max(F.when(F.col("_hands"), F.col("heading_local"))).over(family)
    return rows.withColumn("_handed", handed).filter(~F.col("_hands")).withColumn(
        "group_id", group_id(F.col("group"), F.col("_handed"))).drop("_hands", "_handed")


def extract_state(visible: Column | None = None) -> Column:
    """State struct from accessibility properties and attributes."""
    prop = lambda name: F.try_element_at(F.col("ax_props"), F.lit(name))
    ax_disabled = prop("disabled")
    off = F.when(ax_disabled.isNotNull(), F.coalesce(parse_bool(ax_disabled), F.lit(False))
                 ).otherwise(has_attr("disabled") | F.coalesce(
                     attr("aria-disabled") == "true", F.lit(False)))
    usable = F.coalesce(attr("aria-disabled") == "false", F.lit(False)) | F.coalesce(
        (F.col("has_click_listener") & (F.col("listener_source") == "self"))
        | F.col("has_cursor_pointer"), F.lit(False))
    flag = lambda name: F.when(
        has_attr(name) | F.coalesce(attr(f"aria-{name}") == "true", F.lit(False)), F.lit(True))
    invalid = prop("invalid")
    return node_struct("state", {
        "visible": F.lit(True) if visible is None else F.coalesce(visible, F.lit(True)),
        "enabled": ~off | usable,
        "checked": parse_checked(prop("checked")),
        "expanded": parse_bool(prop("expanded")),
        "selected": parse_bool(prop("selected")),
        "pressed": parse_bool(prop("pressed")),
        "focused": parse_bool(prop("focused")),
        "required": flag("required"),
        "invalid": F.when(invalid.isNotNull(), invalid != "false").when(
            attr("aria-invalid") == "true", F.lit(True)),
        "readonly": flag("readonly"),
    })


def visibility(w, h, display=None, visibility_=None, clip_path=None) -> Column:
    def col(c):
        return F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c

    hidden = (
        F.coalesce(col(display) == "none", F.lit(False))
        | F.coalesce(col(visibility_).isin("hidden", "collapse"), F.lit(False))
        | F.coalesce(col(clip_path) == "inset(100%)", F.lit(False))
        | F.coalesce((col(w) == 0) | (col(h) == 0), F.lit(False))
    )
    return ~hidden


def screen_zone(box, width: float, height: float) -> Column:
    """Cell of a 3 x 3 grid by the box centre, or below-fold when the top is past the viewport."""
    box = F.col(box) if isinstance(box, str) else box
    cx, cy = box.x + box.w / 2, box.y + box.h / 2
    across = F.when(cx < width / 3, "left").when(cx < width / 3 * 2, "center").otherwise("right")
    down = F.when(cy < height / 3, "top").when(cy < height / 3 * 2, "middle").otherwise("bottom")
    return F.when(box.y >= height, "below-fold").otherwise(F.concat(down, F.lit("-"), across))


def extract_attributes(kind: Column) -> Column:
    """Attribute struct for an element of the given kind; passwords are redacted, secrets dropped
    from links."""
    level = F.coalesce(
        F.try_element_at(F.col("ax_props"), F.lit("level")).try_cast("int"),
        F.regexp_extract("tag", "^H([1-6])$", 1).try_cast("int"))
    level = F.when(level.between(1, 6), level).otherwise(
        F.regexp_extract("tag", "^H([1-6])$", 1).try_cast("int"))
    own = lambda name: blank_to_null(attr(name))
    extra = F.map_filter("attributes", lambda k, v: k.isin(
        "class", "open", "aria-modal", "aria-busy", "aria-label", "data-portal", "data-overlay",
        "data-modal", "data-testid"))
    return F.when(F.col("attributes").isNotNull(), node_struct("attributes", {
        "input_type": F.when(kind.isin("input", "combobox"), own("type")),
        "placeholder": own("placeholder"),
        "value": F.when(F.lower(attr("type")) == "password",
                        F.when(has_attr("value"), F.lit("[REDACTED]"))).otherwise(attr("value")),
        "href": F.when(kind == "link", privacy.redact_url(own("href"))),
        "alt": F.when(kind == "image", own("alt")),
        "src": F.when(kind == "image", privacy.image_src(own("src"))),
        "heading_level": F.when(kind == "heading", level),
        "action": F.when(kind == "form", own("action")),
        "method": F.when(kind == "form", own("method")),
        "autocomplete": own("autocomplete"),
        "name": own("name"),
        "test_id": F.coalesce(*[own(n) for n in rules.TEST_ID_ATTRS]),
        "role": own("role"),
        "extra": extra,
    })).cast(ATTRIBUTES)


# -- locators -----------------------------------------------------------------------------------

def _quote(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _css(c: Column) -> Column:
    """Escape an identifier for use after '#' or '.' in a selector."""
    s = F.regexp_replace(c, r"([^a-zA-Z0-9_\-\x{80}-\x{10FFFF}])", r"\\$1")
    return F.regexp_replace(s, r"^(-?)([0-9])", r"$1\\3$2 ")


def locator_candidates() -> Column:
    """Selectors of an element in order of preference."""
    short = lambda c: F.when(F.length(c) <= rules.MAX_LOCATOR_VALUE, blank_to_null(c))
    tag = F.lower("tag")
    test_id = F.coalesce(*[
        F.when(short(attr(n)).isNotNull(),
               F.concat(F.lit(f'[{n}="'), _quote(attr(n)), F.lit('"]')))
        for n in rules.TEST_ID_ATTRS])
    role = blank_to_null("ax_role")
    name = F.coalesce(F.when(trim_ws("ax_name") != "", F.col("ax_name")),
                      blank_to_null(squeeze(attr("aria-label"))))
    usable = (F.length(name) <= rules.MAX_LOCATOR_VALUE) & ~name.rlike(r"[\x00-\x1F\x7F]")
    named = F.when(usable, F.concat(F.lit("role="), role, F.lit('[name="'), _quote(name),
                                    F.lit('"]')))
    # A role alone is only worth a selector when nothing better came first.
    bare = F.when(test_id.isNull(), F.concat(F.lit("role="), role))
    classes = F.filter(F.split(F.coalesce(attr("class"), F.lit("")), WS + "+"),
                       lambda c: c != "")
    cls = F.coalesce(
        F.get(F.filter(classes, lambda c: ~is_in(F.lower(c), rules.GENERIC_CLASSES)), F.lit(0)),
        F.get(classes, F.lit(0)))
    return F.array_compact(F.array_distinct(F.array(
        test_id,
        F.coalesce(named, bare),
        F.concat(F.lit("#"), _css(short(attr("id")))),
        F.concat(F.lit('[aria-label="'), _quote(short(attr("aria-label"))), F.lit('"]')),
        F.when(tag.isin("input", "select", "textarea"),
               F.concat(F.lit('[name="'), _quote(short(attr("name"))), F.lit('"]'))),
        F.concat(tag, F.lit("."), _css(short(cls))),
    )))


def build_locators(candidates: Column | None = None) -> Column:
    """Struct of selectors from ``candidates``; a column of its own is worked out once, not for each field."""
    c = locator_candidates() if candidates is None else candidates
    path = lambda name: F.when(F.size(name) > 0, F.col(name).cast("array<string>"))
    rest = F.slice(c, 2, 3)
    return node_struct("find", {
        "primary": F.coalesce(F.get(c, F.lit(0)), F.lower("tag"), F.lit("*")),
        "alternates": F.when(F.size(rest) > 0, rest),
        "frame_path": path("frame_path"),
        "shadow_path": path("shadow_path"),
    })


def locator_table(nodes: DataFrame) -> DataFrame:
    """One row per (element, selector) with the number of elements in the capture that carry the
    same selector, so unique ones can be picked."""
    rows = nodes.select("snapshot_id", "node_id", F.posexplode(F.concat(
        F.array("find.primary"), F.coalesce("find.alternates", F.array().cast("array<string>"))
    )).alias("rank", "locator"))
    counts = rows.groupBy("snapshot_id", "locator").agg(F.count("*").alias("matches"))
    return rows.join(counts.hint("merge"), ["snapshot_id", "locator"])


# -- cleaning and summary -----------------------------------------------------------------------

def drop_hidden(nodes: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Keep visible elements; options of a closed select always count as visible."""
    option = F.coalesce(F.col("tag") == "OPTION", F.lit(False))
    state = F.col("state").withField("visible", F.col("state.visible") | option)
    out = nodes.withColumn("state", state)
    return out if include_hidden else out.filter(F.coalesce(F.col("state.visible"), F.lit(True)))


def filter_noise(nodes: DataFrame) -> DataFrame:
    """Drop unlabelled lists and list items without an interactive element below, and text that
    repeats the label of its parent.

    ``post + depth`` is the last position inside a node's subtree, so a list has an interactive
    descendant when the next interactive node in document order is not past it.  Text rows share a
    family key with their parent, which hands them its label."""
    back = W.partitionBy("snapshot_id", "frame_path", "shadow_path").orderBy(
        F.desc_nulls_first("doc_order")).rowsBetween(W.unboundedPreceding, -1)
    upcoming = F.last(F.when(is_in("kind", rules.INTERACTIVE_KINDS), F.col("doc_order")),
                      ignorenulls=True).over(back)
    is_text = F.col("kind") == "text"
    hollow = F.col("kind").isin("list", "listitem") & (trim_ws("label") == "") & ~F.coalesce(
        F.col("_next") <= F.col("post") + F.col("depth"), F.lit(False))
    family = W.partitionBy("snapshot_id", F.when(is_text, F.col("parent_id")).otherwise(
        F.col("id")))
    parent_label = F.coalesce(F.max(F.when(~is_text, F.col("label"))).over(family),
                              F.col("parent_ax_name"))
    repeats = is_text & (F.length("_parent_label") > 0) & (F.length("label") > 0) & (
        F.lower(trim_ws("label")) == F.lower(trim_ws("_parent_label")))
    return (
        nodes.withColumn("_next", upcoming).withColumn("_parent_label", parent_label)
        .filter(~hollow & ~F.coalesce(repeats, F.lit(False)))
        .drop("_next", "_parent_label")
    )


def snapshot_stats(nodes: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Node counts per capture; captures without nodes count zero when given."""
    stats = nodes.groupBy("snapshot_id").agg(
        F.count("*").alias("node_count"),
        F.count_if(is_in("kind", rules.INTERACTIVE_KINDS)
                   | F.coalesce("implicitly_interactive", F.lit(False))
                   ).alias("interactive_count"))
    if captures is None:
        return stats
    return captures.join(stats, "snapshot_id", "left").fillna(
        0, ["node_count", "interactive_count"])


def snapshot_health(stats: DataFrame) -> DataFrame:
    """Adds valid, reason, code.  Uses ``partial``, ``warnings`` and ``error`` columns if present."""
    has = lambda name: name in stats.columns
    partial = F.coalesce("partial", F.lit(False)) if has("partial") else F.lit(False)
    warned = F.lower(F.array_join("warnings", " ")) if has("warnings") else F.lit(None).cast(
        "string")
    error = F.lower("error") if has("error") else F.lit(None).cast("string")
    empty = F.coalesce(F.col("node_count"), F.lit(0)) == 0
    gone = F.coalesce(error.rlike("session|target closed|detached"), F.lit(False))
    reason = F.when(error.isNotNull(), "error").when(empty, "empty").when(
        (F.col("interactive_count") == 0) | partial, "partial")
    code = (
        F.when(gone, "CDP_SESSION_DEAD").when(error.isNotNull(), "UNKNOWN")
        .when(~empty, "HEALTHY")
        .when(F.coalesce(F.contains(warned, F.lit("ax")), F.lit(False)), "AX_EMPTY")
        .when(F.coalesce(F.contains(warned, F.lit("dom")), F.lit(False)), "DOM_EMPTY")
        .otherwise("PENDING_DOM")
    )
    return stats.withColumn("valid", ~empty & error.isNull()).withColumn("reason", reason) \
        .withColumn("code", code)


EMPTY_BOX = "named_struct('x', 0D, 'y', 0D, 'w', 0D, 'h', 0D)"
BOX_TYPE = BBOX


def implicit_context(el: DataFrame, order: str = "ax_order", most: int | None = None) -> DataFrame:
    """All steps that need the whole element list of a capture before it is cut down: local and
    global headings, group ids, and which unlisted elements stay."""
    el = heading_context_local(el)
    el = with_group_id(el)
    el = heading_context(el)
    return implicit_candidates(el, order, most)
