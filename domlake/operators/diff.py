"""Changes between consecutive captures of a page.

Nodes carry (page_id, step); captures are one row per (page_id, step).  Instead of joining a capture
with the one before it, every row is sent to the capture it belongs to and to the next one, and both
sides meet in one grouping on (page_id, step, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.privacy import url_path
from ..functions.text import trim_ws
from . import identity
from .scan import Ranks, ordered_scan

KEYS = ["page_id", "step"]


def step_links(captures: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(page_id, step) with the steps of the captures before and after."""
    steps = captures.select(*KEYS).distinct()
    return ordered_scan(steps, ["page_id"], ["step"], {
        "prev_step": ("lag", F.col("step")), "next_step": ("lead", F.col("step"))}, ranks)


def pair_rows(rows: DataFrame, links: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """One row per (page_id, step, *by) that exists in the capture or in the one before it, with the
    structs ``curr`` and ``prev``.  First captures have no partner and are left out."""
    linked = rows.select(*KEYS, *by, F.struct(*payload).alias("v")).join(links, KEYS)
    sides = F.array_compact(F.array(
        F.when(F.col("prev_step").isNotNull(), F.struct(
            F.col("step").alias("at"), F.col("v").alias("c"),
            F.when(F.lit(False), F.col("v")).alias("p"))),
        F.when(F.col("next_step").isNotNull(), F.struct(
            F.col("next_step").alias("at"), F.when(F.lit(False), F.col("v")).alias("c"),
            F.col("v").alias("p")))))
    return (
        linked.select("page_id", *by, F.explode(sides).alias("s"))
        .groupBy("page_id", F.col("s.at").alias("step"), *by)
        .agg(F.max("s.c").alias("curr"), F.max("s.p").alias("prev"))
    )


def tracked_elements(nodes: DataFrame) -> DataFrame:
    """Visible interactive and live elements by region-layer id; the last one in a capture wins."""
    fields = ["state", "label", "value"]
    return (
        nodes.filter(F.col("kind").isin(rules.INTERACTIVE_KINDS + rules.LIVE_KINDS)
                     & F.col("state.visible"))
        .select(*KEYS, identity.eid().alias("eid"), "doc_order", "state", "label",
                F.col("attributes.value").alias("value"))
        .groupBy(*KEYS, "eid").agg(F.max_by(F.struct(*fields), "doc_order").alias("v"))
        .select(*KEYS, "eid", "v.*")
    )


def element_pairs(nodes: DataFrame, captures: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    return pair_rows(tracked_elements(nodes), step_links(captures, ranks), ["eid"],
                     ["state", "label", "value"])


def diff_added(nodes: DataFrame, captures: DataFrame) -> DataFrame:
    return element_pairs(nodes, captures).filter("prev IS NULL").select(*KEYS, "eid")


def diff_removed(nodes: DataFrame, captures: DataFrame) -> DataFrame:
    return element_pairs(nodes, captures).filter("curr IS NULL").select(*KEYS, "eid")


def _changes(pairs: DataFrame) -> DataFrame:
    items = [(short, f"state.{field}") for field, short in rules.DIFF_FIELDS.items()]
    items += [("val", "value"), ("label", "label")]
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"prev.{f}").cast("string").alias("from"),
                     F.col(f"curr.{f}").cast("string").alias("to")) for k, f in items]
    changed = F.filter(F.array(*rows), lambda r: ~r["from"].eqNullSafe(r["to"]))
    return pairs.filter("prev IS NOT NULL AND curr IS NOT NULL").select(
        *KEYS, "eid", F.inline(changed))


def diff_changed(nodes: DataFrame, captures: DataFrame) -> DataFrame:
    """One row per changed property of an element present in both captures."""
    return _changes(element_pairs(nodes, captures))


def nav_type(before, after) -> Column:
    same = F.coalesce(url_path(before) == url_path(after), F.lit(False))
    return F.when(same, "soft").otherwise("hard")


def diff_document(captures: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """Captures whose URL or title differs from the one before."""
    here = F.struct(F.col("url").alias("url"), F.col("title").alias("title"))
    linked = ordered_scan(captures, ["page_id"], ["step"], {"before": ("lag", here)}, ranks)
    changed = (F.col("before.url") != F.col("url")) | (F.col("before.title") != F.col("title"))
    return linked.filter(F.col("before").isNotNull() & changed).select(
        *KEYS, F.col("before.url").alias("from_url"), F.col("before.title").alias("from_title"),
        F.col("url").alias("to_url"), F.col("title").alias("to_title"),
        nav_type("before.url", "url").alias("nav_type"))


def diff_layers(stacks: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """Captures whose layer stack differs from the one before; ``stacks`` has (page_id, step,
    stack)."""
    linked = ordered_scan(stacks.select(*KEYS, "stack"), ["page_id"], ["step"],
                          {"before": ("lag", F.col("stack"))}, ranks)
    return linked.filter(F.col("before").isNotNull() & (F.col("before") != F.col("stack"))).select(
        *KEYS, F.col("before").alias("stack_from"), F.col("stack").alias("stack_to"))


def atoms(nodes: DataFrame, captures: DataFrame, max_toasts: int | None = None,
          max_banners: int | None = None) -> DataFrame:
    """Small facts of a capture: viewport, scroll, spinners, form focus and errors, notices.  A part
    that has nothing to report is null."""
    role, kind = F.col("attributes.role"), F.col("kind")
    interactive = kind.isin(rules.INTERACTIVE_KINDS)
    busy = F.try_element_at(F.col("attributes.extra"), F.lit("aria-busy")) == "true"
    focused = interactive & F.col("state.focused")
    yes = lambda c: F.coalesce(c, F.lit(False))
    upto = lambda n, most: n if most is None else F.least(n, F.lit(most))
    agg = nodes.groupBy(*KEYS).agg(
        F.count_if(yes(role == "progressbar") | yes(busy)).alias("spinners"),
        F.bool_or(kind == "form").alias("has_form"),
        F.min_by(F.when(focused, identity.eid()), F.when(focused, F.col("doc_order"))
                 ).alias("focused_field"),
        F.count_if(yes(interactive & F.col("state.invalid"))).alias("errors"),
        upto(F.count_if(yes(role.isin("alert", "status"))), max_toasts).alias("toasts"),
        upto(F.count_if(yes((role == "banner") & (F.col("where.region") != "header"))),
             max_banners).alias("banners"),
    )
    size = lambda c, f: F.col(c).getField(f) if c in captures.columns else F.lit(None).cast(
        "int")
    base = captures.select(
        *KEYS, size("viewport", "w").alias("viewport_w"), size("viewport", "h").alias("viewport_h"),
        F.coalesce(size("scroll", "x"), F.lit(0)).alias("scroll_x"),
        F.coalesce(size("scroll", "y"), F.lit(0)).alias("scroll_y"))
    form = yes(F.col("has_form")) & (F.col("focused_field").isNotNull() | (F.col("errors") > 0))
    notice = (F.col("toasts") > 0) | (F.col("banners") > 0)
    return base.join(agg, KEYS, "left").select(
        *KEYS, "viewport_w", "viewport_h", "scroll_x", "scroll_y",
        F.when(F.col("spinners") > 0, F.col("spinners")).alias("spinners"),
        F.when(form, F.col("focused_field")).alias("focused_field"),
        F.when(form, F.col("errors")).alias("validation_errors"),
        F.when(notice, F.col("toasts")).alias("toasts"),
        F.when(notice, F.col("banners")).alias("banners"))


ATOM_KEYS = {
    "viewport.w": "viewport_w", "viewport.h": "viewport_h", "scroll.x": "scroll_x",
    "scroll.y": "scroll_y", "loading.spinners": "spinners", "forms.focused_field": "focused_field",
    "forms.validation_errors": "validation_errors", "notifications.toasts": "toasts",
}


def diff_atoms(atom_rows: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    now = F.struct(*[F.col(c).cast("string").alias(c) for c in ATOM_KEYS.values()])
    linked = ordered_scan(atom_rows.select(*KEYS, now.alias("now")), ["page_id"],
                          ["step"], {"before": ("lag", F.col("now"))}, ranks)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"before.{c}").alias("from"),
                              F.col(f"now.{c}").alias("to")) for k, c in ATOM_KEYS.items()])
    return linked.filter("before IS NOT NULL").select(*KEYS, F.inline(
        F.filter(rows, lambda r: ~r["from"].eqNullSafe(r["to"]))))


def _short(text, longest: int | None) -> Column:
    t = trim_ws(text)
    if longest is None:
        return t
    return F.when(F.length(t) <= longest, t).otherwise(
        F.concat(F.substring(t, 1, longest - 3), F.lit("...")))


def diff_mutations(nodes: DataFrame, captures: DataFrame, longest: int | None = None,
                   ranks: Ranks | None = None) -> DataFrame:
    """Status, alert, log and progress elements whose text changed or that appeared."""
    role = F.lower("attributes.role")
    rows = nodes.filter(role.isin(rules.STATUS_ROLES) & F.col("state.visible")).select(
        *KEYS, "node_id", F.concat(F.lit("rd-"), F.substring(identity.eid(), 1, 10)).alias("eid"),
        role.alias("role"), "label")
    pairs = pair_rows(rows, step_links(captures, ranks), ["node_id"], ["eid", "role", "label"])
    appeared = F.col("prev").isNull()
    return pairs.filter(F.col("curr").isNotNull()).filter(
        appeared | (F.col("prev.label") != F.col("curr.label"))).select(
        *KEYS, F.when(appeared, "status_appeared").otherwise("text_changed").alias("op"),
        F.col("curr.eid").alias("eid"),
        F.when(appeared, F.col("curr.role")).alias("role"),
        F.when(~appeared, _short("prev.label", longest)).alias("from"),
        _short("curr.label", longest).alias("to"))


def compute_diff(nodes: DataFrame, captures: DataFrame, stacks: DataFrame | None = None
                 ) -> DataFrame:
    """All changes as one long table (page_id, step, op, eid, k, from, to)."""
    ranks = identity.capture_ranks(captures)
    pairs = element_pairs(nodes, captures, ranks)
    none = F.lit(None).cast("string")

    def shaped(df, op, eid_=none, k=none, frm=none, to=none):
        op = F.lit(op) if isinstance(op, str) else op
        return df.select(*KEYS, op.alias("op"), eid_.alias("eid"), k.alias("k"),
                         frm.alias("from"), to.alias("to"))

    c = F.col
    presence = pairs.filter("prev IS NULL OR curr IS NULL")
    out = shaped(presence, F.when(c("prev").isNull(), "added").otherwise("removed"), c("eid"))
    out = out.unionByName(shaped(_changes(pairs), "changed", c("eid"), c("k"), c("from"), c("to")))
    out = out.unionByName(shaped(diff_document(captures, ranks), "doc", none, c("nav_type"),
                                 c("from_url"), c("to_url")))
    out = out.unionByName(shaped(diff_atoms(atoms(nodes, captures), ranks), "atom", none, c("k"),
                                 c("from"), c("to")))
    out = out.unionByName(shaped(diff_mutations(nodes, captures, ranks=ranks), c("op"), c("eid"), c("role"),
                                 c("from"), c("to")))
    if stacks is not None:
        out = out.unionByName(shaped(diff_layers(stacks, ranks), "layer", none, none,
                                     F.array_join("stack_from", ","),
                                     F.array_join("stack_to", ",")))
    return out


def is_empty(diff: DataFrame, captures: DataFrame) -> DataFrame:
    """Whether nothing changed, for every capture that has one before it."""
    counts = diff.groupBy(*KEYS).agg(F.count("*").alias("changes"))
    return step_links(captures).filter("prev_step IS NOT NULL").select(*KEYS).join(
        counts, KEYS, "left").select(*KEYS, F.col("changes").isNull().alias("is_empty"))


def response_mode(captures: DataFrame) -> DataFrame:
    """baseline (first, navigation, error) or diff for every capture.  Captures without nodes are
    errors and are skipped when looking for the previous document.  Needs url and node_count."""
    good = captures.filter(F.coalesce("node_count", F.lit(0)) > 0).select(
        *KEYS, identity.doc_id("url").alias("doc_id"))
    linked = ordered_scan(good, ["page_id"], ["step"],
                          {"before": ("lag", F.struct("doc_id"))})
    reason = F.when(F.col("before").isNull(), "first").when(
        ~F.col("before.doc_id").eqNullSafe(F.col("doc_id")), "navigation")
    out = linked.select(*KEYS, F.when(reason.isNotNull(), "baseline").otherwise("diff")
                        .alias("mode"), reason.alias("reason"))
    bad = captures.filter(F.coalesce("node_count", F.lit(0)) == 0).select(
        *KEYS, F.lit("baseline").alias("mode"), F.lit("error").alias("reason"))
    return out.unionByName(bad)


def navigated(captures: DataFrame) -> DataFrame:
    """Whether each capture shows another document than the one before: another URL, or another
    loader when both are known."""
    loader = F.col("loader_id") if "loader_id" in captures.columns else F.lit(None).cast("string")
    now = F.struct(F.col("url").alias("url"), loader.alias("loader"))
    linked = ordered_scan(captures.select(*KEYS, now.alias("now")), ["page_id"],
                          ["step"], {"before": ("lag", F.col("now"))})
    moved = (F.col("before.url") != F.col("now.url")) | F.coalesce(
        F.col("before.loader") != F.col("now.loader"), F.lit(False))
    return linked.filter("before IS NOT NULL").select(*KEYS, moved.alias("navigated"))
