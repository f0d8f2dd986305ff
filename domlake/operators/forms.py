"""Forms: detection from markup or from clusters of inputs, purposes, options, state, actions.

Nodes use the common layout plus a capture key ``snapshot_id``.  Every join is inside one capture
and on an equality (region and group, region and heading, or a grid cell), never on all pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions.privacy import mask_runtime_value
from ..functions.text import blank_to_null, contains_any, literal_rows, lookup, trim_ws
from .grid import points_in_boxes


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- detection ----------------------------------------------------------------------------------

def explicit_forms(nodes: DataFrame) -> DataFrame:
    """Form elements with the signal that makes them one."""
    role = F.col("attributes.role")
    signal = F.when(F.col("kind") == "form", "form_tag").when(role == "search", "role_search").when(
        role == "form", "role_form")
    return nodes.withColumn("signal", signal).filter(F.col("signal").isNotNull())


def _near(forms: DataFrame, nodes: DataFrame, pad: tuple[int, int, int, int], form_box: str,
          keys: list[str]) -> DataFrame:
    """(form_key, node_id) where the node's corner lies in the form's box widened by pad
    (left, top, right, bottom)."""
    b = {k: F.col(f"{form_box}.{k}") for k in "xywh"}
    f = forms.select(*dict.fromkeys([*keys, "form_key"]), F.struct(*[b[k].alias(k) for k in "xywh"]).alias("_b"))
    n = nodes.select(*keys, "node_id", F.col("layout.bbox").alias("_b"))
    x, y, w, h = (F.col(f"_b.{k}") for k in "xywh")
    out = points_in_boxes(f, n, keys, (x - pad[0], y - pad[1]), (x + w + pad[2], y + h + pad[3]), (x, y))
    return out.select("snapshot_id", F.col("box.form_key").alias("form_key"), F.col("point.node_id").alias("node_id"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("region", F.col("where.region")).withColumn(
        "group_id", F.col("where.group_id")).withColumn(
        "heading", F.col("where.heading_context"))


def within_form(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, form_key, node_id): nodes of the form's region that share its group or heading,
    or whose corner lies within 50 px of its box.  ``form_key`` is the form's node id."""
    f = _placed(forms.withColumn("form_key", F.col("node_id")))
    n = _placed(nodes)

    def by(column):
        # Join keys are non-null and non-empty by construction of the filter.
        left = f.filter(F.length(column) > 0).select("snapshot_id", "region", column, "form_key")
        right = n.filter(F.length(column) > 0).select("snapshot_id", "region", column, "node_id")
        return left.join(right, ["snapshot_id", "region", column]).select(
            "snapshot_id", "form_key", "node_id")

    near = _near(f, n, (50, 50, 50, 50), "layout.bbox", ["snapshot_id", "region"])
    return by("group_id").unionByName(by("heading")).unionByName(near).distinct()


def cluster_inputs(inputs: DataFrame, gap: float = 200) -> DataFrame:
    """Adds ``cluster``: numbered per capture; inputs of one region belong together while the next
    one starts at most ``gap`` px below the end of the one before it."""
    y, h = F.coalesce("layout.bbox.y", F.lit(0.0)), F.coalesce("layout.bbox.h", F.lit(0.0))
    w = W.partitionBy("snapshot_id", "where.region").orderBy("_y", "doc_order")
    rows = inputs.withColumn("_y", y).withColumn("_end", y + h)
    rows = rows.withColumn("_first", F.min("doc_order").over(
        W.partitionBy("snapshot_id", "where.region")))
    jump = F.col("_y") - F.lag("_end").over(w)
    rows = rows.withColumn("_new", F.when(jump.isNull() | (jump > gap), 1).otherwise(0))
    order = W.partitionBy("snapshot_id").orderBy("_first", "_y", "doc_order").rowsBetween(
        W.unboundedPreceding, 0)
    return rows.withColumn("cluster", F.sum("_new").over(order) - 1).withColumn(
        "in_cluster", F.row_number().over(W.partitionBy("snapshot_id", "cluster")
                                          .orderBy("_y", "doc_order")) - 1
    ).drop("_y", "_end", "_first", "_new")


def cluster_bbox(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Envelope of the boxes per key."""
    b = {k: F.col(f"layout.bbox.{k}") for k in "xywh"}
    agg = rows.groupBy(*keys).agg(
        F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"),
        F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"))
    return agg.select(*keys, F.struct(
        "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))
        .alias("bbox"))


def is_submit(label="label", input_type="attributes.input_type") -> Column:
    return contains_any(F.lower(F.col(label)), rules.SUBMIT_KEYWORDS) | _yes(
        F.col(input_type) == "submit")


def near_box(forms: DataFrame, buttons: DataFrame) -> DataFrame:
    """Buttons close to a form's ``bbox``: 100 px aside, 50 px above, 150 px below."""
    return _near(forms, buttons, (100, 50, 100, 150), "bbox", ["snapshot_id"])


def find_submit(forms: DataFrame, nodes: DataFrame, inside: DataFrame | None,
                field_boxes: DataFrame) -> DataFrame:
    """(snapshot_id, form_key, submit_id, submit_label): the first submit button inside the form,
    else the first near its fields.  ``inside`` has (snapshot_id, form_key, node_id) pairs,
    ``field_boxes`` (snapshot_id, form_key, bbox)."""
    submits = nodes.filter(F.col("kind").isin(rules.BUTTON_KINDS) & is_submit())
    near = near_box(field_boxes, submits).withColumn("tier", F.lit(1))
    found = near if inside is None else near.unionByName(inside.withColumn("tier", F.lit(0)))
    b = submits.select("snapshot_id", "node_id", "label", "doc_order")
    return (
        forms.select("snapshot_id", "form_key")
        .join(found, ["snapshot_id", "form_key"]).join(b, ["snapshot_id", "node_id"])
        .groupBy("snapshot_id", "form_key")
        .agg(F.min_by(F.struct("node_id", "label"), F.struct("tier", "doc_order")).alias("s"))
        .select("snapshot_id", "form_key", F.col("s.node_id").alias("submit_id"),
                F.col("s.label").alias("submit_label")))


def form_confidence(signals) -> Column:
    """Weighted sum of (type, strength) signals, at most 1."""
    s = F.col(signals) if isinstance(signals, str) else signals
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.strength * F.coalesce(
        lookup(x.type, rules.SIGNAL_WEIGHTS), F.lit(0.0)))
    return F.least(F.lit(1.0), total)


def infer_intent(text) -> Column:
    """Intent whose keywords weigh most in a text; the earlier of equals, 'unknown' without any."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    table = literal_rows([(-i, intent, word, float(weight))
                          for i, (intent, words) in enumerate(rules.INTENT_KEYWORDS.items())
                          for word, weight in words], ("rank", "intent", "word", "weight"))

    def best(hits):
        return F.array_max(F.transform(hits, lambda e: F.struct(
            F.aggregate(F.filter(hits, lambda o: o.rank == e.rank), F.lit(0.0),
                        lambda acc, o: acc + o.weight).alias("score"),
            e.rank.alias("rank"), e.intent.alias("intent")))).intent

    # The text and its hits are lambda variables, or they would be worked out anew for each keyword.
    found = F.transform(F.array(t), lambda x: F.filter(table, lambda e: F.contains(x, e.word)))
    return F.coalesce(F.get(F.transform(found, best), F.lit(0)), F.lit("unknown"))


def has_intent_words(text) -> Column:
    words = [w for entries in rules.INTENT_KEYWORDS.values() for w, _ in entries]
    return contains_any(F.lower(F.col(text) if isinstance(text, str) else text), words)


# -- purpose and constraints of a field ---------------------------------------------------------

def _first_match(text: Column, table: list[tuple[str, str]], source: str, verb: str) -> Column:
    """struct(type, why) of the first (word, type) whose word occurs in the text."""
    hit = F.get(F.filter(literal_rows(table, ("word", "type")),
                         lambda e: F.contains(text, e.word)), F.lit(0))
    return F.struct(hit.type.alias("type"), F.concat(F.lit(f'{source} {verb} "'), hit.word,
                                                     F.lit('"')).alias("why"))


def infer_purpose(kind="kind", label="label", attrs: str = "attributes") -> Column:
    """struct(semantic_type, confidence, inferred_from): input type, else autocomplete, else words
    of the label or placeholder, else patterns in names, else the kind of control."""
    a = lambda name: F.col(f"{attrs}.{name}")
    kind, label = F.col(kind), F.coalesce(F.col(label), F.lit(""))
    words = [(w, t) for t, ws in rules.LABEL_PURPOSE.items() for w in ws]
    names = list(rules.NAME_PURPOSE.items())
    strip = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9_-]", "")

    def pick(kind_, confidence, why):
        return F.when(kind_.isNotNull(), F.struct(
            kind_.alias("semantic_type"),
            (confidence if isinstance(confidence, Column) else F.lit(confidence))
            .alias("confidence"), F.array(why).alias("inferred_from")))

    def of(match, confidence):
        return pick(match.type, confidence, match.why)

    by_kind = lookup(kind, {k: v[0] for k, v in rules.KIND_PURPOSE.items()})
    by_kind_conf = lookup(kind, {k: v[1] for k, v in rules.KIND_PURPOSE.items()})
    return F.coalesce(
        pick(lookup(a("input_type"), rules.INPUT_TYPE_PURPOSE), 0.95,
             F.concat(F.lit('input_type="'), a("input_type"), F.lit('"'))),
        pick(lookup(a("autocomplete"), rules.AUTOCOMPLETE_PURPOSE), 0.9,
             F.concat(F.lit('autocomplete="'), a("autocomplete"), F.lit('"'))),
        of(_first_match(F.lower(label), words, "label", "contains"), 0.7),
        of(_first_match(F.lower(a("placeholder")), words, "placeholder", "contains"), 0.65),
        of(_first_match(strip(label), names, "label", "matches pattern"), 0.5),
        of(_first_match(strip(a("test_id")), names, "test_id", "matches pattern"), 0.5),
        pick(by_kind, by_kind_conf, F.concat(F.lit("node kind is "), kind)),
        F.struct(F.lit("unknown").alias("semantic_type"), F.lit(0.0).alias("confidence"),
                 F.array(F.lit("no signals found")).alias("inferred_from")),
    )


def required_flag(label="label", state="state") -> Column:
    """struct(required, confidence)."""
    marked = F.lower(F.col(label)).rlike(r"\*|required")
    conf = F.when(_yes(F.col(f"{state}.required")), 1.0).when(_yes(marked), 0.8).otherwise(0.0)
    return F.struct((conf > 0).alias("required"), conf.alias("required_confidence"))


def _option(n: str, selected: Column) -> Column:
    return F.struct(
        F.col(f"{n}.doc_order").alias("o"), F.col(f"{n}.label").alias("value"),
        F.col(f"{n}.label").alias("label"), selected.alias("selected"),
        (~F.coalesce(F.col(f"{n}.state.enabled"), F.lit(True))).alias("disabled"),
        F.col(f"{n}.node_id").alias("eid"))


def radio_options(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, options) of every radio button.  Two of them belong together when they
    have the same name, or, unless both are named, the same heading or the same group; an absent
    heading or group equals another absent one.

    Members are collected once per name, heading and group and handed to the radios afterwards."""
    r = nodes.filter(F.col("kind") == "radio").select(
        "snapshot_id", "node_id", "label", "state", "doc_order",
        F.col("where.region").alias("region"), F.col("where.heading_context").alias("heading"),
        F.col("where.group_id").alias("grp"),
        blank_to_null("attributes.name").alias("name"))
    chosen = _yes(F.col("r.state.checked").isin("true", "mixed"))
    item = F.struct(_option("r", chosen).alias("opt"), F.col("r.name").isNotNull().alias("named"))

    def members(column):
        return r.alias("r").groupBy("snapshot_id", "region", F.col(column).alias("k")).agg(
            F.collect_list(item).alias("m"))

    def attach(column):
        left, right = r.alias("l"), members(column).alias("m")
        test = (F.col("l.snapshot_id") == F.col("m.snapshot_id")) & F.col("l.region").eqNullSafe(
            F.col("m.region")) & F.col(f"l.{column}").eqNullSafe(F.col("m.k"))
        return left.join(right, test).select(
            "l.snapshot_id", "l.node_id",
            F.when(F.lit(column == "name"), F.when(F.col("l.name").isNotNull(), F.col("m.m")))
            .otherwise(F.filter("m.m", lambda x: ~(x.named & F.col("l.name").isNotNull())))
            .alias("m"))

    parts = attach("name").unionByName(attach("heading")).unionByName(attach("grp"))
    return parts.groupBy("snapshot_id", "node_id").agg(
        F.flatten(F.collect_list("m")).alias("all")).select(
        "snapshot_id", "node_id", F.transform(
            F.array_sort(F.array_distinct(F.transform("all", lambda x: x.opt))),
            lambda o: o.dropFields("o")).alias("options"))


def select_options(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, options) of selects: the list or menu items of the same group, else
    the current value."""
    sel = nodes.filter(F.col("kind").isin("select", "combobox")).select(
        "snapshot_id", "node_id", F.col("where.group_id").alias("grp"),
        blank_to_null("attributes.value").alias("current"))
    item = _option("i", _yes(F.col("i.state.selected")))
    items = nodes.filter(F.col("kind").isin("listitem", "menuitem")).alias("i").groupBy(
        "snapshot_id", F.col("where.group_id").alias("grp")).agg(
        F.array_sort(F.collect_list(item)).alias("items")).filter(F.col("grp").isNotNull())
    none = F.lit(None).cast("string")
    own = F.struct(F.col("current").alias("value"), F.col("current").alias("label"),
                   F.lit(True).alias("selected"), F.lit(False).alias("disabled"),
                   none.alias("eid"))
    return sel.join(items, ["snapshot_id", "grp"], "left").select(
        "snapshot_id", "node_id", F.coalesce(
            F.when(F.size("items") > 0, F.transform("items", lambda o: o.dropFields("o"))),
            F.when(F.col("current").isNotNull(), F.array(own)),
            F.array().cast("array<struct<value:string,label:string,selected:boolean,"
                           "disabled:boolean,eid:string>>")).alias("options"))


def link_radio_groups(fields: DataFrame) -> DataFrame:
    """(snapshot_id, form_key, node_id, radio_group, peers) for radio fields in groups of two or
    more.  ``fields`` has (snapshot_id, form_key, node_id, sequence, kind, region, name, heading,
    group_id).  A form whose radios are all named is grouped by name; otherwise membership depends
    on the order of comparison and the radios of that form are walked through."""
    r = fields.filter(F.col("kind") == "radio").withColumn("name", blank_to_null("name"))
    mixed = r.groupBy("snapshot_id", "form_key").agg(
        F.bool_or(F.col("name").isNull()).alias("walk"))
    r = r.join(mixed, ["snapshot_id", "form_key"]).select(
        "snapshot_id", "form_key", "node_id", "sequence", "region", "name", "heading", "group_id",
        "walk")
    kinds = {f.name: f.dataType.simpleString() for f in r.schema}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        heads, labels = [], []
        for row in pdf.itertuples(index=False):
            for i, h in enumerate(heads):
                both = not pd.isna(row.name) and not pd.isna(h.name)
                same = row.region == h.region and (
                    row.name == h.name if both else
                    (row.heading == h.heading or (pd.isna(row.heading) and pd.isna(h.heading)))
                    or (row.group_id == h.group_id
                        or (pd.isna(row.group_id) and pd.isna(h.group_id))))
                if same:
                    labels.append(i)
                    break
            else:
                labels.append(len(heads))
                heads.append(row)
        return pdf[["snapshot_id", "form_key", "node_id", "sequence"]].assign(
            grp=[str(i) for i in labels])

    schema = (f"snapshot_id {kinds['snapshot_id']}, form_key {kinds['form_key']}, node_id string, "
              f"sequence {kinds['sequence']}, grp string")
    walked = r.filter("walk").groupBy("snapshot_id", "form_key").applyInPandas(walk, schema)
    named = r.filter("NOT walk").select(
        "snapshot_id", "form_key", "node_id", "sequence",
        F.to_json(F.struct("region", "name")).alias("grp"))
    per = named.unionByName(walked).groupBy("snapshot_id", "form_key", "grp").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "node_id"))).getField("node_id")
        .alias("members"), F.min("sequence").alias("first")).filter(F.size("members") > 1)
    number = F.row_number().over(W.partitionBy("snapshot_id", "form_key").orderBy("first")) - 1
    return per.withColumn("radio_group", F.concat(F.lit("radio-group-"), number)).select(
        "snapshot_id", "form_key", "radio_group", "members",
        F.explode("members").alias("node_id")).select(
        "snapshot_id", "form_key", "node_id", "radio_group",
        F.array_remove("members", F.col("node_id")).alias("peers"))


def field_state(purpose: Column, mask: bool = True) -> Column:
    """State struct of a field node: value (masked when sensitive), filled, valid, ..."""
    value = F.col("attributes.value")
    hide = F.lit(mask) & purpose.isin(rules.SENSITIVE_PURPOSES) & (F.length(value) > 0)
    checked = _yes(F.col("state.checked").isin("true", "mixed"))
    filled = _yes(F.length(value) > 0) | checked
    return F.struct(
        F.when(_yes(hide), rules.MASK_DOTS).otherwise(value).alias("current_value"),
        F.when(value.isNotNull(), "attribute").alias("value_source"),
        filled.alias("has_value"), filled.alias("filled"),
        (~_yes(F.col("state.invalid"))).alias("valid"),
        F.coalesce("state.enabled", F.lit(True)).alias("enabled"), F.lit(False).alias("touched"),
        _yes(F.col("state.focused")).alias("focused"),
        F.coalesce("state.visible", F.lit(True)).alias("visible"))


def extract_fields(nodes: DataFrame, members: DataFrame, mask: bool = True) -> DataFrame:
    """Field rows of each form.  ``members`` has (snapshot_id, form_key, node_id, sequence)."""
    rows = members.join(nodes, ["snapshot_id", "node_id"])
    rows = rows.withColumn("purpose", infer_purpose())
    return rows.select(
        "snapshot_id", "form_key", "node_id", "sequence", "backend_node_id", "frame_id", "kind",
        "label", "purpose", required_flag().alias("constraints"),
        field_state(F.col("purpose.semantic_type"), mask).alias("field_state"),
        F.col("where.region").alias("region"), F.col("attributes.name").alias("name"),
        F.col("attributes.input_type").alias("input_type"),
        F.col("where.heading_context").alias("heading"), F.col("where.group_id").alias("group_id"))


def form_state(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Completion of each form.  ``fields`` has required, filled, valid and optionally touched."""
    touched = F.bool_or("touched") if "touched" in fields.columns else F.lit(False)
    agg = fields.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("required").alias("required_count"),
        F.count_if(F.col("required") & F.col("filled")).alias("filled_required_count"),
        F.count_if("filled").alias("filled_count"), F.count_if(~F.col("valid")).alias(
            "error_count"), touched.alias("dirty"))
    need = F.col("required_count") > 0
    share = F.when(need, F.col("filled_required_count") / F.col("required_count")).otherwise(
        F.col("filled_count") / F.col("n"))
    ready = F.when(need, F.col("filled_required_count") == F.col("required_count")).otherwise(
        F.col("filled_count") > 0)
    return agg.select(
        *keys, F.floor(share * 100 + 0.5).cast("int").alias("completion_pct"), "error_count",
        ((F.col("error_count") == 0) & ready).alias("can_submit"), "dirty", "required_count",
        "filled_required_count")


def form_actions(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buttons near each form's ``bbox`` with their type."""
    buttons = nodes.filter(F.col("kind").isin(rules.BUTTON_KINDS))
    label = F.lower("label")
    kind = (
        F.when(is_submit(), "submit").when(contains_any(label, ["cancel", "close"]), "cancel")
        .when(contains_any(label, ["back", "previous"]), "back")
        .when(contains_any(label, ["next", "continue"]), "next")
        .when(contains_any(label, ["reset", "clear"]), "reset").otherwise("action"))
    return near_box(forms, buttons).join(
        buttons.withColumn("type", kind), ["snapshot_id", "node_id"]).select(
        "snapshot_id", "form_key", "node_id", "doc_order", "label", "type",
        F.coalesce("state.enabled", F.lit(True)).alias("enabled"),
        (F.col("type") == "submit").alias("is_primary"))


def form_id(intent, root, position, field_count) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [F.coalesce(col(intent), F.lit("form")),
             F.coalesce(col(root), F.concat(F.lit("cluster-"), col(position).cast("string"))),
             col(field_count).cast("string")]
    return F.concat(F.lit("form-"), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 8))


def next_action(fields: DataFrame, keys: list[str], states: DataFrame | None = None,
                actions: DataFrame | None = None) -> DataFrame:
    """What to do next in each form: the first open required field, else the first open optional
    one, else submit when the form is ready.  ``fields`` has node_id, label, sequence, required,
    filled, enabled."""
    rows = fields.filter(~F.col("filled") & F.col("enabled")).select(
        *keys, "node_id", "label", F.col("sequence").cast("bigint").alias("sequence"),
        F.when(F.col("required"), 0).otherwise(1).alias("tier"))
    if states is not None and actions is not None:
        ready = states.filter("can_submit").select(*keys)
        submit = actions.filter((F.col("type") == "submit") & F.col("enabled")).join(
            ready, keys, "left_semi")
        rows = rows.unionByName(submit.select(
            *keys, "node_id", "label", F.col("doc_order").cast("bigint").alias("sequence"),
            F.lit(2).alias("tier")))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("node_id", "label", "tier"),
                                            F.struct("tier", "sequence")).alias("b"))
    reason = F.when(F.col("b.tier") == 0, "Next required field").when(
        F.col("b.tier") == 1, "Optional field").otherwise("Form ready to submit")
    return best.select(*keys, F.col("b.node_id").alias("node_id"),
                       F.col("b.label").alias("label"), reason.alias("reason"))


def apply_runtime_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Replace attribute values by observed ones, masked when sensitive; fields without an observed
    value keep their state but lose the value source.  ``values`` has (snapshot_id, node_id,
    value)."""
    out = fields.join(values.select("snapshot_id", "node_id", F.col("value").alias("_v")),
                      ["snapshot_id", "node_id"], "left")
    safe = mask_runtime_value("_v", F.col("input_type"), F.col("purpose.semantic_type"),
                              F.col("label"))
    seen = F.col("_v").isNotNull()
    s = F.col("field_state")
    full = F.length("_v") > 0
    state = (
        s.withField("current_value", F.when(seen, safe).otherwise(s.current_value))
        .withField("value_source", F.when(seen, "runtime"))
        .withField("has_value", F.when(seen, full).otherwise(s.has_value))
        .withField("filled", F.when(seen, full).otherwise(s.filled)))
    return out.withColumn("field_state", state).drop("_v")


def flat_fields(fields: DataFrame) -> DataFrame:
    """Fields with the flags ``form_state`` and ``next_action`` read."""
    return fields.select(
        "*", F.col("constraints.required").alias("required"),
        F.col("field_state.filled").alias("filled"), F.col("field_state.valid").alias("valid"),
        F.col("field_state.enabled").alias("enabled"),
        F.col("field_state.touched").alias("touched"))


def detect_forms(nodes: DataFrame, min_confidence: float = 0.3, detect_formless: bool = True,
                 cluster_distance: float = 200) -> tuple[DataFrame, DataFrame]:
    """(forms, members).  ``forms``: one row per form with form_id, intent, confidence, signals,
    bbox, field_count.  ``members``: (snapshot_id, form_key, node_id, sequence)."""
    inputs = nodes.filter(F.col("kind").isin(rules.INPUT_KINDS))
    roots = explicit_forms(nodes)
    inside_all = within_form(roots, nodes.filter(
        F.col("kind").isin(rules.INPUT_KINDS + rules.BUTTON_KINDS)))
    facts = nodes.select("snapshot_id", "node_id", "kind", "label", "doc_order", "layout",
                         F.col("attributes.placeholder").alias("placeholder"))
    hits = inside_all.join(facts, ["snapshot_id", "node_id"])
    fields = hits.filter(F.col("kind").isin(rules.INPUT_KINDS))
    f_members = fields.select(
        "snapshot_id", "form_key", "node_id", "label", "placeholder", "layout", "doc_order",
        F.col("doc_order").alias("sequence"))
    f_root = roots.select(
        "snapshot_id", F.col("node_id").alias("form_key"), F.col("node_id").alias("root"),
        "signal", F.col("label").alias("root_label"),
        F.col("where.heading_context").alias("root_heading"),
        F.col("layout.bbox").alias("bbox"), F.col("doc_order").alias("place"))
    explicit = _summarise(f_root, f_members, 5.0)
    inside_buttons = hits.filter(F.col("kind").isin(rules.BUTTON_KINDS)).select(
        "snapshot_id", "form_key", "node_id")
    candidates = _with_signals(explicit, nodes, f_members, inside_buttons, 1.0, True)
    members = f_members
    if detect_formless:
        free = inputs.join(f_members.select("snapshot_id", "node_id").distinct(),
                           ["snapshot_id", "node_id"], "left_anti")
        clustered = cluster_inputs(free, cluster_distance)
        c_members = clustered.select(
            "snapshot_id", F.concat(F.lit("cluster:"), F.col("cluster").cast("string"))
            .alias("form_key"), "node_id", "label",
            F.col("attributes.placeholder").alias("placeholder"), "layout", "doc_order",
            F.col("in_cluster").cast("bigint").alias("sequence"), "cluster")
        c_root = cluster_bbox(c_members, ["snapshot_id", "form_key", "cluster"]).select(
            "snapshot_id", "form_key", F.lit(None).cast("string").alias("root"),
            F.lit(None).cast("string").alias("signal"),
            F.lit(None).cast("string").alias("root_label"),
            F.lit(None).cast("string").alias("root_heading"), "bbox",
            (F.col("cluster") + F.lit(1 << 40)).cast("bigint").alias("place"))
        c_members = c_members.drop("cluster")
        implicit = _with_signals(_summarise(c_root, c_members, 3.0), nodes, c_members, None, 0.9,
                                 False)
        candidates = candidates.unionByName(implicit)
        members = members.unionByName(c_members)
    kept = candidates.filter(F.col("confidence") >= min_confidence)
    at = F.row_number().over(W.partitionBy("snapshot_id").orderBy("place")) - 1
    forms = kept.withColumn("position", at).withColumn(
        "form_id", form_id("intent", "root", "position", "field_count")).drop("place")
    w = W.partitionBy("snapshot_id", "form_key").orderBy("sequence", "doc_order")
    members = members.join(forms.select("snapshot_id", "form_key"), ["snapshot_id", "form_key"],
                           "left_semi").select(
        "snapshot_id", "form_key", "node_id", (F.row_number().over(w) - 1).alias("sequence"))
    return forms, members


def _summarise(roots: DataFrame, members: DataFrame, full_at: float) -> DataFrame:
    """Roots with counts and the text that tells their intent."""
    word = F.struct("sequence", "doc_order", F.concat_ws(
        " ", blank_to_null("label"), blank_to_null("placeholder")).alias("t"))
    agg = members.groupBy("snapshot_id", "form_key").agg(
        F.count("*").alias("field_count"),
        F.count_if(_yes(trim_ws("label") != "")).alias("labelled"),
        F.bool_or(has_intent_words("label")).alias("worded"),
        F.array_join(F.array_sort(F.collect_list(word)).getField("t"), " ").alias("texts"))
    out = roots.join(agg, ["snapshot_id", "form_key"], "left").fillna(0, ["field_count",
                                                                         "labelled"])
    text = F.concat_ws(" ", blank_to_null("root_label"), blank_to_null("root_heading"),
                       F.coalesce("texts", F.lit("")))
    return out.withColumn("intent", infer_intent(text)).withColumn(
        "size_strength", F.least(F.lit(1.0), F.col("field_count") / full_at))


def _with_signals(cands: DataFrame, nodes: DataFrame, members: DataFrame,
                  inside: DataFrame | None, submit_strength: float, explicit: bool) -> DataFrame:
    boxes = cluster_bbox(members, ["snapshot_id", "form_key"])
    submit = find_submit(cands, nodes, inside, boxes)
    out = cands.join(submit, ["snapshot_id", "form_key"], "left")

    def signal(kind, strength, test):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(test, F.struct(kind.alias("type"), strength.cast("double")
                                     .alias("strength")))

    has = F.col("field_count") > 0
    parts = [signal(F.col("signal"), F.lit(1.0), F.col("signal").isNotNull()),
             signal("input_cluster", F.col("size_strength"), has)]
    if not explicit:
        parts += [signal("label_input_pairs", F.col("labelled") / F.col("field_count"),
                         F.col("labelled") > 0),
                  signal("form_keywords", F.lit(0.8), _yes(F.col("worded")))]
    parts.append(signal("submit_button", F.lit(submit_strength), F.col("submit_id").isNotNull()))
    return out.withColumn("signals", F.array_compact(F.array(*parts))).withColumn(
        "confidence", form_confidence("signals")).select(
        "snapshot_id", "form_key", "root", "place", "intent", "field_count", "bbox", "signals",
        "confidence", "submit_id")


def field_context(fields: DataFrame, forms: DataFrame, dependencies: DataFrame,
                  nexts: DataFrame) -> DataFrame:
    """Each field with its form, what it depends on and the form's next step.  ``dependencies`` has
    (target_eid, depends_on)."""
    return fields.join(forms.select("snapshot_id", "form_key", "form_id", "intent"),
                       ["snapshot_id", "form_key"]).join(
        dependencies.withColumnRenamed("target_eid", "node_id"), "node_id", "left").join(
        nexts.select("snapshot_id", "form_key", F.col("node_id").alias("next_node_id"),
                     F.col("reason").alias("next_reason")).hint("merge"), ["snapshot_id", "form_key"], "left")
