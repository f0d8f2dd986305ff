"""Queries for forms and learned dependencies."""

from pyspark.sql import functions as F

from ..operators import dependencies as dep
from ..operators import forms
from . import adapters as a
from .catalog import query
from .catalog_query import CAPS

BOX = f"WITH b AS (SELECT * FROM ({a.BOXES}))"
INSIDE = """, inside AS (SELECT f.snapshot_id, f.node_id AS form_key, n.node_id, n.kind, n.label
    FROM b f JOIN b n ON f.snapshot_id = n.snapshot_id AND f.region = n.region WHERE f.kind = 'form'
    AND n.x BETWEEN f.x - 50 AND f.x + f.w + 50 AND n.y BETWEEN f.y - 50 AND f.y + f.h + 50)"""
_INPUTS = "('input', 'textarea', 'select')"


@query("f1_explicit_forms", BOX + """SELECT node_id, 'form_tag' AS signal FROM b
    WHERE kind = 'form'""")
def _(spark, d):
    return forms.explicit_forms(a.box_nodes(spark, d)).select(
        F.col("doc_order").alias("node_id"), "signal")


@query("f2_within_form", BOX + INSIDE + f"""SELECT form_key, node_id FROM inside
    WHERE kind IN {_INPUTS}""")
def _(spark, d):
    nodes = a.box_nodes(spark, d)
    inputs = nodes.filter(F.col("kind").isin("input", "textarea", "select"))
    return forms.within_form(forms.explicit_forms(nodes), inputs).select(
        F.col("form_key").cast("bigint").alias("form_key"),
        F.col("node_id").cast("bigint").alias("node_id"))


def _kept(rows):
    """Rows of many pages, computed once; what is left of them is still too much to broadcast."""
    return a.materialize(rows).hint("merge")


_CONTROLS = ["input", "checkbox", "slider", "combobox", "button", "select"]


def _controls(spark, d):
    """Forms and controls of the product pages: only the rows and columns that forms are made of are kept."""
    return _kept(a._plan(spark, d, "controls", lambda: a.product_nodes(spark, d).filter(
        F.col("kind").isin("form", *_CONTROLS)).select(
        "snapshot_id", "node_id", "backend_node_id", "frame_id", "kind", "label", "where", "layout",
        "state", "attributes", "doc_order")))


@query("f2_within_form_groups", """SELECT p_partkey AS page_id, 'controls' AS what,
    9 AS n FROM part""")
def _(spark, d):
    # No layout here: membership by group and heading.  Nine controls share the form's heading.
    nodes = _controls(spark, d)
    controls = nodes.filter(F.col("kind").isin(_CONTROLS))
    boxless = controls.withColumn("layout", F.col("layout").withField("bbox", F.lit(None).cast(
        "struct<x:double,y:double,w:double,h:double>")))
    # The heading is shared; regions differ from the form's unless the control sits inside it.
    pairs = forms.within_form(nodes.filter("kind = 'form'").withColumn(
        "layout", F.col("layout").withField("bbox", F.lit(None).cast(
            "struct<x:double,y:double,w:double,h:double>"))), boxless)
    return pairs.groupBy(F.col("snapshot_id").alias("page_id"), F.lit("controls").alias(
        "what")).agg(F.count("*").cast("int").alias("n"))


CLUSTERS = BOX + f""", i AS (SELECT *, lag(y + h) OVER w AS prev, min(node_id) OVER (PARTITION BY
    snapshot_id, region) AS first FROM b WHERE kind IN {_INPUTS} WINDOW w AS (PARTITION BY
    snapshot_id, region ORDER BY y, node_id)), c AS (SELECT *, sum(CASE WHEN prev IS NULL OR
    y - prev > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot_id ORDER BY first, y, node_id
    ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM i)"""


@query("f3_cluster_inputs", CLUSTERS + "SELECT node_id, cluster::BIGINT AS cluster FROM c")
def _(spark, d):
    inputs = a.box_nodes(spark, d).filter(F.col("kind").isin("input", "textarea", "select"))
    return forms.cluster_inputs(inputs).select(F.col("doc_order").alias("node_id"), "cluster")


@query("f5_cluster_bbox", CLUSTERS + """SELECT snapshot_id, cluster::BIGINT AS cluster,
    min(x)::DOUBLE AS x, min(y)::DOUBLE AS y, (max(x + w) - min(x))::DOUBLE AS w,
    (max(y + h) - min(y))::DOUBLE AS h FROM c GROUP BY ALL""")
def _(spark, d):
    inputs = a.box_nodes(spark, d).filter(F.col("kind").isin("input", "textarea", "select"))
    return forms.cluster_bbox(forms.cluster_inputs(inputs), ["snapshot_id", "cluster"]).select(
        "snapshot_id", "cluster", "bbox.*")


# Buttons of the box view that submit: a colour stands in for the keyword on every third part.
_SUBMIT = "(node_id % 3 = 0)"


def _with_submits(spark, d):
    nodes = a.box_nodes(spark, d)
    label = F.when((F.col("kind") == "button") & (F.col("doc_order") % 3 == 0),
                   F.concat(F.lit("Save "), "label")).when(
        F.col("doc_order") % 4 == 0, F.concat(F.lit("Email "), "label")).otherwise(F.col("label"))
    return nodes.withColumn("label", label)


@query("f6_is_submit", BOX + f"SELECT node_id, {_SUBMIT} AS submit FROM b WHERE kind = 'button'")
def _(spark, d):
    return _with_submits(spark, d).filter("kind = 'button'").select(
        F.col("doc_order").alias("node_id"), forms.is_submit().alias("submit"))


@query("f6_find_submit", CLUSTERS + f""", e AS (SELECT snapshot_id, cluster, min(x) AS x0, min(y)
    AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM c GROUP BY ALL) SELECT e.snapshot_id,
    cluster::BIGINT AS cluster, min(n.node_id) AS submit_id FROM e JOIN b n ON n.snapshot_id =
    e.snapshot_id WHERE n.kind = 'button' AND n.node_id % 3 = 0 AND n.x BETWEEN x0 - 100 AND x1 +
    100 AND n.y BETWEEN y0 - 50 AND y1 + 150 GROUP BY ALL""")
def _(spark, d):
    nodes = _with_submits(spark, d)
    inputs = nodes.filter(F.col("kind").isin("input", "textarea", "select"))
    boxes = forms.cluster_bbox(forms.cluster_inputs(inputs).withColumn(
        "form_key", F.col("cluster").cast("string")), ["snapshot_id", "form_key"])
    return forms.find_submit(boxes, nodes, None, boxes).select(
        "snapshot_id", F.col("form_key").cast("bigint").alias("cluster"),
        F.col("submit_id").cast("bigint").alias("submit_id"))


# Forms found in the box view, explicit ones first, then clusters of what they did not claim.
DETECTED = BOX + f""", lb AS (SELECT *, CASE WHEN kind = 'button' AND node_id % 3 = 0 THEN 'Save ' ||
    label WHEN node_id % 4 = 0 THEN 'Email ' || label ELSE label END AS lbl FROM b)
    {INSIDE.replace('FROM b f JOIN b n', 'FROM lb f JOIN lb n').replace('n.label', 'n.lbl AS label')},
    free AS (SELECT * FROM lb WHERE kind IN {_INPUTS} AND node_id NOT IN (SELECT node_id FROM
    inside)), i AS (SELECT *, lag(y + h) OVER w AS prev, min(node_id) OVER (PARTITION BY snapshot_id,
    region) AS first FROM free WINDOW w AS (PARTITION BY snapshot_id, region ORDER BY y, node_id)),
    c AS (SELECT *, sum(CASE WHEN prev IS NULL OR y - prev > 200 THEN 1 ELSE 0 END) OVER (PARTITION
    BY snapshot_id ORDER BY first, y, node_id ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM i),
    m AS (SELECT f.snapshot_id, f.node_id::VARCHAR AS form_key, f.node_id AS place, true AS
      explicit, f.lbl AS root_label, n.node_id, n.label, n.x, n.y, n.w, n.h FROM lb f LEFT JOIN
      (SELECT i.*, b.x, b.y, b.w, b.h FROM inside i JOIN b ON b.node_id = i.node_id WHERE i.kind IN
      {_INPUTS}) n ON n.form_key = f.node_id WHERE f.kind = 'form'
    UNION ALL SELECT snapshot_id, 'cluster:' || cluster, 1099511627776 + cluster, false, NULL,
      node_id, lbl, x, y, w, h FROM c),
    g AS (SELECT snapshot_id, form_key, place, explicit, any_value(root_label) AS root_label,
      count(node_id) AS k, bool_or(contains(coalesce(label, ''), 'Email')) AS mail, min(x) AS x0,
      min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM m GROUP BY snapshot_id, form_key, place,
      explicit),
    s AS (SELECT g.*, EXISTS (SELECT 1 FROM b n WHERE n.snapshot_id = g.snapshot_id AND n.kind =
      'button' AND n.node_id % 3 = 0 AND n.x BETWEEN x0 - 100 AND x1 + 100 AND n.y BETWEEN y0 - 50
      AND y1 + 150) OR EXISTS (SELECT 1 FROM inside n WHERE g.explicit AND n.form_key::VARCHAR =
      g.form_key AND n.kind = 'button' AND n.node_id % 3 = 0) AS submit FROM g),
    z AS (SELECT *, least(1.0, CASE WHEN explicit THEN 0.5 + CASE WHEN k > 0 THEN 0.25 * least(1.0,
      k / 5.0) ELSE 0 END + CASE WHEN submit THEN 0.3 ELSE 0 END ELSE 0.25 * least(1.0, k / 3.0) +
      0.2 + CASE WHEN mail THEN 0.15 * 0.8 ELSE 0 END + CASE WHEN submit THEN 0.27 ELSE 0 END END)
      AS conf FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY place) - 1 AS pos, CASE WHEN
      mail OR (explicit AND contains(root_label, 'Email')) THEN 'login' ELSE 'unknown' END AS intent
      FROM z WHERE conf >= 0.3)"""


@query("f4_implicit_forms", DETECTED + """SELECT snapshot_id, form_key, k AS field_count,
    round(conf, 6)::DOUBLE AS confidence FROM f WHERE NOT explicit""")
def _(spark, d):
    found, _ = forms.detect_forms(a.materialize(_with_submits(spark, d)))
    return found.filter("root IS NULL").select("snapshot_id", "form_key", "field_count",
                                               F.round("confidence", 6).alias("confidence"))


@query("f7_form_confidence", DETECTED + """SELECT snapshot_id, form_key,
    round(conf, 6)::DOUBLE AS confidence FROM f""")
def _(spark, d):
    found, _ = forms.detect_forms(a.materialize(_with_submits(spark, d)))
    return found.select("snapshot_id", "form_key", F.round("confidence", 6).alias("confidence"))


@query("f16_form_id", DETECTED + """SELECT snapshot_id, intent, k AS field_count, 'form-' || substr(
    sha256(intent || '::' || CASE WHEN explicit THEN form_key ELSE 'cluster-' || pos END || '::' ||
    k), 1, 8) AS form_id FROM f""")
def _(spark, d):
    found, _ = forms.detect_forms(a.materialize(_with_submits(spark, d)))
    return found.select("snapshot_id", "intent", "field_count", "form_id")


@query("f19_detect_forms", DETECTED + """SELECT snapshot_id, form_key, node_id FROM m WHERE node_id
    IS NOT NULL AND (snapshot_id, form_key) IN (SELECT (snapshot_id, form_key) FROM f)""")
def _(spark, d):
    _, members = forms.detect_forms(a.materialize(_with_submits(spark, d)))
    return members.select("snapshot_id", "form_key",
                          F.col("node_id").cast("bigint").alias("node_id"))


_INTENTS = {
    "login": "3*(x LIKE '%log in%')::INT + 3*(x LIKE '%login%')::INT + 3*(x LIKE '%sign in%')::INT "
             "+ 3*(x LIKE '%signin%')::INT + 0.5*(x LIKE '%email%')::INT + 0.5*(x LIKE '%password%')"
             "::INT + 0.5*(x LIKE '%username%')::INT",
    "signup": "3*(x LIKE '%sign up%')::INT + 3*(x LIKE '%signup%')::INT + 3*(x LIKE '%register%')"
              "::INT + 3*(x LIKE '%create account%')::INT + 2*(x LIKE '%join%')::INT",
    "search": "3*(x LIKE '%search%')::INT + 2*(x LIKE '%find%')::INT + 2*(x LIKE '%lookup%')::INT + "
              "2*(x LIKE '%query%')::INT",
    "checkout": "3*(x LIKE '%checkout%')::INT + 2*(x LIKE '%payment%')::INT + 2*(x LIKE '%order%')"
                "::INT + 2*(x LIKE '%purchase%')::INT + 3*(x LIKE '%buy now%')::INT",
    "filter": "3*(x LIKE '%filter%')::INT + 2*(x LIKE '%sort%')::INT + 2*(x LIKE '%refine%')::INT + "
              "2*(x LIKE '%narrow%')::INT",
    "settings": "3*(x LIKE '%settings%')::INT + 2*(x LIKE '%preferences%')::INT + "
                "2*(x LIKE '%configuration%')::INT + (x LIKE '%options%')::INT",
    "contact": "3*(x LIKE '%contact%')::INT + (x LIKE '%message%')::INT + 2*(x LIKE '%feedback%')"
               "::INT + 2*(x LIKE '%inquiry%')::INT",
    "subscribe": "3*(x LIKE '%subscribe%')::INT + 3*(x LIKE '%newsletter%')::INT + "
                 "2*(x LIKE '%email updates%')::INT",
    "shipping": "3*(x LIKE '%shipping%')::INT + 2*(x LIKE '%delivery%')::INT + (x LIKE '%address%')"
                "::INT",
    "payment": "3*(x LIKE '%payment%')::INT + 3*(x LIKE '%credit card%')::INT + 2*(x LIKE "
               "'%billing%')::INT + 3*(x LIKE '%card number%')::INT",
    "profile": "3*(x LIKE '%profile%')::INT + (x LIKE '%account%')::INT + 2*(x LIKE "
               "'%personal info%')::INT",
}
_CASE = ", ".join(f"({v})::DOUBLE AS {k}_s" for k, v in _INTENTS.items())
_BEST = "greatest(" + ", ".join(f"{k}_s" for k in _INTENTS) + ")"
_PICK = "CASE WHEN " + _BEST + " = 0 THEN 'unknown' " + " ".join(
    f"WHEN {k}_s = {_BEST} THEN '{k}'" for k in _INTENTS) + " END"
# The corpora hold hardly any of the words; each text gets a few by its number.
_WORDS = ["log in", "payment order", "Sort options", "join our newsletter", "credit card billing",
          "find your account", "email password", "nothing here", "shipping address message"]
_PHRASE = "(['" + "', '".join(_WORDS) + "'])"


@query("f8_infer_intent", f"""SELECT doc_id, {_PICK} AS intent FROM (SELECT doc_id, {_CASE} FROM
    (SELECT doc_id, lower({_PHRASE}[1 + doc_id % 9] || ' ' || text || ' ' ||
    {_PHRASE}[1 + (doc_id // 9) % 9]) AS x FROM documents))""")
def _(spark, d):
    words = F.array(*[F.lit(w) for w in _WORDS])
    doc = F.col("doc_id")
    text = F.concat_ws(" ", F.get(words, (doc % 9).cast("int")), "text",
                       F.get(words, (F.floor(doc / 9) % 9).cast("int")))
    return a.texts(spark, d).select("doc_id", forms.infer_intent(text).alias("intent"))


@query("f9_infer_purpose", """SELECT p_partkey AS page_id, kind, label, semantic_type,
    confidence::DOUBLE AS confidence FROM (SELECT p_partkey, 'slider' AS kind, 'Quantity ' || p_size AS label,
      'quantity' AS semantic_type, 0.7 AS confidence FROM part
    UNION ALL SELECT p_partkey, 'input', 'Secret code', 'password', 0.95 FROM part
    UNION ALL SELECT p_partkey, 'checkbox', 'Gift wrap', 'toggle', 0.5 FROM part
    UNION ALL SELECT p_partkey, 'input', 'Mail ' || p_size, 'email', 0.95 FROM part
    UNION ALL SELECT p_partkey, 'combobox', 'color', 'color', 0.7 FROM part
    UNION ALL SELECT p_partkey, 'input', 'First ' || p_size || ' Second', 'unknown', 0.0 FROM part
    UNION ALL SELECT p_partkey, 'input', 'note-' || p_partkey, 'comment', 0.7 FROM part)""")
def _(spark, d):
    nodes = a.product_nodes(spark, d).filter(F.col("kind").isin(
        "input", "checkbox", "slider", "combobox"))
    p = nodes.withColumn("p", forms.infer_purpose())
    return p.select(F.col("snapshot_id").alias("page_id"), "kind", "label", "p.semantic_type",
                    F.col("p.confidence").alias("confidence"))


@query("f10_extract_constraints", """SELECT p_partkey AS page_id, label, required,
    confidence::DOUBLE AS confidence FROM (
    SELECT p_partkey, 'Quantity ' || p_size AS label, p_size % 2 = 0 AS required,
      CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS confidence FROM part
    UNION ALL SELECT p_partkey, 'Gift wrap *', true, 0.8 FROM part)""")
def _(spark, d):
    nodes = a.product_nodes(spark, d).filter(F.col("kind").isin("slider", "checkbox"))
    nodes = nodes.withColumn("label", F.when(F.col("kind") == "checkbox", F.concat(
        "label", F.lit(" *"))).otherwise(F.col("label"))).withColumn("c", forms.required_flag())
    return nodes.select(F.col("snapshot_id").alias("page_id"), "label", "c.required",
                        F.col("c.required_confidence").alias("confidence"))


# Inputs of the box view as radio buttons: two in three carry one of four names.
RADIO = BOX + """, r AS (SELECT *, CASE WHEN node_id % 3 <> 0 THEN 'n' || node_id % 4 END AS name,
    'h' || node_id % 5 AS heading, CASE WHEN node_id % 2 = 0 THEN 'g' || node_id % 8 END AS grp
    FROM b WHERE kind IN ('input', 'select'))"""
_SAME = """x.snapshot_id = y.snapshot_id AND x.region = y.region AND CASE WHEN x.name IS NOT NULL AND
    y.name IS NOT NULL THEN x.name = y.name ELSE x.heading = y.heading OR
    x.grp IS NOT DISTINCT FROM y.grp END"""


def _radios(spark, d):
    k = F.col("doc_order")
    nodes = a.box_nodes(spark, d).filter(F.col("kind").isin("input", "select"))
    where = F.col("where").withField("heading_context", F.concat(F.lit("h"), k % 5)).withField(
        "group_id", F.when(k % 2 == 0, F.concat(F.lit("g"), k % 8)))
    name = F.when(k % 3 != 0, F.concat(F.lit("n"), k % 4))
    return nodes.withColumn("kind", F.lit("radio")).withColumn("where", where).withColumn(
        "attributes", F.col("attributes").withField("name", name))


@query("f11_radio_options", RADIO + f"""SELECT x.node_id, string_agg(y.node_id::VARCHAR, ',' ORDER BY
    y.node_id) AS options FROM r x JOIN r y ON {_SAME} GROUP BY x.node_id""")
def _(spark, d):
    return forms.radio_options(_radios(spark, d)).select(
        F.col("node_id").cast("bigint").alias("node_id"),
        F.array_join("options.eid", ",").alias("options"))


@query("f11_select_options", BOX + """, g AS (SELECT snapshot_id, region, node_id % 8 AS g,
    string_agg(label, ',' ORDER BY node_id) AS opts FROM b WHERE kind = 'link' GROUP BY ALL)
    SELECT node_id, coalesce(opts, 'now') AS options FROM b LEFT JOIN (SELECT snapshot_id, g,
    string_agg(opts, ',') AS opts FROM (SELECT snapshot_id, node_id % 8 AS g, string_agg(label, ','
    ORDER BY node_id) AS opts FROM b WHERE kind = 'link' GROUP BY ALL) GROUP BY ALL) o ON
    o.snapshot_id = b.snapshot_id AND o.g = b.node_id % 8 WHERE kind = 'select'""")
def _(spark, d):
    nodes = a.box_nodes(spark, d)
    nodes = nodes.withColumn("kind", F.when(F.col("kind") == "link", "menuitem").otherwise(
        F.col("kind"))).withColumn("where", F.col("where").withField(
            "group_id", F.concat(F.lit("g"), F.col("doc_order") % 8))).withColumn(
        "attributes", F.col("attributes").withField("value", F.lit("now")))
    return forms.select_options(nodes).select(
        F.col("node_id").cast("bigint").alias("node_id"),
        F.array_join("options.label", ",").alias("options"))


def _radio_fields(spark, d):
    return _radios(spark, d).select(
        "snapshot_id", F.col("where.region").alias("form_key"), "node_id",
        F.col("doc_order").alias("sequence"), "kind", F.col("where.region").alias("region"),
        F.col("attributes.name").alias("name"), F.col("where.heading_context").alias("heading"),
        F.col("where.group_id").alias("group_id"))


# Radios of a form are taken in order; each joins the first group whose first member it agrees with, or opens one.
_HEAD = "struct_pack(name := o.name, heading := o.heading, grp := o.grp)"
_JOINS = """coalesce(list_indexof(list_transform(heads, lambda hd: CASE WHEN hd.name IS NOT NULL AND o.name IS NOT NULL
    THEN hd.name = o.name ELSE hd.heading = o.heading OR hd.grp IS NOT DISTINCT FROM o.grp END), true), 0)"""


@query("f12_link_radio_groups", RADIO.replace("WITH", "WITH RECURSIVE", 1) + f""", ord AS (SELECT *, row_number() OVER (PARTITION BY
    snapshot_id, region ORDER BY node_id) AS i FROM r), walk AS (
    SELECT snapshot_id, region, i, node_id, 1 AS member, [{_HEAD}] AS heads FROM ord o WHERE i = 1
    UNION ALL SELECT o.snapshot_id, o.region, o.i, o.node_id, CASE WHEN {_JOINS} = 0 THEN len(heads) + 1 ELSE {_JOINS} END,
      CASE WHEN {_JOINS} = 0 THEN list_append(heads, {_HEAD}) ELSE heads END
    FROM walk JOIN ord o ON o.snapshot_id = walk.snapshot_id AND o.region = walk.region AND o.i = walk.i + 1),
    g AS (SELECT *, count(*) OVER (PARTITION BY snapshot_id, region, member) AS n, min(i) OVER (PARTITION BY snapshot_id,
      region, member) AS first FROM walk)
    SELECT snapshot_id, region AS form_key, node_id, 'radio-group-' || (dense_rank() OVER (PARTITION BY snapshot_id, region
      ORDER BY first) - 1) AS radio_group, CAST(n - 1 AS INT) AS peers FROM g WHERE n > 1""")
def _(spark, d):
    return forms.link_radio_groups(_radio_fields(spark, d)).select(
        "snapshot_id", "form_key", F.col("node_id").cast("bigint").alias("node_id"), "radio_group", F.size("peers").alias("peers"))


@query("f12_link_named_radio_groups", RADIO + """, n AS (SELECT snapshot_id, region, coalesce(name,
    'none') AS name, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS members, count(*) AS n,
    min(node_id) AS first FROM r GROUP BY ALL HAVING count(*) > 1) SELECT snapshot_id, region AS
    form_key, members, 'radio-group-' || (row_number() OVER (PARTITION BY snapshot_id, region ORDER
    BY first) - 1) AS radio_group FROM n""")
def _(spark, d):
    fields = _radio_fields(spark, d).withColumn("name", F.coalesce("name", F.lit("none")))
    groups = forms.link_radio_groups(fields)
    return groups.groupBy("snapshot_id", "form_key", "radio_group").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.col("node_id").cast("bigint"))),
        lambda x: x.cast("string")), ",").alias("members"))


@query("f13_extract_fields", """SELECT p_partkey AS page_id, label, filled, valid, current_value,
    enabled FROM (SELECT p_partkey, 'Quantity ' || p_size AS label, true AS filled, true AS valid,
      p_size::VARCHAR AS current_value, NOT (p_size % 3 = 0) OR p_size % 5 = 0 AS enabled FROM part
    UNION ALL SELECT p_partkey, 'Secret code', true, true, '••••••••', true FROM part
    UNION ALL SELECT p_partkey, 'Gift wrap', p_size % 4 = 0, true, NULL, true FROM part
    UNION ALL SELECT p_partkey, 'Mail ' || p_size, false, p_size % 2 = 0, NULL, true FROM part
    UNION ALL SELECT p_partkey, 'color', false, true, NULL, true FROM part
    UNION ALL SELECT p_partkey, 'First ' || p_size || ' Second', false, true, NULL, true FROM part
    UNION ALL SELECT p_partkey, 'note-' || p_partkey, false, true, NULL, true FROM part)""")
def _(spark, d):
    fields = _product_fields(spark, d)
    return fields.select(
        F.col("snapshot_id").alias("page_id"), "label", "field_state.filled", "field_state.valid",
        "field_state.current_value", "field_state.enabled")


def _product_fields(spark, d):
    nodes = _controls(spark, d)
    members = nodes.filter(F.col("kind").isin("input", "checkbox", "slider", "combobox")
                           & F.startswith("where.group_id", F.lit("form-"))).select(
        "snapshot_id", F.lit("f").alias("form_key"), "node_id",
        F.col("doc_order").alias("sequence"))
    return forms.extract_fields(nodes, members).hint("merge")


@query("f14_form_state", f"""SELECT form_id, CAST(floor(CASE WHEN r > 0 THEN fr::DOUBLE / r ELSE
    f::DOUBLE / n END * 100 + 0.5) AS INT) AS completion_pct, e AS error_count, e = 0 AND CASE WHEN
    r > 0 THEN fr = r ELSE f > 0 END AS can_submit, r AS required_count, fr AS filled_required_count
    FROM (SELECT form_id, count(*) AS n, count(*) FILTER (required) AS r, count(*) FILTER (required
    AND filled) AS fr, count(*) FILTER (filled) AS f, count(*) FILTER (NOT valid) AS e
    FROM ({a.FIELDS}) GROUP BY form_id)""")
def _(spark, d):
    return forms.form_state(a.fields(spark, d), ["form_id"]).drop("dirty")


@query("f15_form_actions", BOX + f"""SELECT f.node_id AS form_key, n.node_id, CASE WHEN {_SUBMIT
    .replace('node_id', 'n.node_id')} THEN 'submit' ELSE 'action' END AS type FROM b f JOIN b n ON
    n.snapshot_id = f.snapshot_id WHERE f.kind = 'form' AND n.kind = 'button' AND n.x BETWEEN
    f.x - 100 AND f.x + f.w + 100 AND n.y BETWEEN f.y - 50 AND f.y + f.h + 150""")
def _(spark, d):
    nodes = _with_submits(spark, d)
    roots = nodes.filter("kind = 'form'").select(
        "snapshot_id", F.col("node_id").alias("form_key"), F.col("layout.bbox").alias("bbox"))
    return forms.form_actions(roots, nodes).select(
        F.col("form_key").cast("bigint").alias("form_key"),
        F.col("node_id").cast("bigint").alias("node_id"), "type")


@query("f17_next_action", f"""SELECT form_id, field_id AS node_id, CASE WHEN required THEN
    'Next required field' ELSE 'Optional field' END AS reason FROM ({a.FIELDS}) WHERE NOT filled AND
    enabled QUALIFY row_number() OVER (PARTITION BY form_id ORDER BY NOT required, field_id) = 1""")
def _(spark, d):
    fields = a.fields(spark, d).select(
        "form_id", F.col("field_id").alias("node_id"), F.lit("").alias("label"),
        F.col("field_id").alias("sequence"), "required", "filled", "enabled")
    return forms.next_action(fields, ["form_id"]).select("form_id", "node_id", "reason")


@query("f18_apply_runtime_values", """SELECT p_partkey AS page_id, label, filled, source, shown FROM
    (SELECT p_partkey, 'Quantity ' || p_size AS label, p_size % 2 = 1 AS filled,
      'runtime' AS source, CASE WHEN p_size % 2 = 1 THEN 'v' ELSE '' END AS shown FROM part
    UNION ALL SELECT p_partkey, 'Secret code', p_size % 2 = 1, 'runtime', '********' FROM part
    UNION ALL SELECT p_partkey, 'Gift wrap', p_size % 4 = 0, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, unnest(['Mail ' || p_size, 'First ' || p_size || ' Second', 'note-' || p_partkey]),
      p_size % 2 = 1, 'runtime', CASE WHEN p_size % 2 = 1 THEN 'v' ELSE '' END FROM part
    UNION ALL SELECT p_partkey, 'color', false, NULL, NULL FROM part)""")
def _(spark, d):
    fields = _product_fields(spark, d)
    seen = fields.filter(~F.col("kind").isin("checkbox", "combobox")).join(
        a.products(spark, d).select(F.col("page_id").alias("snapshot_id"), "p_size"),
        "snapshot_id").select("snapshot_id", "node_id", F.when(
            F.col("p_size") % 2 == 1, "v").otherwise("").alias("value")).hint("merge")
    return forms.apply_runtime_values(fields, seen).select(
        F.col("snapshot_id").alias("page_id"), "label", "field_state.filled",
        F.col("field_state.value_source").alias("source"),
        F.col("field_state.current_value").alias("shown"))


@query("f19_field_context", """SELECT p_partkey AS page_id, label, CASE WHEN starts_with(label, 'Quantity') THEN 'e' ||
    p_size % 3 END AS source, CASE WHEN p_size % 4 = 0 THEN 'Mail ' || p_size ELSE 'Gift wrap' END AS next FROM (SELECT
    p_partkey, p_size, unnest(['Quantity ' || p_size, 'Secret code', 'Gift wrap', 'Mail ' || p_size, 'color', 'First ' || p_size
    || ' Second', 'note-' || p_partkey]) AS label FROM part)""")
def _(spark, d):
    fields = _kept(_product_fields(spark, d))
    flat = forms.flat_fields(fields)
    nexts = forms.next_action(flat, ["snapshot_id", "form_key"])
    roots = fields.select("snapshot_id", "form_key").distinct().withColumn(
        "form_id", F.lit("form-x")).withColumn("intent", F.lit("unknown")).hint("merge")
    deps = fields.filter(F.startswith("label", F.lit("Quantity"))).select(
        "snapshot_id", F.col("node_id").alias("target_eid"),
        F.concat(F.lit("e"), F.split_part("label", F.lit(" "), F.lit(2)).cast("int") % 3)
        .alias("depends_on"))
    # One page's ids repeat on every page here, so dependencies are looked up per page.
    out = forms.field_context(
        fields.withColumn("node_id", F.concat_ws(":", "snapshot_id", "node_id")), roots,
        deps.select(F.concat_ws(":", "snapshot_id", "target_eid").alias("target_eid"),
                    "depends_on"), nexts)
    names = fields.select("snapshot_id", F.col("node_id").alias("next_node_id"),
                          F.col("label").alias("next"))
    return out.join(
        names, ["snapshot_id", "next_node_id"]).select(
        F.col("snapshot_id").alias("page_id"), "label", F.col("depends_on").alias("source"), "next")


# Effects between consecutive captures; the trigger is the last click of the capture.
EFFECT = CAPS + """, links AS (SELECT page_id, step, lag(step) OVER w AS prev FROM (SELECT DISTINCT
    page_id, step FROM caps) WINDOW w AS (PARTITION BY page_id ORDER BY step)),
act AS (SELECT user_id AS page_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS step,
    'click-' || (max(event_id) % 6) AS trigger FROM events WHERE event_type = 'click' GROUP BY ALL),
pr AS (SELECT l.page_id, l.step, coalesce(c.node_id, o.node_id) AS node_id, c.node_id IS NOT NULL
    AS new, o.node_id IS NOT NULL AS old, c.enabled AS ce, o.enabled AS oe, c.visible AS cv,
    o.visible AS ov, c.value AS cval, o.value AS oval, coalesce(o.rank, c.rank) AS pos
    FROM (SELECT l.page_id, l.step, l.prev, n.node_id FROM links l JOIN (SELECT DISTINCT page_id,
    node_id FROM caps) n USING (page_id) WHERE prev IS NOT NULL) l LEFT JOIN caps c ON
    c.page_id = l.page_id AND c.step = l.step AND c.node_id = l.node_id LEFT JOIN caps o ON
    o.page_id = l.page_id AND o.step = l.prev AND o.node_id = l.node_id WHERE c.node_id IS NOT NULL
    OR o.node_id IS NOT NULL),
hit AS (SELECT page_id, step, trigger, node_id, old, pos, e FROM pr JOIN act USING (page_id, step),
    unnest([CASE WHEN new AND ce AND (NOT old OR NOT oe) THEN 'enabled' END,
      CASE WHEN new AND old AND oe AND NOT ce THEN 'disabled' END,
      CASE WHEN new AND cv AND (NOT old OR NOT ov) THEN 'appeared' END,
      CASE WHEN old AND ov AND (NOT new OR NOT cv) THEN 'disappeared' END,
      CASE WHEN new AND cval IS DISTINCT FROM oval AND node_id <> trigger THEN 'value_changed' END])
    u(e) WHERE e IS NOT NULL)
"""


def _effects(spark, d):
    clicks = a.click_actions(spark, d).withColumn(
        "step", F.floor((F.day("ts") - 1) / 5).cast("int"))
    actions = clicks.groupBy("page_id", "step").agg(F.max("action_id").alias("last")).select(
        "page_id", "step", F.concat(F.lit("click-"), F.col("last") % 6).alias("trigger_eid"),
        F.lit("click").alias("action_type"))
    return dep.observed_effect(a.capture_nodes(spark, d), a.captures(spark, d), actions)


_LISTS = ["enabled", "disabled", "appeared", "disappeared", "value_changed"]


@query("f20_observed_effect", EFFECT + "SELECT page_id, step, trigger AS trigger_eid, " + ", ".join(
    f"coalesce(string_agg(node_id, ',' ORDER BY NOT old, pos, node_id) FILTER (e = '{x}'), '') AS {x}" for x in _LISTS)
    + ", round(least(1.0, 0.5 + count(*) * 0.1), 6)::DOUBLE AS confidence FROM hit GROUP BY ALL")
def _(spark, d):
    e = _effects(spark, d)
    return e.select("page_id", "step", "trigger_eid", *[F.array_join(c, ",").alias(c) for c in _LISTS],
                    F.round("confidence", 6).alias("confidence"))


EDGES = EFFECT + """, edge AS (SELECT page_id, trigger AS source_eid, node_id AS target_eid, CASE WHEN
    e IN ('enabled', 'disabled') THEN 'enables' WHEN e = 'value_changed' THEN 'populates' ELSE
    'reveals' END AS type, count(*) AS observations, max(step) AS last_step FROM hit GROUP BY ALL),
conf AS (SELECT *, least(1.0, 0.3 + least(1.0, observations / 3.0) * 0.5 + CASE WHEN type = 'reveals'
    THEN 0.1 ELSE 0.15 END) AS confidence FROM edge)
"""


@query("f21_dependency_edges", EDGES + """SELECT page_id, source_eid, target_eid, type, observations, last_step, CASE type
    WHEN 'reveals' THEN 'observed_mutation' ELSE 'observed_state_change' END AS method FROM edge""")
def _(spark, d):
    return dep.dependency_edges(_effects(spark, d))


@query("f22_dependency_confidence", EDGES + """SELECT page_id, source_eid, target_eid, type,
    round(confidence, 6)::DOUBLE AS confidence FROM conf WHERE confidence >= 0.7""")
def _(spark, d):
    edges = dep.with_confidence(dep.dependency_edges(_effects(spark, d)), 0.7)
    return edges.select("page_id", "source_eid", "target_eid", "type",
                        F.round("confidence", 6).alias("confidence"))


@query("f23_dependencies_for", EDGES + """SELECT page_id, source_eid, type FROM conf
    WHERE target_eid = 'view-3'""")
def _(spark, d):
    edges = dep.with_confidence(dep.dependency_edges(_effects(spark, d)))
    return dep.dependencies_for(edges, "view-3").select("page_id", "source_eid", "type")


@query("f23_all_dependencies", EDGES + """SELECT page_id, target_eid, string_agg(source_eid || ':' ||
    type, ',' ORDER BY source_eid, type) AS depends_on FROM conf GROUP BY ALL""")
def _(spark, d):
    edges = dep.with_confidence(dep.dependency_edges(_effects(spark, d)))
    return dep.all_dependencies(edges).select("page_id", "target_eid", F.array_join(F.transform(
        "depends_on", lambda x: F.concat(x["source_eid"], F.lit(":"), x["type"])), ",")
        .alias("depends_on"))


@query("f23_dependents_of", EDGES + """SELECT page_id, source_eid, string_agg(DISTINCT target_eid, ','
    ORDER BY target_eid) AS dependents FROM conf GROUP BY ALL""")
def _(spark, d):
    edges = dep.with_confidence(dep.dependency_edges(_effects(spark, d)))
    return dep.dependents_of(edges).select("page_id", "source_eid",
                                           F.array_join("dependents", ",").alias("dependents"))


@query("f24_recent_effects", EFFECT + """SELECT page_id, step, trigger AS trigger_eid, row_number()
    OVER (PARTITION BY page_id, trigger ORDER BY step DESC) AS age_rank FROM (SELECT DISTINCT
    page_id, step, trigger FROM hit) QUALIFY age_rank <= 2""")
def _(spark, d):
    return dep.recent_effects(_effects(spark, d), 2).select("page_id", "step", "trigger_eid",
                                                            "age_rank")
