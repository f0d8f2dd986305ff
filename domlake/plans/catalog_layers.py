"""Queries for layers, ranking, region lists and rendering."""

from pyspark.sql import functions as F

from ..operators import diff, identity, layers, render
from . import adapters as a
from .catalog import query
from .catalog_changes import ADDED, BOX_LAYERS, CHANGED, PAIRS
from .catalog_pages import CORPUS
from .catalog_query import CAPS


@query("l1_detect_layers", BOX_LAYERS + """SELECT snapshot_id, node_id, type, z FROM k""")
def _(spark, d):
    return layers.detect_layers(a.box_nodes(spark, d)).select(
        "snapshot_id", F.col("doc_order").alias("node_id"), "type", "z")


@query("l2_layer_stack", BOX_LAYERS + """SELECT snapshot_id, array_to_string(stack, ',') AS stack,
    active FROM st""")
def _(spark, d):
    return layers.layer_stack(a.box_nodes(spark, d)).select(
        "snapshot_id", F.array_join("stack", ",").alias("stack"), "active")


def _focused(spark, d):
    """The box view with every thirteenth node focused."""
    nodes = a.box_nodes(spark, d)
    return nodes.withColumn("state", F.col("state").withField(
        "focused", F.col("doc_order") % 13 == 0))


@query("l3_focused_eid", f"""SELECT snapshot_id, substr(sha256(concat_ws('::', coalesce(role, kind),
    label, '', region || '/', CASE WHEN region = 'dialog' THEN 'modal' ELSE 'main' END, '', '')), 1,
    12) AS focus_eid FROM ({a.BOXES}) WHERE node_id % 13 = 0
    QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY node_id) = 1""")
def _(spark, d):
    return layers.focused_eid(_focused(spark, d))


# Layer of each node of the box view under the active layer of its capture, and its score.
_LAYER = """CASE WHEN region = 'dialog' THEN 'modal' WHEN active IN ('popover', 'drawer') AND
    z_index > 1 THEN active ELSE 'main' END"""
RANKED = BOX_LAYERS + f""", n AS (SELECT b.*, active, {_LAYER} AS layer, least(1.0::DOUBLE,
    0.5::DOUBLE + 0.2::DOUBLE + CASE kind WHEN 'button' THEN 0.3 WHEN 'input' THEN 0.3
    WHEN 'link' THEN 0.25 WHEN 'textarea' THEN 0.25 WHEN 'select' THEN 0.25 ELSE 0.1 END::DOUBLE +
    CASE region WHEN 'main' THEN 0.15 WHEN 'dialog' THEN 0.2 ELSE 0.0 END::DOUBLE + 0.15::DOUBLE)
    AS score FROM b JOIN st USING (snapshot_id)), c AS (SELECT * FROM n WHERE kind IN ('link',
    'button', 'input', 'textarea', 'select') AND (active IN ('popover', 'drawer')
    OR layer = active)), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY
    score DESC, node_id) AS rank FROM c)
"""


@query("l4_node_layer", RANKED + "SELECT node_id, layer FROM n")
def _(spark, d):
    nodes = layers.with_active_layer(a.box_nodes(spark, d))
    return nodes.select(F.col("doc_order").alias("node_id"),
                        layers.node_layer(F.col("active")).alias("layer"))


@query("l5_select_actionables", RANKED + """SELECT snapshot_id, node_id, rank,
    round(score, 6) AS score FROM r WHERE rank <= 12""")
def _(spark, d):
    rows = layers.select_actionables(layers.with_active_layer(a.box_nodes(spark, d)), 12)
    return rows.select("snapshot_id", F.col("doc_order").alias("node_id"), "rank",
                       F.round("score", 6).alias("score"))


@query("l6_score_actionable", CORPUS + """SELECT page_id, kind, round(least(1.0, 0.5 + 0.2 +
    CASE kind WHEN 'link' THEN 0.25 ELSE 0.1 END + CASE WHEN trim(label) <> '' THEN 0.15 ELSE 0 END
    ), 6)::DOUBLE AS score, count(*) AS n FROM els GROUP BY ALL""")
def _(spark, d):
    return a.corpus_nodes(spark, d).groupBy(
        "page_id", "kind", F.round(layers.score_actionable(), 6).alias("score")).agg(
        F.count("*").alias("n"))


@query("l7_focus_guarantee", RANKED + """, f AS (SELECT n.*, CASE WHEN fo = 1 AND node_id % 13 = 0
    AND ok THEN 0 ELSE 2 END AS tier FROM (SELECT *, ok AND node_id % 13 = 0 AS foc, count(CASE WHEN
    ok AND node_id % 13 = 0 THEN 1 END) OVER (PARTITION BY snapshot_id ORDER BY node_id) AS fo FROM
    (SELECT *, kind IN ('link', 'button', 'input', 'textarea', 'select') AND (active IN ('popover',
    'drawer') OR layer = active) AS ok FROM n)) n WHERE ok), g AS (SELECT snapshot_id, node_id,
    tier, row_number() OVER (PARTITION BY snapshot_id ORDER BY tier, CASE WHEN tier = 0 THEN 0 ELSE
    -least(1.0::DOUBLE, score + CASE WHEN foc THEN 0.2 ELSE 0.0 END) END, node_id) AS rank FROM f)
    SELECT snapshot_id, node_id, tier, rank FROM g WHERE rank <= 12 OR tier < 2""")
def _(spark, d):
    rows = layers.focus_guarantee(layers.with_active_layer(_focused(spark, d)), 12)
    return rows.select("snapshot_id", F.col("doc_order").alias("node_id"), "tier", "rank")


@query("l6_primary_bonus", RANKED + """SELECT snapshot_id, node_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY
    CASE WHEN node_id % 9 = 0 THEN 1.0 ELSE score END DESC, node_id) AS rank FROM c QUALIFY rank <= 12""")
def _(spark, d):
    # 0.95 is the least an element with a name has, so the bonus always lifts it to the top score
    nodes = layers.with_active_layer(a.box_nodes(spark, d))
    return layers.select_actionables(nodes, 12, primary=F.col("doc_order") % 9 == 0).select(
        "snapshot_id", F.col("doc_order").alias("node_id"), "rank")


@query("l7_close_affordances", RANKED + f""", m AS (SELECT * REPLACE ({_LAYER} AS layer) FROM (SELECT * REPLACE (CASE WHEN
    snapshot_id % 2 = 0 THEN 'modal' ELSE active END AS active) FROM n)), f AS (SELECT *, CASE WHEN foc AND fo = 1 THEN 0 WHEN clo AND cc <= 2 THEN 1 ELSE 2
    END AS tier FROM (SELECT *, count(CASE WHEN foc THEN 1 END) OVER w AS fo, count(CASE WHEN clo THEN 1 END) OVER w AS cc FROM
    (SELECT *, ok AND node_id % 13 = 0 AS foc, ok AND active = 'modal' AND node_id % 6 IN (1, 2) AS clo FROM (SELECT *, kind IN
    ('link', 'button', 'input', 'textarea', 'select') AND (active IN ('popover', 'drawer') OR layer = active) AS ok FROM m))
    WINDOW w AS (PARTITION BY snapshot_id ORDER BY node_id ROWS UNBOUNDED PRECEDING)) WHERE ok), g AS (SELECT snapshot_id, node_id,
    tier, row_number() OVER (PARTITION BY snapshot_id ORDER BY tier, CASE WHEN tier < 2 THEN 0 ELSE
    -least(1.0::DOUBLE, score + CASE WHEN foc THEN 0.2 ELSE 0.0 END) END, node_id) AS rank FROM f)
    SELECT snapshot_id, node_id, tier, rank FROM g WHERE rank <= 12 OR tier < 2""")
def _(spark, d):
    # No overlay of the box view is a dialog that keeps the page from use, so every other capture is taken to show one.
    nodes = layers.with_active_layer(_focused(spark, d)).withColumn(
        "active", F.when(F.col("snapshot_id") % 2 == 0, "modal").otherwise(F.col("active")))
    label = F.when(F.col("doc_order") % 6 == 1, "Close it").when(F.col("doc_order") % 6 == 2, "×").otherwise(F.col("label"))
    rows = layers.focus_guarantee(nodes.withColumn("label", label), 12)
    return rows.select("snapshot_id", F.col("doc_order").alias("node_id"), "tier", "rank")


@query("l8_format_actionables", """SELECT p_partkey AS page_id, kind, name, val_hint, href, type,
    ena, chk, req, locator_ax FROM (
    SELECT p_partkey, 'slider' AS kind, 'Quantity ' || p_size AS name, p_size::VARCHAR AS val_hint,
      NULL AS href, NULL AS type, NOT (p_size % 3 = 0) OR p_size % 5 = 0 AS ena, NULL AS chk,
      CASE WHEN p_size % 2 = 0 THEN true END AS req,
      'role=slider[name*="Quantity ' || p_size || '"]' AS locator_ax FROM part
    UNION ALL SELECT p_partkey, 'checkbox', 'Gift wrap', NULL, NULL, NULL, true,
      CASE WHEN p_size % 4 = 0 THEN 'true' END, NULL, 'role=checkbox[name*="Gift wrap"]' FROM part
    UNION ALL SELECT p_partkey, 'link', 'Details', NULL, 'https://shop.example/p/' || p_partkey ||
      '?page=2', NULL, true, NULL, NULL, 'role=link[name*="Details"]' FROM part
    UNION ALL SELECT p_partkey, 'input', 'Secret code', '••••••••', NULL, 'password', true, NULL,
      NULL, 'role=input[name*="Secret code"]' FROM part)""")
def _(spark, d):
    nodes = a.product_nodes(spark, d).withColumn("active", F.lit("main"))
    rows = layers.format_actionables(layers.select_actionables(nodes))
    return rows.filter(F.col("kind").isin("slider", "checkbox") | F.col("name").isin(
        "Details", "Secret code")).select(
        F.col("snapshot_id").alias("page_id"), "kind", "name", "val_hint", "href", "type", "ena",
        "chk", "req", "locator_ax")


@query("l9_layer_counts", RANKED + """SELECT snapshot_id, least(count(*) FILTER (c), 10) AS shown,
    count(*) FILTER (c) AS total_in_layer, count(*) FILTER (c) > 10 AS capped FROM (SELECT *,
    kind IN ('link', 'button', 'input', 'textarea', 'select') AND (active IN ('popover', 'drawer')
    OR layer = active) AS c FROM n) GROUP BY snapshot_id""")
def _(spark, d):
    return layers.layer_counts(layers.with_active_layer(a.box_nodes(spark, d)), 10)


def _shown(nodes, keys=("snapshot_id",)):
    """Actionables of every capture on the main layer, with registered ids."""
    ids = identity.with_eids(nodes, F.lit("main"), keys).withColumn("active", F.lit("main"))
    return layers.format_actionables(layers.select_actionables(ids, keys=keys), keys=keys)


@query("l10_region_groups", CORPUS + """SELECT page_id, 'nav' AS region, n_a AS n,
    1 AS first_rank FROM heads WHERE n_a > 0""")
def _(spark, d):
    groups = layers.region_groups(_shown(a.corpus_nodes(spark, d)))
    return groups.select(F.col("snapshot_id").alias("page_id"), "region",
                         F.size("eids").cast("bigint").alias("n"), "first_rank")


# Ranked visible elements of the capture view with their numbered ids.
SHOWN = CAPS + """, sc AS (SELECT *, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN enabled THEN 0.2
    ELSE 0.0 END::DOUBLE + CASE kind WHEN 'link' THEN 0.25 WHEN 'button' THEN 0.3
    WHEN 'input' THEN 0.3 WHEN 'checkbox' THEN 0.2 ELSE 0.1 END::DOUBLE + CASE WHEN region = 'main'
    THEN 0.15 ELSE 0.0 END::DOUBLE + 0.15::DOUBLE) AS score FROM ids WHERE visible),
    sh AS (SELECT *, row_number() OVER (PARTITION BY page_id, step ORDER BY score DESC, rank)
    AS pos FROM sc),
    grp AS (SELECT page_id, step, region, string_agg(eid, ',' ORDER BY pos) AS eids FROM sh
    GROUP BY ALL)
"""


@query("l11_region_unchanged", SHOWN + """, links AS (SELECT page_id, step, lag(step) OVER
    (PARTITION BY page_id ORDER BY step) AS prev FROM (SELECT DISTINCT page_id, step FROM caps))
    SELECT g.page_id, g.step, g.region, coalesce(p.eids = g.eids, false) AS unchanged FROM grp g
    JOIN links l ON l.page_id = g.page_id AND l.step = g.step AND prev IS NOT NULL LEFT JOIN grp p
    ON p.page_id = g.page_id AND p.step = l.prev AND p.region = g.region""")
def _(spark, d):
    caps = a.captures(spark, d)
    groups = layers.region_groups(_shown(a.capture_nodes(spark, d), ("page_id", "step")),
                                  ("page_id", "step"))
    every = caps.select("page_id", "step", F.lit("baseline").alias("mode"))
    return layers.region_unchanged(groups, diff.step_links(caps), every)


@query("l12_trim_regions", CORPUS + """SELECT page_id, label, ord::BIGINT AS pos,
    greatest(n_a - 5, 0)::BIGINT AS trimmed FROM links JOIN heads USING (page_id)
    WHERE n_a <= 5 OR ord <= 3 OR ord > n_a - 2""")
def _(spark, d):
    rows = layers.trim_regions(_shown(a.corpus_nodes(spark, d)))
    return rows.select(F.col("snapshot_id").alias("page_id"), F.col("name").alias("label"),
                       F.col("pos").cast("bigint").alias("pos"),
                       F.col("trimmed").cast("bigint").alias("trimmed"))


@query("l13_diff_mode_filter", PAIRS + f""", sh AS (SELECT page_id, step, eid FROM ids WHERE
    visible), t AS (SELECT page_id, step, eid FROM ({ADDED}) UNION SELECT page_id, step, eid FROM
    ({CHANGED})) SELECT page_id, step, eid FROM sh JOIN links USING (page_id, step) WHERE
    prev IS NULL OR (page_id, step, eid) IN (SELECT (page_id, step, eid) FROM t)""")
def _(spark, d):
    nodes, caps = a.capture_nodes(spark, d), a.captures(spark, d)
    rows = _shown(nodes, ("page_id", "step")).withColumn("active", F.lit("main"))
    modes = diff.response_mode(caps.withColumn("node_count", F.lit(1)))
    return layers.diff_mode_filter(rows, modes, diff.compute_diff(nodes, caps)).select(
        "page_id", "step", "eid")


_EID = (r"substr(sha256(concat_ws('::', 'link', regexp_replace(regexp_replace(lower(trim(label)), "
        r"'\([0-9]+\)', '(#)', 'g'), ' [0-9]+$', ' #'), href, 'nav/', 'main', '', '')), 1, 12)")


def _esc(c: str) -> str:
    return (f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', "
            "'&gt;'), '\"', '&quot;'), '''', '&apos;')")


@query("l15_render_state", CORPUS + f""", e AS (SELECT *, CASE WHEN n = 1 THEN b ELSE b || '-' || n
    END AS eid FROM (SELECT *, row_number() OVER (PARTITION BY page_id, b ORDER BY ord) AS n FROM
    (SELECT *, {_EID} AS b FROM links))), g AS (SELECT page_id, '  <region name="nav">' || chr(10)
    || string_agg('    <link id="' || eid || '" href="' || {_esc('href')} || '">' || {_esc('label')}
    || '</link>' || chr(10), '' ORDER BY ord) || '  </region>' || chr(10) AS r FROM e
    GROUP BY page_id), dg AS (SELECT page_id, '<state step="1" title="Page ' || page_id ||
    '" url="' || {_esc('url')} || '">' || chr(10) ||
    '  <meta view="1280x720" scroll="0,0" layer="main" />' || chr(10) ||
    '  <baseline reason="first" />' || chr(10) || coalesce(r, '') || '</state>' AS digest
    FROM base LEFT JOIN g USING (page_id))
    SELECT page_id, md5(digest) AS hash, ceil(length(digest) / 4.0)::BIGINT AS tokens FROM dg""")
def _(spark, d):
    return corpus_digests(spark, d).select(
        F.col("snapshot_id").alias("page_id"), F.md5("digest").alias("hash"), "tokens")


def corpus_digests(spark, d):
    pages = a.table(spark, d, "pages").select(
        F.col("page_id").alias("snapshot_id"), F.lit(1).alias("step"),
        F.concat(F.lit("Page "), "page_id").alias("title"), "url",
        F.lit("1280x720").alias("view"), F.lit("0,0").alias("scroll"),
        F.lit("main").alias("layer"))
    regions = render.render_regions(_shown(a.corpus_nodes(spark, d)))
    return render.render_state(pages, regions)


def capture_digests(spark, d):
    """Digests of the capture view, one per (page_id, step)."""
    keys = ("page_id", "step")
    caps = a.captures(spark, d).select(
        "page_id", "step", "title", "url", F.lit("1280x720").alias("view"),
        F.lit("0,0").alias("scroll"), F.lit("main").alias("layer"))
    regions = render.render_regions(_shown(a.capture_nodes(spark, d), keys), keys)
    return render.render_state(caps, regions, keys=keys)


# The digest of the capture view, written out.
LINE = f"""'    <' || CASE kind WHEN 'link' THEN 'link' WHEN 'button' THEN 'btn' WHEN 'checkbox' THEN
    'chk' WHEN 'alert' THEN 'alert' ELSE 'elt' END || ' id="' || eid || '"' || CASE WHEN kind =
    'input' THEN ' kind="input"' ELSE '' END || CASE WHEN enabled THEN '' ELSE ' enabled="false"'
    END || ' val="' || value || '">' || label || '</' || CASE kind WHEN 'link' THEN 'link' WHEN
    'button' THEN 'btn' WHEN 'checkbox' THEN 'chk' WHEN 'alert' THEN 'alert' ELSE 'elt' END || '>'
    || chr(10)"""
DIGESTS = SHOWN + f""", blk AS (SELECT page_id, step, region, min(pos) AS head_pos,
    '  <region name="' || region || '">' || chr(10) || string_agg({LINE}, '' ORDER BY pos) ||
    '  </region>' || chr(10) AS part FROM sh GROUP BY page_id, step, region), dig AS (SELECT page_id, step,
    '<state step="' || step || '" title="Page ' || page_id || '" url="https://x.example/' || page_id
    || '">' || chr(10) || '  <meta view="1280x720" scroll="0,0" layer="main" />' || chr(10) ||
    '  <baseline reason="first" />' || chr(10) || coalesce(r, '') || '</state>' AS digest FROM
    (SELECT DISTINCT page_id, step FROM caps) LEFT JOIN (SELECT page_id, step, string_agg(part, ''
    ORDER BY head_pos) AS r FROM blk GROUP BY ALL) USING (page_id, step))
"""


@query("l15_render_captures", DIGESTS + """SELECT page_id, step, md5(digest) AS hash,
    length(digest)::BIGINT AS chars FROM dig""")
def _(spark, d):
    return capture_digests(spark, d).select(
        "page_id", "step", F.md5("digest").alias("hash"),
        F.length("digest").cast("bigint").alias("chars"))
