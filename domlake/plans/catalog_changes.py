"""Queries for ids, the registry and changes between captures."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import diff, identity, layers
from . import adapters as a
from .catalog import query
from .catalog_pages import CORPUS
from .catalog_query import CAPS, NORM


@query("d1_normalize_name", f"""SELECT p_partkey, {NORM} AS name FROM (SELECT p_partkey,
    upper(p_name) || ' (' || p_size || ') page ' || p_partkey AS label FROM part)""")
def _(spark, d):
    label = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t("), "p_size", F.lit(")  page "),
                     "p_partkey", F.lit(" "))
    return a.table(spark, d, "part").select("p_partkey",
                                            identity.normalize_name(label).alias("name"))


@query("d2_landmark_path", CAPS + """SELECT page_id, step, node_id, region || '/' || region AS path,
    region AS hint FROM caps""")
def _(spark, d):
    return a.capture_nodes(spark, d).select(
        "page_id", "step", "node_id", identity.landmark_path().alias("path"),
        identity.position_hint().alias("hint"))


_LINK_EID = f"""substr(sha256(concat_ws('::', 'link', {NORM}, href, 'nav/', 'main', '', '')), 1,
    12)"""


@query("d3_eid", CORPUS + f"""SELECT page_id, rank::BIGINT AS rank, {_LINK_EID} AS eid FROM els
    WHERE kind = 'link'""")
def _(spark, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy("doc_order")).cast("bigint")
    return a.corpus_nodes(spark, d).withColumn("rank", rank).filter("kind = 'link'").select(
        "page_id", "rank", identity.eid().alias("eid"))


@query("d4_resolve_collisions", CAPS + "SELECT page_id, step, node_id, eid FROM ids")
def _(spark, d):
    return identity.with_eids(a.capture_nodes(spark, d), F.lit("main")).select(
        "page_id", "step", "node_id", "eid")


@query("d5_registry_update", CAPS + """, steps AS (SELECT DISTINCT page_id, step FROM caps),
    first AS (SELECT page_id, eid, min(step) AS f FROM ids GROUP BY ALL)
    SELECT page_id, step, eid, CASE WHEN step = f THEN 'added' ELSE 'updated' END AS op
    FROM ids JOIN first USING (page_id, eid)
    UNION ALL SELECT page_id, s.step, eid, 'removed' FROM first JOIN steps s USING (page_id)
    WHERE s.step > f AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.page_id = first.page_id AND
    i.eid = first.eid AND i.step = s.step)""")
def _(spark, d):
    ids = identity.with_eids(a.capture_nodes(spark, d), F.lit("main"))
    return identity.registry_update(ids, a.captures(spark, d)).select("page_id", "step", "eid",
                                                                      "op")


@query("d5_registry_intervals", CAPS + """, t AS (SELECT page_id, step, row_number() OVER (PARTITION BY page_id
    ORDER BY step) AS tick, count(*) OVER (PARTITION BY page_id) AS top FROM (SELECT DISTINCT page_id, step FROM caps))
    SELECT page_id, eid, step, CASE WHEN lag(step) OVER w IS NULL THEN 'added' ELSE 'updated' END AS op, tick + 1 AS
    gone_from, coalesce(lead(tick) OVER w, top + 1) AS gone_until FROM ids JOIN t USING (page_id, step)
    WINDOW w AS (PARTITION BY page_id, eid ORDER BY step)""")
def _(spark, d):
    ids = identity.with_eids(a.capture_nodes(spark, d), F.lit("main"))
    caps = a.captures(spark, d)
    ranks = identity.capture_ranks(caps)
    return identity.registry_intervals(ids, identity.capture_clock(ids, caps, ranks), ranks)


@query("d6_stale", CAPS + """, t AS (SELECT page_id, step, row_number() OVER (PARTITION BY page_id
    ORDER BY step) AS tick FROM (SELECT DISTINCT page_id, step FROM caps)), now AS (SELECT page_id,
    max(tick) AS now FROM t GROUP BY page_id) SELECT page_id, eid, now - tick AS age,
    now - tick > 2 AS is_stale FROM (SELECT page_id, eid, max(step) AS step FROM ids GROUP BY ALL)
    JOIN t USING (page_id, step) JOIN now USING (page_id)""")
def _(spark, d):
    ids = identity.with_eids(a.capture_nodes(spark, d), F.lit("main"))
    return identity.stale(ids, a.captures(spark, d))


# Visible elements by id, last one wins; each capture with the one before it.
PAIRS = CAPS + """, links AS (SELECT page_id, step, lag(step) OVER w AS prev, lead(step) OVER w
    AS next FROM (SELECT DISTINCT page_id, step FROM caps) WINDOW w AS (PARTITION BY page_id ORDER BY
    step)),
els AS (SELECT page_id, step, base AS eid, label, visible, enabled, value FROM caps WHERE visible
    QUALIFY row_number() OVER (PARTITION BY page_id, step, base ORDER BY rank DESC) = 1),
cur AS (SELECT e.*, prev FROM els e JOIN links USING (page_id, step) WHERE prev IS NOT NULL),
old AS (SELECT e.page_id, next AS step, eid, label, visible, enabled, value FROM els e JOIN links
    USING (page_id, step) WHERE next IS NOT NULL)
"""
ADDED = """SELECT page_id, step, eid FROM cur c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE
    o.page_id = c.page_id AND o.step = c.step AND o.eid = c.eid)"""
REMOVED = """SELECT page_id, step, eid FROM old o WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE
    o.page_id = c.page_id AND o.step = c.step AND o.eid = c.eid)"""
CHANGED = """SELECT page_id, step, eid, k, f AS "from", t AS "to" FROM (
    SELECT c.page_id, c.step, c.eid, 'ena' AS k, o.enabled::VARCHAR AS f, c.enabled::VARCHAR AS t
      FROM cur c JOIN old o USING (page_id, step, eid)
    UNION ALL SELECT c.page_id, c.step, c.eid, 'val', o.value, c.value FROM cur c JOIN old o
      USING (page_id, step, eid)
    UNION ALL SELECT c.page_id, c.step, c.eid, 'label', o.label, c.label FROM cur c JOIN old o
      USING (page_id, step, eid)) WHERE f IS DISTINCT FROM t"""


@query("d7_diff_added", PAIRS + ADDED)
def _(spark, d):
    return diff.diff_added(a.capture_nodes(spark, d), a.captures(spark, d))


@query("d7_diff_removed", PAIRS + REMOVED)
def _(spark, d):
    return diff.diff_removed(a.capture_nodes(spark, d), a.captures(spark, d))


@query("d8_diff_changed", PAIRS + CHANGED)
def _(spark, d):
    return diff.diff_changed(a.capture_nodes(spark, d), a.captures(spark, d))


# Four pages of the corpus as four captures of one page.
_SITE = """WITH s AS (SELECT page_id // 4 AS page_id, (page_id % 4)::INT AS step, url,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS title FROM pages), p AS (SELECT *, lag(url)
    OVER w AS u, lag(title) OVER w AS t, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path
    FROM s WINDOW w AS (PARTITION BY page_id ORDER BY step))
"""


def _site(spark, d):
    return a.table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 4).alias("page_id"),
        (F.col("page_id") % 4).cast("int").alias("step"), "url",
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("title"))


@query("d9_diff_document", _SITE + """SELECT page_id, step, u AS from_url, url AS to_url, t AS from_title, title AS to_title, CASE WHEN
    regexp_extract(u, '^https?://[^/]+([^?#]*)', 1) = path THEN 'soft' ELSE 'hard' END AS nav_type
    FROM p WHERE u IS NOT NULL AND (u <> url OR t <> title)""")
def _(spark, d):
    return diff.diff_document(_site(spark, d)).select("page_id", "step", "from_url", "to_url", "from_title", "to_title",
                                                      "nav_type")


# Layers of the box view; its captures are steps of a page, eight each.
_Z = "coalesce(z_index, 0)"
BOX_LAYERS = f"""WITH b AS (SELECT * FROM ({a.BOXES})), l AS (SELECT *, {_Z} AS z, CASE
    WHEN role = 'dialog' AND {_Z} > 1000 THEN 'modal 0.8'
    WHEN {_Z} > 500 AND w > 200 AND h > 200 THEN 'modal 0.75'
    WHEN role = 'complementary' AND {_Z} > 100 THEN 'drawer 0.7'
    WHEN {_Z} > 100 AND role = 'menu' THEN 'popover 0.8'
    WHEN {_Z} > 100 AND role = 'dialog' THEN 'popover 0.6'
    WHEN {_Z} > 100 AND role = 'alert' THEN 'toast 0.7' END AS layer FROM b),
    k AS (SELECT *, split_part(layer, ' ', 1) AS type FROM l
      WHERE layer IS NOT NULL AND layer <> 'popover 0.6'),
    st AS (SELECT snapshot_id, list_concat(['main'], coalesce(list(type ORDER BY z DESC, node_id)
      FILTER (type IS NOT NULL), [])) AS stack, coalesce(arg_max(type, (-z, node_id)) FILTER
      (type <> 'toast'), 'main') AS active FROM (SELECT DISTINCT snapshot_id FROM b) LEFT JOIN k
      USING (snapshot_id) GROUP BY snapshot_id)
"""


def box_stacks(spark, d):
    return layers.layer_stack(a.box_nodes(spark, d)).withColumn(
        "page_id", F.floor(F.col("snapshot_id") / 8)).withColumn(
        "step", (F.col("snapshot_id") % 8).cast("int"))


@query("d10_diff_layers", BOX_LAYERS + """SELECT snapshot_id // 8 AS page_id,
    (snapshot_id % 8)::INT AS step, array_to_string(prev, ',') AS stack_from,
    array_to_string(stack, ',') AS stack_to FROM (SELECT *, lag(stack) OVER (PARTITION BY
    snapshot_id // 8 ORDER BY snapshot_id) AS prev FROM st) WHERE prev IS NOT NULL AND
    prev <> stack""")
def _(spark, d):
    return diff.diff_layers(box_stacks(spark, d)).select(
        "page_id", "step", F.array_join("stack_from", ",").alias("stack_from"),
        F.array_join("stack_to", ",").alias("stack_to"))


ATOMS = CAPS + """, atm AS (SELECT page_id, step, nullif(count(*) FILTER (role IN ('alert',
    'status')), 0) AS toasts FROM caps GROUP BY ALL)
"""


@query("d11_atoms", ATOMS + f""", capped AS (SELECT * REPLACE (CASE WHEN toasts >
    {rules.MAX_TOASTS} THEN {rules.MAX_TOASTS} ELSE toasts END AS toasts) FROM atm)
    """ + """SELECT page_id, step, toasts, CASE WHEN toasts > 0 THEN 0 END
    AS banners, NULL::BIGINT AS spinners FROM capped""")
def _(spark, d):
    return diff.atoms(a.capture_nodes(spark, d), a.captures(spark, d), rules.MAX_TOASTS,
                      rules.MAX_BANNERS).select(
        "page_id", "step", "toasts", "banners", "spinners")


@query("d11_atoms_forms", """SELECT p_partkey AS page_id, 0 AS step, 1280 AS viewport_w,
    (p_partkey % 50)::INT AS scroll_y, CASE WHEN p_size % 2 = 1 THEN 1 END AS validation_errors,
    2 AS toasts FROM part""")
def _(spark, d):
    nodes = a.product_nodes(spark, d).withColumn("page_id", F.col("snapshot_id")).withColumn(
        "step", F.lit(0))
    # A promoted toast carries no role attribute, the alert does: give the toast one.
    role = F.when(F.col("kind") == "alert", "alert").otherwise(F.col("attributes.role"))
    nodes = nodes.withColumn("attributes", F.col("attributes").withField("role", role))
    captures = a.products(spark, d).select(
        "page_id", F.lit(0).alias("step"),
        F.struct(F.lit(1280).alias("w"), F.lit(720).alias("h")).alias("viewport"),
        F.struct(F.lit(0).alias("x"), (F.col("page_id") % 50).cast("int").alias("y"))
        .alias("scroll"))
    return diff.atoms(nodes, captures).select(
        "page_id", "step", "viewport_w", "scroll_y", "validation_errors", "toasts")


ATOM_DIFF = """SELECT page_id, step, 'notifications.toasts' AS k, p::VARCHAR AS "from",
    toasts::VARCHAR AS "to" FROM (SELECT *, lag(toasts) OVER w AS p, lag(step) OVER w AS s FROM atm
    WINDOW w AS (PARTITION BY page_id ORDER BY step)) WHERE s IS NOT NULL AND
    p IS DISTINCT FROM toasts"""


@query("d12_diff_atoms", ATOMS + ATOM_DIFF)
def _(spark, d):
    return diff.diff_atoms(diff.atoms(a.capture_nodes(spark, d), a.captures(spark, d)))


MUTATIONS = """SELECT c.page_id, c.step, CASE WHEN o.node_id IS NULL THEN 'status_appeared' ELSE
    'text_changed' END AS op, 'rd-' || substr(c.base, 1, 10) AS eid,
    CASE WHEN o.node_id IS NULL THEN c.role END AS role,
    o.label AS "from", c.label AS "to" FROM (SELECT caps.*, prev FROM caps JOIN links
    USING (page_id, step) WHERE prev IS NOT NULL AND visible AND role IS NOT NULL) c LEFT JOIN
    (SELECT * FROM caps WHERE visible AND role IS NOT NULL) o ON o.page_id = c.page_id AND
    o.step = c.prev AND o.node_id = c.node_id WHERE o.node_id IS NULL OR o.label <> c.label"""


@query("d13_diff_mutations", PAIRS + MUTATIONS)
def _(spark, d):
    return diff.diff_mutations(a.capture_nodes(spark, d), a.captures(spark, d))


_AT = ATOMS[len(CAPS):]
ALL = f"""SELECT page_id, step, 'added' AS op, eid, NULL AS k, NULL AS "from", NULL AS "to"
    FROM ({ADDED}) UNION ALL SELECT page_id, step, 'removed', eid, NULL, NULL, NULL FROM ({REMOVED})
    UNION ALL SELECT page_id, step, 'changed', eid, k, "from", "to" FROM ({CHANGED})
    UNION ALL SELECT page_id, step, 'atom', NULL, k, "from", "to" FROM ({ATOM_DIFF})
    UNION ALL SELECT page_id, step, op, eid, role, "from", "to" FROM ({MUTATIONS})"""


@query("d14_compute_diff", PAIRS + _AT + ALL)
def _(spark, d):
    nodes, caps = a.capture_nodes(spark, d), a.captures(spark, d)
    return diff.compute_diff(nodes, caps)


@query("d14_is_empty", PAIRS + _AT + f"""SELECT page_id, step, n IS NULL AS is_empty FROM (SELECT
    page_id, step FROM links WHERE prev IS NOT NULL) LEFT JOIN (SELECT page_id, step, count(*) AS n
    FROM ({ALL}) GROUP BY ALL) USING (page_id, step)""")
def _(spark, d):
    nodes, caps = a.capture_nodes(spark, d), a.captures(spark, d)
    return diff.is_empty(diff.compute_diff(nodes, caps), caps)


@query("d15_doc_id", r"""SELECT page_id, substr(sha256(lower(regexp_extract(url,
    '^(https?://[^/]+)', 1)) || ':' || regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)), 1, 12)
    AS doc_id FROM pages""")
def _(spark, d):
    return a.table(spark, d, "pages").select("page_id", identity.doc_id("url").alias("doc_id"))


@query("d15_ui_hash", CAPS + """SELECT page_id, step, substr(sha256(string_agg(base, ',' ORDER BY
    rank)), 1, 6) AS ui_hash FROM caps WHERE visible AND kind <> 'alert' GROUP BY ALL""")
def _(spark, d):
    return identity.ui_hash(a.capture_nodes(spark, d), ("page_id", "step"))


@query("d15_layer_hash", BOX_LAYERS + """SELECT snapshot_id, substr(sha256(array_to_string(stack,
    ',')), 1, 6) AS layer_hash FROM st""")
def _(spark, d):
    return layers.layer_stack(a.box_nodes(spark, d)).select(
        "snapshot_id", identity.layer_hash("stack").alias("layer_hash"))


@query("d16_response_mode", _SITE + """, g AS (SELECT *, regexp_extract(url,
    '^(https?://[^?#]*)', 1) AS doc FROM s WHERE (page_id + step) % 5 <> 0), m AS (SELECT page_id,
    step, lag(doc) OVER (PARTITION BY page_id ORDER BY step) AS before, doc FROM g)
    SELECT page_id, step, CASE WHEN before = doc THEN 'diff' ELSE 'baseline' END AS mode,
    CASE WHEN before IS NULL THEN 'first' WHEN before <> doc THEN 'navigation' END AS reason FROM m
    UNION ALL SELECT page_id, step, 'baseline', 'error' FROM s WHERE (page_id + step) % 5 = 0""")
def _(spark, d):
    caps = _site(spark, d).withColumn("node_count", F.when(
        (F.col("page_id") + F.col("step")) % 5 == 0, 0).otherwise(9))
    return diff.response_mode(caps)


@query("d17_latest_snapshot", CAPS + """SELECT page_id, max(step) AS step FROM (SELECT user_id AS
    page_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS step, max(ts) AS seen FROM events GROUP BY ALL)
    GROUP BY page_id HAVING max(seen) >= TIMESTAMP '2024-01-28 00:00:00'""")
def _(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return identity.latest_snapshot(a.captures(spark, d), 4 * 86_400, now).select("page_id", "step")


@query("d17_store_stats", CAPS + """SELECT count(*) AS snapshot_count, sum(n)::BIGINT AS total_nodes
    FROM (SELECT page_id, step, count(*) AS n FROM caps GROUP BY page_id, step QUALIFY row_number()
    OVER (PARTITION BY page_id ORDER BY step DESC) = 1)""")
def _(spark, d):
    latest = identity.latest_snapshot(a.captures(spark, d))
    return identity.store_stats(latest, a.capture_nodes(spark, d)).select(
        "snapshot_count", "total_nodes")
