"""Queries from documents to elements: sources, tree operators, compile, readable text."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import content, observe, tree
from ..schema import ELEMENT_COLUMNS
from ..sources.captures import ax_nodes, frame_loaders, read_pages, split_snapshots
from ..sources.html import flatten_dom_json, html_to_dom
from . import adapters as a
from .catalog import query
from .compile import compile_captures, compile_elements

# -- SQL over the corpus, by regular expression ------------------------------------------------


def unescape(c: str) -> str:
    return (f"trim(regexp_replace(replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', "
            "'·'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))")


_A = "'<a href=\"([^\"]*)\">([^<]*)</a>'"
CORPUS = f"""
WITH base AS (SELECT page_id, url, html, regexp_replace(html,
    '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS c FROM pages),
links AS (SELECT page_id, href, ord, {unescape('raw')} AS label FROM (SELECT page_id,
    unnest(regexp_extract_all(c, {_A}, 1)) AS href, unnest(regexp_extract_all(c, {_A}, 2)) AS raw,
    unnest(range(1, len(regexp_extract_all(c, {_A})) + 1)) AS ord FROM base)),
heads AS (SELECT page_id, {unescape("regexp_extract(c, '<h1>([^<]*)</h1>', 1)")} AS h1,
    len(regexp_extract_all(c, '<p>')) AS n_p, len(regexp_extract_all(c, {_A})) AS n_a FROM base),
els AS (
    SELECT page_id, 1 AS rank, 'list' AS kind, '' AS label, NULL AS href, 'nav' AS region,
      NULL AS heading, 'navigation-12' AS grp FROM heads
    UNION ALL SELECT page_id, 2 * ord, 'listitem', label, NULL, 'nav', NULL, 'list-13' FROM links
    UNION ALL SELECT page_id, 2 * ord + 1, 'link', label, href, 'nav', NULL, 'list-13' FROM links
    UNION ALL SELECT page_id, 2 * n_a + 2, 'heading', CASE WHEN length(h1) <= 160 THEN h1
      ELSE h1[1:159] || '…' END, NULL, 'unknown', h1, 'article-' || (17 + 3 * n_a) FROM heads
    UNION ALL SELECT page_id, 2 * n_a + 2 + unnest(range(1, n_p + 1)), 'paragraph', '', NULL,
      'unknown', h1, 'article-' || (17 + 3 * n_a) FROM heads)
"""


def dom_nodes(spark, d):
    return a.corpus(spark, d)


@query("s1_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(spark, d):
    return read_pages(spark, f"{d}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("s2_html_to_dom", CORPUS + """SELECT page_id, tag, count(*) AS n FROM (SELECT page_id,
    upper(unnest(regexp_extract_all(c, '<([a-z0-9]+)[ >]', 1))) AS tag FROM base
    UNION ALL SELECT page_id, 'SCRIPT' FROM base UNION ALL SELECT page_id, 'STYLE' FROM base)
    GROUP BY page_id, tag""")
def _(spark, d):
    return dom_nodes(spark, d).filter("node_type = 1").groupBy(
        F.col("snapshot_id").alias("page_id"), F.col("node_name").alias("tag")).agg(
        F.count("*").alias("n"))


@query("s3_flatten_dom_json", """SELECT p_partkey AS snapshot_id, id, parent_id, pre, depth,
    CASE id WHEN 12 THEN p_name WHEN 24 THEN 'light' WHEN 33 THEN p_brand END AS value, path
    FROM part, (VALUES (1, NULL, 0, 0, 'root|light'), (10, 1, 1, 1, 'root|light'),
    (11, 10, 2, 2, 'root|light'), (12, 11, 3, 3, 'root|light'), (20, 10, 4, 2, 'root|light'),
    (23, 20, 5, 3, 'root|light'), (24, 23, 6, 4, 'root|light'), (21, 20, 7, 3, 'root|20'),
    (22, 21, 8, 4, 'root|20'), (30, 10, 9, 2, 'root|light'), (31, 30, 10, 3, '30|light'),
    (32, 31, 11, 4, '30|light'), (33, 32, 12, 5, '30|light')) v(id, parent_id, pre, depth, path)""")
def _(spark, d):
    dom = flatten_dom_json(a.capture_json(spark, d), "dom_json")
    return dom.select("snapshot_id", "id", "parent_id", "pre", "depth",
                      F.col("node_value").alias("value"), tree.context_key().alias("path"))


@query("s4_ax_nodes", """SELECT p_partkey AS snapshot_id, id, role, CASE id WHEN 10 THEN 'Main ' ||
    p_brand WHEN 11 THEN p_name WHEN 22 THEN '' WHEN 24 THEN 'light' WHEN 32 THEN 'Frame ' || p_size
    END AS name, CASE WHEN id = 11 THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END END
    AS disabled, CASE WHEN id = 32 THEN '2' END AS level FROM part, (VALUES (10, 'main'),
    (11, 'button'), (22, 'textbox'), (23, 'generic'), (24, 'StaticText'), (32, 'heading'))
    v(id, role)""")
def _(spark, d):
    prop = lambda n: F.try_element_at("properties", F.lit(n)).alias(n)
    return ax_nodes(a.capture_json(spark, d), "ax_json").select(
        "snapshot_id", "id", "role", "name", prop("disabled"), prop("level"))


@query("s5_read_snapshots_json", f"""SELECT page_id || '-' || step AS snapshot_id, node_id, kind,
    label, region, visible, row_number() OVER (PARTITION BY page_id, step ORDER BY kind, node_id)
    - 1 AS doc_order FROM ({a.CAPS})""")
def _(spark, d):
    # Finished snapshots as JSON text, read back through the file schema.
    from ..schema import SNAPSHOT_FILE

    nodes = a.capture_nodes(spark, d)
    packed = nodes.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct(
        "doc_order", "node_id", "kind", "label", "where", "state"))).alias("nodes"))
    text = packed.select(F.to_json(F.struct("*")).alias("j"))
    schema = f"struct<{', '.join(_typed(SNAPSHOT_FILE))}>"
    raw = text.select(F.from_json("j", schema).alias("s")).select("s.*")
    return split_snapshots(raw)[1].select(
        "snapshot_id", "node_id", "kind", "label", F.col("where.region").alias("region"),
        F.col("state.visible").alias("visible"), "doc_order")


def _typed(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return out


@query("t1_dom_order", CORPUS + """SELECT page_id, 'A' AS tag, ord AS pos FROM links
    UNION ALL SELECT page_id, 'H1', n_a + 1 FROM heads""")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = dom_nodes(spark, d).filter("node_name IN ('A', 'H1')")
    pos = F.row_number().over(W.partitionBy("snapshot_id").orderBy("pre")).cast("bigint")
    return rows.select(F.col("snapshot_id").alias("page_id"), F.col("node_name").alias("tag"),
                       pos.alias("pos"))


@query("t2_context_key", """SELECT p_partkey AS page_id, scope, n FROM part, (VALUES
    ('root|light', 1), ('root|shadow', 1), ('frame|light', 1)) v(scope, n)""")
def _(spark, d):
    # Elements with id 'top' live in three different scopes of each page.
    rows = a.product_dom(spark, d).filter(tree.attr("id") == "top")
    key = tree.context_key()
    scope = F.regexp_replace(F.regexp_replace(key, r"^\d+\|", "frame|"), r"\|\d+$", "|shadow")
    return rows.groupBy(F.col("snapshot_id").alias("page_id"), scope.alias("scope")).agg(
        F.count("*").alias("n"))


@query("t3_id_map", """SELECT p_partkey AS page_id, html_id, scopes, tag FROM part, (VALUES
    ('top', 3, 'BUTTON,H1,P'), ('order', 1, 'FORM'), ('qty', 1, 'INPUT'), ('ref1', 1, 'DIV'),
    ('ref2', 1, 'DIV'), ('host', 1, 'DIV')) v(html_id, scopes, tag)""")
def _(spark, d):
    # Text and comments carry no html id.
    marked = a.product_dom(spark, d, texts=False, columns=("id", "attributes", "frame_path", "shadow_path", "pre"))
    names = a.product_dom(spark, d, columns=("id", "node_name"))
    ids = tree.id_map(marked).join(names.select("snapshot_id", "id", "node_name"), ["snapshot_id", "id"])
    return ids.groupBy(F.col("snapshot_id").alias("page_id"), "html_id").agg(
        F.count("*").alias("scopes"),
        F.array_join(F.array_sort(F.collect_list("node_name")), ",").alias("tag"))


@query("t4_adjacency", """SELECT p_partkey AS page_id, link, tag, 1 AS roots FROM part, (VALUES
    ('shadow', 'DIV'), ('document', 'IFRAME')) v(link, tag)""")
def _(spark, d):
    roots = a.product_dom(spark, d, texts=False, columns=("id", "parent_id", "node_name", "pre"))
    names = a.product_dom(spark, d, columns=("id", "node_name"))
    adj = tree.adjacency(roots)
    return adj.join(names.select("snapshot_id", F.col("id").alias("parent_id"), "node_name"),
                    ["snapshot_id", "parent_id"]).select(
        F.col("snapshot_id").alias("page_id"), "link", F.col("node_name").alias("tag"),
        F.size("roots").alias("roots"))


@query("t5_frame_loaders", """SELECT p_partkey AS snapshot_id, 'F1' AS frame_id, 'L' || p_partkey
    AS loader_id, true AS is_main FROM part UNION ALL SELECT p_partkey, 'F2',
    CASE WHEN p_size % 2 = 0 THEN 'LX' END, false FROM part""")
def _(spark, d):
    return frame_loaders(a.capture_json(spark, d), "frame_json").drop("error")


@query("t6_ancestors", CORPUS + """SELECT page_id, tag, depth, count(*) AS n FROM (
    SELECT page_id, upper(unnest(regexp_extract_all(c, '<([a-z0-9]+)[ >]', 1))) AS tag FROM base)
    JOIN (VALUES ('HTML', 1), ('HEAD', 2), ('META', 3), ('TITLE', 3), ('BODY', 2), ('NAV', 3),
    ('UL', 4), ('LI', 5), ('A', 6), ('DIV', 3), ('ARTICLE', 3), ('H1', 4), ('P', 4), ('B', 5),
    ('BR', 6), ('FOOTER', 3)) v(tag, depth) USING (tag) GROUP BY page_id, tag, depth""")
def _(spark, d):
    dom = dom_nodes(spark, d).filter("node_type = 1 AND node_name NOT IN ('SCRIPT', 'STYLE')")
    up = tree.ancestors(dom).groupBy("snapshot_id", "id").agg(
        F.max("distance").alias("depth"))
    return up.join(dom.select("snapshot_id", "id", "node_name"), ["snapshot_id", "id"]).groupBy(
        F.col("snapshot_id").alias("page_id"), F.col("node_name").alias("tag"), "depth").agg(
        F.count("*").alias("n"))


@query("t7_text_content", CORPUS + """SELECT page_id, 'LI' AS tag, label AS text, count(*) AS n
    FROM links GROUP BY ALL UNION ALL SELECT page_id, 'H1', h1, 1 FROM heads""")
def _(spark, d):
    dom = dom_nodes(spark, d)
    rows = tree.text_content(dom, 2).join(
        dom.filter("node_name IN ('LI', 'H1')").select("snapshot_id", "id", "node_name"),
        ["snapshot_id", "id"])
    return rows.groupBy(F.col("snapshot_id").alias("page_id"), F.col("node_name").alias("tag"),
                        "text").agg(F.count("*").alias("n"))


@query("t8_heading_context", CORPUS + """SELECT page_id, kind, heading, count(*) AS n FROM els
    GROUP BY ALL""")
def _(spark, d):
    return a.corpus_nodes(spark, d).groupBy(
        "page_id", "kind", F.col("where.heading_context").alias("heading")).agg(
        F.count("*").alias("n"))


@query("t8_heading_context_frames", """SELECT p_partkey AS page_id, label, heading FROM (
    SELECT p_partkey, 'Go' AS label, p_name AS heading FROM part
    UNION ALL SELECT p_partkey, 'One', 'Related' FROM part
    UNION ALL SELECT p_partkey, 'Inside', 'Related' FROM part
    UNION ALL SELECT p_partkey, 'x', 'In frame' FROM part)""")
def _(spark, d):
    return a.product_nodes(spark, d).filter(F.col("label").isin("Go", "One", "Inside", "x")).select(
        F.col("snapshot_id").alias("page_id"), "label",
        F.col("where.heading_context").alias("heading"))


@query("t9_heading_context_local", """SELECT p_partkey AS page_id, 'UL' AS tag, 'Related' AS local
    FROM part UNION ALL SELECT p_partkey, 'OL', 'Related' FROM part
    UNION ALL SELECT p_partkey, 'FORM', p_name FROM part
    UNION ALL SELECT p_partkey, 'MAIN', NULL FROM part""")
def _(spark, d):
    el = tree.join_dom_ax(tree.with_derived_ax(a.product_dom(spark, d)))
    return tree.heading_context_local(el.filter("node_type = 1")).filter(
        F.col("tag").isin("UL", "OL", "FORM", "MAIN")).select(
        F.col("snapshot_id").alias("page_id"), "tag", F.col("heading_local").alias("local"))


@query("t10_join_dom_ax", CORPUS + """SELECT page_id, tag, sum(n)::BIGINT AS n FROM (
    SELECT page_id, CASE kind WHEN 'link' THEN 'A' WHEN 'listitem' THEN 'LI' WHEN 'list' THEN 'UL'
    WHEN 'heading' THEN 'H1' ELSE 'P' END AS tag, count(*) AS n FROM els GROUP BY ALL)
    GROUP BY page_id, tag""")
def _(spark, d):
    el = tree.join_dom_ax(tree.with_derived_ax(dom_nodes(spark, d)))
    return el.filter("listed").groupBy(F.col("snapshot_id").alias("page_id"), "tag").agg(
        F.count("*").alias("n"))


@query("t10_join_captured_ax", """SELECT p_partkey AS snapshot_id, id, tag, role, listed, region
    FROM part, (VALUES (10, 'MAIN', 'main', false, 'main'), (11, 'BUTTON', 'button', true, 'main'),
    (22, 'INPUT', 'textbox', true, 'main'), (32, 'H2', 'heading', true, 'main'),
    (24, '#TEXT', 'statictext', true, 'main')) v(id, tag, role, listed, region)""")
def _(spark, d):
    src = a.capture_json(spark, d)
    el = tree.join_dom_ax(tree.with_ax(flatten_dom_json(src, "dom_json"),
                                       ax_nodes(src, "ax_json")))
    return el.filter(F.col("ax_role").isNotNull() & (F.col("ax_role") != "generic")).select(
        "snapshot_id", "id", "tag", F.col("ax_role").alias("role"), "listed",
        tree.resolve_region().alias("region"))


@query("t11_classify_role", CORPUS + """SELECT page_id, 'interactive' AS class, n_a AS n FROM heads
    UNION ALL SELECT page_id, 'readable', n_a + 2 + n_p FROM heads
    UNION ALL SELECT page_id, 'structural', 3 FROM heads""")
def _(spark, d):
    ax = tree.derive_ax(dom_nodes(spark, d))
    return ax.groupBy(F.col("snapshot_id").alias("page_id"),
                      tree.classify_role("role").alias("class")).agg(F.count("*").alias("n"))


@query("t12_map_kind", CORPUS + "SELECT page_id, kind, count(*) AS n FROM els GROUP BY ALL")
def _(spark, d):
    return a.corpus_nodes(spark, d).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("t13_resolve_region", CORPUS + """SELECT page_id, region, count(*) AS n FROM els
    GROUP BY ALL""")
def _(spark, d):
    return a.corpus_nodes(spark, d).groupBy("page_id", F.col("where.region").alias("region")).agg(
        F.count("*").alias("n"))


@query("t14_resolve_grouping", CORPUS + """SELECT page_id, grp, count(*) AS n FROM els
    GROUP BY ALL""")
def _(spark, d):
    return a.corpus_nodes(spark, d).groupBy("page_id", F.col("where.group_id").alias("grp")).agg(
        F.count("*").alias("n"))


@query("t15_group_id", """SELECT p_partkey AS page_id, label, grp, path FROM (
    SELECT p_partkey, 'Go' AS label, 'form-order-' || replace(lower(p_brand), '#', '') AS grp,
      'Order ' || p_brand AS path FROM part
    UNION ALL SELECT p_partkey, 'Two', 'list-steps', 'Steps' FROM part
    UNION ALL SELECT p_partkey, 'Details', NULL, NULL FROM part)""")
def _(spark, d):
    return a.product_nodes(spark, d).filter(F.col("label").isin("Go", "Two", "Details")).select(
        F.col("snapshot_id").alias("page_id"), "label", F.col("where.group_id").alias("grp"),
        F.array_join("where.group_path", "/").alias("path"))


@query("t16_resolve_label", """SELECT p_partkey AS page_id, source, label FROM (
    SELECT p_partkey, 'ax-name' AS source, 'Quantity ' || p_size AS label FROM part
    UNION ALL SELECT p_partkey, 'placeholder', 'Secret code' FROM part
    UNION ALL SELECT p_partkey, 'ax-name', 'Gift wrap' FROM part
    UNION ALL SELECT p_partkey, 'title', 'Mail ' || p_size FROM part
    UNION ALL SELECT p_partkey, 'value', 'Buy ' || p_name FROM part
    UNION ALL SELECT p_partkey, 'name', 'color' FROM part
    UNION ALL SELECT p_partkey, 'labelledby', 'First ' || p_size || ' Second' FROM part
    UNION ALL SELECT p_partkey, 'test-id', 'note-' || p_partkey FROM part
    UNION ALL SELECT p_partkey, 'ax-name', 'Go' FROM part
    UNION ALL SELECT p_partkey, 'ax-name', 'Inside' FROM part)""")
def _(spark, d):
    kinds = ["input", "checkbox", "combobox", "slider", "textarea", "button"]
    nodes = a.product_nodes(spark, d).filter(
        F.col("kind").isin(kinds) | (F.col("label_source") == "test-id"))
    return nodes.filter("kind IN ('input','checkbox','combobox','slider','textarea','button')"
                        ).select(F.col("snapshot_id").alias("page_id"),
                                 F.col("label_source").alias("source"), "label")


@query("t16_labelledby", """SELECT p_partkey AS page_id, 'First ' || p_size || ' Second' AS text
    FROM part""")
def _(spark, d):
    dom = a.product_dom(spark, d, texts=False, columns=(  # text and comments carry no attributes
        "id", "attributes", "node_value", "frame_path", "shadow_path", "pre"))
    return tree.labelledby(dom).select(
        F.col("snapshot_id").alias("page_id"), F.col("labelledby").alias("text"))


@query("t17_live_label_fallback", """SELECT p_partkey AS page_id, 'Low stock ' || p_size AS label
    FROM part UNION ALL SELECT p_partkey, 'Saved ' || p_size FROM part""")
def _(spark, d):
    return a.product_nodes(spark, d).filter("kind = 'alert'").select(
        F.col("snapshot_id").alias("page_id"), "label")


@query("t18_synthesize_options", """SELECT p_partkey AS page_id, 'Red' AS label, true AS selected,
    true AS enabled FROM part UNION ALL SELECT p_partkey, 'Blue', NULL, false FROM part""")
def _(spark, d):
    # Drop the options from the derived tree, as a browser does for a closed select.
    el = tree.with_derived_ax(a.product_dom(spark, d))
    el = el.withColumn("ax_role", F.when(F.col("tag") != "OPTION", F.col("ax_role")))
    el = tree.synthesize(tree.join_dom_ax(el)).filter("made = 'option'")
    prop = lambda n: F.try_element_at("ax_props", F.lit(n))
    return el.select(F.col("snapshot_id").alias("page_id"), F.col("ax_name").alias("label"),
                     (prop("selected") == "true").alias("selected"),
                     prop("disabled").isNull().alias("enabled"))


@query("t19_synthesize_canvas", """SELECT p_partkey AS page_id, 'canvas' AS kind, 'Chart' AS label
    FROM part""")
def _(spark, d):
    return a.product_nodes(spark, d).filter("kind = 'canvas'").select(
        F.col("snapshot_id").alias("page_id"), "kind", "label")


@query("t20_promote_toasts", """SELECT p_partkey AS page_id, 'alert' AS role, 'Saved ' || p_size
    AS text FROM part""")
def _(spark, d):
    el = tree.synthesize(tree.join_dom_ax(tree.with_derived_ax(a.product_dom(spark, d))))
    return el.filter("made = 'toast'").select(
        F.col("snapshot_id").alias("page_id"), F.col("ax_role").alias("role"),
        tree.near_text(3).alias("text"))


def _signal_tables(spark, d):
    """Listener and style rows for a third of the pages each: clicks on the form and on the image,
    a pointer cursor on the alert. Few nodes carry one, so they are looked up once and kept."""
    size = a.products(spark, d).select(F.col("page_id").alias("snapshot_id"), "p_size")
    dom = a.product_dom(spark, d, texts=False, columns=("id", "node_name", "attributes"))
    alert = tree.attr("role") == "alert"
    rows = a.materialize(dom.filter(F.col("node_name").isin("FORM", "IMG") | alert).join(size, "snapshot_id").select(
        "snapshot_id", "id", "node_name", alert.alias("alert"), "p_size")).hint("merge")
    listeners = rows.filter(
        ((F.col("node_name") == "FORM") & (F.col("p_size") % 3 == 0))
        | ((F.col("node_name") == "IMG") & (F.col("p_size") % 3 == 1))).select(
        "snapshot_id", "id", F.lit("mousedown").alias("type"))
    styles = rows.filter(F.col("alert") & (F.col("p_size") % 3 == 2)).select(
        "snapshot_id", "id", F.lit("pointer").alias("cursor"))
    return listeners, styles


@query("t21_interactivity_signals", """SELECT p_partkey AS page_id, tag, tab, pointer, source
    FROM (SELECT p_partkey, 'IMG' AS tag, false AS tab, false AS pointer,
      CASE WHEN p_size % 3 = 1 THEN 'self' ELSE 'none' END AS source FROM part
    UNION ALL SELECT p_partkey, 'LABEL', false, false,
      CASE WHEN p_size % 3 = 0 THEN 'ancestor' ELSE 'none' END FROM part
    UNION ALL SELECT p_partkey, 'DIV', false, p_size % 3 = 2, 'none' FROM part)""")
def _(spark, d):
    el = tree.with_derived_ax(a.product_dom(spark, d, columns=(
        "id", "node_name", "node_type", "attributes", "pre", "near_text", "label_text", "in_hidden", "ancestor_ids")))
    listeners, styles = _signal_tables(spark, d)
    out = tree.interactivity_signals(el, listeners, styles)
    return out.filter(F.col("tag").isin("IMG", "LABEL") | (tree.attr("role") == "alert")).select(
        F.col("snapshot_id").alias("page_id"), "tag", F.col("has_tabindex").alias("tab"),
        F.col("has_cursor_pointer").alias("pointer"), F.col("listener_source").alias("source"))


@query("t22_implicit_candidates", """SELECT p_partkey AS page_id, 'generic' AS kind,
    'card' AS label FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'image', 'Photo of ' || p_name FROM part WHERE p_size % 3 = 1
    UNION ALL SELECT p_partkey, 'alert', 'Low stock ' || p_size FROM part WHERE p_size % 3 = 2
    UNION ALL SELECT p_partkey, 'form', 'Order ' || p_brand FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'generic', 'label' FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'generic', 'optgroup' FROM part WHERE p_size % 3 = 0""")
def _(spark, d):
    dom = a.product_dom(spark, d, texts=False, columns=(*ELEMENT_COLUMNS, "ancestor_ids"))
    listeners, styles = _signal_tables(spark, d)
    layouts = styles.select(
        "snapshot_id", "id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(9).alias("w"),
        F.lit(9).alias("h"), "cursor")
    nodes = compile_elements(dom, listeners=listeners, layouts=layouts, internals=True,
                             max_candidates=rules.IMPLICIT_CANDIDATES)
    label = F.when(F.col("label") != "", F.col("label")).otherwise(F.lower("tag"))
    return nodes.filter("implicitly_interactive").select(
        F.col("snapshot_id").alias("page_id"), "kind", label.alias("label"))


@query("t23_overlay_budget", f"""WITH v AS (SELECT *, coalesce(z_index > 100, false) AS o FROM
    ({a.BOXES})), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, o ORDER BY node_id)
    AS k, count(*) OVER (PARTITION BY snapshot_id) AS n, count(CASE WHEN o THEN 1 END) OVER
    (PARTITION BY snapshot_id) AS m FROM v) SELECT snapshot_id, node_id FROM r WHERE n <= 40 OR
    CASE WHEN o THEN k <= least(m, 12) ELSE k <= 40 - least(m, 12) END""")
def _(spark, d):
    rows = a.box_nodes(spark, d).withColumn("z_index", F.col("layout.z_index"))
    return tree.overlay_budget(rows, 40, order="doc_order").select(
        "snapshot_id", F.col("doc_order").alias("node_id"))


@query("t24_extract_state", """SELECT p_partkey AS page_id, tag_name, enabled, checked, required,
    invalid FROM (SELECT p_partkey, 'qty' AS tag_name,
      NOT (p_size % 3 = 0) OR p_size % 5 = 0 AS enabled, NULL AS checked,
      CASE WHEN p_size % 2 = 0 THEN true END AS required, NULL::BOOLEAN AS invalid FROM part
    UNION ALL SELECT p_partkey, 'gift', true, CASE WHEN p_size % 4 = 0 THEN 'true' ELSE 'false' END,
      NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'mail', true, NULL, NULL, p_size % 2 = 1 FROM part)""")
def _(spark, d):
    nodes = a.product_nodes(spark, d)
    name = F.coalesce("attributes.name", F.when(F.col("attributes.autocomplete") == "email",
                                                "mail"))
    return nodes.withColumn("tag_name", name).filter(
        F.col("tag_name").isin("qty", "gift", "mail")).select(
        F.col("snapshot_id").alias("page_id"), "tag_name", "state.enabled", "state.checked",
        "state.required", "state.invalid")


@query("t25_visibility", """SELECT p_partkey AS node_id, NOT (p_size % 7 = 0 OR p_size % 5 = 0
    OR p_size % 6 = 0 OR p_size % 11 = 0) AS visible FROM part""")
def _(spark, d):
    s = F.col("p_size")
    return a.table(spark, d, "part").select(
        F.col("p_partkey").alias("node_id"), tree.visibility(
            F.when(s % 7 == 0, 0.0).otherwise(10.0), F.lit(5.0),
            F.when(s % 5 == 0, "none").otherwise("block"),
            F.when(s % 6 == 0, "collapse").otherwise("visible"),
            F.when(s % 11 == 0, "inset(100%)")).alias("visible"))


@query("t26_screen_zone", f"""SELECT node_id, CASE WHEN y >= 720 THEN 'below-fold' ELSE
    CASE WHEN y + h / 2.0 < 240 THEN 'top' WHEN y + h / 2.0 < 480 THEN 'middle' ELSE 'bottom' END
    || '-' || CASE WHEN x + w / 2.0 < 1280 / 3.0 THEN 'left' WHEN x + w / 2.0 < 1280 / 3.0 * 2
    THEN 'center' ELSE 'right' END END AS zone FROM ({a.BOXES})""")
def _(spark, d):
    return a.box_nodes(spark, d).select(
        F.col("doc_order").alias("node_id"),
        tree.screen_zone("layout.bbox", 1280, 720).alias("zone"))


@query("t27_extract_attributes", """SELECT p_partkey AS page_id, kind, a, b FROM (
    SELECT p_partkey, 'slider' AS kind, p_size::VARCHAR AS a, 'qty' AS b FROM part
    UNION ALL SELECT p_partkey, 'input', '[REDACTED]', 'pw' FROM part
    UNION ALL SELECT p_partkey, 'image', 'Photo of ' || p_name,
      'img.example/' || p_partkey || '.png' FROM part
    UNION ALL SELECT p_partkey, 'link', 'https://shop.example/p/' || p_partkey || '?page=2',
      NULL FROM part
    UNION ALL SELECT p_partkey, 'form', '/buy', 'post' FROM part
    UNION ALL SELECT p_partkey, 'heading', '1', NULL FROM part
    UNION ALL SELECT p_partkey, 'input', NULL, 'note-' || p_partkey FROM part)""")
def _(spark, d):
    at = lambda f: F.col(f"attributes.{f}")
    first = F.coalesce(at("href"), at("action"), at("alt"), at("heading_level").cast("string"),
                       at("value"))
    second = F.coalesce(at("src"), at("method"), at("test_id"), F.when(
        F.col("kind") != "form", at("name")))
    nodes = a.product_nodes(spark, d)
    pick = (
        (at("name").isin("qty", "pw")) | (F.col("kind").isin("image", "form"))
        | F.contains(at("href"), F.lit("shop.example")) | (at("heading_level") == 1)
        | F.startswith(at("test_id"), F.lit("note-")))
    return nodes.filter(pick).select(F.col("snapshot_id").alias("page_id"), "kind",
                                     first.alias("a"), second.alias("b"))


@query("t28_locator_table", CORPUS + """SELECT page_id, locator, count(*) AS n, count(*) AS matches
    FROM (SELECT page_id, CASE WHEN label = '' THEN 'role=' || r ELSE 'role=' || r || '[name="' ||
    replace(replace(full_label, '\\', '\\\\'), '"', '\\"') || '"]' END AS locator FROM (SELECT *,
    CASE kind WHEN 'link' THEN 'link' ELSE kind END AS r,
    CASE WHEN kind = 'heading' THEN heading ELSE label END AS full_label FROM els)
    WHERE length(full_label) <= 200) GROUP BY page_id, locator""".replace("\\\\", "\\"))
def _(spark, d):
    nodes = a.corpus_nodes(spark, d)
    # Names longer than a locator may be fall back to the bare role; they are left out here.
    rows = tree.locator_table(nodes.filter("NOT (kind = 'heading' AND find.primary = "
                                           "'role=heading')"))
    return rows.groupBy(F.col("snapshot_id").alias("page_id"), "locator").agg(
        F.count("*").alias("n"), F.max("matches").alias("matches"))


@query("t28_build_locators", """SELECT p_partkey AS page_id, kind, loc FROM (
    SELECT p_partkey, 'slider' AS kind,
      'role=spinbutton[name="Quantity ' || p_size || '"] | #qty | [name="qty"]' AS loc FROM part
    UNION ALL SELECT p_partkey, 'input', '[data-testid="note-' || p_partkey || '"]' FROM part
    UNION ALL SELECT p_partkey, 'link', 'role=link[name="Details"] | a.container' FROM part
    UNION ALL SELECT p_partkey, 'form', 'role=form[name="Order ' || p_brand || '"] | #order | ' ||
      '[aria-label="Order ' || p_brand || '"]' FROM part)""")
def _(spark, d):
    loc = F.array_join(F.concat(F.array("find.primary"), F.coalesce(
        "find.alternates", F.array().cast("array<string>"))), " | ")
    return a.product_nodes(spark, d).filter(
        "kind IN ('slider', 'form') OR label = 'Details' OR label LIKE 'note-%'").select(
        F.col("snapshot_id").alias("page_id"), "kind", loc.alias("loc"))


@query("t30_drop_hidden", """SELECT p_partkey AS page_id, 15 + (p_size % 2 = 0)::INT AS kept, 2 AS options FROM part""")
def _(spark, d):
    # A layout that hides every option and the submit button's row: options stay, others go.
    dom = a.product_dom(spark, d, texts=False, columns=ELEMENT_COLUMNS)
    layouts = a.product_dom(spark, d, texts=False, columns=("id", "node_name")).filter("node_name IN ('OPTION', 'INPUT')").select(
        "snapshot_id", "id", *[F.lit(0).alias(c) for c in "xywh"])
    nodes = compile_elements(dom, layouts=layouts, internals=True)
    return nodes.filter("kind NOT IN ('paragraph', 'listitem')").groupBy(
        F.col("snapshot_id").alias("page_id")).agg(
        F.count_if(F.col("tag") != "OPTION").alias("kept"),
        F.count_if(F.col("tag") == "OPTION").alias("options"))


@query("t31_filter_noise", """SELECT p_partkey AS page_id, 'list' AS kind, 'Steps' AS label
    FROM part UNION ALL SELECT p_partkey, 'listitem', 'One' FROM part
    UNION ALL SELECT p_partkey, 'listitem', 'Two' FROM part""")
def _(spark, d):
    return a.product_nodes(spark, d).filter("kind IN ('list', 'listitem')").select(
        F.col("snapshot_id").alias("page_id"), "kind", "label")


@query("t31_filter_noise_text", """SELECT p_partkey AS snapshot_id, 'light' AS label FROM part
    UNION ALL SELECT p_partkey, p_name || ' plus' FROM part WHERE p_size % 2 = 0""")
def _(spark, d):
    # Text rows under the button: the same words as its label on odd sizes, more words on even.
    src = a.capture_json(spark, d)
    ax = ax_nodes(src, "ax_json").unionByName(src.select(
        "snapshot_id", F.lit(12).cast("bigint").alias("id"), F.lit("StaticText").alias("role"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" plus"))).otherwise(
            F.concat(F.lit(" "), F.upper("p_name"))).alias("name"),
        F.create_map().cast("map<string,string>").alias("properties"), F.lit(99).alias("ax_order")))
    nodes = compile_elements(flatten_dom_json(src, "dom_json"), ax)
    return nodes.filter("kind = 'text'").select("snapshot_id", "label")


@query("t32_snapshot_stats", CORPUS + """SELECT page_id, 2 * n_a + 2 + n_p AS node_count,
    n_a AS interactive_count FROM heads""")
def _(spark, d):
    stats = compile_captures(read_pages(spark, f"{d}/pages.parquet"), a.corpus_nodes(spark, d))
    return stats.select("page_id", "node_count", "interactive_count")


@query("t33_snapshot_health", CORPUS + """SELECT page_id, page_id % 4 <> 1 AS valid,
    CASE page_id % 4 WHEN 1 THEN 'empty' WHEN 2 THEN 'partial' END AS reason,
    CASE WHEN page_id % 4 <> 1 THEN 'HEALTHY' WHEN page_id % 8 = 1 THEN 'AX_EMPTY'
    ELSE 'PENDING_DOM' END AS code FROM heads""")
def _(spark, d):
    # Pages 1 mod 4 lost their nodes, pages 2 mod 4 their interactive elements.
    nodes = a.corpus_nodes(spark, d).filter("page_id % 4 <> 1").filter(
        "NOT (page_id % 4 = 2 AND kind = 'link')")
    stats = compile_captures(read_pages(spark, f"{d}/pages.parquet"), nodes)
    warn = F.when(F.col("page_id") % 8 == 1, F.array(F.lit("AX extraction failed")))
    return tree.snapshot_health(stats.withColumn("warnings", warn)).select(
        "page_id", "valid", "reason", "code")


@query("t34_compile", CORPUS + """SELECT page_id, rank::BIGINT AS rank, kind, label, href, region,
    grp, heading FROM els""")
def _(spark, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy("doc_order")).cast("bigint")
    return a.corpus_nodes(spark, d).select(
        "page_id", rank.alias("rank"), "kind", "label", F.col("attributes.href").alias("href"),
        F.col("where.region").alias("region"), F.col("where.group_id").alias("grp"),
        F.col("where.heading_context").alias("heading"))


@query("t34_compile_captured", """SELECT p_partkey AS snapshot_id, id, kind, label, enabled,
    focused, invalid, heading, loader, zone FROM (
    SELECT p_partkey, 11 AS id, 'button' AS kind, p_name AS label, p_size % 2 = 1 AS enabled,
      NULL AS focused, NULL AS invalid, NULL AS heading, 'L' || p_partkey AS loader,
      'top-left' AS zone FROM part
    UNION ALL SELECT p_partkey, 24, 'text', 'light', true, NULL, NULL, NULL, 'L' || p_partkey, NULL
      FROM part
    UNION ALL SELECT p_partkey, 22, 'input', 'n' || p_size, true, p_size % 3 = 0, true, NULL,
      'L' || p_partkey, NULL FROM part
    UNION ALL SELECT p_partkey, 32, 'heading', 'Frame ' || p_size, true, NULL, NULL,
      'Frame ' || p_size, CASE WHEN p_size % 2 = 0 THEN 'LX' ELSE '' END, NULL FROM part)""")
def _(spark, d):
    src = a.capture_json(spark, d)
    layouts = src.select("snapshot_id", F.lit(11).cast("bigint").alias("id"), F.lit(5).alias("x"),
                         F.lit(5).alias("y"), F.lit(50).alias("w"), F.lit(20).alias("h"))
    nodes = compile_elements(
        flatten_dom_json(src, "dom_json"), ax_nodes(src, "ax_json"), layouts=layouts,
        frames=frame_loaders(src, "frame_json").filter("error IS NULL").drop("error"))
    return nodes.select(
        "snapshot_id", F.col("backend_node_id").alias("id"), "kind", "label", "state.enabled",
        "state.focused", "state.invalid", F.col("where.heading_context").alias("heading"),
        F.col("loader_id").alias("loader"), F.col("layout.screen_zone").alias("zone"))


@query("t35_derive_ax", CORPUS + """SELECT page_id, role, name, count(*) AS n FROM (
    SELECT page_id, 'link' AS role, label AS name FROM links
    UNION ALL SELECT page_id, 'heading', h1 FROM heads) GROUP BY ALL""")
def _(spark, d):
    return tree.derive_ax(dom_nodes(spark, d)).filter("role IN ('link', 'heading')").groupBy(
        F.col("snapshot_id").alias("page_id"), "role", "name").agg(F.count("*").alias("n"))


@query("o9_live_region_ancestor", """SELECT p_partkey AS page_id, 'Low stock' AS text, 'DIV' AS tag
    FROM part UNION ALL SELECT p_partkey, p_size::VARCHAR, 'DIV' FROM part""")
def _(spark, d):
    live = observe.live_region_ancestor(a.product_dom(spark, d, columns=(
        "id", "node_name", "node_type", "attributes", "ancestor_ids")))
    dom = a.product_dom(spark, d, columns=("id", "node_name", "node_value"))
    texts = dom.select("snapshot_id", "id", F.trim("node_value").alias("text"))
    tags = dom.select("snapshot_id", F.col("id").alias("live_id"), F.col("node_name").alias("tag"))
    return live.join(texts, ["snapshot_id", "id"]).join(tags, ["snapshot_id", "live_id"]).select(
        F.col("snapshot_id").alias("page_id"), "text", "tag")


_PARTS = ("list_filter(list_transform(regexp_split_to_array(%s, '<[^>]*>'), lambda x: "
          "trim(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', "
          "'\"'), '&amp;', '&'), E' \\n\\t\\r')), lambda x: x <> '')")
_ART = "regexp_extract(c, '(?s)<article>(.*)</article>', 1)"
# Without enough text in the article the whole body counts, less navigation and footer.
_BODY = "regexp_extract(c, '(?s)</nav>(.*)<footer>', 1)"


@query("o12_clean_text", CORPUS + f"""SELECT page_id, array_to_string({_PARTS % _ART}, ' ')[1:100]
    AS text FROM base""")
def _(spark, d):
    dom = dom_nodes(spark, d)
    art = dom.filter("node_name = 'ARTICLE'").select("snapshot_id", "id")
    return tree.clean_text(dom, 100).join(art, ["snapshot_id", "id"]).select(
        F.col("snapshot_id").alias("page_id"), "text")


@query("r1_read_page", CORPUS + f"""SELECT page_id, {unescape("regexp_extract(c, '<title>([^<]*)</title>', 1)")}
    AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, md5(regexp_replace(CASE WHEN
    length(array_to_string({_PARTS % _ART}, '')) >= 100 THEN array_to_string({_PARTS % _ART}, ' ')
    WHEN length(array_to_string({_PARTS % _BODY}, '')) >= 100 THEN array_to_string(
    {_PARTS % _BODY}, ' ') END, '\\s+', ' ', 'g')) AS hash FROM base""")
def _(spark, d):
    pages = read_pages(spark, f"{d}/pages.parquet")
    out = content.read_page(pages, dom_nodes(spark, d))
    return out.select("page_id", "title", "lang",
                      F.md5(F.regexp_replace("text", r"\s+", " ")).alias("hash"))


# The corpus with an author, a site and a description; every second page says next to nothing.
@query("r1_read_page_meta", CORPUS + f"""SELECT page_id, 'Writer ' || page_id AS byline, 'About ' || page_id AS excerpt, 'Site ' ||
    page_id % 7 AS site_name, CASE WHEN page_id % 2 = 0 THEN 9 ELSE coalesce(length(regexp_replace(CASE WHEN
    length(array_to_string({_PARTS % _ART}, '')) >= 100 THEN array_to_string({_PARTS % _ART}, ' ')
    WHEN length(array_to_string({_PARTS % _BODY}, '')) >= 100 THEN array_to_string(
    {_PARTS % _BODY}, ' ') END, '\\s+', ' ', 'g')), 0) END::INT AS length, CASE WHEN page_id % 2 = 1 AND
    length(array_to_string({_PARTS % _BODY}, '')) < 100 THEN 'Could not extract readable content from this page.' END AS error
    FROM base""")
def _(spark, d):
    pages = read_pages(spark, f"{d}/pages.parquet")
    number = F.col("page_id").cast("string")
    head = F.concat(F.lit('<head><meta name="author" content="Writer '), number, F.lit('"><meta property="og:site_name" content="Site '),
                    (F.col("page_id") % 7).cast("string"), F.lit('"><meta name="description" content="About '), number, F.lit('">'))
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<html>"), head, F.lit("</head><body><p>Next to 0</p></body></html>"))).otherwise(
        F.replace("html", F.lit("<head>"), head))
    pages = pages.withColumn("html", html)
    long_, brief = pages.filter("page_id % 2 = 1"), pages.filter("page_id % 2 = 0")
    out = content.read_page(long_, html_to_dom(long_)).unionByName(content.read_page(brief, html_to_dom(brief), min_text=5))
    return out.select("page_id", "byline", "excerpt", "site_name", "length", "error")
