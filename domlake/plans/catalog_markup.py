"""Queries over markup and changes that the shared tables alone do not show: locators, layer rules, changes in digests."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import layers, observe, render
from ..operators.diff import compute_diff
from ..schema import ELEMENT_COLUMNS, bbox, make_nodes
from ..sources.html import html_to_dom
from . import adapters as a
from .catalog import ORACLES, query
from .catalog_logs import OBS
from .compile import compile_elements

# -- locators -----------------------------------------------------------------------------------


def _scope(scopes: dict[str, str]) -> str:
    return "CASE layer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scopes.items()) + " ELSE '' END"


def _quoted(c: str) -> str:
    return f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"


# Names with quotes and backslashes, some longer than a locator shows, some blank; attributes that win over each other.
_NAMED = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '  ' WHEN 1 THEN p_name || ' "' || p_brand || '" \\ ' || p_type ||
    ' ' || p_name ELSE ' ' || p_name END AS label, CASE p_size % 4 WHEN 0 THEN 'modal' WHEN 1 THEN 'drawer' WHEN 2 THEN
    'popover' ELSE 'main' END AS layer, CASE WHEN p_size % 3 = 0 THEN 'switch' END AS role, CASE WHEN p_size % 7 = 0 THEN
    'id"' || p_partkey END AS test_id, CASE WHEN p_size % 2 = 0 THEN 'n' || p_size END AS name, CASE WHEN p_size % 11 <> 0
    THEN p_brand END AS aria_label FROM part"""
_CUT = "substr(trim(label), 1, 40)"


@query("t29_locators", f"""WITH v AS ({_NAMED}) SELECT p_partkey AS node_id, {_scope(rules.AX_SCOPES)} || 'role=' ||
    coalesce(role, 'button') || CASE WHEN {_CUT} = '' THEN '' ELSE '[name*="' || {_quoted(_CUT)} || '"]' END AS by_role,
    {_scope(rules.CSS_SCOPES)} || coalesce('[data-testid="' || {_quoted('test_id')} || '"]', '[name="' || {_quoted('name')} || '"]',
    '[aria-label*="' || {_quoted('aria_label')} || '"]') AS by_css FROM v""")
def _(spark, d):
    part = a.table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    label = F.when(size % 5 == 0, F.lit("  ")).when(size % 5 == 1, F.concat(
        "p_name", F.lit(' "'), "p_brand", F.lit('" \\ '), "p_type", F.lit(" "), "p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    extra = F.map_from_entries(F.array_compact(F.array(
        F.when(size % 7 == 0, F.struct(F.lit("data-testid").alias("k"), F.concat(F.lit('id"'), key.cast("string")).alias("v"))),
        F.when(size % 11 != 0, F.struct(F.lit("aria-label").alias("k"), F.col("p_brand").alias("v"))))))
    nodes = make_nodes(
        part, keys=["p_size"], node_id=key, kind=F.lit("button"), label=label, doc_order=key,
        attributes={"role": F.when(size % 3 == 0, "switch"), "extra": extra,
                    "name": F.when(size % 2 == 0, F.concat(F.lit("n"), size.cast("string")))})
    layer = F.get(F.array(*[F.lit(x) for x in ("modal", "drawer", "popover", "main")]), size % 4)
    return nodes.select(F.col("doc_order").alias("node_id"), layers.ax_locator(layer).alias("by_role"),
                        layers.css_locator(layer).alias("by_css"))


# -- layers -------------------------------------------------------------------------------------

# An element for each of the twelve rules: name, markup, layout (x, y, z), layer, confidence, and whether it needs its z. Landmarks
# are no elements of a compiled page, so the rules for them look at finished snapshots.
_OVERLAYS = [
    ("A1", '<div role="dialog" aria-modal="true"', (20, 20, 10), "modal", 1.0, False),
    ("A2", "<dialog open", (20, 20, 10), "modal", 0.95, False),
    ("A3", '<div role="alertdialog"', (20, 20, 10), "modal", 0.9, False),
    ("A4", '<div role="dialog"', (20, 20, 2000), "modal", 0.8, True),
    ("A5", '<div role="form" class="ReactModal"', (20, 20, 150), "modal", 0.75, True),
    ("A6", '<aside role="complementary"', (20, 20, 150), "drawer", 0.7, True),
    ("A7", '<nav role="navigation"', (0, 20, 150), "drawer", 0.75, True),
    ("A8", '<div role="form" class="ant-drawer"', (20, 20, 60), "drawer", 0.7, True),
    ("A9", '<div role="menu" tabindex="0"', (20, 20, 150), "popover", 0.8, True),
    ("A10", '<div role="dialog"', (20, 20, 150), "popover", 0.6, True),
    ("A11", '<div role="form" class="el-dropdown"', (20, 20, 150), "popover", 0.65, True),
    ("A12", '<div role="alert"', (20, 20, 150), "toast", 0.7, True),
]
_RULES = ", ".join(f"('{n}', '{t}', {c}::DOUBLE, {z}, {need})" for n, _, (_, _, z), t, c, need in _OVERLAYS)
_HTML = "".join(f'{m} id="{n}" aria-label="{n}"><button>Go {n}</button></{m[1:].split()[0]}>' for n, m, *_ in _OVERLAYS)


@query("l1_detect_layers_markup", f"""SELECT p_partkey AS page_id, name, type, confidence, CASE WHEN p_size % 2 = 1 THEN z ELSE 0
    END AS z FROM part, (VALUES {_RULES}) v(name, type, confidence, z, needs) WHERE p_size % 2 = 1 OR NOT needs""")
def _(spark, d):
    pages = a.table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), "p_size", F.concat(
        F.lit("<html><body>"), F.lit(_HTML), F.lit("</body></html>")).alias("html"))
    documents = a.spread(spark, d, pages.select("page_id", "html"), "page_id")
    dom = html_to_dom(documents, texts=False, columns=ELEMENT_COLUMNS)
    marked = html_to_dom(documents, columns=("id", "attributes"))
    place = F.create_map(*[x for n, _, (x, y, z), *_ in _OVERLAYS for x in (F.lit(n), F.struct(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")))])
    at = F.try_element_at(place, F.try_element_at("attributes", F.lit("id")))
    flat = (F.col("p_size") % 2 == 1).cast("int")
    layouts = marked.withColumn("at", at).filter("at IS NOT NULL").join(
        pages.select(F.col("page_id").alias("snapshot_id"), "p_size"), "snapshot_id").select(
        "snapshot_id", "id", "at.x", "at.y", F.lit(90).alias("w"), F.lit(40).alias("h"), F.lit("block").alias("display"),
        F.lit("visible").alias("visibility"), F.lit(None).cast("string").alias("clip_path"), (F.col("at.z") * flat).alias("z_index"))
    nodes = compile_elements(dom, layouts=layouts, include_hidden=True)
    marks = pages.select(F.col("page_id").alias("snapshot_id"), flat.alias("flat"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(m.split('"')[1]).alias("role"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
        for n, m, (x, y, z), *_ in _OVERLAYS if n in ("A6", "A7")]))).withColumns({"w": F.lit(90), "h": F.lit(40)})
    nodes = nodes.unionByName(make_nodes(
        marks, keys=["snapshot_id"], node_id=F.col("name"), kind=F.when(F.col("role") == "navigation", "navigation").otherwise("section"),
        label=F.col("name"), doc_order=F.lit(0), attributes={"role": F.col("role")},
        layout={"bbox": bbox("x", "y", "w", "h"), "z_index": F.col("z") * F.col("flat")}), allowMissingColumns=True)
    names = marked.select("snapshot_id", F.col("id").cast("string").alias("node_id"), F.try_element_at("attributes", F.lit("id")).alias("name"))
    found = layers.detect_layers(nodes, 0.5).join(names, ["snapshot_id", "node_id"], "left")
    return found.select(F.col("snapshot_id").alias("page_id"), F.coalesce("name", "node_id").alias("name"), "type", "confidence", "z")


# -- digests of changes -------------------------------------------------------------------------

def _changes_sql() -> str:
    esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""WITH dd AS ({ORACLES['d14_compute_diff']}), df AS (SELECT page_id, step, '  <diff type="mutation"' ||
    coalesce(' nav="' || max(CASE WHEN op = 'doc' THEN k END) || '"', '') || CASE WHEN count(*) FILTER (op = 'added') > 0 THEN
    ' added="' || count(*) FILTER (op = 'added') || '"' ELSE '' END || CASE WHEN count(*) FILTER (op = 'removed') > 0 THEN
    ' removed="' || count(*) FILTER (op = 'removed') || '"' ELSE '' END || coalesce('>' || chr(10) || string_agg(line, '' ORDER BY op = 'status_appeared', eid, line)
    || '  </diff>' || chr(10), ' />' || chr(10)) AS t FROM (SELECT *, CASE op WHEN 'text_changed' THEN '    <text-changed id="' || eid ||
    '">' || {esc('"from"')} || ' → ' || {esc('"to"')} || '</text-changed>' || chr(10) WHEN 'status_appeared' THEN '    <status id="' ||
    eid || '" role="' || k || '">' || {esc('"to"')} || '</status>' || chr(10) END AS line FROM dd) GROUP BY ALL),
    ob AS (SELECT * FROM ({OBS} SELECT page_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS step, mut_id, CASE WHEN mut_id % 2 = 0
      THEN 'action' ELSE 'prior' END AS "when", CASE WHEN type = 'added' THEN 'appeared' ELSE 'disappeared' END AS change, tag, role,
      text, significance FROM o WHERE significance >= 4) QUALIFY row_number() OVER (PARTITION BY page_id, step, "when", tag, text
      ORDER BY significance DESC, mut_id) = 1),
    og AS (SELECT page_id, step, '  <observations>' || chr(10) || string_agg('    <' || change || ' when="' || "when" || '"' ||
      coalesce(' role="' || role || '"', '') || '>' || text || '</' || change || '>' || chr(10), '' ORDER BY "when" <> 'action', mut_id)
      || '  </observations>' || chr(10) AS t FROM ob GROUP BY page_id, step),
    st AS (SELECT DISTINCT user_id AS page_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS step FROM events)
    SELECT page_id, step, md5('<state step="' || step || '" title="Page ' || page_id || '" url="https://x.example/' || page_id ||
    '">' || chr(10) || '  <meta view="1280x720" scroll="0,0" layer="main" />' || chr(10) || coalesce(df.t,
    '  <diff type="mutation" />' || chr(10)) || coalesce(og.t, '') || '</state>') AS hash FROM st LEFT JOIN df USING (page_id, step)
    LEFT JOIN og USING (page_id, step)"""


@query("l15_render_changes", _changes_sql())
def _(spark, d):
    keys = ("page_id", "step")
    captures = a.captures(spark, d)
    obs = observe.observations(a.mutations(spark, d)).select(
        "page_id", F.floor((F.day("ts") - 1) / 5).cast("int").alias("step"), F.when(F.col("mut_id") % 2 == 0, "action")
        .otherwise("prior").alias("when"), F.col("change").alias("type"), "tag", "role", "text", "significance",
        F.col("mut_id").alias("obs_order"))
    heads = captures.select(*keys, "title", "url", F.lit("1280x720").alias("view"), F.lit("0,0").alias("scroll"),
                            F.lit("main").alias("layer"), F.lit("diff").alias("mode"))
    nothing = captures.select(*keys, F.lit("").alias("regions"))
    out = render.render_state(heads, nothing, render.render_diff(compute_diff(a.capture_nodes(spark, d), captures)),
                              render.render_observations(obs, keys), keys)
    return out.select(*keys, F.md5("digest").alias("hash"))
