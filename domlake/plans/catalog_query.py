"""Queries for element search."""

from pyspark.sql import functions as F

from ..operators import identity, query as q
from . import adapters as a
from .catalog import query
from .catalog_pages import CORPUS
from .catalog_text import fuzzy_sql

BOX = f"WITH b AS (SELECT *, label AS p_name FROM ({a.BOXES}))\n"
NORM = (r"regexp_replace(regexp_replace(lower(trim(label)), '\([0-9]+\)', '(#)', 'g'), "
        r"' [0-9]+$', ' #')")


def caps_eid(layer: str = "'main'") -> str:
    return (f"substr(sha256(concat_ws('::', coalesce(role, kind), {NORM}, '', region || '/' || "
            f"region, {layer}, region, '')), 1, 12)")


# The capture view in document order, with ids; repeats within a capture are numbered.
CAPS = f"""WITH caps AS (SELECT *, page_id || '-' || step AS snapshot_id, row_number() OVER
    (PARTITION BY page_id, step ORDER BY kind, node_id) AS rank, {caps_eid()} AS base
    FROM ({a.CAPS})),
ids AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS eid FROM (SELECT *,
    row_number() OVER (PARTITION BY page_id, step, base ORDER BY rank) AS n FROM caps))
"""


@query("q1_filter_kind", CORPUS + """SELECT page_id, rank::BIGINT AS rank, label FROM els
    WHERE kind = 'link'""")
def _(spark, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy("doc_order")).cast("bigint")
    nodes = a.corpus_nodes(spark, d).withColumn("rank", rank)
    return q.filter_kind(nodes, "link").select("page_id", "rank", "label")


@query("q1_filter_kind_alias", BOX + """SELECT node_id, kind FROM b
    WHERE kind IN ('input', 'textarea')""")
def _(spark, d):
    return q.filter_kind(a.box_nodes(spark, d), q.expand_kind("textbox")).select(
        F.col("doc_order").alias("node_id"), "kind")


@query("q2_filter_label", CORPUS + """SELECT page_id, label, count(*) AS n FROM els
    WHERE kind = 'link' AND contains(lower(label), 'the') GROUP BY ALL""")
def _(spark, d):
    nodes = q.filter_label(q.filter_kind(a.corpus_nodes(spark, d), "link"), "the")
    return nodes.groupBy("page_id", "label").agg(F.count("*").alias("n"))


@query("q2_filter_label_exact", BOX + "SELECT node_id, label FROM b WHERE label = 'blue widget'")
def _(spark, d):
    return q.filter_label(a.box_nodes(spark, d), {"text": " Blue  WIDGET", "mode": "exact"}).select(
        F.col("doc_order").alias("node_id"), "label")


@query("q3_filter_label_fuzzy", BOX + f"""SELECT node_id, round({fuzzy_sql(['smal', 'widgett'])},
    6) AS score FROM b WHERE {fuzzy_sql(['smal', 'widgett'])} >= 0.5""")
def _(spark, d):
    nodes = q.filter_label_fuzzy(a.box_nodes(spark, d), {"text": "smal widgett", "mode": "fuzzy"})
    return nodes.select(F.col("doc_order").alias("node_id"),
                        F.round("label_score", 6).alias("score"))


@query("q4_filter_region", BOX + """SELECT node_id, region FROM b
    WHERE region IN ('nav', 'dialog')""")
def _(spark, d):
    return q.filter_region(a.box_nodes(spark, d), ["nav", "dialog"]).select(
        F.col("doc_order").alias("node_id"), F.col("where.region").alias("region"))


@query("q5_filter_state", CAPS + """SELECT page_id, step, node_id FROM caps
    WHERE visible AND NOT enabled""")
def _(spark, d):
    # focused is missing everywhere and counts as false.
    return q.filter_state(a.capture_nodes(spark, d), {
        "visible": True, "enabled": False, "focused": False}).select("page_id", "step", "node_id")


@query("q6_filter_group", CORPUS + """SELECT page_id, count(*) AS n FROM els
    WHERE grp = 'list-13' GROUP BY page_id""")
def _(spark, d):
    return q.filter_group(a.corpus_nodes(spark, d), "list-13").groupBy("page_id").agg(
        F.count("*").alias("n"))


@query("q7_filter_heading", """SELECT p_partkey AS page_id, kind, label FROM part, (VALUES
    ('heading', 'Related'), ('list', 'Steps'), ('listitem', 'One'), ('listitem', 'Two'),
    ('button', 'Inside'), ('paragraph', '')) v(kind, label)""")
def _(spark, d):
    return q.filter_heading(a.product_nodes(spark, d), "Related").select(
        F.col("snapshot_id").alias("page_id"), "kind", "label")


REQUEST = {"kind": ["link", "button"], "region": "main",
           "label": {"text": "smal widgett", "mode": "fuzzy"},
           "state": {"visible": True, "enabled": True}}
_FZ = fuzzy_sql(["smal", "widgett"])
SCORED = BOX + f""", s AS (SELECT *, least(1.0, (0.25 * {_FZ} + 0.15 + 0.12 + 0.06 + 0.02) / 0.6)
    AS rel FROM b WHERE kind IN ('link', 'button') AND region = 'main' AND {_FZ} >= 0.5)
"""


@query("q8_score_match", SCORED + "SELECT node_id, round(rel, 6) AS relevance FROM s")
def _(spark, d):
    return q.candidates(a.box_nodes(spark, d), REQUEST).select(
        F.col("doc_order").alias("node_id"), F.round("relevance", 6).alias("relevance"))


@query("q9_match_reasons", SCORED + f"""SELECT node_id, type, round(c, 6) AS contribution,
    description FROM (SELECT node_id, 'label' AS type, 0.25 * {_FZ} AS c,
      'Label "' || label || '" matches query' AS description FROM s
    UNION ALL SELECT node_id, 'kind', 0.15, 'Kind "' || kind || '" matches filter' FROM s
    UNION ALL SELECT node_id, 'region', 0.12, 'Region "main" matches filter' FROM s
    UNION ALL SELECT node_id, 'state', 0.06, 'States match: visible, enabled' FROM s)""")
def _(spark, d):
    return q.candidates(a.box_nodes(spark, d), REQUEST).select(
        F.col("doc_order").alias("node_id"), F.inline("match_reasons")).select(
        "node_id", "type", F.round("contribution", 6).alias("contribution"), "description")


@query("q10_min_score", SCORED + "SELECT node_id FROM s WHERE rel >= 0.9")
def _(spark, d):
    return q.candidates(a.box_nodes(spark, d), {**REQUEST, "min_score": 0.9}).select(
        F.col("doc_order").alias("node_id"))


@query("q11_sort_by_relevance", SCORED + """SELECT snapshot_id, node_id, row_number() OVER
    (PARTITION BY snapshot_id ORDER BY rel DESC, node_id) AS match_rank FROM s
    QUALIFY match_rank <= 10""")
def _(spark, d):
    return q.find(a.box_nodes(spark, d), {**REQUEST, "sort_by_relevance": True}).select(
        "snapshot_id", F.col("doc_order").alias("node_id"), "match_rank")


@query("q12_limit", BOX + """SELECT snapshot_id, node_id, row_number() OVER (PARTITION BY
    snapshot_id ORDER BY node_id) AS match_rank, count(*) OVER (PARTITION BY snapshot_id)
    AS total_matched, nodes_evaluated FROM b JOIN (SELECT snapshot_id, count(*) AS nodes_evaluated
    FROM b GROUP BY snapshot_id) USING (snapshot_id) WHERE kind = 'link'
    QUALIFY match_rank <= 3""")
def _(spark, d):
    nodes = a.box_nodes(spark, d)
    hits = q.find(nodes, {"kind": "link", "limit": 3})
    return hits.join(q.nodes_evaluated(nodes), "snapshot_id").select(
        "snapshot_id", F.col("doc_order").alias("node_id"), "match_rank", "total_matched",
        "nodes_evaluated")


@query("q13_suggest_refinements", CAPS + """, m AS (SELECT *, count(*) OVER (PARTITION BY
    page_id, step) AS shown FROM caps WHERE rank <= 10), f AS (
    SELECT snapshot_id, shown, rank, 'refine_kind' AS type, kind AS value, 0 AS o FROM m
    UNION ALL SELECT snapshot_id, shown, rank, 'refine_region', region, 1 FROM m
    UNION ALL SELECT snapshot_id, shown, rank, 'add_state', 'enabled', 3 FROM m WHERE enabled
    UNION ALL SELECT snapshot_id, shown, rank, 'add_state', 'visible', 4 FROM m WHERE visible)
    SELECT snapshot_id, type, value, n AS expected_matches, r AS suggestion_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY n, o, first) AS r FROM (
    SELECT snapshot_id, shown, type, value, o, count(*) AS n, min(rank) AS first FROM f
    GROUP BY ALL) WHERE n < shown) WHERE r <= 5""")
def _(spark, d):
    hits = q.find(a.capture_nodes(spark, d), {"limit": 10})
    return q.suggest_refinements(hits, {}).select(
        "snapshot_id", "type", "value", "expected_matches", "suggestion_rank")


@query("q14_get_by_id", CAPS + "SELECT page_id, step, label FROM caps WHERE node_id = 'click-3'")
def _(spark, d):
    return q.get_by_id(a.capture_nodes(spark, d), "click-3").select("page_id", "step", "label")


@query("q14_snapshot_info", BOX + """SELECT snapshot_id, count(*) AS node_count FROM b
    GROUP BY snapshot_id""")
def _(spark, d):
    return q.snapshot_info(a.box_nodes(spark, d))


@query("q14_all_nodes", BOX + """SELECT snapshot_id, node_id FROM b QUALIFY row_number() OVER
    (PARTITION BY snapshot_id ORDER BY node_id) <= 3""")
def _(spark, d):
    return q.all_nodes(a.box_nodes(spark, d), 3).select(
        "snapshot_id", F.col("doc_order").alias("node_id"))


@query("q15_find", CORPUS + """SELECT page_id, label, href, count(*) OVER (PARTITION BY page_id)
    AS total_matched, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS match_rank,
    round((0.3 + 0.15 + 0.12 + 0.02) / 0.59, 6) AS relevance FROM els WHERE kind = 'link'
    AND region = 'nav' AND contains(lower(label), 'the') QUALIFY match_rank <= 10""")
def _(spark, d):
    hits = q.find(a.corpus_nodes(spark, d), {
        "kind": "link", "region": "nav", "label": "the", "sort_by_relevance": True, "limit": 10})
    return hits.select("page_id", "label", F.col("attributes.href").alias("href"),
                       "total_matched", "match_rank", F.round("relevance", 6).alias("relevance"))


MANY = [
    {"kind": "link", "limit": 2},
    {"label": "widget", "region": ["nav", "main"], "limit": 4},
    {**REQUEST, "sort_by_relevance": True, "limit": 3},
    {"kind": "heading", "label": {"text": "cold rod", "mode": "exact"}},
]


@query("q16_find_many", BOX + f""", h AS (
    SELECT 0 AS request_id, 2 AS k, snapshot_id, node_id, 1.0 AS rel, 0.0 AS o FROM b
      WHERE kind = 'link'
    UNION ALL SELECT 1, 4, snapshot_id, node_id, 1.0, 0.0 FROM b WHERE contains(label, 'widget')
      AND region IN ('nav', 'main')
    UNION ALL SELECT 2, 3, snapshot_id, node_id, rel, rel FROM (SELECT *, least(1.0,
      (0.25 * {_FZ} + 0.15 + 0.12 + 0.06 + 0.02) / 0.6) AS rel FROM b WHERE kind IN ('link',
      'button') AND region = 'main' AND {_FZ} >= 0.5)
    UNION ALL SELECT 3, 10, snapshot_id, node_id, 1.0, 0.0 FROM b WHERE kind = 'heading' AND
      label = 'cold rod')
    SELECT request_id, snapshot_id, node_id, round(rel, 6) AS relevance, row_number() OVER
    (PARTITION BY snapshot_id, request_id ORDER BY o DESC, node_id) AS match_rank, count(*) OVER
    (PARTITION BY snapshot_id, request_id) AS total_matched FROM h QUALIFY match_rank <= k""")
def _(spark, d):
    return q.find_many(a.box_nodes(spark, d), MANY).select(
        "request_id", "snapshot_id", F.col("doc_order").alias("node_id"),
        F.round("relevance", 6).alias("relevance"), "match_rank", "total_matched")


# One request for each word of the labels: links and buttons of the main part with the word, and all that is like it.
WORDS = """, words AS (SELECT DISTINCT unnest(string_split(label, ' ')) AS word FROM b), rq AS (SELECT
    ('0x' || substr(md5(word), 1, 8))::BIGINT AS request_id, word FROM words WHERE length(word) > 2)"""


@query("q16_find_table", BOX + WORDS + f""", h AS (
    SELECT request_id * 2 AS request_id, 3 AS k, snapshot_id, node_id, 1.0::DOUBLE AS rel, 0.0 AS o FROM b, rq
      WHERE contains(label, word) AND kind IN ('link', 'button') AND region = 'main'
    UNION ALL SELECT request_id * 2 + 1, 5, snapshot_id, node_id, rel, rel FROM (SELECT *, least(1.0, (0.25 * qual + 0.02) /
      (0.25 + 0.02)) AS rel FROM (SELECT *, list_max(list_transform(list_filter(string_split(label, ' '), lambda y: length(y) > 2), lambda t: CASE WHEN t = word THEN 1.0
      WHEN starts_with(t, word) THEN 0.9 WHEN starts_with(word, t) THEN 0.85 WHEN 1 - levenshtein(t, word)::DOUBLE / greatest(length(t),
      length(word)) >= 0.8 THEN 1 - levenshtein(t, word)::DOUBLE / greatest(length(t), length(word)) ELSE 0.0 END)) AS qual FROM b, rq)
      WHERE qual >= 0.85))
    SELECT request_id, snapshot_id, node_id, round(rel, 6) AS relevance, row_number() OVER (PARTITION BY snapshot_id, request_id
    ORDER BY o DESC, node_id) AS match_rank, count(*) OVER (PARTITION BY snapshot_id, request_id) AS total_matched FROM h
    QUALIFY match_rank <= k""")
def _(spark, d):
    nodes = a.box_nodes(spark, d)
    words = nodes.select(F.explode(F.split("label", " ")).alias("text")).distinct().filter("length(text) > 2")
    number = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint") * 2
    plain = words.select(number.alias("request_id"), "text", F.array(F.lit("link"), F.lit("button")).alias("kinds"),
                         F.array(F.lit("main")).alias("regions"), F.lit(3).alias("k"))
    like = words.select((number + 1).alias("request_id"), "text", F.lit("fuzzy").alias("mode"), F.lit(0.85).alias("overlap"),
                        F.lit(True).alias("by_relevance"), F.lit(5).alias("k"))
    requests = q.complete_requests(plain.unionByName(like, allowMissingColumns=True))
    return q.find_many(nodes, requests).select(
        "request_id", "snapshot_id", F.col("doc_order").alias("node_id"), F.round("relevance", 6).alias("relevance"),
        "match_rank", "total_matched")


@query("q17_find_rows", CAPS + f"""SELECT snapshot_id, node_id, kind, label, region, value, CASE
    WHEN kind = 'alert' THEN 'rd-' || substr(base, 1, 10) ELSE e.eid END AS eid FROM caps LEFT JOIN
    (SELECT snapshot_id AS s, rank AS r, eid FROM (SELECT *, CASE WHEN n = 1 THEN base ELSE base ||
    '-' || n END AS eid FROM (SELECT *, row_number() OVER (PARTITION BY page_id, step, base ORDER BY
    rank) AS n FROM caps WHERE kind <> 'alert'))) e ON s = snapshot_id AND r = rank""")
def _(spark, d):
    nodes = a.capture_nodes(spark, d)
    # Only interactive elements are registered here, so that live ones take a content id.
    registry = identity.with_eids(nodes.filter("kind <> 'alert'"), F.lit("main"))
    return q.find_rows(nodes, registry).select("snapshot_id", "node_id", "kind", "label", "region",
                                               "value", "eid")


@query("q18_element_details", CAPS + """, last AS (SELECT page_id, eid, max(step) AS step,
    max_by(snapshot_id, step) AS snap FROM ids GROUP BY ALL), top AS (SELECT page_id,
    max(step) AS top FROM ids GROUP BY page_id)
    SELECT l.page_id, l.eid, CASE WHEN l.eid < '4' THEN 'missing' WHEN l.step < top THEN 'stale'
    ELSE 'current' END AS status, CASE WHEN l.eid >= '4' AND l.step = top THEN i.label END AS label
    FROM last l JOIN top USING (page_id) LEFT JOIN ids i ON i.snapshot_id = snap AND
    i.eid = l.eid""")
def _(spark, d):
    nodes = a.capture_nodes(spark, d)
    ids = identity.with_eids(nodes, F.lit("main"))
    newest = nodes.groupBy("page_id").agg(F.max_by("snapshot_id", "step").alias("snapshot_id"))
    registry = ids.groupBy("page_id", "eid").agg(F.max_by(F.struct(
        "snapshot_id", "backend_node_id"), "step").alias("r")).select("page_id", "eid", "r.*")
    current = nodes.join(newest.select("snapshot_id"), "snapshot_id", "left_semi")
    out = q.element_details(registry.select("page_id", "eid"), registry.filter("eid >= '4'"),
                            current)
    return out.select("page_id", "eid", "status", "label")


@query("q19_relink_stale", CAPS + """SELECT o.page_id, o.step + 1 AS step, o.node_id AS old_node_id,
    f.node_id AS new_node_id, (o.region = f.region)::INT AS score FROM caps o JOIN caps f ON
    f.page_id = o.page_id AND f.step = o.step + 1 AND f.label = o.label AND f.kind = o.kind
    QUALIFY row_number() OVER (PARTITION BY o.page_id, o.step, o.node_id ORDER BY
    (o.region = f.region)::INT DESC, abs(o.rank - f.rank), f.rank) = 1""")
def _(spark, d):
    nodes = a.capture_nodes(spark, d)
    old = nodes.withColumn("step", F.col("step") + 1)
    return q.relink_stale(old, nodes, ["page_id", "step"])
