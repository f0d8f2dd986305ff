"""Queries for the event logs: observations, network, quiet periods, session reports."""

from pyspark.sql import functions as F

from ..operators import logs, network, observe, render
from ..sources.feeds import mutation_source, network_source
from ..sources.session_log import tool_calls
from . import adapters as a
from .catalog import query
from .catalog_layers import DIGESTS, LINE, capture_digests
from .catalog_query import BOX, CAPS

HOUR = 3_600_000
QUIET, LIMIT = 1 * HOUR, 12 * HOUR

MUT = f"WITH m AS (SELECT * FROM ({a.MUT}))"
_SIGNALS = {
    "has_alert_role": "coalesce(role IN ('alert', 'status', 'log', 'alertdialog'), false)",
    "has_aria_live": "aria_live IS NOT NULL",
    "is_dialog": "coalesce(role = 'dialog', false) OR tag = 'dialog'",
    "is_fixed_or_sticky": "is_fixed",
    "has_high_z_index": "z_index > 1000",
    "covers_viewport": "width_pct > 50 OR height_pct > 30",
    "is_body_child": "is_body_child",
    "has_interactives": "has_interactives",
    "is_visible": "is_visible",
    "has_text": "length(text) >= 3",
}
_W = {"has_alert_role": 3, "has_aria_live": 3, "is_dialog": 3, "is_fixed_or_sticky": 2,
      "has_high_z_index": 1, "covers_viewport": 2, "is_body_child": 1, "has_interactives": 1,
      "is_visible": 2, "has_text": 1}
_SIG = " + ".join(f"{w} * (coalesce({_SIGNALS[k]}, false))::INT" for k, w in _W.items())
OBS = MUT + f", o AS (SELECT *, {_SIG} AS significance FROM m)"


@query("o1_mutation_signals", MUT + "SELECT mut_id, " + ", ".join(
    f"({v}) AS {k}" for k, v in _SIGNALS.items()) + " FROM m")
def _(spark, d):
    m = observe.mutation_signals(mutation_source(a.mutations(spark, d)))
    return m.select("mut_id", *[F.col(f"signals.{k}").alias(k) for k in _SIGNALS])


@query("o2_significance", OBS + """SELECT mut_id, significance, significance + CASE WHEN
    mut_id % 5 = 0 THEN 3 ELSE 0 END AS at_capture FROM o""")
def _(spark, d):
    m = observe.mutation_signals(a.mutations(spark, d))
    return m.select("mut_id", observe.significance().alias("significance"),
                    observe.significance(False, F.col("mut_id") % 5 == 0).alias("at_capture"))


@query("o3_filter_significant", OBS + """SELECT mut_id, significance >= 5 AS attach FROM o
    WHERE significance >= 4""")
def _(spark, d):
    return observe.observations(a.mutations(spark, d), 4).select(
        "mut_id", (F.col("significance") >= 5).alias("attach"))


# Actions are clicks; each is reported two hours after it started.
ACTS = """, act AS (SELECT user_id AS page_id, event_id AS action_id, ts AS start,
    ts + INTERVAL 2 HOUR AS fin FROM events WHERE event_type = 'click')"""


@query("o4_action_windows", OBS + ACTS + """, p AS (SELECT o.page_id, mut_id, o.ts, a.action_id,
    a.fin FROM o ASOF LEFT JOIN act a ON o.page_id = a.page_id AND o.ts >= a.start
    WHERE significance >= 4), n AS (SELECT p.*, b.action_id AS nid, b.fin AS nfin FROM p ASOF LEFT
    JOIN act b ON p.page_id = b.page_id AND p.ts < b.start)
    SELECT page_id, mut_id, CASE WHEN ts <= fin THEN 'during' WHEN nid IS NOT NULL THEN 'prior'
    ELSE 'open' END AS "window", CASE WHEN ts <= fin THEN action_id ELSE nid END AS action_id,
    CASE WHEN ts <= fin THEN NULL ELSE (epoch_us(nfin) - epoch_us(ts)) / 1000.0::DOUBLE END AS age_ms
    FROM n""")
def _(spark, d):
    obs = observe.observations(a.mutations(spark, d), 4)
    actions = a.click_actions(spark, d).withColumn("end_ts", F.expr("ts + INTERVAL 2 HOURS"))
    return observe.action_windows(obs, actions)


@query("o5_unreported", MUT + """, seen AS (SELECT page_id, max(mut_id) AS last FROM m WHERE ts <
    TIMESTAMP '2024-01-16 00:00:00' GROUP BY page_id) SELECT page_id, count(*) AS n, min(mut_id) AS
    first_id FROM m LEFT JOIN seen USING (page_id) WHERE mut_id > coalesce(last, -1)
    GROUP BY page_id""")
def _(spark, d):
    m = a.mutations(spark, d)
    seen = m.filter(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")).groupBy(
        "page_id").agg(F.max("mut_id").alias("last_mut_id"))
    return observe.unreported(m, seen).groupBy("page_id").agg(
        F.count("*").alias("n"), F.min("mut_id").alias("first_id"))


@query("o6_appeared_after_delay", MUT + """, l AS (SELECT *, min(ts) OVER (PARTITION BY page_id) AS
    loaded FROM m) SELECT mut_id, epoch_us(ts) - epoch_us(loaded) > 100000 AS late FROM l""")
def _(spark, d):
    m = a.mutations(spark, d)
    loaded = m.groupBy("page_id").agg(F.min("ts").alias("loaded"))
    return m.join(loaded, "page_id").select(
        "mut_id", observe.after_delay(F.col("ts"), F.col("loaded")).alias("late"))


@query("o7_short_lived", MUT + f""", l AS (SELECT *, lead(type) OVER w AS nt, lead(ts) OVER w AS nts,
    lag(type) OVER w AS pt, lag(ts) OVER w AS pts FROM m WINDOW w AS (PARTITION BY page_id, text
    ORDER BY ts, mut_id)) SELECT mut_id, coalesce(type = 'added' AND nt = 'removed' AND epoch_us(nts)
    - epoch_us(ts) < {24 * HOUR * 1000}, false) OR coalesce(type = 'removed' AND pt = 'added' AND
    epoch_us(ts) - epoch_us(pts) < {24 * HOUR * 1000}, false) AS short_lived FROM l""")
def _(spark, d):
    return observe.short_lived(a.mutations(spark, d), ["text"], 24 * HOUR).select("mut_id",
                                                                                  "short_lived")


@query("o8_debounce", MUT.replace("WITH", "WITH RECURSIVE") + f""", r AS (SELECT page_id,
    coalesce(role, '') AS role, mut_id, epoch_us(ts) AS t FROM m), cap AS (SELECT page_id, role,
    min(t) AS t FROM r GROUP BY page_id, role UNION ALL SELECT cap.page_id, cap.role, min(r.t) FROM
    cap JOIN r ON r.page_id = cap.page_id AND r.role = cap.role AND r.t >= cap.t +
    {12 * HOUR * 1000} GROUP BY cap.page_id, cap.role) SELECT r.page_id, r.role, mut_id,
    cap.t IS NOT NULL AS captured FROM r LEFT JOIN cap USING (page_id, role, t)""")
def _(spark, d):
    m = a.mutations(spark, d).withColumn("role", F.coalesce("role", F.lit("")))
    return observe.debounce(m, ["role"], 12 * HOUR)


@query("o10_fifo_cap", MUT + """SELECT page_id, mut_id, row_number() OVER (PARTITION BY page_id ORDER
    BY ts DESC, mut_id DESC) AS age_rank FROM m QUALIFY age_rank <= 20""")
def _(spark, d):
    return observe.fifo_cap(a.mutations(spark, d), 20).select("page_id", "mut_id", "age_rank")


@query("o11_dedup_observations", OBS + """SELECT page_id, mut_id, tag, text, significance FROM o
    WHERE significance >= 4 QUALIFY row_number() OVER (PARTITION BY page_id, tag, text ORDER BY
    significance DESC, mut_id) = 1""")
def _(spark, d):
    obs = observe.observations(a.mutations(spark, d), 4).select(
        "page_id", "mut_id", "tag", "text", "significance", F.col("mut_id").alias("obs_order"))
    return render.dedup_observations(obs, ["page_id"]).select("page_id", "mut_id", "tag", "text",
                                                              "significance")


_KINDS = """CASE tag WHEN 'button' THEN ['button'] WHEN 'form' THEN ['form'] WHEN 'dialog' THEN
    ['dialog'] ELSE ['generic', 'dialog', 'section', 'button', 'link'] END"""


@query("o13_candidate_kinds", MUT + f"""SELECT mut_id, array_to_string({_KINDS}, ',') AS kinds
    FROM m""")
def _(spark, d):
    return a.mutations(spark, d).select("mut_id", F.array_join(
        observe.candidate_kinds("tag", "role"), ",").alias("kinds"))


# Words of a text longer than two characters, and the best match of each among a label's words.
def _toks(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: length(w) > 2)"


_SIM = "(1 - levenshtein(w, q)::DOUBLE / greatest(length(w), length(q)))"
_FUZZ = f"""list_sum(list_transform({_toks('o.text')}, lambda q: coalesce(list_max(list_transform(
    {_toks('c.label')}, lambda w: CASE WHEN w = q THEN 1.0 WHEN starts_with(w, q) THEN 0.9 WHEN
    starts_with(q, w) THEN 0.85 WHEN {_SIM} >= 0.8 THEN {_SIM} ELSE 0.0 END)), 0.0)))
    / len({_toks('o.text')})"""
LINKS = CAPS + f""", m AS (SELECT * FROM ({a.MUT})), o AS (SELECT *, {_SIG} AS significance,
    CAST(floor((day(ts) - 1) / 5) AS INT) AS step FROM m), ap AS (SELECT * FROM o WHERE
    significance >= 4 AND type = 'added'), sc AS (SELECT o.mut_id, c.node_id, c.rank,
    list_position({_KINDS}, c.kind) AS kpos, least(1.0, 0.3 + CASE WHEN o.role = 'dialog' AND c.kind =
    'dialog' THEN 0.25 ELSE 0.0 END + CASE WHEN o.text = c.label THEN 0.3 WHEN {_FUZZ} >= 0.5 THEN 0.3
    * ({_FUZZ}) ELSE 0.0 END) AS score FROM ap o JOIN caps c ON c.page_id = o.page_id AND c.step =
    o.step AND list_contains({_KINDS}, c.kind)), best AS (SELECT * FROM sc WHERE score > 0.5
    QUALIFY row_number() OVER (PARTITION BY mut_id ORDER BY score DESC, kpos, rank) = 1)
"""


def _stepped(spark, d):
    return observe.observations(a.mutations(spark, d), 4).withColumn(
        "step", F.floor((F.day("ts") - 1) / 5).cast("int"))


@query("o14_link_observations", LINKS + """SELECT ap.mut_id, b.node_id, round(b.score, 6)::DOUBLE
    AS score FROM ap LEFT JOIN best b USING (mut_id)""")
def _(spark, d):
    out = observe.link_observations(_stepped(spark, d), a.capture_nodes(spark, d),
                                    ["page_id", "step"])
    return out.select("mut_id", "node_id", F.round("score", 6).alias("score"))


@query("o14_link_counts", LINKS + """SELECT count(b.mut_id) AS linked, count(*) - count(b.mut_id) AS
    unlinked, count(*) AS total FROM ap LEFT JOIN best b USING (mut_id)""")
def _(spark, d):
    return observe.link_counts(observe.link_observations(
        _stepped(spark, d), a.capture_nodes(spark, d), ["page_id", "step"]))


@query("o15_observation_children", BOX + """SELECT c.snapshot_id, c.node_id AS container_id,
    n.node_id, CASE n.kind WHEN 'button' THEN 'button' WHEN 'link' THEN 'link' WHEN 'heading' THEN
    'heading' WHEN 'select' THEN 'select' ELSE 'input' END AS tag, row_number() OVER (PARTITION BY
    c.node_id ORDER BY n.node_id) AS child_rank FROM b c JOIN b n ON n.snapshot_id = c.snapshot_id
    AND n.node_id <> c.node_id AND n.kind <> 'form' AND n.x >= c.x - 100 AND n.y >= c.y - 100 AND
    n.x + n.w <= c.x + c.w + 100 AND n.y + n.h <= c.y + c.h + 100 WHERE c.kind = 'form'
    QUALIFY child_rank <= 5""")
def _(spark, d):
    nodes = a.box_nodes(spark, d)
    box = F.col("layout.bbox")
    grown = F.struct((box.x - 100).alias("x"), (box.y - 100).alias("y"),
                     (box.w + 200).alias("w"), (box.h + 200).alias("h"))
    forms_ = nodes.filter("kind = 'form'").withColumn(
        "layout", F.col("layout").withField("bbox", grown))
    return observe.observation_children(forms_, nodes, ["snapshot_id"]).select(
        "snapshot_id", F.col("container_id").cast("bigint").alias("container_id"),
        F.col("node_id").cast("bigint").alias("node_id"), "tag", "child_rank")


# -- network ------------------------------------------------------------------------------------

NET = f"WITH c AS (SELECT * FROM ({a.NET}))"
# Requests and completions in time order, with the number of navigations so far.
FEED = NET + """, ev AS (SELECT page_id, call_id, 'request' AS event, started_at AS ts, 0 AS phase,
    is_navigation AS nav FROM c UNION ALL SELECT page_id, call_id, CASE WHEN failed THEN 'failed'
    ELSE 'finished' END, ended_at, 1, false FROM c WHERE ended_at IS NOT NULL), nv AS (SELECT *,
    sum(nav::INT) OVER (PARTITION BY page_id ORDER BY ts, phase, call_id ROWS UNBOUNDED PRECEDING)
    ::BIGINT AS navigation_id FROM ev)"""


@query("s7_network_source", FEED + """SELECT page_id, event, count(*) AS n FROM ev JOIN c USING
    (page_id, call_id) WHERE resource_type <> 'document' GROUP BY ALL""")
def _(spark, d):
    # Documents stand in for the web sockets, which the log does not have.
    ev = a.net_events(spark, d).withColumn("resource_type", F.when(
        F.col("resource_type") == "document", "websocket").otherwise(F.col("resource_type")))
    return network_source(ev).groupBy("page_id", "event").agg(F.count("*").alias("n"))


@query("s8_mutation_source", MUT + "SELECT page_id, type, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return mutation_source(a.mutations(spark, d)).groupBy("page_id", "type").agg(
        F.count("*").alias("n"))


ASSEMBLED = FEED + """, r AS (SELECT * FROM nv WHERE event = 'request'), e AS (SELECT * FROM nv WHERE
    event <> 'request'), done AS (SELECT c.*, r.navigation_id, e.event AS outcome, (epoch_us(e.ts) -
    epoch_us(r.ts)) / 1000.0::DOUBLE AS duration_ms FROM c JOIN r USING (page_id, call_id) LEFT JOIN
    e ON e.page_id = c.page_id AND e.call_id = c.call_id AND e.navigation_id = r.navigation_id)"""


@query("n1_assemble_calls", ASSEMBLED + """SELECT page_id, call_id, navigation_id, coalesce(outcome =
    'failed', false) AS failed, CASE WHEN outcome = 'finished' THEN status END AS status, duration_ms
    FROM done""")
def _(spark, d):
    return network.assemble_calls(network_source(a.net_events(spark, d))).select(
        "page_id", "call_id", "navigation_id", "failed", "status", "duration_ms")


@query("n2_navigation_id", FEED + """SELECT page_id, call_id AS request_id, event, navigation_id
    FROM nv""")
def _(spark, d):
    return network.with_navigation_id(a.net_events(spark, d)).select(
        "page_id", "request_id", "event", "navigation_id")


@query("n3_pick_headers", NET + """SELECT call_id, 'application/json; v=' || k AS content_type,
    CASE WHEN k % 2 = 0 THEN 'b' END AS accept, 'application/json' AS mime FROM c""")
def _(spark, d):
    calls = a.net_calls(spark, d)
    headers = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("Content-Type").alias("k"),
                 F.concat(F.lit("application/json; v="), "k").alias("v")),
        F.struct(F.lit("Cookie").alias("k"), F.lit("secret").alias("v")),
        F.when(F.col("k") % 2 == 0, F.struct(F.lit("ACCEPT").alias("k"), F.lit("b").alias("v"))))))
    out = calls.withColumn("h", network.pick_headers(headers, [
        "content-type", "accept", "content-length", "x-requested-with"]))
    get = lambda n: F.try_element_at("h", F.lit(n))
    return out.select("call_id", get("content-type").alias("content_type"),
                      get("accept").alias("accept"),
                      network.mime_type(get("content-type")).alias("mime"))


@query("n4_truncate_body", """SELECT doc_id, md5(CASE WHEN length(text) > 2048 THEN text[1:2048] ||
    '…[truncated]' ELSE text END) AS hash FROM documents""")
def _(spark, d):
    return a.table(spark, d, "documents").select(
        "doc_id", F.md5(network.truncate_body("text")).alias("hash"))


@query("n5_mime_type", NET + """SELECT call_id, CASE WHEN k % 3 = 0 THEN 'text/html' WHEN k % 3 = 1
    THEN 'image/png' END AS mime FROM c""")
def _(spark, d):
    kind = F.when(F.col("k") % 3 == 0, " text/html ; charset=utf-8").when(
        F.col("k") % 3 == 1, "image/png")
    return a.net_calls(spark, d).select("call_id", network.mime_type(kind).alias("mime"))


@query("n6_filter_calls", NET + """SELECT call_id FROM c WHERE method = 'GET' AND resource_type =
    'fetch' AND status >= 400 AND status <= 599 AND contains(url, 'h3')""")
def _(spark, d):
    return network.filter_calls(a.net_calls(spark, d), method="get", resource_type="fetch",
                                status_min=400, status_max=599, url_pattern="h3").select("call_id")


@query("n6_failed_only", NET + "SELECT call_id FROM c WHERE failed")
def _(spark, d):
    return network.filter_calls(a.net_calls(spark, d), failed_only=True).select("call_id")


@query("n7_search_calls", r"""SELECT page_id, 'regex' AS how FROM pages WHERE regexp_matches(url,
    'm\.[a-z]+\.example\.(com|net)/en') UNION ALL SELECT page_id, 'text' FROM pages WHERE
    contains(url, 'page=2') UNION ALL SELECT page_id, 'broken' FROM pages WHERE
    contains(url, '(net')""")
def _(spark, d):
    pages = a.table(spark, d, "pages").select("page_id", "url")
    how = lambda df, name: df.select("page_id", F.lit(name).alias("how"))
    return how(network.search_calls(pages, r"m\.[a-z]+\.example\.(com|net)/en", True), "regex") \
        .unionByName(how(network.search_calls(pages, "page=2"), "text")) \
        .unionByName(how(network.search_calls(pages, "(net", True), "broken"))


@query("n8_page_calls", NET + """SELECT page_id, call_id, row_number() OVER (PARTITION BY page_id
    ORDER BY call_id) AS position, count(*) OVER (PARTITION BY page_id) AS total FROM c
    QUALIFY position BETWEEN 6 AND 15""")
def _(spark, d):
    return network.page_calls(a.net_calls(spark, d), 5, 10).select("page_id", "call_id",
                                                                   "position", "total")


@query("n9_call_stats", NET + """SELECT page_id, count(*) AS total, count(*) FILTER (status IS NULL
    AND NOT failed) AS pending, count(*) FILTER (failed) AS failed, count(*) FILTER (resource_type =
    'fetch') AS fetches FROM c GROUP BY page_id""")
def _(spark, d):
    stats = network.call_stats(a.net_calls(spark, d))
    return stats.select("page_id", "total", "pending", "failed", F.coalesce(
        F.try_element_at("by_resource_type", F.lit("fetch")), F.lit(0)).alias("fetches"))


@query("n10_ring_buffer", NET + """SELECT page_id, call_id, row_number() OVER (PARTITION BY page_id
    ORDER BY call_id DESC) AS age_rank FROM c QUALIFY age_rank <= 30""")
def _(spark, d):
    return network.ring_buffer(a.net_calls(spark, d), 30).select("page_id", "call_id", "age_rank")


INFLIGHT = FEED + """, s AS (SELECT *, sum(CASE WHEN event = 'request' THEN 1 ELSE -1 END) OVER w AS s
    FROM nv WINDOW w AS (PARTITION BY page_id, navigation_id ORDER BY ts, phase, call_id ROWS
    UNBOUNDED PRECEDING)), fl AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY page_id,
    navigation_id ORDER BY ts, phase, call_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS inflight
    FROM s)"""


@query("n11_inflight", INFLIGHT + """SELECT page_id, call_id AS request_id, event, inflight FROM fl""")
def _(spark, d):
    return network.inflight(a.net_events(spark, d)).select("page_id", "request_id", "event",
                                                           "inflight")


def quiet_sql(events: str) -> str:
    """Per action: the first calm stretch of an event list (page_id, t, seq, level), by brute
    force over the events of the page."""
    w, lim = QUIET * 1000, LIMIT * 1000
    return f""", ev2 AS ({events}), nx AS (SELECT *, lead(t) OVER (PARTITION BY page_id ORDER BY t,
    seq) AS nt, row_number() OVER (PARTITION BY page_id ORDER BY t, seq) AS n FROM ev2),
    act AS (SELECT user_id AS page_id, event_id AS action_id, epoch_us(ts) AS a0 FROM events WHERE
    event_type = 'click'), bf AS (SELECT a.*, coalesce(e.level, 0) AS lv, coalesce(e.n, 0) AS n0
    FROM act a ASOF LEFT JOIN nx e ON e.page_id = a.page_id AND a.a0 >= e.t), fol AS (SELECT b.*,
    (SELECT min(t) FROM nx WHERE nx.page_id = b.page_id AND t > a0) AS nt0, (SELECT min(t) FROM nx
    WHERE nx.page_id = b.page_id AND t > a0 AND level = 0 AND (nt IS NULL OR nt - t >= {w})) AS z,
    (SELECT count(*) FROM nx WHERE nx.page_id = b.page_id AND t <= a0 + {lim}) AS nend FROM bf b),
    wt AS (SELECT *, CASE WHEN lv = 0 AND (nt0 IS NULL OR nt0 - a0 >= {w}) THEN {w} ELSE z + {w} - a0
    END AS wait FROM fol), rs AS (SELECT page_id, action_id, coalesce(wait <= {lim}, false) AS quiet,
    CASE WHEN wait <= {lim} THEN wait ELSE {lim} END / 1000.0::DOUBLE AS wait_ms, CASE WHEN wait <=
    {lim} THEN (SELECT count(*) FROM nx WHERE nx.page_id = wt.page_id AND t <= a0 + wait - {w}) ELSE
    nend END - n0 AS events_seen FROM wt)"""


_NETQ = INFLIGHT + quiet_sql("SELECT page_id, epoch_us(ts) AS t, call_id * 2 + phase AS seq, "
                             "inflight AS level FROM fl")
_DOMQ = MUT + quiet_sql("SELECT page_id, epoch_us(ts) AS t, mut_id AS seq, 0 AS level FROM m")


@query("n12_network_quiet", _NETQ + """SELECT page_id, action_id, quiet, wait_ms, events_seen
    FROM rs""")
def _(spark, d):
    return network.network_quiet(a.net_events(spark, d), a.click_actions(spark, d), QUIET, LIMIT)


@query("n13_dom_quiet", _DOMQ + """SELECT page_id, action_id, CASE WHEN quiet THEN 'stable' ELSE
    'timeout' END AS status, wait_ms, events_seen AS mutation_count FROM rs""")
def _(spark, d):
    return network.dom_quiet(a.mutations(spark, d), a.click_actions(spark, d), QUIET, LIMIT)


@query("n13_mutation_bursts", MUT + f""", g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts)
    OVER w) < {6 * HOUR * 1000} THEN 0 ELSE 1 END AS opens FROM m WINDOW w AS (PARTITION BY page_id
    ORDER BY ts, mut_id)), b AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY ts, mut_id
    ROWS UNBOUNDED PRECEDING) AS b FROM g), s AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY
    page_id, b) AS s0 FROM b) SELECT page_id, s0 AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS
    mutations, count(*) FILTER (epoch_us(ts) - s0 <= {24 * HOUR * 1000}) AS mutation_count, CASE WHEN
    max(epoch_us(ts)) + {6 * HOUR * 1000} - s0 <= {24 * HOUR * 1000} THEN 'stable' ELSE 'timeout' END
    AS status FROM s GROUP BY page_id, s0""")
def _(spark, d):
    return network.mutation_bursts(a.mutations(spark, d), 6 * HOUR, 24 * HOUR)


def _net_tail() -> str:
    return INFLIGHT.replace("WITH c AS", ", c AS", 1)


@query("n14_settle_after_action", _DOMQ + ", dom AS (SELECT * FROM rs)" + (
    _net_tail() + quiet_sql("SELECT page_id, epoch_us(ts) AS t, call_id * 2 + phase AS seq, "
                            "inflight AS level FROM fl")
).replace("ev2", "ev3").replace("nx", "nx3").replace("act AS", "act3 AS").replace(
    "FROM act a", "FROM act3 a").replace("bf", "bf3").replace("fol", "fol3").replace(
    "wt", "wt3").replace("rs AS", "rs3 AS") + """SELECT d.page_id, d.action_id, CASE WHEN d.quiet THEN
    'stable' ELSE 'timeout' END AS status, n.quiet AS network_idle, d.wait_ms + n.wait_ms AS wait_ms,
    CASE WHEN NOT d.quiet THEN 'DOM still mutating (' || d.events_seen ||
    ' mutations observed). Snapshot may be incomplete.' WHEN NOT n.quiet THEN
    'Network did not reach idle state within timeout' END AS warning FROM dom d JOIN rs3 n USING
    (page_id, action_id)""")
def _(spark, d):
    actions = a.click_actions(spark, d)
    dom = network.dom_quiet(a.mutations(spark, d), actions, QUIET, LIMIT)
    net = network.network_quiet(a.net_events(spark, d), actions, QUIET, LIMIT)
    return network.settle_after_action(dom, net)


@query("n15_navigated", CAPS + """, u AS (SELECT DISTINCT page_id, step, step // 2 AS
    url, CASE WHEN step % 3 <> 0 THEN step // 3 END AS loader FROM caps), v AS (SELECT *, lag(url)
    OVER w AS pu, lag(loader) OVER w AS pl, lag(step) OVER w AS ps FROM u WINDOW w AS (PARTITION BY
    page_id ORDER BY step)) SELECT page_id, step, pu <> url OR coalesce(pl <> loader, false) AS
    navigated FROM v WHERE ps IS NOT NULL""")
def _(spark, d):
    from ..operators.diff import navigated

    caps = a.captures(spark, d).withColumn(
        "url", F.floor(F.col("step") / 2).cast("string")).withColumn(
        "loader_id", F.when(F.col("step") % 3 != 0, F.floor(F.col("step") / 3).cast("string")))
    return navigated(caps)


# -- session logs -------------------------------------------------------------------------------

# Every assistant turn is a tool call, the user turn after it its result.
CALLS = """WITH calls AS (SELECT c.conv_id AS session_id, c.turn, c.conv_id || '-' || c.turn AS
    call_id, '{"turn":' || c.turn || '}' AS input, u.text AS response FROM conversations c LEFT JOIN
    conversations u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1 AND u.role = 'user' WHERE
    c.role = 'assistant')
"""


def _tool_calls(spark, d):
    c = a.table(spark, d, "conversations")
    own = F.concat_ws("-", "conv_id", "turn")
    before = F.concat_ws("-", "conv_id", F.col("turn") - 1)
    none = F.lit(None).cast("string")
    use = F.struct(F.lit("tool_use").alias("type"), F.lit("find").alias("name"),
                   F.to_json(F.struct("turn")).alias("input"), own.alias("id"),
                   none.alias("tool_use_id"), none.alias("content"))
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    result = F.struct(F.lit("tool_result").alias("type"), none.alias("name"), none.alias("input"),
                      none.alias("id"), before.alias("tool_use_id"), F.when(
        F.col("turn") % 4 == 0, blocks).otherwise(F.col("text")).alias("content"))
    messages = c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"),
        F.col("role").alias("type"), F.struct(F.array(F.when(
            F.col("role") == "assistant", use).otherwise(result)).alias("content"))
        .alias("message"))
    return tool_calls(messages)


@query("s6_read_session_log", CALLS + """SELECT session_id, call_id, input, md5(response) AS hash
    FROM calls""")
def _(spark, d):
    return _tool_calls(spark, d).select("session_id", "call_id", "input",
                                        F.md5("response").alias("hash"))


@query("r2_tool_token_report", CALLS + """, t AS (SELECT session_id, turn AS call_no,
    ceil(length(input) / 4.0)::BIGINT AS i, coalesce(nullif(response, ''), '(no response found)') AS r
    FROM calls) SELECT session_id, call_no, count(*) AS calls, sum(i)::BIGINT AS input_tokens,
    sum(ceil(length(r) / 4.0)::BIGINT)::BIGINT AS response_tokens, sum(length(r))::BIGINT AS
    response_chars FROM t GROUP BY ROLLUP (session_id, call_no)""")
def _(spark, d):
    calls = _tool_calls(spark, d).withColumn("call_no", F.col("at.line_no"))
    return logs.tool_token_report(calls)


@query("r3_is_baseline", DIGESTS + """SELECT page_id, step, length(digest) > 2000 AS is_baseline
    FROM dig""")
def _(spark, d):
    out = capture_digests(spark, d).withColumnRenamed("digest", "response")
    return out.select("page_id", "step", logs.is_baseline().alias("is_baseline"))


@query("r4_region_token_share", DIGESTS + """, p AS (SELECT page_id, step, region, part AS t FROM (
    SELECT page_id, step, region, regexp_replace(substr(part, 3), chr(10) || '$', '') AS part
    FROM blk) UNION ALL SELECT page_id, step, '_header', regexp_extract(digest,
    '(?s)^(.*?)(<region |$)', 1) FROM dig UNION ALL SELECT page_id, step, '_trailer',
    chr(10) || '</state>' FROM dig WHERE contains(digest, '</region>'))
    SELECT page_id, step, region, ceil(length(t) / 4.0)::BIGINT AS tokens, length(t)::BIGINT AS chars,
    round(ceil(length(t) / 4.0) / ceil(length(digest) / 4.0) * 100, 4)::DOUBLE AS pct FROM p JOIN dig
    USING (page_id, step)""")
def _(spark, d):
    out = capture_digests(spark, d).withColumnRenamed("digest", "response")
    share = logs.region_token_share(out, ["page_id", "step"])
    return share.select("page_id", "step", "region", "tokens",
                        F.col("chars").cast("bigint").alias("chars"),
                        F.round("pct", 4).alias("pct"))


# Ids shown in the digests of a page, and the steps that repeat them.
REPEATED = DIGESTS + """, rep AS (SELECT page_id, eid, list(step ORDER BY step) AS steps, count(*) AS
    n FROM sh GROUP BY page_id, eid HAVING count(*) >= 2)
"""


def _repeated(spark, d):
    out = capture_digests(spark, d).withColumnRenamed("digest", "response")
    eids = logs.digest_eids(out, ["page_id", "step"])
    return out, logs.repeated_eids(eids, ["page_id"])


@query("r5_repeated_eids", REPEATED + """SELECT page_id, eid, n, array_to_string(steps, ',') AS steps
    FROM rep""")
def _(spark, d):
    _, rep = _repeated(spark, d)
    return rep.select("page_id", "eid", F.col("n").cast("bigint").alias("n"), F.array_join(
        F.transform("steps", lambda s: s.cast("string")), ",").alias("steps"))


@query("r6_shared_step_combos", REPEATED + """SELECT page_id, array_to_string(steps, ',') AS steps,
    count(*) AS shared, array_to_string(list_slice(list(eid ORDER BY eid), 1, 4), ',') AS examples
    FROM rep GROUP BY page_id, steps""")
def _(spark, d):
    _, rep = _repeated(spark, d)
    return logs.shared_step_combos(rep, ["page_id"]).select(
        "page_id", F.array_join(F.transform("steps", lambda s: s.cast("string")), ",")
        .alias("steps"), "shared", F.array_join("examples", ",").alias("examples"))


@query("r7_repeated_cost", REPEATED + f""", ln AS (SELECT sh.page_id, sh.step, length({LINE}) - 5 AS
    c FROM sh JOIN rep USING (page_id, eid)), k AS (SELECT page_id, step, count(*) AS repeated,
    sum(c) + count(*) - 1 AS chars FROM ln GROUP BY page_id, step) SELECT page_id, step,
    coalesce(repeated, 0) AS repeated, ceil(coalesce(chars, 0) / 4.0)::BIGINT AS repeated_tokens,
    ceil(length(digest) / 4.0)::BIGINT AS total_tokens FROM dig LEFT JOIN k
    USING (page_id, step)""")
def _(spark, d):
    # A line of the digest, less its indent of four and its line end.
    out, rep = _repeated(spark, d)
    return logs.repeated_cost(out, rep, ["page_id"]).select(
        "page_id", "step", "repeated", "repeated_tokens", "total_tokens")
