"""Operators on hand-made rows: skew-safe scans, query rules, layers, network, forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from domlake.operators import dependencies, diff, forms, grid, identity, layers, network, observe, query, scan
from domlake.plans import adapters as a
from domlake.schema import bbox, make_nodes


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_scan_in_pieces_equals_plain_order(spark, most):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 1, None]), i // 3, i, rng.choice([None, 1, 2, 3]), rng.choice([-1, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a int, i int, v int, d int")
    ranks = scan.rank_ranges(df, ["k"], ["a", "i"], most)
    assert (ranks.cuts is None) == (most == 10_000)
    out = scan.ordered_scan(df, ["k"], ["a", "i"], {
        "s": ("sum", F.col("d")), "l": ("last", F.col("v")), "g": ("lag", F.col("v")),
        "e": ("lead", F.col("v")), "n": ("next", F.col("v")), "t": ("total", F.col("d"))}, ranks)
    out = scan.reflected_sum(out, ["k"], ["a", "i"], F.col("d"), "r", ranks)
    got = {(r.k, r.i): (r.s, r.l, r.g, r.e, r.n, r.r, r.t) for r in out.collect()}
    assert len(got) == 400
    for k in (0, 1):
        mine, s, last, level = [r for r in rows if r[0] == k], 0, None, 0
        for j, (_, _, i, v, d) in enumerate(mine):
            s, last, level = s + d, v if v is not None else last, max(0, level + d)
            after = [x[3] for x in mine[j + 1:]]
            nxt = next((x for x in after if x is not None), None)
            want = (s, last, mine[j - 1][3] if j else None, after[0] if after else None, nxt, level, sum(r[4] for r in mine))
            assert got[(k, i)] == want


def test_a_hot_page_is_spread_evenly(spark):
    """One page has nine of ten rows, most of them within a minute: no piece is over twice its share."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("page_id"), "id",
        F.when(F.col("id") % 7 == 0, F.col("id") * 1000).otherwise(F.col("id") % 3).alias("t"))
    ranks = scan.rank_ranges(rows, ["page_id"], ["t", "id"], 2_000)
    sizes = [r["count"] for r in scan.in_pieces(rows, ranks).where("page_id = -1").groupBy("_piece").count().collect()]
    assert sum(sizes) == 36_000 and max(sizes) <= 4_000 and len(sizes) > 12


def captured(times, gap):
    last, out = None, []
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out


@pytest.mark.parametrize("most, gap", [(20, 100), (20, 7), (50, 3000), (10_000, 100)])
def test_debounce_over_pieces(spark, most, gap):
    """A burst that never pauses is told apart over many pieces as by a walk."""
    rng = random.Random(gap)
    logs = {(1, "a"): sorted(rng.randrange(4000) for _ in range(900)), (1, None): [5, 5, 6, 300], (2, "a"): sorted(rng.randrange(900) for _ in range(300)),
            (3, "b"): [0] * 200 + [50] * 60}
    rows = [(p, r, i, t) for (p, r), times in logs.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "page_id int, region string, mut_id int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {(r.page_id, r.region, r.mut_id): r.captured for r in observe.debounce(df, ["region"], gap, most).collect()}
    assert got == {(p, r, i): c for (p, r), times in logs.items() for i, c in enumerate(captured(times, gap))}


def log_scans(df, name):
    """How often a plan reads a table, and how many exchanges it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(name in line for line in text.splitlines() if "FileScan" in line), sum(
        "Exchange " in line and "Broadcast" not in line and "Reused" not in line for line in text.splitlines())


def test_quiet_plans_stay_small(spark, data):
    events, actions = a.net_events(spark, data), a.click_actions(spark, data)
    net = network.network_quiet(events, actions, 3_600_000, 43_200_000)
    scans, exchanges = log_scans(net, "user_id")
    assert scans <= 3 and exchanges <= 8
    both = network.settle_after_action(network.dom_quiet(a.mutations(spark, data), actions, 3_600_000, 43_200_000), net)
    scans, exchanges = log_scans(both, "user_id")
    assert scans <= 6 and exchanges <= 14


def test_top_n_keeps_ties_and_all_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = scan.top_n(df, ["k"], [F.desc("v")], 5, spread=4)
    assert sorted(r.v for r in got.collect()) == list(range(985, 1000))


def nodes_of(spark, rows):
    """rows: (node_id, kind, label, region, role, z, x, y, w, h, focused)"""
    df = spark.createDataFrame(rows, "id int, kind string, label string, region string, "
                               "role string, z int, x int, y int, w int, h int, focused boolean")
    return make_nodes(df.withColumn("snapshot_id", F.lit(1)), keys=["snapshot_id"],
                      node_id=F.col("id"), kind=F.col("kind"), label=F.col("label"),
                      doc_order=F.col("id"), where={"region": F.col("region")},
                      layout={"bbox": bbox("x", "y", "w", "h"), "z_index": F.col("z")},
                      state={"visible": F.lit(True), "enabled": F.lit(True),
                             "focused": F.col("focused")},
                      attributes={"role": F.col("role")})


def test_close_buttons_come_after_focus_in_modals(spark):
    nodes = nodes_of(spark, [
        (1, "button", "Save", "dialog", None, None, 0, 0, 9, 9, False),
        (2, "button", "Close", "dialog", None, None, 0, 0, 9, 9, False),
        (3, "button", "x", "dialog", None, None, 0, 0, 9, 9, False),
        (4, "button", "Cancel", "dialog", None, None, 0, 0, 9, 9, False),
        (5, "input", "Name", "dialog", None, None, 0, 0, 9, 9, True),
        (6, "link", "Home", "main", None, None, 0, 0, 9, 9, False),
    ]).withColumn("active", F.lit("modal"))
    got = layers.focus_guarantee(nodes, 4).orderBy("rank").collect()
    assert [r.node_id for r in got] == ["5", "2", "3", "1"]


def test_lowest_overlay_is_active_unless_asked(spark):
    nodes = nodes_of(spark, [
        (1, "dialog", "", "dialog", "alertdialog", 50, 0, 0, 9, 9, False),
        (2, "list", "", "main", "menu", 900, 0, 0, 9, 9, False),
        (3, "alert", "", "main", "alert", 2000, 0, 0, 9, 9, False)])
    row = layers.layer_stack(nodes).first()
    assert (row.stack, row.active) == (["main", "toast", "popover", "modal"], "modal")
    assert layers.layer_stack(nodes, topmost=True).first().active == "popover"


def test_empty_fuzzy_query_matches_nothing(spark):
    nodes = nodes_of(spark, [(1, "link", "an ox", "main", None, None, 0, 0, 1, 1, False)])
    assert query.filter_label_fuzzy(nodes, {"text": "an ox", "mode": "fuzzy"}).count() == 0
    assert query.filter_label(nodes, "").count() == 1


def test_diff_of_equal_captures_is_empty(spark, data):
    from domlake.plans import adapters as a

    one = a.capture_nodes(spark, data).filter("step = 0")
    nodes = one.unionByName(one.withColumn("step", F.lit(1)))
    caps = a.captures(spark, data).filter("step = 0")
    caps = caps.unionByName(caps.withColumn("step", F.lit(1)))
    assert diff.compute_diff(nodes, caps).count() == 0
    assert diff.is_empty(diff.compute_diff(nodes, caps), caps).filter("NOT is_empty").count() == 0


def test_swapped_captures_swap_added_and_removed(spark, data):
    from domlake.plans import adapters as a

    nodes = a.capture_nodes(spark, data).filter("step < 2")
    caps = a.captures(spark, data).filter("step < 2")
    flip = lambda df: df.withColumn("step", 1 - F.col("step"))
    added = diff.diff_added(nodes, caps).select("page_id", "eid")
    removed = diff.diff_removed(flip(nodes), flip(caps)).select("page_id", "eid")
    assert added.count() > 0 and added.exceptAll(removed).count() == 0


def test_headers_and_body(spark):
    df = spark.sql("SELECT map('ACCEPT', 'a', 'accept', 'b', 'cookie', 'c') AS h, "
                   "repeat('x', 2050) AS b, ' text/html ; q' AS c")
    row = df.select(network.pick_headers("h", ["accept", "content-type"]).alias("h"),
                    network.truncate_body("b").alias("b"), network.mime_type("c").alias("c")).first()
    assert row.h == {"accept": "b"} and row.c == "text/html"
    assert row.b == "x" * 2048 + "…[truncated]"


def test_unnamed_radios_group_by_first_match(spark):
    cols = ("snapshot_id int, form_key string, node_id string, sequence int, kind string, "
            "region string, name string, heading string, group_id string")
    rows = [(1, "f", "a", 0, "radio", "main", "n1", "h1", "g1"),
            (1, "f", "b", 1, "radio", "main", None, "h1", "g2"),
            (1, "f", "c", 2, "radio", "main", "n1", "h9", "g9"),
            (1, "f", "d", 3, "radio", "main", "n2", "h8", "g8")]
    got = forms.link_radio_groups(spark.createDataFrame(rows, cols)).collect()
    assert {r.node_id: (r.radio_group, sorted(r.peers)) for r in got} == {
        "a": ("radio-group-0", ["b", "c"]), "b": ("radio-group-0", ["a", "c"]),
        "c": ("radio-group-0", ["a", "b"])}


def test_intent_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([("payment",), ("log in and sign up",), ("zzz",)], "t string")
    assert [r.i for r in df.select(forms.infer_intent("t").alias("i")).collect()] == [
        "payment", "login", "unknown"]


def test_wide_boxes_use_the_capture_join(spark):
    nodes = nodes_of(spark, [
        (1, "form", "", "main", None, None, 0, 0, 900000, 900000, False),
        (2, "button", "Go", "main", None, None, 5, 5, 10, 10, False),
        (3, "link", "Far", "main", None, None, 800000, 5, 10, 10, False)])
    pairs = observe.boxes_inside(nodes.filter("kind = 'form'"), nodes, ["snapshot_id"])
    assert sorted(r.node_id for r in pairs.collect()) == ["2", "3"]


def test_confidence_grows_with_observations(spark):
    edges = spark.createDataFrame(
        [(1, "a", "b", "enables", n, 1, "observed_state_change") for n in (1, 2, 3, 9)],
        "page_id int, source_eid string, target_eid string, type string, observations long, "
        "last_step int, method string")
    got = [round(r.confidence, 4) for r in dependencies.with_confidence(edges).orderBy(
        "observations").collect()]
    assert got == [0.6167, 0.7833, 0.95, 0.95]


def test_many_requests_are_answered_as_each(spark, data):
    nodes = a.box_nodes(spark, data).cache()
    some = [r for r in nodes.select("label", "kind", "where.region").limit(400).collect() if r.label]
    rng = random.Random(5)
    requests = [{}, {"label": ""}, {"label": " "}, {"label": "o"}, {"label": "zzzz"}, {"label": {"text": "ab", "mode": "fuzzy"}},
                {"state": {}, "limit": 5}, {"state": {"visible": True, "focused": True}}, {"kind": ["link", "link"], "min_score": 0.9},
                {"label": {"text": "", "mode": "exact"}, "kind": "link"}]
    while len(requests) < 34:
        row, req = rng.choice(some), {}
        word = rng.choice(row.label.split())
        mode = rng.choice([None, "contains", "exact", "fuzzy", "fuzzy"])
        if mode:
            text = row.label if mode == "exact" else rng.choice([word, word[:4], row.label, word[:-1] + "x " + word, word + " nothing"])
            req["label"] = {"text": text.upper() if rng.random() < .3 else text, "mode": mode, "case_sensitive": rng.random() < .3,
                            "prefix": rng.random() < .7, "overlap": rng.choice([0.3, 0.5, 1.0]), "sim": rng.choice([0.7, 0.8]),
                            "max_tokens": rng.choice([None, 1, 2])}
        if rng.random() < .5:
            req["kind"] = rng.choice([row.kind, ["link", "button"]])
        if rng.random() < .3:
            req["region"] = [row.region]
        req |= {"sort_by_relevance": rng.random() < .5, "limit": rng.choice([None, 3])}
        requests.append(req)
    cols = "snapshot_id", "node_id", "relevance", "match_rank", "total_matched"
    got = query.find_many(nodes, requests).select("request_id", *cols).collect()
    for i, request in enumerate(requests):
        want = query.find(nodes, request).select(*cols).collect()
        assert sorted(tuple(r)[1:] for r in got if r.request_id == i) == sorted(map(tuple, want)), request


def test_a_table_of_requests_is_completed_as_a_list(spark):
    requests = [{"label": {"text": " Big  FISH ", "mode": "fuzzy"}, "kind": "link", "state": {"visible": True}, "limit": 3},
                {"label": ""}, {"region": ["nav"], "min_score": 0.5}, {"label": {"text": "X", "mode": "exact", "case_sensitive": True}}]
    rows = [(0, " Big  FISH ", "fuzzy", None, ["link"], None, [("visible", "true")], 3, None), (1, "", None, None, None, None, None, None, None),
            (2, None, None, None, None, ["nav"], None, None, 0.5), (3, "X", "exact", True, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "request_id long, text string, mode string, sensitive boolean, kinds array<string>, "
                                  "regions array<string>, states array<struct<flag:string,want:string>>, k int, min_score double")
    cols = ["request_id", "kinds", "regions", "has_state", "states", "mode", "k", "min_score", "by_relevance", "top"]
    got, want = query.complete_requests(table), query.request_table(spark, requests)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.select(cols).collect() == want.select(cols).collect()
    labelled = ["needle", "tokens", "overlap", "prefix", "sim", "sensitive"]
    assert got.filter("mode IS NOT NULL").select(labelled).collect() == want.filter("mode IS NOT NULL").select(labelled).collect()


def test_plans_do_not_grow_with_requests(spark, data):
    nodes = a.box_nodes(spark, data)
    def plan(n):
        many = [{"label": {"text": f"word{i} cold", "mode": "fuzzy", "overlap": 1.0}, "kind": "link"} if i % 2 else {"label": f"cold {i}"} for i in range(n)]
        df = query.find_many(nodes, query.request_table(spark, many).repartition(4))
        return df, len(re.sub(r"#\d+L?|_\d+", "", df._jdf.queryExecution().optimizedPlan().toString()))
    assert plan(10)[1] == plan(10_000)[1]
    assert plan(10_000)[0].groupBy("request_id").count().count() >= 0


def test_registry_intervals_and_their_removals(spark):
    """Gaps, ids gone for good, a step that only the ids have, and more captures than a block."""
    captures = [(1, s) for s in range(0, 6000, 2)] + [(2, 1), (3, 5)]
    seen = [(1, s, "always") for s in range(0, 6000, 2)] + [(1, 0, "once"), (1, 10, "twice"), (1, 4000, "twice"), (1, 7, "odd"), (2, 1, "x"), (2, 1, "x")]
    eids = spark.createDataFrame(seen, "page_id long, step int, eid string")
    caps = spark.createDataFrame(captures, "page_id long, step int")
    got = sorted(map(tuple, identity.registry_update(eids, caps).collect()))
    first, at = {}, set(seen)
    for p, s, e in sorted(at):
        first[p, e] = min(s, first.get((p, e), s))
    want = [(p, s, e, "added" if s == first[p, e] else "updated") for p, s, e in at]
    want += [(p, s, e, "removed") for (p, e), f in first.items() for q, s in captures if q == p and s > f and (p, s, e) not in at]
    assert got == sorted(want)
    rows = identity.registry_intervals(eids, identity.capture_clock(eids, caps))
    assert rows.count() == len(at)


def test_large_boxes_meet_only_what_lies_in_them(spark):
    """Boxes of all sizes give the pairs of a comparison of all with all; a page-sized box takes few cells."""
    rng = random.Random(3)
    boxes = [(c % 2, i, x, y, x + w, y + w * rng.random()) for c in range(2) for i in range(40)
             for x, y, w in [(rng.uniform(-500, 5000), rng.uniform(-500, 9000), 10 ** rng.uniform(0, 6))]] + [(0, 99, None, 0.0, 1.0, 1.0)]
    points = [(i % 2, i, rng.uniform(-500, 5000), rng.uniform(-500, 9000)) for i in range(600)] + [(0, 999, 0.0, None), (1, 998, 256.0, 256.0)]
    b = spark.createDataFrame(boxes, "k int, i int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "k int, j int, x double, y double")
    got = grid.points_in_boxes(b, p, ["k"], (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x"), F.col("y")))
    got = [(r.k, r.box.i, r.point.j) for r in got.collect()]
    want = {(k, i, j) for k, i, x0, y0, x1, y1 in boxes for q, j, x, y in points
            if q == k and None not in (x0, y) and x0 <= x <= x1 and y0 <= y <= y1}
    assert len(got) == len(set(got)) and set(got) == want
