"""File sources and sinks."""

import json

from pyspark.sql import functions as F

from domlake.operators import logs
from domlake.plans import adapters as a
from domlake.sources import captures, html, sinks
from domlake.sources.captures import read_ax_json, read_snapshots_json
from domlake.sources.session_log import read_session_log


def test_snapshot_files(spark, tmp_path):
    snap = {"snapshot_id": "s1", "page_id": "p", "step": 2, "url": "https://a.b/", "title": "T",
            "viewport": {"width": 800, "height": 600}, "nodes": [
                {"node_id": "7", "kind": "link", "label": "Go", "where": {"region": "nav"},
                 "layout": {"bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "zIndex": 9},
                 "state": {"visible": True, "checked": "mixed"}},
                {"node_id": "8", "kind": "heading", "attributes": {"heading_level": 2}}]}
    (tmp_path / "s.json").write_text(json.dumps(snap))
    captures, nodes = read_snapshots_json(spark, str(tmp_path / "s.json"))
    c = captures.first()
    assert (c.snapshot_id, c.viewport.w) == ("s1", 800)
    first, second = nodes.orderBy("doc_order").collect()
    assert (first.backend_node_id, first.layout.z_index, first.state.checked) == (7, 9, "mixed")
    assert (second.label, second.attributes.heading_level) == ("", 2)


def test_ax_files(spark, tmp_path):
    doc = {"snapshot_id": "s", "nodes": [
        {"nodeId": "1", "backendDOMNodeId": 5, "role": {"value": "button"},
         "name": {"value": "Go"}, "properties": [{"name": "pressed", "value": {"value": True}}]},
        {"nodeId": "2", "ignored": True, "backendDOMNodeId": 6}, {"nodeId": "3"}]}
    (tmp_path / "ax.json").write_text(json.dumps(doc))
    rows = read_ax_json(spark, str(tmp_path / "ax.json")).collect()
    assert [(r.id, r.role, r.name, r.properties) for r in rows] == [
        (5, "button", "Go", {"pressed": "true"})]


def test_session_log_files(spark, tmp_path):
    lines = [
        {"type": "assistant", "message": {"content": [
            {"type": "tool_use", "name": "find", "id": "c1", "input": {"label": "x"}},
            {"type": "text"}]}},
        {"type": "user", "message": {"content": [
            {"type": "tool_result", "tool_use_id": "c1",
             "content": [{"type": "text", "text": "ab"}, {"type": "text", "text": "cd"}]}]}},
        {"type": "assistant", "message": {"content": [
            {"type": "tool_use", "name": "find", "id": "c2", "input": {}}]}}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    calls = read_session_log(spark, str(tmp_path / "log.jsonl"))
    got = {r.call_id: (r.input, r.response) for r in calls.collect()}
    assert got == {"c1": ('{"label":"x"}', "abcd"), "c2": ("{}", None)}
    report = logs.tool_token_report(calls.withColumn("call_no", F.col("call_id")))
    total = report.filter("session_id IS NULL").first()
    assert (total.calls, total.input_tokens, total.response_chars) == (2, 5, 4 + 19)


def test_node_and_digest_sinks(spark, data, tmp_path):
    nodes, caps = a.capture_nodes(spark, data), a.captures(spark, data)
    path = str(tmp_path / "nodes")
    sinks.write_nodes(nodes, caps, path)
    back = spark.read.parquet(path)
    assert back.count() == nodes.count()
    days = {str(r.capture_date) for r in back.select("capture_date").distinct().collect()}
    assert len(days) > 1 and all(d.startswith("2024-01") for d in days)
    digests = spark.createDataFrame([(1, "a"), (2, "b")], "page_id int, digest string")
    sinks.write_digest(digests, str(tmp_path / "d"))
    sinks.write_digest_text(digests, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_baseline_rule(spark):
    big = "<region name=\"a\">" + "x" * 2000 + "</region><region name=\"b\"></region>"
    df = spark.createDataFrame([(big,), ("<baseline />",), (None,)], "response string")
    assert [r.b for r in df.select(logs.is_baseline().alias("b")).collect()] == [
        True, False, False]


def test_broken_captures_are_rows_not_failures(spark):
    good = '{"root":{"backendNodeId":1,"nodeType":9,"nodeName":"#document","children":[{"backendNodeId":2,"nodeType":1,"nodeName":"P"}]}}'
    bad = '{"root":{"backendNodeId":1,"nodeType":9,"nodeName":"#document","children":[{"backendNodeId":2,"nodeType":1,"nodeName":"P"},{"nodeType":1}]}}'
    df = spark.createDataFrame([(1, good), (2, bad), (3, "{"), (4, None), (5, "[]"), (6, good)], "snapshot_id long, doc string").coalesce(1)
    assert sorted((r.snapshot_id, r.id) for r in html.flatten_dom_json(df, "doc").collect()) == [(1, 1), (1, 2), (6, 1), (6, 2)]
    assert sorted(r.snapshot_id for r in html.broken_captures(df, "doc").collect()) == [2, 3, 5]
    frames = spark.createDataFrame([(1, '{"frame":{"id":"F"}}'), (2, '{"frame":{"id":"F"},"childFrames":[{}]}'), (3, "nope"), (4, None)], "snapshot_id long, doc string")
    got = sorted((r.snapshot_id, r.frame_id, r.error is not None) for r in captures.frame_loaders(frames, "doc").collect())
    assert got == [(1, "F", False), (2, None, True), (3, None, True)]
