"""Replaying the network log as a stream gives what the batch operators give."""

import pytest
from pyspark.sql import functions as F
from test_streaming import drain, files, rows

from domlake.operators import network
from domlake.plans import adapters as a
from domlake.sources.feeds import stream_files
from domlake.streaming import network as stream
from domlake.streaming import stateful

FEED = ("page_id bigint, request_id bigint, event string, ts timestamp, url string, is_navigation boolean, "
        "status int, failure_text string")
HOUR = 3_600_000


def replay(spark, df, path, parts=3):
    """df as a stream of files in time order; a row of a page of its own, a year later, passes everything."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    files(df, path, "ts", parts)
    last = df.orderBy(F.desc("ts")).limit(1).withColumn("page_id", F.lit(-1).cast("bigint")).withColumn(
        "ts", F.col("ts") + F.expr("INTERVAL 365 DAYS"))
    last.coalesce(1).write.mode("append").parquet(path)
    return stream_files(spark, path, df.schema)


@pytest.fixture
def feed(spark, data):
    stateful.use_rocksdb(spark)
    return a.net_events(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))


def test_inflight_and_navigation_match_batch(spark, feed, tmp_path):
    got = drain(stream.inflight(replay(spark, feed, str(tmp_path / "ev")), "1 hour"), "append", "inflight", spark, tmp_path)
    got = got.where("page_id >= 0")
    assert rows(got, "page_id", "request_id", "event", "inflight") == rows(
        network.inflight(feed), "page_id", "request_id", "event", "inflight")
    assert rows(got, "page_id", "request_id", "event", "navigation_id") == rows(
        network.with_navigation_id(feed), "page_id", "request_id", "event", "navigation_id")


def newest(df):
    return df.where("page_id >= 0").groupBy("page_id", "call_id").agg(F.max_by(F.struct(
        "navigation_id", "failed", "status", "duration_ms", "url", "method", "revision"), "revision").alias("s")).select(
        "page_id", "call_id", "s.*")


def test_calls_match_batch(spark, feed, tmp_path):
    got = newest(drain(stream.assemble_calls(replay(spark, feed, str(tmp_path / "ev")), "1 hour"), "append", "calls", spark, tmp_path))
    cols = "page_id", "call_id", "navigation_id", "failed", "status", "duration_ms", "url", "method"
    assert rows(got, *cols) == rows(network.assemble_calls(feed), *cols)


def test_quiet_matches_batch(spark, feed, data, tmp_path):
    actions = a.click_actions(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))
    ev, act = replay(spark, feed, str(tmp_path / "ev")), replay(spark, actions, str(tmp_path / "act"))
    got = drain(stream.network_quiet(ev, act, HOUR, 12 * HOUR, "30 days"), "append", "quiet", spark, tmp_path).where("page_id >= 0")
    cols = "page_id", "action_id", "quiet", "wait_ms", "events_seen"
    assert rows(got, *cols) == rows(network.network_quiet(feed, actions, HOUR, 12 * HOUR), *cols)


def test_dom_quiet_matches_batch(spark, data, tmp_path):
    stateful.use_rocksdb(spark)
    actions = a.click_actions(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))
    m = a.mutations(spark, data).select("page_id", "mut_id", F.col("ts").cast("timestamp").alias("ts"))
    mut, act = replay(spark, m, str(tmp_path / "mut")), replay(spark, actions, str(tmp_path / "act"))
    got = drain(stream.dom_quiet(mut, act, HOUR, 12 * HOUR, "30 days"), "append", "domquiet", spark, tmp_path).where("page_id >= 0")
    cols = "page_id", "action_id", "status", "wait_ms", "mutation_count"
    assert rows(got, *cols) == rows(network.dom_quiet(m, actions, HOUR, 12 * HOUR), *cols)


def at(minute, page, request, event, nav=False, status=None):
    return page, request, event, 60_000 + minute * 60, "u", nav, status, "lost" if event == "failed" else None


def small_feed(spark, *events):
    df = spark.createDataFrame(events, FEED.replace("ts timestamp", "ts bigint"))
    return df.withColumn("ts", F.timestamp_seconds("ts")).withColumn("method", F.lit("GET"))


def test_late_ends_and_old_navigations(spark, tmp_path):
    stateful.use_rocksdb(spark)
    ev = small_feed(
        spark, at(0, 1, 1, "request", True), at(1, 1, 2, "request"), at(12, 1, 1, "finished", status=200),  # ends after 11 minutes and more
        at(20, 1, 3, "request", True), at(21, 1, 2, "finished", status=200),  # of the navigation before
        at(22, 1, 3, "failed"), at(23, 1, 9, "finished", status=200),  # a call nobody saw start
        at(5, 2, 1, "request"))  # never ends
    got = newest(drain(stream.assemble_calls(replay(spark, ev, str(tmp_path / "ev"), 4), "1 minute"), "append", "late", spark, tmp_path))
    assert sorted(rows(got, "page_id", "call_id", "revision", "status", "failed", "duration_ms"), key=lambda r: r[:2]) == [
        (1, 1, 1, 200, False, 720000.0), (1, 2, 0, None, False, None), (1, 3, 1, None, True, 120000.0), (2, 1, 0, None, False, None)]
    cols = "page_id", "call_id", "navigation_id", "failed", "status", "duration_ms"
    assert rows(got, *cols) == rows(network.assemble_calls(ev), *cols)


def test_pages_that_never_fall_quiet_time_out(spark, tmp_path):
    stateful.use_rocksdb(spark)
    ev = small_feed(spark, at(0, 1, 1, "request"), at(0, 2, 1, "request"), at(2, 2, 1, "finished"), at(3, 3, 1, "request"),
                    at(3, 3, 1, "finished"))
    act = spark.createDataFrame([(1, 10, 60_060), (2, 20, 60_060), (2, 21, 63_600), (3, 30, 60_120), (4, 40, 60_000)], "page_id bigint, action_id bigint, ts bigint")
    act = act.withColumn("ts", F.timestamp_seconds("ts"))
    out = stream.network_quiet(replay(spark, ev, str(tmp_path / "ev"), 1), replay(spark, act, str(tmp_path / "act"), 1), 90_000, 600_000, "2 hours")
    got = drain(out, "append", "never", spark, tmp_path).where("page_id >= 0")
    cols = "page_id", "action_id", "quiet", "wait_ms", "events_seen"
    assert rows(got, *cols) == rows(network.network_quiet(ev, act, 90_000, 600_000), *cols)
    assert (1, 10, False, 600000.0, 0) in rows(got, *cols) and (4, 40, True, 90000.0, 0) in rows(got, *cols)
