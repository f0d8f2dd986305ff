"""Replaying a log as a stream gives what the batch operators give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from domlake.operators import identity, network, observe
from domlake.plans import adapters as a
from domlake.sources import sinks
from domlake.sources.feeds import stream_files
from domlake.streaming import feeds, stateful


def files(df, path, column, parts=3):
    """Write a table as a few files in the order of a column, one per micro-batch."""
    ranked = df.withColumn("_p", F.ntile(parts).over(
        Window.orderBy(column)))
    for p in range(1, parts + 1):
        ranked.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)
    return path


def drain(df, mode, name, spark, tmp, endless=False):
    """``endless`` is for state with a lifetime, whose query goes on without input to clear it away."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", f"{tmp}/ck-{name}").trigger(availableNow=True).start()
    for _ in range(48):
        if q.awaitTermination(5) or (endless and q.lastProgress and not q.lastProgress["numInputRows"]):
            break
    assert q.exception() is None
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.table(name)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_registry_matches_batch(spark, data, tmp_path):
    stateful.use_rocksdb(spark)
    ids = identity.with_eids(a.capture_nodes(spark, data), F.lit("main")).select(
        "page_id", "step", "eid").cache()
    path = str(tmp_path / "ids")
    for step in range(7):
        part = ids.filter(F.col("step") == step)
        part.coalesce(1).write.mode("append").parquet(path)
    got = drain(stateful.registry(stream_files(spark, path, ids.schema)), "append", "reg", spark,
                tmp_path)
    want = identity.registry_update(ids, a.captures(spark, data))
    assert rows(got, "page_id", "step", "eid", "op") == rows(want, "page_id", "step", "eid", "op")


def test_newest_matches_ring_buffer(spark, data, tmp_path):
    stateful.use_rocksdb(spark)
    calls = a.net_calls(spark, data).select("page_id", "call_id", "url").cache()
    path = files(calls, str(tmp_path / "calls"), "call_id")
    stream = stream_files(spark, path, calls.schema)
    out = drain(stateful.newest(stream, {"page_id": "bigint"}, "call_id", "url", 5), "update",
                "ring", spark, tmp_path)
    # Every buffer that was ever current is in the output, so the final one must be part of it.
    got = out.select("page_id", "call_id").distinct()
    want = network.ring_buffer(calls, 5).select("page_id", "call_id")
    assert want.exceptAll(got).count() == 0


def test_debounce_matches_batch(spark, data, tmp_path):
    stateful.use_rocksdb(spark)
    m = a.mutations(spark, data).withColumn("role", F.coalesce("role", F.lit("")))
    hour = 3_600_000
    want = observe.debounce(m, ["role"], 12 * hour)
    log = m.select("page_id", F.col("role").alias("region"), "mut_id",
                   F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    path = files(log, str(tmp_path / "deb"), "t")
    got = drain(stateful.debounce(stream_files(spark, path, log.schema), 12 * hour), "append",
                "deb", spark, tmp_path)
    assert rows(got, "page_id", "region", "mut_id", "captured") == rows(
        want, "page_id", "role", "mut_id", "captured")


def test_latest_captures(spark, data, tmp_path):
    stateful.use_rocksdb(spark)
    caps = a.captures(spark, data).select("page_id", "step", "snapshot_id", "captured_at")
    path = files(caps, str(tmp_path / "caps"), "step")
    out = drain(stateful.latest_captures(stream_files(spark, path, caps.schema), 3_600_000),
                "update", "latest", spark, tmp_path, endless=True)
    got = out.groupBy("page_id").agg(F.max("step").alias("step"))
    want = identity.latest_snapshot(caps).select("page_id", "step")
    assert rows(got, "page_id", "step") == rows(want, "page_id", "step")


def test_latest_sink_keeps_one_row_per_page(spark, data, tmp_path):
    caps = a.captures(spark, data).select("page_id", "step", "snapshot_id", "captured_at")
    path = files(caps, str(tmp_path / "caps"), "step")
    q = sinks.latest_sink(stream_files(spark, path, caps.schema), str(tmp_path / "out"),
                          str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    table = sinks.read_latest(spark, str(tmp_path / "out"), caps.schema)
    want = identity.latest_snapshot(caps).select("page_id", "step")
    assert rows(table, "page_id", "step") == rows(want, "page_id", "step")


def test_call_stats_and_bursts(spark, data, tmp_path):
    calls = a.net_calls(spark, data)
    path = files(calls, str(tmp_path / "calls"), "call_id")
    got = drain(feeds.call_stats(stream_files(spark, path, calls.schema)), "complete", "stats",
                spark, tmp_path)
    totals = got.groupBy("page_id").agg(F.sum("total").alias("total"))
    want = network.call_stats(calls)
    assert rows(totals, "page_id", "total") == rows(want, "page_id", "total")

    m = a.mutations(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))
    path = files(m, str(tmp_path / "mut"), "ts")
    out = drain(feeds.mutation_bursts(stream_files(spark, path, m.schema), "6 hours"), "append",
                "bursts", spark, tmp_path)
    batch = network.mutation_bursts(m, 6 * 3_600_000, 24 * 3_600_000).select(
        "page_id", F.timestamp_micros("start_us").alias("start"), "mutations")
    # Bursts that are still open at the end of the log are not emitted yet.
    closed = out.select("page_id", "start", "mutations")
    assert closed.count() > 0
    assert closed.exceptAll(batch).count() == 0


def test_assemble_calls_drops_late_completions(spark, data, tmp_path):
    ev = network.with_navigation_id(a.net_events(spark, data)).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    req = ev.filter("event = 'request'").select("page_id", "request_id", "navigation_id", "ts")
    end = ev.filter("event <> 'request'").select("page_id", "request_id", "navigation_id", "event",
                                                 "ts", "status")
    rp = files(req, str(tmp_path / "req"), "ts")
    ep = files(end, str(tmp_path / "end"), "ts")
    out = drain(feeds.assemble_calls(stream_files(spark, rp, req.schema),
                                     stream_files(spark, ep, end.schema), "30 days", "30 days"),
                "append", "joined", spark, tmp_path)
    done = out.filter("outcome IS NOT NULL").select("page_id", "request_id")
    want = network.assemble_calls(a.net_events(spark, data)).filter(
        "duration_ms IS NOT NULL").select("page_id", F.col("call_id").alias("request_id"))
    assert rows(done, "page_id", "request_id") == rows(want, "page_id", "request_id")


CAPTURE = "page_id long, step int, snapshot_id string, captured_at timestamp"


def capture(spark, *pairs):
    return spark.createDataFrame([(p, s, f"{p}-{s}", None) for p, s in pairs], CAPTURE).withColumn(
        "captured_at", F.timestamp_seconds(F.col("step") * 60))


def test_latest_table_versions(spark, tmp_path):
    path = str(tmp_path / "latest")
    now = lambda: rows(sinks.read_latest(spark, path, capture(spark).schema), "page_id", "step")
    files_of = lambda v: sorted(f.name for f in (tmp_path / "latest" / "data").glob(f"v={v}-*/*/*.parquet"))
    assert sinks.merge_latest(capture(spark), path, 0, buckets=8)  # an empty first batch
    assert now() == []
    sinks.merge_latest(capture(spark, *((p, 1) for p in range(30))), path, 1)
    untouched = files_of(1)
    sinks.merge_latest(capture(spark, (3, 5), (3, 4)), path, 2)
    want = sorted([(p, 5 if p == 3 else 1) for p in range(30)], key=repr)
    assert now() == want
    assert len(list((tmp_path / "latest" / "data").glob("v=2-*/bucket=*"))) == 1
    assert untouched == files_of(1)
    assert not sinks.merge_latest(capture(spark, (3, 5), (3, 4)), path, 2)  # repeated
    sinks.merge_latest(capture(spark, (3, 2)), path, 3)  # older than what is there
    assert now() == want
    with pytest.raises(sinks.LostBatch):
        sinks.merge_latest(capture(spark, (1, 9)), path, 5)  # batch 4 was never written
    assert sinks.vacuum_latest(spark, path, 1)
    assert now() == want


def test_latest_table_outlives_its_checkpoint(spark, tmp_path):
    """A new checkpoint starts over at batch 0; a writer that died or lost a race changes nothing."""
    path = str(tmp_path / "latest")
    now = lambda: rows(sinks.read_latest(spark, path, capture(spark).schema), "page_id", "step")
    sinks.merge_latest(capture(spark, *((p, 1) for p in range(30))), path, 0, "one")
    sinks.merge_latest(capture(spark, (40, 2)), path, 0, "two")
    assert now() == sorted([(p, 1) for p in range(30)] + [(40, 2)], key=repr)
    with pytest.raises(sinks.LostBatch):
        sinks.merge_latest(capture(spark, (1, 9)), path, 3, "three")  # its first batches went elsewhere
    (tmp_path / "latest" / "manifest" / "v=2.json").write_text('{"buckets": 64, "held"')  # cut short
    sinks.merge_latest(capture(spark, (41, 2)), path, 1, "two")
    assert now() == sorted([(p, 1) for p in range(30)] + [(40, 2), (41, 2)], key=repr)
    old = sinks._newest(spark, path)
    with pytest.raises(sinks.LostBatch):
        sinks._commit(spark, path, old)  # the version is taken
    sinks.vacuum_latest(spark, path, 1)
    assert now() == sorted([(p, 1) for p in range(30)] + [(40, 2), (41, 2)], key=repr)


def test_latest_table_gets_more_buckets(spark, tmp_path):
    path = str(tmp_path / "latest")
    for n in range(4):
        sinks.merge_latest(capture(spark, *((p, n) for p in range(20 * n, 20 * n + 40))), path, n, buckets=2, bucket_rows=10)
    assert sinks._newest(spark, path).buckets == 8
    want = {p: max(n for n in range(4) if 20 * n <= p < 20 * n + 40) for p in range(100)}
    assert rows(sinks.read_latest(spark, path, capture(spark).schema), "page_id", "step") == sorted(want.items(), key=repr)


def test_latest_sink_restarts_with_a_new_checkpoint(spark, tmp_path):
    path, out = str(tmp_path / "caps"), str(tmp_path / "out")
    for n, pages in enumerate((range(20), range(10, 30))):
        capture(spark, *((p, n) for p in pages)).coalesce(1).write.mode("append").parquet(path)
        for _ in range(2):  # a restart finds nothing new
            q = sinks.latest_sink(stream_files(spark, path, capture(spark).schema), out, str(tmp_path / f"ck{n}")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    want = sorted([(p, 1 if p >= 10 else 0) for p in range(30)], key=repr)
    assert rows(sinks.read_latest(spark, out, capture(spark).schema), "page_id", "step") == want


def test_append_sink_keeps_every_row(spark, data, tmp_path):
    calls = a.net_calls(spark, data).select("page_id", "call_id", "url")
    path = files(calls, str(tmp_path / "calls"), "call_id")
    q = sinks.append_stream(stream_files(spark, path, calls.schema), str(tmp_path / "out"),
                            str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.schema(calls.schema).parquet(str(tmp_path / "out"))
    assert rows(got, "page_id", "call_id", "url") == rows(calls, "page_id", "call_id", "url")
