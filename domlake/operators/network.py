"""Network log: calls from events, filters, statistics, in-flight counts and quiet periods.

Events are rows (page_id, request_id, event, ts, ...) with event 'request', 'finished' or 'failed'.
Times inside the operators are epoch microseconds, so that arithmetic stays exact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .scan import Ranks, micros, ordered_scan, rank_ranges, reflected_sum, top_n

REQUEST_FIELDS = ["url", "method", "resource_type", "is_navigation", "request_headers",
                  "post_data"]
REPLY_FIELDS = ["status", "status_text", "response_headers", "failure_text"]


def _phase() -> Column:
    return F.when(F.col("event") == "request", 0).otherwise(1)


EVENT_ORDER = ["ts", "phase", "request_id"]


def event_ranks(events: DataFrame, most: int | None = None) -> Ranks:
    """Cuts of busy pages' event logs, of at most ``most`` rows each; see ``scan.rank_ranges``."""
    return rank_ranges(events.withColumn("phase", _phase()), ["page_id"], EVENT_ORDER, most)


def with_navigation_id(events: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """Adds ``navigation_id``: how many navigations the page had up to and including the event."""
    rows = events.withColumn("phase", _phase())
    mark = (F.col("event") == "request") & F.coalesce("is_navigation", F.lit(False))
    return ordered_scan(rows, ["page_id"], EVENT_ORDER,
                        {"navigation_id": ("sum", mark.cast("int"))}, ranks).drop("phase")


def pick_headers(headers, kept: list[str]) -> Column:
    """Kept headers under lower-case names; of repeated spellings the last one counts."""
    entries = F.map_entries(F.col(headers) if isinstance(headers, str) else headers)
    pairs = []
    for name in kept:
        last = F.try_element_at(_named(entries, name), F.lit(-1))
        pairs.append(F.struct(F.lit(name).alias("k"), last.value.alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.v.isNotNull()))


def _named(entries: Column, name: str) -> Column:
    return F.filter(entries, lambda e: F.lower(e.key) == F.lit(name))


def truncate_body(body, limit: int = rules.MAX_BODY) -> Column:
    b = F.col(body) if isinstance(body, str) else body
    return F.when(F.length(b) > limit, F.concat(F.substring(b, 1, limit),
                                                F.lit(rules.BODY_MARK))).otherwise(b)


def mime_type(content_type) -> Column:
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.when(F.length(c) > 0, F.trim(F.split_part(c, F.lit(";"), F.lit(1))))


def assemble_calls(events: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """One row per request with its outcome.  A completion that arrives after a later navigation of
    the page is dropped and its call stays pending.  Requests and completions meet in one grouping
    on (page, request), which spreads evenly even when one page owns most of the log."""
    rows = with_navigation_id(events, ranks).withColumn("t", micros("ts"))
    have = set(events.columns)
    req = [c if c in have else F.lit(None).cast(
        "map<string,string>" if c == "request_headers" else "string").alias(c)
        for c in REQUEST_FIELDS]
    # Maps cannot be sorted inside the list of completions, so headers travel as JSON.
    rep = [F.lit(None).cast("int" if c == "status" else "string").alias(c) if c not in have
           else F.to_json(c).alias(c) if c == "response_headers" else F.col(c)
           for c in REPLY_FIELDS]
    is_req = F.col("event") == "request"
    grouped = rows.groupBy("page_id", "request_id").agg(
        F.min_by(F.struct("t", "navigation_id", *req), F.when(is_req, F.col("t"))).alias("r"),
        F.array_sort(F.collect_list(F.when(~is_req, F.struct(
            "t", "event", "navigation_id", *rep)))).alias("ends"),
    ).filter(F.col("r").isNotNull())
    end = F.get(F.filter("ends", lambda e: e.navigation_id == F.col("r.navigation_id")), F.lit(0))
    out = grouped.withColumn("e", end)
    failed = F.coalesce(F.col("e.event") == "failed", F.lit(False))
    headers = F.from_json("e.response_headers", "map<string,string>") \
        if "response_headers" in have else F.lit(None).cast("map<string,string>")
    kept = pick_headers(headers, rules.KEPT_RESPONSE_HEADERS)
    return out.select(
        "page_id", F.col("request_id").alias("call_id"), "r.url", "r.method", "r.resource_type",
        "r.is_navigation",
        pick_headers("r.request_headers", rules.KEPT_REQUEST_HEADERS).alias("request_headers"),
        truncate_body("r.post_data").alias("post_data"), F.col("r.t").alias("started_us"),
        F.when(~failed, F.col("e.status")).alias("status"),
        F.when(~failed, F.col("e.status_text")).alias("status_text"),
        F.when(~failed, kept).alias("response_headers"),
        F.when(~failed, mime_type(F.try_element_at(kept, F.lit("content-type")))
               ).alias("mime_type"),
        ((F.col("e.t") - F.col("r.t")) / 1000).alias("duration_ms"),
        failed.alias("failed"), F.when(failed, F.col("e.failure_text")).alias("failure_text"),
        "r.navigation_id")


def _safe_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def url_matches(pattern: str, regex: bool = False, column: str = "url") -> Column:
    """Substring or regular expression; a broken expression is taken as plain text."""
    c = F.col(column)
    return c.rlike(pattern) if regex and _safe_regex(pattern) else F.contains(c, F.lit(pattern))


def filter_calls(calls: DataFrame, method: str | None = None, resource_type: str | None = None,
                 status_min: int | None = None, status_max: int | None = None,
                 failed_only: bool = False, url_pattern: str | None = None,
                 url_regex: bool = False) -> DataFrame:
    test = F.lit(True)
    if method:
        test = test & (F.upper("method") == method.upper())
    if resource_type:
        test = test & (F.col("resource_type") == resource_type)
    if status_min is not None:
        test = test & (F.col("status") >= status_min)
    if status_max is not None:
        test = test & (F.col("status") <= status_max)
    if failed_only:
        test = test & F.col("failed")
    if url_pattern:
        test = test & url_matches(url_pattern, url_regex)
    return calls.filter(test)


def search_calls(calls: DataFrame, pattern: str, regex: bool = False, **filters) -> DataFrame:
    return filter_calls(calls, url_pattern=pattern, url_regex=regex, **filters)


def page_calls(calls: DataFrame, offset: int = 0, limit: int = 25) -> DataFrame:
    """One slice of every page's calls in id order, with the page's total."""
    totals = calls.groupBy("page_id").agg(F.count("*").alias("total"))
    rows = top_n(calls, ["page_id"], [F.asc("call_id")], offset + limit, "position")
    return rows.filter(F.col("position") > offset).join(totals, "page_id")


def call_stats(calls: DataFrame) -> DataFrame:
    """total, pending, failed and a count per resource type for every page."""
    pending = F.col("status").isNull() & ~F.col("failed")
    by_type = calls.groupBy("page_id", "resource_type").agg(
        F.count("*").alias("n"), F.count_if(pending).alias("pending"),
        F.count_if("failed").alias("failed"))
    return by_type.groupBy("page_id").agg(
        F.sum("n").alias("total"), F.sum("pending").alias("pending"),
        F.sum("failed").alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("resource_type", "n"))))
        .alias("by_resource_type"))


def ring_buffer(calls: DataFrame, size: int = 1000) -> DataFrame:
    """The newest ``size`` calls of every page."""
    return top_n(calls, ["page_id"], [F.desc("call_id")], size, "age_rank")


def inflight(events: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """Requests in flight after each event: never negative, zero again at each navigation."""
    ranks = event_ranks(events) if ranks is None else ranks
    rows = with_navigation_id(events, ranks).withColumn("phase", _phase())
    step = F.when(F.col("event") == "request", 1).otherwise(-1)
    return reflected_sum(rows, ["page_id", "navigation_id"], EVENT_ORDER, step, "inflight", ranks).drop("phase")


def first_quiet(events: DataFrame, actions: DataFrame, quiet_ms: int, timeout_ms: int,
                most: int | None = None) -> DataFrame:
    """For every action the first moment after which nothing happened for ``quiet_ms``.

    ``events`` has (page_id, ts, seq, level): level above zero means the page stays busy until the
    next event.  ``actions`` has (page_id, action_id, ts).  Action starts and deadlines are merged
    into the event order and read off neighbouring values, so no range join is needed.  Adds
    ``quiet``, ``wait_ms`` and ``events_seen``."""
    w, limit = quiet_ms * 1000, timeout_ms * 1000
    none = F.lit(None).cast("bigint")
    log = events.select("page_id", micros("ts").alias("t"), F.lit(0).alias("mark"),
                        F.col("seq").cast("bigint").alias("seq"),
                        F.col("level").cast("bigint").alias("level"))
    marks = actions.select("page_id", F.col("action_id").cast("bigint").alias("seq"), none.alias("level"), F.inline(F.array(
        F.struct(micros("ts").alias("t"), F.lit(1).alias("mark")),
        F.struct((micros("ts") + limit).alias("t"), F.lit(2).alias("mark")))))
    rows = log.unionByName(marks)
    order, is_event = ["t", "mark", "seq"], F.col("mark") == 0
    ranks = rank_ranges(rows, ["page_id"], order, most)
    rows = ordered_scan(rows, ["page_id"], order, {
        "n": ("sum", is_event.cast("int")),
        "busy": ("last", F.col("level")),
        "next_t": ("next", F.when(is_event, F.col("t")))}, ranks)
    calm = F.col("next_t").isNull() | (F.col("next_t") - F.col("t") >= w)
    rows = ordered_scan(rows, ["page_id"], order, {
        "later": ("next", F.when(is_event & (F.col("level") == 0) & calm,
                                 F.struct("t", "n")))}, ranks)
    at_once = (F.coalesce("busy", F.lit(0)) == 0) & calm
    found = F.when(at_once, F.struct("t", "n")).otherwise(F.col("later"))
    per = rows.filter("mark > 0").withColumn("q", found).groupBy(
        "page_id", F.col("seq").alias("action_id")).agg(
        F.max(F.when(F.col("mark") == 1, F.struct("t", "n", "q"))).alias("s"),
        F.max(F.when(F.col("mark") == 2, F.col("n"))).alias("n_end"))
    wait = F.col("s.q.t") + w - F.col("s.t")
    quiet = F.coalesce(wait <= limit, F.lit(False))
    return per.select(
        "page_id", "action_id", quiet.alias("quiet"),
        (F.when(quiet, wait).otherwise(F.lit(limit)) / 1000).alias("wait_ms"),
        (F.when(quiet, F.col("s.q.n")).otherwise(F.col("n_end")) - F.col("s.n"))
        .alias("events_seen"))


def network_quiet(events: DataFrame, actions: DataFrame, quiet_ms: int = 500,
                  timeout_ms: int = 3000, most: int | None = None) -> DataFrame:
    """Whether the network of the page fell idle in time after each action."""
    levels = inflight(events, event_ranks(events, most)).select(
        "page_id", "ts", (F.col("request_id") * 2 + _phase()).alias("seq"),
        F.col("inflight").alias("level"))
    return first_quiet(levels, actions, quiet_ms, timeout_ms, most)


def dom_quiet(mutations: DataFrame, actions: DataFrame, quiet_ms: int = 100,
              timeout_ms: int = 2000, most: int | None = None) -> DataFrame:
    """stable or timeout after each action, with the number of mutations seen while waiting."""
    log = mutations.select("page_id", "ts", F.col("mut_id").alias("seq"), F.lit(0).alias("level"))
    out = first_quiet(log, actions, quiet_ms, timeout_ms, most)
    return out.select("page_id", "action_id",
                      F.when(F.col("quiet"), "stable").otherwise("timeout").alias("status"),
                      "wait_ms", F.col("events_seen").alias("mutation_count"))


def mutation_bursts(mutations: DataFrame, quiet_ms: int = 100, timeout_ms: int = 2000,
                    most: int | None = None) -> DataFrame:
    """Runs of mutations without a pause of ``quiet_ms``: start, end, count and whether the run fell
    quiet within ``timeout_ms`` of its start (mutations after that point are not counted)."""
    rows = mutations.select("page_id", "mut_id", "ts", micros("ts").alias("t"))
    order = ["t", "mut_id"]
    ranks = rank_ranges(rows, ["page_id"], order, most)
    rows = ordered_scan(rows, ["page_id"], order, {"before": ("lag", F.col("t"))}, ranks)
    opens = F.col("before").isNull() | (F.col("t") - F.col("before") >= quiet_ms * 1000)
    rows = ordered_scan(rows, ["page_id"], order, {
        "start_us": ("last", F.when(opens, F.col("t")))}, ranks)
    within = F.col("t") - F.col("start_us") <= timeout_ms * 1000
    out = rows.groupBy("page_id", "start_us").agg(
        F.max("t").alias("end_us"), F.count("*").alias("mutations"),
        F.count_if(within).alias("mutation_count"))
    settled = F.col("end_us") + quiet_ms * 1000 - F.col("start_us") <= timeout_ms * 1000
    return out.withColumn("status", F.when(settled, "stable").otherwise("timeout"))


def settle_after_action(dom: DataFrame, network: DataFrame) -> DataFrame:
    """Combine ``dom_quiet`` and ``network_quiet`` per action into status and warning."""
    out = dom.join(network.select("page_id", "action_id", F.col("quiet").alias("network_idle"),
                                  F.col("wait_ms").alias("network_wait_ms")),
                   ["page_id", "action_id"], "left")
    idle = F.coalesce("network_idle", F.lit(True))
    warning = F.when(F.col("status") == "timeout", F.concat(
        F.lit("DOM still mutating ("), F.col("mutation_count"),
        F.lit(" mutations observed). Snapshot may be incomplete."))).when(
        ~idle, "Network did not reach idle state within timeout")
    return out.select("page_id", "action_id", "status", idle.alias("network_idle"),
                      (F.col("wait_ms") + F.coalesce("network_wait_ms", F.lit(0.0)))
                      .alias("wait_ms"), warning.alias("warning"))
