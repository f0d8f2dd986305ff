"""The network log as one stream: calls, in-flight counts and quiet moments from keyed state.

Rows of a page wait in state until the watermark has passed them and are then taken in the order of the
batch operators (time, requests before completions, request id), so what a replay emits is what the batch
forms compute. One event-time timer per page wakes the state when something is due without a new row. A page
counts its navigations itself; no batch-made navigation id is needed, and the age of a completion does not matter:
calls stay pending until they end or the page navigates. Rows that arrive later than the watermark's delay are
lost, as in any event-time stream. The processors need the RocksDB state store (``stateful.use_rocksdb``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..operators.network import (REPLY_FIELDS, REQUEST_FIELDS, mime_type, pick_headers,
                                 truncate_body)

_EVENT = ["t", "phase", "seq", "event", "navigates", "payload"]
_WAITING = "t bigint, phase int, seq bigint, event string, navigates boolean, payload string"


class _InOrder(StatefulProcessor):
    """Takes the rows of a key in order once the watermark has passed them. Subclasses give ``take(row)``, which may
    append to ``self.out``, ``pass_time(t)`` for what falls due up to and with ``t``, ``due()`` for the earliest
    moment at which something falls due, and ``load`` and ``store`` for their own state."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", _WAITING)
        self._first = handle.getValueState("first", "t bigint")
        self._own = handle.getValueState("own", "state string")
        self._timer = handle.getValueState("timer", "ms bigint")

    def fresh(self) -> dict:
        return {"nav": 0, "level": 0}

    def pass_time(self, t: int) -> None:
        pass

    def due(self) -> int | None:
        return None

    def _wake(self, at_us: int | None) -> None:
        """One timer for the key, at the first millisecond that is not before ``at_us``."""
        ms = None if at_us is None else -(-at_us // 1000)
        held = self._timer.get()[0] if self._timer.exists() else None
        if ms == held:
            return
        if held is not None:
            self._handle.deleteTimer(held)
        if ms is None:
            self._timer.clear()
        else:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        first = self._first.get()[0] if self._first.exists() else None
        for frame in rows:
            new = [(int(r[0]), int(r[1]), int(r[2]), r[3], bool(r[4]), r[5])
                   for r in frame[_EVENT].itertuples(index=False, name=None)]
            self._waiting.appendList(new)
            low = min(r[0] for r in new)
            first = low if first is None else min(first, low)
        self._first.update((first,))
        held = self._timer.get()[0] if self._timer.exists() else None
        if held is None or first < held * 1000:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._timer.exists() and self._timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self._timer.clear()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self._waiting.get()) if self._waiting.exists() else []
        ready = sorted((r for r in waiting if r[0] <= until), key=lambda r: r[:3])
        rest = [tuple(r) for r in waiting if r[0] > until]
        self.out: list[tuple] = []
        self.key = key[0]
        self.s = json.loads(self._own.get()[0]) if self._own.exists() else self.fresh()
        for row in ready:
            self.take(row)
        self.pass_time(until)
        self._own.update((json.dumps(self.s),))
        first = min((r[0] for r in rest), default=None)
        if rest:
            self._waiting.put(rest)
            self._first.update((first,))
        else:
            self._waiting.clear()
            self._first.clear()
        moments = [m for m in (first, self.due()) if m is not None]
        self._wake(min(moments, default=None))
        yield pd.DataFrame(self.out, columns=self.columns)

    def close(self) -> None:
        pass


class _Counts(_InOrder):
    """Navigation id and requests in flight after each event; a navigation starts both anew."""

    columns = ["page_id", "request_id", "event", "t", "navigation_id", "inflight"]

    def count(self, row) -> None:
        _, phase, _, _, navigates, _ = row
        if phase == 0 and navigates:
            self.s["nav"], self.s["level"] = self.s["nav"] + 1, 0
        self.s["level"] = self.s["level"] + 1 if phase == 0 else max(0, self.s["level"] - 1)

    def take(self, row) -> None:
        self.count(row)
        self.out.append((self.key, row[2], row[3], row[0], self.s["nav"], self.s["level"]))


class _Calls(_InOrder):
    """A row when a call starts and one when it ends. A navigation forgets the calls that are pending."""

    columns = ["page_id", "call_id", "revision", "started_us", "ended_us", "navigation_id",
               "outcome", "request", "reply"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._pending = handle.getMapState("pending", "call bigint", "t bigint, request string")

    def take(self, row) -> None:
        t, phase, call, event, navigates, payload = row
        if phase == 0:
            if navigates:
                self.s["nav"] += 1
                self._pending.clear()
            if not self._pending.containsKey((call,)):
                self._pending.updateValue((call,), (t, payload))
                self.out.append((self.key, call, 0, t, None, self.s["nav"], None, payload, None))
        elif self._pending.containsKey((call,)):
            started, request = self._pending.getValue((call,))
            self._pending.removeKey((call,))
            self.out.append((self.key, call, 1, started, t, self.s["nav"], event, request, payload))


class _Quiet(_Counts):
    """For each action the first moment after which nothing was in flight and nothing happened for a while, or its
    deadline. Actions are rows of phase 2; rows of phase -1 happen without anything in flight."""

    columns = ["page_id", "action_id", "quiet", "wait_us", "events_seen"]

    def __init__(self, quiet_us: int, timeout_us: int) -> None:
        self._quiet_us, self._timeout_us = quiet_us, timeout_us

    def fresh(self) -> dict:
        return super().fresh() | {"last": None, "n": 0, "before": 0, "actions": []}

    def _ends(self, action) -> tuple[int, bool]:
        """When an action's wait ends if nothing more happens, and whether in quiet."""
        start = action[1]
        calm = start if self.s["last"] is None else max(self.s["last"], start)
        deadline = start + self._timeout_us
        if self.s["level"] == 0 and calm + self._quiet_us <= deadline:
            return calm + self._quiet_us, True
        return deadline, False

    def _settle(self, done) -> None:
        left = []
        for action in self.s["actions"]:
            at, quiet = self._ends(action)
            if done(at, quiet):
                self.out.append((self.key, action[0], quiet, at - action[1], self.s["n"] - action[2]))
            else:
                left.append(action)
        self.s["actions"] = left

    def take(self, row) -> None:
        t, phase, seq, _, _, _ = row
        # an event may fall on the end of a calm stretch, and events at a deadline still count
        self._settle(lambda at, quiet: at <= t if quiet else at < t)
        if phase == 2:
            self.s["actions"].append([seq, t, self.s["n"]])
            return
        self.count(row)
        self.s["n"] += 1
        self.s["last"] = t

    def pass_time(self, t: int) -> None:
        self._settle(lambda at, quiet: at <= t)

    def due(self) -> int | None:
        return min((self._ends(a)[0] for a in self.s["actions"]), default=None)


def _feed(events: DataFrame, payload: Column | None = None) -> DataFrame:
    navigates = F.coalesce("is_navigation", F.lit(False)) if "is_navigation" in events.columns else F.lit(False)
    return events.select(
        "page_id", F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.when(F.col("event") == "request", 0).otherwise(1).alias("phase"),
        F.coalesce(F.col("request_id").cast("bigint"), F.lit(-1)).alias("seq"), "event", navigates.alias("navigates"),
        (F.lit(None).cast("string") if payload is None else payload).alias("payload"))


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    return rows.where("ts IS NOT NULL").withWatermark("ts", delay).groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def inflight(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Stream of (page_id, request_id, event, t, navigation_id, inflight) for a stream of events. Events without a time
    have no place in the order and are left out here and below."""
    return _run(_feed(events), _Counts(), "page_id bigint, request_id bigint, event string, t bigint, "
                "navigation_id bigint, inflight bigint", delay)


def assemble_calls(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Stream of calls in the columns of the batch form, with ``revision``: 0 when a call starts, 1 when it has ended.
    The newest revision of a call is its state; a call whose page navigates before it ends keeps revision 0."""
    have = set(events.columns)
    request = F.to_json(F.struct(*[F.col(c) for c in REQUEST_FIELDS if c in have and c not in ("request_headers", "post_data")], *(
        [pick_headers("request_headers", rules.KEPT_REQUEST_HEADERS).alias("request_headers")] if "request_headers" in have else []),
        *([truncate_body("post_data").alias("post_data")] if "post_data" in have else [])))
    reply = F.to_json(F.struct(*[F.col(c) for c in REPLY_FIELDS if c in have and c != "response_headers"], *(
        [pick_headers("response_headers", rules.KEPT_RESPONSE_HEADERS).alias("response_headers")] if "response_headers" in have else [])))
    rows = _feed(events, F.when(F.col("event") == "request", request).otherwise(reply))
    raw = _run(rows, _Calls(), "page_id bigint, call_id bigint, revision int, started_us bigint, ended_us bigint, "
               "navigation_id bigint, outcome string, request string, reply string", delay)
    r = F.from_json("request", "url string, method string, resource_type string, is_navigation boolean, "
                    "request_headers map<string,string>, post_data string")
    e = F.from_json("reply", "status int, status_text string, response_headers map<string,string>, failure_text string")
    failed = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    return raw.withColumn("r", r).withColumn("e", e).select(
        "page_id", "call_id", "revision", *[F.col(f"r.{c}") for c in REQUEST_FIELDS], "started_us",
        *[F.when(~failed, F.col(f"e.{c}")).alias(c) for c in ("status", "status_text", "response_headers")],
        F.when(~failed, mime_type(F.try_element_at("e.response_headers", F.lit("content-type")))).alias("mime_type"),
        ((F.col("ended_us") - F.col("started_us")) / 1000).alias("duration_ms"), failed.alias("failed"),
        F.when(failed, F.col("e.failure_text")).alias("failure_text"), "navigation_id")


def _actions(actions: DataFrame) -> DataFrame:
    return actions.select(
        "page_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.lit(2).alias("phase"), F.col("action_id").cast("bigint").alias("seq"), F.lit("action").alias("event"),
        F.lit(False).alias("navigates"), F.lit(None).cast("string").alias("payload"))


def _quiet(rows: DataFrame, actions: DataFrame, quiet_ms: int, timeout_ms: int, delay: str) -> DataFrame:
    out = _run(rows.unionByName(_actions(actions)), _Quiet(quiet_ms * 1000, timeout_ms * 1000),
               "page_id bigint, action_id bigint, quiet boolean, wait_us bigint, events_seen bigint", delay)
    return out.select("page_id", "action_id", "quiet", (F.col("wait_us") / 1000).alias("wait_ms"), "events_seen")


def network_quiet(events: DataFrame, actions: DataFrame, quiet_ms: int = 500, timeout_ms: int = 3000,
                  delay: str = "1 minute") -> DataFrame:
    """Stream of (page_id, action_id, quiet, wait_ms, events_seen), one row per action once its wait has ended: by an
    event-time timer if nothing more happens on the page, so a page whose calls never end times out."""
    return _quiet(_feed(events), actions, quiet_ms, timeout_ms, delay)


def dom_quiet(mutations: DataFrame, actions: DataFrame, quiet_ms: int = 100, timeout_ms: int = 2000,
              delay: str = "1 minute") -> DataFrame:
    """Stream of (page_id, action_id, status, wait_ms, mutation_count), as the batch form."""
    rows = mutations.select(
        "page_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.lit(-1).alias("phase"), F.col("mut_id").cast("bigint").alias("seq"), F.lit("mutation").alias("event"),
        F.lit(False).alias("navigates"), F.lit(None).cast("string").alias("payload"))
    out = _quiet(rows, actions, quiet_ms, timeout_ms, delay)
    return out.select("page_id", "action_id", F.when(F.col("quiet"), "stable").otherwise("timeout").alias("status"),
                      "wait_ms", F.col("events_seen").alias("mutation_count"))


def settle_after_action(events: DataFrame, mutations: DataFrame, actions: DataFrame, dom_quiet_ms: int = 100,
                        dom_timeout_ms: int = 2000, quiet_ms: int = 500, timeout_ms: int = 3000,
                        delay: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """The two streams that ``operators.network.settle_after_action`` combines, for a sink that joins them by action."""
    return (dom_quiet(mutations, actions, dom_quiet_ms, dom_timeout_ms, delay),
            network_quiet(events, actions, quiet_ms, timeout_ms, delay))
