"""Custom keyed state: element registry, newest rows per key, debounce, captures with a lifetime.

The processors need the RocksDB state store.  State is one entry per key (a page, or a page and a
live region), bounded by the limit given or by the number of ids a page has shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Registry(StatefulProcessor):
    """Ids a page has shown so far; reports added, updated and removed ones per capture."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "eid string", "last_step int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        frame = pd.concat(list(rows))
        known = {k[0] for k in self._seen.keys()}
        out = []
        for step, group in frame.groupby("step", sort=True):
            now = set(group["eid"])
            out += [(key[0], int(step), e, "updated" if e in known else "added")
                    for e in sorted(now)]
            out += [(key[0], int(step), e, "removed") for e in sorted(known - now)]
            for e in now:
                self._seen.updateValue((e,), (int(step),))
            known |= now
        yield pd.DataFrame(out, columns=["page_id", "step", "eid", "op"])

    def close(self) -> None:
        pass


def registry(eids: DataFrame) -> DataFrame:
    """Registry updates from a stream of (page_id, step, eid); all rows of a capture must arrive in
    one batch and captures of a page in step order."""
    return eids.select("page_id", "step", "eid").groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=_Registry(),
        outputStructType="page_id bigint, step int, eid string, op string",
        outputMode="Append", timeMode="None")


class _Newest(StatefulProcessor):
    """The newest ``n`` rows of a key, kept as a list."""

    def __init__(self, n: int, order: str, value: str, keys: list[str]) -> None:
        self._n, self._order, self._value, self._keys = n, order, value, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getListState("rows", f"{self._order} bigint, {self._value} string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        kept = [(int(r[0]), r[1]) for r in self._rows.get()] if self._rows.exists() else []
        for frame in rows:
            kept += list(zip(frame[self._order].astype("int64"), frame[self._value]))
            kept = sorted(kept, key=lambda r: r[0])[-self._n:]
        self._rows.put([(int(o), v) for o, v in kept])
        out = pd.DataFrame(kept, columns=[self._order, self._value])
        for i, name in enumerate(self._keys):
            out.insert(i, name, key[i])
        out["kept"] = len(kept)
        yield out

    def close(self) -> None:
        pass


def newest(df: DataFrame, keys: dict[str, str], order: str, value: str, n: int) -> DataFrame:
    """After every batch, the newest ``n`` rows of each key it touched.  ``keys`` maps key columns to
    their types; ``order`` is an increasing number, ``value`` the text to keep."""
    names = list(keys)
    head = ", ".join(f"{k} {t}" for k, t in keys.items())
    return df.select(*names, order, value).groupBy(*names).transformWithStateInPandas(
        statefulProcessor=_Newest(n, order, value, names),
        outputStructType=f"{head}, {order} bigint, {value} string, kept int",
        outputMode="Update", timeMode="None")


class _Debounce(StatefulProcessor):
    def __init__(self, gap_us: int) -> None:
        self._gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        last = self._last.get()[0] if self._last.exists() else None
        frame = pd.concat(list(rows)).sort_values(["t", "mut_id"])
        flags = []
        for t in frame["t"]:
            keep = last is None or t - last >= self._gap
            last = int(t) if keep else last
            flags.append(keep)
        self._last.update((last,))
        yield frame[["page_id", "region", "mut_id"]].assign(captured=flags)

    def close(self) -> None:
        pass


def debounce(changes: DataFrame, quiet_ms: int = 100) -> DataFrame:
    """Flags (page_id, region, mut_id, t) rows of a stream in event order; ``t`` in microseconds."""
    return changes.select("page_id", "region", "mut_id", "t").groupBy(
        "page_id", "region").transformWithStateInPandas(
        statefulProcessor=_Debounce(quiet_ms * 1000),
        outputStructType="page_id bigint, region string, mut_id bigint, captured boolean",
        outputMode="Append", timeMode="None")


class _Latest(StatefulProcessor):
    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("latest", "step int, snapshot_id string",
                                           **({"ttlDurationMs": self._ttl} if self._ttl else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        frame = pd.concat(list(rows))
        top = frame.loc[frame["step"].idxmax()]
        best = self._state.get() if self._state.exists() else None
        if best is None or int(top["step"]) >= best[0]:
            best = (int(top["step"]), str(top["snapshot_id"]))
            self._state.update(best)
        yield pd.DataFrame({"page_id": [key[0]], "step": [best[0]], "snapshot_id": [best[1]]})

    def close(self) -> None:
        pass


def latest_captures(captures: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Newest capture per page; with ``ttl_ms`` the store forgets a page that long after its last
    capture arrived."""
    return captures.select("page_id", "step", "snapshot_id").groupBy(
        "page_id").transformWithStateInPandas(
        statefulProcessor=_Latest(ttl_ms),
        outputStructType="page_id bigint, step int, snapshot_id string", outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None")
