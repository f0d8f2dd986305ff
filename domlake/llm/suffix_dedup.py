"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that also starts anywhere else.

Every window of 200 bytes has an anchor: the 32 bytes in it with the least hash, so equal windows have equal
anchors, and all windows of one anchor lie in one context of the text. Contexts are counted by anchor and by
content. Windows of a context that is there twice are repeated, as are none whose anchor is there once.
What is left, contexts of one anchor that differ, is dealt to shards by anchor. A shard concatenates its
contexts, sorts their suffixes by induced sorting (suffix types, sorted leftmost-smaller substrings, two
linear induction passes), computes the permuted common prefixes, and marks the windows that share a whole
window's length with another. Texts are never shuffled: each pass reads them again and looks up what the
pass before it found, in memory-mapped arrays sorted by hash.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import arrays, common

#: Bytes of a repeated string, and of an anchor.
WINDOW, ANCHOR = 200, 32
#: Anchors that a task holds before it hands them on, and bytes of contexts.
HELD, HELD_BYTES = 1 << 18, 1 << 22
#: An anchor with more contexts than this is dealt by finer keys: the bytes that STEP windows in a row share.
#: From VERY_CROWDED contexts the steps are FINE windows: then few different strings are left of many contexts.
CROWDED, STEP = 64, 25
VERY_CROWDED, FINE = 1024, 5
#: Bytes of contexts that are sorted together, but for one key's, which always are.
TOGETHER = 1 << 18
#: Each range of hashes has two to this many shards.
SHARDS = 2
#: Windows of one text that are worked on at once.
PIECE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


# --- suffix arrays ---------------------------------------------------------------------------------

def _place(chars: np.ndarray, pointer: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups chars, stably, and the slots they get; pointer moves on."""
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=len(pointer))
    rank = np.arange(len(chars)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(pointer, count)
    if down:
        pointer -= count
        return order, at - 1 - rank
    pointer += count
    return order, at + rank


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Sort all suffixes given the leftmost-smaller ones in order. Suffixes of one first symbol are
    handled together, in as many rounds as that symbol repeats in a row."""
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    head = end - count
    suffixes = np.full(len(text), -1, np.int32)
    tail = end.copy()
    order, at = _place(text[lms[::-1]], tail, True)
    suffixes[at] = lms[::-1][order]
    larger_end = head.copy()
    for c in range(size):
        low = head[c]
        while True:
            last = low == larger_end[c]
            block = suffixes[tail[c]: end[c]] if last else suffixes[low: larger_end[c]]
            low = larger_end[c]
            before = block - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                order, at = _place(text[before], larger_end, False)
                suffixes[at] = before[order]
            if last:
                break
    smaller_start = end.copy()
    smaller_start[0] = head[0]  # the end mark, alone in its bucket, is in place
    for c in range(size - 1, -1, -1):
        high = end[c]
        while True:
            last = high == smaller_start[c]
            block = suffixes[head[c]: larger_end[c]] if last else suffixes[smaller_start[c]: high]
            high = smaller_start[c]
            before = block[::-1] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                order, at = _place(text[before], smaller_start, True)
                suffixes[at] = before[order]
            if last:
                break
    return suffixes


def _ranks(names: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a reduced text, whose symbols may be as many as its length: ranks of twice the
    length from pairs of ranks, until all differ."""
    step = 1
    while True:
        following = np.zeros(len(names), np.int64)
        following[:-step] = names[step:] + 1
        pairs = names * (names.max() + 2) + following
        some, names = np.unique(pairs, return_inverse=True)
        if len(some) == len(names):
            return names
        step *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffixes in order of a text of symbols below size; the last symbol is 0 and nowhere else."""
    present = np.bincount(text, minlength=size) > 0
    text, size = (np.cumsum(present) - 1).astype(np.uint16)[text], int(present.sum())  # symbols in use, in order
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.append(text[:-1] != text[1:], True)
    next_ = np.minimum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
    smaller = text[next_] < np.append(text, 0)[next_ + 1]
    smaller[-1] = True
    lms = np.flatnonzero(smaller & ~np.append(True, smaller[:-1]))
    stop = np.append(lms[1:], n - 1) + 1
    first = _induce(text, smaller, lms, size)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms))
    order = place[first]
    order = order[order >= 0]
    low, high = (text & 255).astype(np.uint8), (text >> 8).astype(np.uint8)
    hashes = common.span_hash(low, lms, stop) + np.uint64(3) * common.span_hash(high, lms, stop)
    new = np.append(True, (hashes[order[1:]] != hashes[order[:-1]]) | ((stop - lms)[order[1:]] != (stop - lms)[order[:-1]]))
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        names = _ranks(names)
    ordered = np.empty(len(lms), np.int64)
    ordered[names] = lms
    return _induce(text, smaller, ordered, size)


def permuted_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """For each of some suffixes in order, by its position, how much it shares with the one before it, as far
    as most."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    up, down = common.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(common.mix(text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    shared = np.zeros(n, np.int64)
    here = np.flatnonzero(before >= 0)
    there = before[here]
    step = 1 << most.bit_length()
    while step := step // 2:  # halving: equal hashes, equal symbols
        inside = np.flatnonzero(np.maximum(here, there) + step <= n)
        i, j = here[inside], there[inside]
        same = (total[i + step] - total[i]) * down[i] == (total[j + step] - total[j]) * down[j]
        here[inside[same]] += step
        there[inside[same]] += step
    at = np.flatnonzero(before >= 0)
    shared[at] = here - at
    return shared


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each of different contexts, which of its windows equal another window of any of them."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.ones(int((size + 1).sum()) + 1, np.uint16)  # 1 between contexts, 0 at the end
    text[-1] = 0
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin, size) + inner] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 2
    windows = np.maximum(0, size - WINDOW + 1)
    own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(begin, windows) + own
    asked = np.zeros(len(text), bool)
    asked[starts] = True
    suffixes = suffix_array(text, 258)
    suffixes = suffixes[asked[suffixes]]  # those that a window starts
    shared = permuted_prefixes(text, suffixes, WINDOW)
    group = np.cumsum(shared[suffixes] < WINDOW)
    group_at = np.empty(len(text), np.int64)
    group_at[suffixes] = group
    of = group_at[starts]
    twice = np.bincount(of, minlength=len(of) + 1)[of] > 1
    return np.split(twice, np.cumsum(windows)[:-1])


# --- anchors ---------------------------------------------------------------------------------------

def _hash_windows(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return common.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Anchors:
    """Anchors of the texts of one piece: fp (hash of the anchor), low and high (first and last window it
    stands for, as places in the buffer), at (its place), id (hash of the whole context)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        up, down = common.powers(len(buf) + 1)
        self.buf, self.down = buf, down
        self.total = total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(common._BYTE[buf] * up[:-1], out=total[1:])
        n = len(buf) - WINDOW + 1
        empty = np.zeros(0, np.int64)
        self.fp = self.id = np.zeros(0, np.uint64)
        self.low = self.high = self.at = empty
        if n <= 0:
            return
        grams = common.mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: len(buf) - ANCHOR + 1])
        least = grams & ~_LOW | np.arange(len(grams), dtype=np.uint64)
        span, width = WINDOW - ANCHOR + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width: span - width + n])
        valid = np.zeros(n + 1, np.int8)
        first, last = offsets[:-1], offsets[1:] - WINDOW + 1
        some = last > first
        np.add.at(valid, first[some], 1)
        np.add.at(valid, last[some], -1)
        inside = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int8) > 0)
        if not len(inside):
            return
        at = (least[inside] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)))
        self.at = at[new]
        self.low = inside[new]
        self.high = inside[np.append(new[1:], len(inside)) - 1]
        self.fp = common.mix(grams[self.at])  # least hashes are small; mixed, they spread over all ranges
        self.id = self.hash(self.low, self.high + WINDOW) + np.uint64(0x9E3779B97F4A7C15) * (self.at - self.low).astype(np.uint64)
        self.id = common.mix(self.id ^ self.fp)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _hash_windows(self.total, self.down, starts, ends)


def pieces(t: common.Texts):
    """(row, Anchors, where the piece starts) for texts; a very long text in pieces that overlap."""
    if len(t.buf) <= PIECE:
        yield Anchors(t.buf, t.offsets), 0
        return
    for row in range(t.rows):
        a, z = int(t.offsets[row]), int(t.offsets[row + 1])
        for start in range(a, max(a + 1, z - WINDOW + 1), PIECE):
            stop = min(z, start + PIECE + WINDOW - 1)
            yield Anchors(t.buf[start:stop], np.array([0, stop - start])), start


# --- passes ----------------------------------------------------------------------------------------

class Found:
    """Files of one pass, by table and range of hashes."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.files = folder, bits, {}

    def find(self, table: str, keys: np.ndarray, route: np.ndarray | None = None):
        return arrays.find(self.folder, self.files.get(table, {}), self.bits, keys, route)


def count_contexts(docs: DataFrame, found: Found) -> None:
    """Tables: "many", contexts that are there twice or more; "mixed", anchors with different contexts of
    which one is there once, with how many."""
    bits, folder = found.bits, found.folder

    def emit(parts):
        fp, id_, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(id_, kind="stable")
        first = np.flatnonzero(np.append(True, id_[order][1:] != id_[order][:-1]))
        n = np.minimum(np.add.reduceat(n[order], first), 2).astype(np.uint8)
        fp, id_ = fp[order][first], id_[order][first]
        order = np.argsort(fp, kind="stable")
        fp, id_, n = fp[order], id_[order], n[order]
        cut = np.searchsorted((fp >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        rows = [(i, fp[a:z].tobytes(), id_[a:z].tobytes(), n[a:z].tobytes()) for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                                          names=["bucket", "fp", "id", "n"])

    def read(batches):
        parts, size = [], 0
        for b in batches:
            for t in common.texts(b.column("text"), common.CHUNK // 2):
                for a, _ in pieces(t):
                    parts.append((a.fp, a.id, np.ones(len(a.fp), np.int64)))
                    size += len(a.fp)
                    if size > HELD:
                        yield emit(parts)
                        parts, size = [], 0
        if size:
            yield emit(parts)

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fp, id_ = (np.concatenate([np.frombuffer(x, "<u8") for x in table.column(c).to_pylist()]) for c in ("fp", "id"))
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(id_, kind="stable")
        first = np.flatnonzero(np.append(True, id_[order][1:] != id_[order][:-1]))
        n, fp, id_ = np.add.reduceat(n[order], first), fp[order][first], id_[order][first]
        many = id_[n > 1]
        arrays.save(folder, f"many-{bucket}", many, np.ones(len(many)))
        order = np.argsort(fp, kind="stable")
        first = np.flatnonzero(np.append(True, fp[order][1:] != fp[order][:-1]))
        kinds = np.diff(np.append(first, len(fp)))
        mixed = (kinds > 1) & (np.minimum.reduceat(n[order], first) == 1)
        arrays.save(folder, f"mixed-{bucket}", fp[order][first][mixed], kinds[mixed].astype(float))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    rows = (common.by_bucket(docs.select("text").mapInArrow(common.released(read), "bucket int, fp binary, id binary, n binary"))
            .applyInArrow(merge, "bucket int").collect())  # a row for each range of hashes
    for table in ("many", "mixed"):
        found.files[table] = {r["bucket"]: f"{table}-{r['bucket']}" for r in rows}


def compare_contexts(docs: DataFrame, found: Found) -> None:
    """Table "part": for contexts that are there once, the runs of their windows that are repeated. The j-th
    run of a context has the key mix(id + j)."""
    bits, folder = found.bits, found.folder

    def asked(a: Anchors):
        """Contexts to compare: key, id, first window in the context, bytes, whether the answer is wanted."""
        kinds, mixed = found.find("mixed", a.fp)
        at = np.flatnonzero(mixed)
        if not len(at):
            return
        _, many = found.find("many", a.id[at], a.fp[at])
        seen: set[int] = set()
        for i, twice, kind in zip(at.tolist(), many.tolist(), kinds[at].tolist(), strict=True):
            if twice and int(a.id[i]) in seen:
                continue
            seen.add(int(a.id[i]))
            low, high, p = int(a.low[i]), int(a.high[i]), int(a.at[i])
            if kind <= CROWDED:
                yield int(a.fp[i]), int(a.id[i]), 0, a.buf[low: high + WINDOW].tobytes(), not twice
                continue
            width = STEP if kind <= VERY_CROWDED else FINE
            for step in range((p - high) // width, (p - low) // width + 1):
                z, y = max(low, p - step * width - width + 1), min(high, p - step * width)
                # the bytes that all windows of the step share, whatever part of the step is here
                core = a.buf[p - step * width: p - step * width - width + 1 + WINDOW].tobytes()
                key = int.from_bytes(hashlib.blake2b(core + bytes([step]), digest_size=8).digest(), "little")
                yield key, int(a.id[i]), z - low, a.buf[z: y + WINDOW].tobytes(), not twice

    def emit(rows):
        """Each string once for a key, with the contexts that it was cut out of."""
        by: dict[int, dict] = {}
        for key, id_, first, data, want in rows:
            by.setdefault(key >> (64 - bits - SHARDS), {}).setdefault((key, data), []).append((id_, first, want))
        out = [(b, np.array([k for k, _ in x], "<u8").tobytes(), np.array([[len(d), len(own)] for (_, d), own in x.items()], "<u4").tobytes(),
                np.array([o[0] for own in x.values() for o in own], "<u8").tobytes(),
                np.array([o[1:] for own in x.values() for o in own], "<u4").tobytes(), b"".join(d for _, d in x)) for b, x in by.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in range(1, 6))],
                                          names=["bucket", "keys", "shape", "ids", "uses", "bytes"])

    def read(batches):
        rows, size = [], 0
        for b in batches:
            for t in common.texts(b.column("text"), common.CHUNK // 2):
                for a, _ in pieces(t):
                    for r in asked(a):
                        rows.append(r)
                        size += len(r[3])
                    if size > HELD_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
        if rows:
            yield emit(rows)

    def shard(table: pa.Table) -> pa.Table:
        by: dict[int, dict[bytes, tuple[list, set]]] = {}
        for keys, shape, ids, uses, data in zip(*(table.column(c).to_pylist() for c in ("keys", "shape", "ids", "uses", "bytes")), strict=True):
            at = use = 0
            ids, uses = np.frombuffer(ids, "<u8").tolist(), np.frombuffer(uses, "<u4").reshape(-1, 2).tolist()
            for key, (size, n) in zip(np.frombuffer(keys, "<u8").tolist(), np.frombuffer(shape, "<u4").reshape(-1, 2).tolist(), strict=True):
                own, all_ = by.setdefault(key, {}).setdefault(data[at: at + size], ([], set()))
                at += size
                for i in range(use, use + n):
                    all_.add(ids[i])
                    if uses[i][1]:
                        own.append((ids[i], uses[i][0]))
                use += n
        out: list[tuple[int, int]] = []

        def compare(group: list[tuple[bytes, tuple[list, set]]]) -> None:
            if not group:
                return
            for (_, (own, all_)), twice in zip(group, repeated_windows([c for c, _ in group]), strict=True):
                if len(all_) > 1:  # the same bytes, cut out of different contexts
                    twice = np.ones(len(twice), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
                out.extend((id_, (first + int(a)) << 24 | (first + int(z) - 1)) for id_, first in own for a, z in zip(edge[::2], edge[1::2], strict=True))

        group: list = []
        size = 0
        for contexts in by.values():
            own_size = sum(map(len, contexts))
            if size + own_size > TOGETHER:
                compare(group)
                group, size = [], 0
            group += contexts.items()
            size += own_size
        compare(group)
        common.give_back()
        ids = np.array([x[0] for x in out], np.uint64)
        order = np.argsort(ids, kind="stable")
        cut = np.searchsorted((ids[order] >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        spans = np.array([x[1] for x in out], np.int64)
        rows = [(i, ids[order[a:z]].tobytes(), spans[order[a:z]].tobytes()) for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "ids": pa.array([r[1] for r in rows], pa.binary()),
                         "spans": pa.array([r[2] for r in rows], pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ids = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("ids").to_pylist()])
        spans = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("spans").to_pylist()])
        order = np.lexsort((spans, ids))
        ids, spans = ids[order], spans[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        keys = common.mix(ids + nth.astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        arrays.save(folder, f"part-{bucket}", keys[order], spans[order].astype(float))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    compared = (common.by_bucket(docs.select("text").mapInArrow(common.released(read), "bucket int, keys binary, shape binary, ids binary, uses binary, bytes binary"), 4)
                .applyInArrow(shard, "bucket int, ids binary, spans binary"))
    rows = (common.by_bucket(compared).applyInArrow(keep, "bucket int").collect())  # a row for each range of hashes
    found.files["part"] = {r["bucket"]: f"part-{r['bucket']}" for r in rows}


def removed(t: common.Texts, found: Found) -> np.ndarray:
    """Which bytes of the texts are covered by repeated windows."""
    edge = np.zeros(len(t.buf) + 1, np.int32)
    for a, start in pieces(t):
        _, many = found.find("many", a.id, a.fp)
        np.add.at(edge, a.low[many] + start, 1)
        np.add.at(edge, a.high[many] + start + WINDOW, -1)
        _, mixed = found.find("mixed", a.fp)
        at = np.flatnonzero(mixed & ~many)
        nth = 0
        while len(at):
            span, had = found.find("part", common.mix(a.id[at] + np.uint64(nth)), a.id[at])
            at, span = at[had], span[had].astype(np.int64)
            np.add.at(edge, a.low[at] + (span >> 24) + start, 1)
            np.add.at(edge, a.low[at] + (span & (1 << 24) - 1) + start + WINDOW, -1)
            nth += 1
    return np.cumsum(edge[:-1]) > 0


def search(docs: DataFrame) -> Found:
    """Find all repeated windows of docs (doc_id, text)."""
    width = common.shuffle_width(docs.sparkSession)
    bits = max(3, (width - 1).bit_length() + 1)
    found = Found(f"{common.shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}-repeats", bits)
    count_contexts(docs, found)
    compare_contexts(docs, found)
    return found


def measure(docs: DataFrame, found: Found) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text counts as empty.
    Rows that repeat stay, and repeat each other's text. Other columns are not read."""
    def read(batches):
        for b in batches:
            for t in common.texts(b.column("text"), common.CHUNK // 2):
                gone = removed(t, found)
                before = np.append(False, gone)[: len(gone)]
                before[t.offsets[:-1][t.offsets[:-1] < len(gone)]] = False
                spans = np.concatenate([[0], np.cumsum(gone & ~before)])
                total = np.concatenate([[0], np.cumsum(gone)])
                kept, size = t.buf[~gone].tobytes(), t.offsets - total[t.offsets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(t.first, t.rows), pa.array(np.diff(t.offsets)), pa.array(np.diff(total[t.offsets])),
                     pa.array(np.diff(spans[t.offsets])),
                     pa.array([hashlib.sha256(kept[a:z]).hexdigest() for a, z in zip(size, size[1:], strict=False)])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        common.released(read), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, found: Found) -> DataFrame:
    """docs with text shortened; pieces of a character that was cut go too. A null text stays null."""
    at = docs.columns.index("text")

    def read(batches):
        for b in batches:
            out = []
            for t in common.texts(b.column("text"), common.CHUNK // 2):
                gone = removed(t, found)
                size = t.offsets - np.concatenate([[0], np.cumsum(gone)])[t.offsets]
                kept = t.buf[~gone].tobytes()
                out += [kept[a:z].decode(errors="ignore") for a, z in zip(size, size[1:], strict=False)]
            null = b.column(at).is_null().to_pylist()
            texts = pa.array([None if x else y for x, y in zip(null, out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(common.released(read), docs.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return measure(docs, search(docs))
