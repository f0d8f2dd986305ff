"""Phrase collocation mining with Rabin-Karp fingerprints.

Prefix polynomials over the words' hashes give the fingerprint of every n-gram in a few numpy steps. Fingerprints
are counted level by level: an n-gram can be frequent only if both its shorter ones are, so words are counted first,
then pairs of frequent words, and so on. What is shuffled is, for each n-gram of a task, its fingerprint, its count and
a pointer to one occurrence: the hash of a text and a word's place in it. Only the texts that frequent
n-grams point to are read for their words, which are stored once, in the shared folder, sorted by
fingerprint. A last pass then holds every occurrence of a frequent fingerprint against the stored text; what differs
is counted by its text and taken off, so counts are exact whatever the fingerprints. The rest, scores and ranks, is
SQL over the frequent phrases.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domlake.llm import arrays, common

#: What ends a piece, apart from line ends; and what stands between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Language of texts that name none.
UNKNOWN = "und"
#: Entries that a task adds up before it hands them on.
HELD = 1 << 20
#: Parts into which each language's phrases are dealt before the best are chosen.
SALTS = 64
_ENDS = common.separator_table(tuple(PIECE_ENDS))
_SEPARATORS = common.separator_table(tuple(PIECE_ENDS + BLANKS))


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


@dataclass
class Grams:
    """Words of some texts with their prefix polynomial: fingerprints of the n-grams that start at each word."""

    words: common.Words
    breaks: np.ndarray  # pieces begun up to each word
    prefix: np.ndarray
    lang: np.ndarray  # hash of each row's language
    mask: np.uint64

    def at(self, n: int) -> np.ndarray:
        """Words at which n words of one piece start."""
        last = len(self.breaks) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.breaks[n - 1:] == self.breaks[:last])

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        _, down = common.powers(len(self.prefix))
        run = (self.prefix[at + n] - self.prefix[at]) * down[at]
        return common.mix(run + self.lang[self.words.row[at]] + np.uint64(n)) & self.mask


def grams(t: common.Texts, langs: np.ndarray, mask: int) -> Grams:
    w = common.words(t, _SEPARATORS)
    ended = np.append(0, np.cumsum(_ENDS[w.buf]))
    gap = np.zeros(len(w.starts), np.int64)
    gap[1:] = (ended[w.starts[1:]] != ended[w.ends[:-1]]) | (w.row[1:] != w.row[:-1])
    up, _ = common.powers(len(w.hash) + 1)
    prefix = np.append(np.uint64(0), np.cumsum(common.mix(w.hash) * up[:len(w.hash)]))
    return Grams(w, np.cumsum(gap), prefix, langs, np.uint64(mask))


def languages(column: pa.Array, t: common.Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch's rows t: names, the number of each row's, and the hash of each row's."""
    coded = column.slice(t.first, t.rows).fill_null(UNKNOWN).cast(pa.string()).dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    return names, number, np.array([language_hash(x) for x in names], np.uint64)[number]


def text_hashes(t: common.Texts) -> np.ndarray:
    """A hash of each whole text, letter case aside."""
    return common.span_hash(common.LOWER[t.buf], t.offsets[:-1], t.offsets[1:])


class Counts:
    """Count and one pointer by fingerprint, added up whenever HELD entries have come in."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.n += len(part[0])

    def sum(self) -> tuple[np.ndarray, ...]:
        key, count, text, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(count[order], first) if len(key) else count
        return key[first], count, text[order[first]], at[order[first]]

    def full(self) -> bool:
        if self.n <= HELD:
            return False
        self.parts = [self.sum()]
        self.n = len(self.parts[0][0])
        return self.n > HELD // 2


@dataclass
class Level:
    """Frequent n-grams of one length: a file of sorted fingerprints for each range."""

    folder: str
    files: dict[int, str]
    bits: int

    def known(self, keys: np.ndarray) -> np.ndarray:
        some, back = np.unique(keys, return_inverse=True)
        return arrays.find(self.folder, self.files, self.bits, some)[1][back]


def occurrences(g: Grams, n: int, below: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Words at which n-grams start whose shorter ones are all frequent, and their fingerprints."""
    frequent = np.ones(len(g.breaks) + 1, bool)
    for m in range(1, n + 1):
        at = g.at(m)
        at = at[frequent[at] & frequent[at + (m > 1)]]
        keys = g.fingerprints(m, at)
        if m < n:
            frequent = np.zeros(len(g.breaks) + 1, bool)
            frequent[at] = below[m - 1].known(keys)
    return at, keys


_BLOCKS = "bucket int, keys binary, counts binary, texts binary, places binary"
_POINTERS = "bucket int, key long, c long, text_hash long, place long"


def counted(docs: DataFrame, n: int, least: int, below: list[Level], folder: str, bits: int, mask: int) -> tuple[DataFrame, Level]:
    """Fingerprints of n-grams that occur least times or more: bucket, key, c, text_hash, place. Groups are ranges of
    fingerprints, to which each task hands one entry a fingerprint, however often it occurs."""
    top = np.uint64(64 - bits)

    def blocks(keys, counts, text, place):
        cut = np.searchsorted((keys >> top).astype(np.int64), np.arange((1 << bits) + 1))
        rows = [(i, keys[a:z].tobytes(), bytes([kind.itemsize]) + counts[a:z].astype(kind).tobytes(), text[a:z].tobytes(), place[a:z].astype("<u4").tobytes())
                for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a
                for kind in [np.min_scalar_type(int(counts[a:z].max()))]]
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["bucket", "keys", "counts", "texts", "places"])

    def count(batches):
        held = Counts()
        for b in batches:
            for t in common.texts(b.column("text")):
                g = grams(t, languages(b.column("lang"), t)[2], mask)
                at, keys = occurrences(g, n, below)
                some, first, times = np.unique(keys, return_index=True, return_counts=True)
                row = g.words.row[at[first]]
                held.add(some, times, text_hashes(t)[row], at[first] - g.words.first[row])
                if held.full():
                    yield blocks(*held.sum())
                    held = Counts()
        if held.parts:
            yield blocks(*held.sum())

    def merge(table: pa.Table) -> pa.Table:
        held = Counts()
        for keys, counts, text, place in zip(*(table.column(x).to_pylist() for x in ("keys", "counts", "texts", "places")), strict=True):
            held.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, f"<u{counts[0]}", offset=1).astype(np.int64),
                     np.frombuffer(text, "<u8"), np.frombuffer(place, "<u4"))
        keys, c, text, place = held.sum()
        often = c >= least
        keys, c, text, place = keys[often], c[often], text[often], place[often]
        bucket = table.column("bucket")[0].as_py()
        arrays.save(folder, f"n{n}-{bucket}", keys, c)
        return pa.table({"bucket": pa.array([bucket] * len(keys), pa.int32()), "key": keys.view(np.int64), "c": c,
                         "text_hash": text.view(np.int64), "place": place.astype(np.int64)})

    got = common.staged(common.by_bucket(docs.mapInArrow(common.released(count), _BLOCKS)).applyInArrow(merge, _POINTERS))
    files = {r["bucket"]: f"n{n}-{r['bucket']}" for r in got.select("bucket").distinct().collect()}
    return got.drop("bucket"), Level(folder, files, bits)


def materialised(docs: DataFrame, pointers: DataFrame, folder: str, bits: int, mask: int) -> DataFrame:
    """The words at pointers (n, key, text_hash, place): rows (n, key, lang, phrase). Workers map the pointers, by
    ranges of text hashes; other texts are hashed and passed over."""
    by_text = pointers.withColumn("bucket", F.shiftrightunsigned("text_hash", 64 - bits).cast("int"))

    def write(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        cells = [table.column(x).to_numpy().astype(np.int64).view(np.uint64) for x in ("text_hash", "key", "place", "n")]
        order = np.argsort(cells[0], kind="stable")
        arrays.save(folder, f"at-{bucket}", np.concatenate([c[order] for c in cells]), np.zeros(0))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    buckets = {r["bucket"] for r in common.by_bucket(by_text).applyInArrow(write, "bucket int").collect()}

    def find(batches):
        for b in batches:
            for t in common.texts(b.column("text")):
                hashes = text_hashes(t)
                rows, cells = [], []
                for bucket in np.unique(hashes >> np.uint64(64 - bits)).tolist():
                    if bucket in buckets:
                        have = arrays.flat(folder, f"at-{bucket}").reshape(4, -1)
                        mine = np.flatnonzero(hashes >> np.uint64(64 - bits) == bucket)
                        a, z = (np.searchsorted(have[0], hashes[mine], side) for side in ("left", "right"))
                        many = z - a
                        rows.append(np.repeat(mine, many))
                        cells.append(have[1:, np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())])
                if not sum(map(len, rows)):
                    continue
                row, (key, place, n) = np.concatenate(rows), np.concatenate(cells, axis=1)
                names, number, langs = languages(b.column("lang"), t)
                g = grams(t, langs, mask)
                start = g.words.first[row] + place.astype(np.int64)
                out = {k: [] for k in ("n", "key", "lang", "phrase")}
                data = g.words.buf.tobytes()
                for size in np.unique(n).tolist():
                    at, mine = start[n == size], np.flatnonzero(n == size)
                    right = at + size <= g.words.first[row[mine] + 1]
                    at, mine = at[right], mine[right]
                    right = g.fingerprints(size, at) == key[mine]  # texts of one hash may differ, in language too
                    at, mine = at[right], mine[right]
                    _, one = np.unique(key[mine], return_index=True)
                    for a, m in zip(at[one].tolist(), mine[one].tolist(), strict=True):
                        out["n"].append(size)
                        out["key"].append(int(key[m].astype(np.int64)))
                        out["lang"].append(names[number[row[m]]])
                        out["phrase"].append(b" ".join(data[x:y] for x, y in zip(g.words.starts[a:a + size].tolist(), g.words.ends[a:a + size].tolist(), strict=True)).decode())
                yield pa.RecordBatch.from_arrays([pa.array(out["n"], pa.int32()), pa.array(out["key"], pa.int64()), pa.array(out["lang"], pa.string()),
                                                  pa.array(out["phrase"], pa.string())], names=list(out))

    return (docs.mapInArrow(common.released(find), "n int, key long, lang string, phrase string")
            .groupBy("n", "key").agg(F.min(F.struct("lang", "phrase")).alias("s")).select("n", "key", "s.lang", "s.phrase"))


@dataclass
class Store:
    """Stored phrases: a file for each length and range of fingerprints with the fingerprints, where texts end, and the
    texts, each the language, a zero and the phrase."""

    folder: str
    files: set[str]
    bits: int

    def write(self, n: int, bucket: int, keys: np.ndarray, texts: list[bytes]) -> None:
        order = np.argsort(keys, kind="stable")
        blob = b"".join(texts[i] for i in order)
        ends = np.cumsum([0, *(len(texts[i]) for i in order)]).astype(np.uint64)
        blob = np.frombuffer(blob + b"\0" * (-len(blob) % 8), "<u8")
        arrays.save(self.folder, f"text{n}-{bucket}", np.concatenate([[np.uint64(len(keys))], keys[order], ends, blob]), np.zeros(0))

    def lookup(self, n: int, keys: np.ndarray):
        """For each range that keys fall into: which keys are stored, where their texts begin and end, and the bytes."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1))
        for at in np.flatnonzero(np.diff(cut)).tolist():
            if f"text{n}-{at}" in self.files:
                flat = arrays.flat(self.folder, f"text{n}-{at}")
                size = int(flat[0])
                have, ends = flat[1:size + 1], flat[size + 1:2 * size + 2].astype(np.int64)
                mine = order[cut[at]:cut[at + 1]]
                i = np.minimum(np.searchsorted(have, keys[mine]), size - 1)
                hit = have[i] == keys[mine]
                yield mine[hit], ends[i[hit]], ends[i[hit] + 1], flat[2 * size + 2:].view(np.uint8)


def same_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether left[a:a + size] is right[b:b + size], for each of some places."""
    begin = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(begin, size)
    differ = left[np.repeat(a, size) + step] != right[np.repeat(b, size) + step]
    return np.diff(np.append(0, np.cumsum(differ))[np.append(begin, size.sum())]) == 0


def word_numbers(w: common.Words) -> np.ndarray:
    """A number for each word, the same for the same bytes and no others."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    size = w.ends - w.starts
    lead = first[number]
    same = size == size[lead]
    at = np.flatnonzero(same)
    same[at] = same_bytes(w.buf, w.starts[at], w.buf, w.starts[lead[at]], size[at])
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # another word with the hash
        number[i] = len(first) + own.setdefault(w.buf[w.starts[i]:w.ends[i]].tobytes(), len(own))
    return number


def differing(docs: DataFrame, words: int, store: Store, mask: int) -> DataFrame:
    """Occurrences of stored fingerprints whose words or language are not those stored: n, key, lang, phrase, c.

    The first occurrence of a fingerprint in some texts is held against the store, byte by byte, the others
    against the first, by words that are numbered by their bytes."""
    def verify(batches):
        for b in batches:
            for t in common.texts(b.column("text")):
                names, number, langs = languages(b.column("lang"), t)
                g = grams(t, langs, mask)
                w, known = g.words, word_numbers(g.words)
                lang = number[w.row]
                spelled = np.frombuffer(b"".join(x.encode() + b"\0" for x in names), np.uint8)
                long_ = np.array([len(x.encode()) + 1 for x in names])
                begin = np.cumsum(long_) - long_
                found: dict[tuple, int] = {}
                frequent = np.ones(len(g.breaks) + 1, bool)
                for n in range(1, words + 1):
                    at = g.at(n)
                    at = at[frequent[at] & frequent[at + (n > 1)]]
                    keys, first, back = np.unique(g.fingerprints(n, at), return_index=True, return_inverse=True)
                    head = at[first]
                    stored, right, texts = np.zeros(len(keys), bool), np.zeros(len(keys), bool), []
                    for mine, start, end, blob in store.lookup(n, keys):
                        texts.append((mine, start, end, blob))
                        length = [long_[lang[head[mine]]], *(w.ends[head[mine] + i] - w.starts[head[mine] + i] for i in range(n))]
                        fits = end - start == sum(length) + n - 1
                        place = start
                        for i, size in enumerate(length):
                            ok = np.flatnonzero(fits)
                            from_ = begin[lang[head[mine]]] if i == 0 else w.starts[head[mine] + i - 1]
                            fits[ok] = same_bytes(spelled if i == 0 else w.buf, from_[ok], blob, place[ok], size[ok])
                            place = place + size + (i > 0)
                        stored[mine], right[mine] = True, fits
                    frequent = np.zeros(len(g.breaks) + 1, bool)
                    frequent[at] = stored[back]
                    lead = head[back]
                    alike = lang[at] == lang[lead]
                    for i in range(n):
                        alike &= known[at + i] == known[lead + i]
                    bad = np.flatnonzero(stored[back] & ~(alike & right[back]))
                    if len(bad):
                        wrong = set(back[bad].tolist())
                        held = {int(m): blob[x:y].tobytes() for mine, start, end, blob in texts
                                for m, x, y in zip(mine, start, end, strict=True) if m in wrong}
                        for m in bad.tolist():
                            a = int(at[m])
                            phrase = b" ".join(w.buf[w.starts[a + i]: w.ends[a + i]].tobytes() for i in range(n))
                            if names[lang[a]].encode() + b"\0" + phrase != held[int(back[m])]:
                                what = n, int(keys[back[m]].astype(np.int64)), names[lang[a]], phrase.decode()
                                found[what] = found.get(what, 0) + 1
                if found:
                    columns = list(zip(*((*k, c) for k, c in found.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                                     names=["n", "key", "lang", "phrase", "c"])

    return (docs.mapInArrow(common.released(verify), "n int, key long, lang string, phrase string, c long")
            .groupBy("n", "key", "lang", "phrase").agg(F.sum("c").alias("c")))


def frequent(docs: DataFrame, words: int = 3, least: int = 10, fingerprint_bits: int = 64) -> DataFrame:
    """docs (text, lang): lang, n, phrase, f for every phrase of at most so many words that occurs least times or more
    within the pieces of its language's texts. Exact; fewer fingerprint_bits only make more collisions to settle.

    A null text is an empty one, a null lang is UNKNOWN; other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select("text", "lang")
    bits = max(3, (common.shuffle_width(spark) - 1).bit_length())
    folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}-phrases"
    mask = ~((1 << 64 - fingerprint_bits) - 1) & ((1 << 64) - 1)
    levels, pointers = [], None
    for n in range(1, words + 1):
        rows, level = counted(docs, n, least, levels, folder, bits, mask)
        levels = [*levels, level]
        rows = rows.withColumn("n", F.lit(n))
        pointers = rows if pointers is None else pointers.unionByName(rows)
    stored = common.staged(materialised(docs, pointers, folder, bits, mask))
    store = Store(folder, set(), bits)

    def write(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
        texts = [f"{lang}\0{phrase}".encode() for lang, phrase in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist(), strict=True)]
        n, bucket = table.column("n")[0].as_py(), table.column("bucket")[0].as_py()
        store.write(n, bucket, keys, texts)
        return pa.table({"file": [f"text{n}-{bucket}"]})

    by_range = stored.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    written = by_range.repartition(common.shuffle_width(spark), "n", "bucket").groupBy("n", "bucket").applyInArrow(write, "file string").collect()
    other = common.checkpoint(differing(docs, words, Store(folder, {r["file"] for r in written}, bits), mask))
    taken = other.groupBy("n", "key").agg(F.sum("c").alias("gone"))
    kept = (stored.join(pointers.select("n", "key", "c"), ["n", "key"]).join(taken, ["n", "key"], "left")
            .select("lang", "n", "phrase", (F.col("c") - F.coalesce("gone", F.lit(0))).alias("f")))
    return kept.unionByName(other.select("lang", "n", "phrase", F.col("c").alias("f"))).where(F.col("f") >= least)


def totals(docs: DataFrame) -> DataFrame:
    """lang, total: the words of each language's texts."""
    def count(batches):
        for b in batches:
            sums: dict[str, int] = {}
            for t in common.texts(b.column("text")):
                names, number, _ = languages(b.column("lang"), t)
                each = np.bincount(number, np.diff(common.words(t, _SEPARATORS).first), len(names))
                for name, c in zip(names, each.tolist(), strict=True):
                    sums[name] = sums.get(name, 0) + int(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "total"])

    return docs.select("text", "lang").mapInArrow(count, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def collocations(docs: DataFrame, words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """docs (text, lang): lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words to the
    given number. a is the phrase's count, l and r those of its two parts at the cut that scores least (the
    first of equal ones), n the language's words, score floor(1000000 a a / (l r)).

    Phrases inside a longer one with at least so many per cent of their count give way to it. Ties go by count, then
    by phrase, in the order of bytes. A null text is empty, a null lang is UNKNOWN; repeated rows count again; texts are
    read whole; other columns are not read, whatever their names. No frequent phrase, no rows."""
    counts = common.staged(frequent(docs, words, least))
    listed = counts.withColumn("w", F.split("phrase", " ")).where("n > 1")
    cuts = listed.select("lang", "n", "phrase", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).select(
        "lang", "n", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("n") - F.col("k"))).alias("right"))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    big = "decimal(19,0)"
    scored = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
              .withColumn("score", F.expr(f"(cast(cast(a as {big}) * cast(a as {big}) as decimal(32,0)) * 1000000) div (cast(l as {big}) * cast(r as {big}))"))
              .groupBy("lang", "phrase").agg(F.first("n").alias("size"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")))
    # phrases of two words or more within longer ones, without those themselves
    inner = (listed.where("n > 2").select("lang", "n", "f", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
             .select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i"))
             .select("lang", "f", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("m"))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or cast(longer as {big}) * 100 < cast(a as {big}) * {int(inside)}")
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top))
    return best.join(totals(docs), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, x FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
w AS (SELECT piece, lang, list_filter(regexp_split_to_array(x, '[ \x09]+'), lambda y: y <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(s[1:k], ' ') AS left_, array_to_string(s[k + 1:m], ' ') AS right_
  FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.left_ JOIN f r ON r.lang = c.lang AND r.phrase = c.right_),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS at FROM scored),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, array_to_string(s[i:i + 1], ' ') AS phrase
    FROM (SELECT lang, f, string_split(phrase, ' ') AS s, unnest([1, 2]) AS i FROM f WHERE m = 3)) GROUP BY ALL),
kept AS (
  SELECT x.* FROM least x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE x.at = 1 AND (y.f IS NULL OR 100 * y.f < 50 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r,
       n.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
