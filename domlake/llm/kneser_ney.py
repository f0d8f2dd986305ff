"""LM scoring by an interpolated modified Kneser-Ney n-gram model.

A text is a row of words and one end. Each word is given the one before it, or the text's start: the highest order
is the pair of words, the next the word by the number of different words it follows. What its discounts leave over goes
to the word spelled out byte by byte: each byte, and the space that closes the word, given the four before it.
So unseen words have honest probabilities and all words together sum to one. Words, pairs and n-grams are counted in
Spark; pairs are dealt by their hash, and what each range holds of a context or of a word that follows is added up in a
second exchange, so a frequent word is no group of its own. Discounts, continuation counts and back-off weights of bytes
are aggregates and joins over the n-gram table. The result is written, by the tasks that hold it, as arrays
sorted by hash into the shared folder; workers memory-map them, so a worker touches only the pages it needs
and nothing of the model passes the driver but the list of files. Word counts for the base score are kept
in the same form.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import arrays, common

#: Bytes of an n-gram, the last given the others.
ORDER = 5
#: Entries that a task adds up before it hands them on.
HELD = 1 << 20
#: Probability of a byte that nothing is known of: 256 bytes and the end of a word.
UNIFORM = 1.0 / 257
#: Bytes of text whose pairs of words go to one range of hashes.
PAIRED = 1 << 24
_SPACE, _END = 32, 10  # neither is part of a word
#: Hashes of a text's start and end, of bytes that are no part of a word.
START, STOP = common.span_hash(np.array([_SPACE, _END], np.uint8), np.array([0, 1]), np.array([1, 2]))


def spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of words, one for each byte and one for the closing space, and where each word's begin."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + ORDER)])
    flat = np.full(begin[-1] + ORDER - 1, _SPACE, np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin[:-1] + ORDER - 1, size) + inner] = buf[np.repeat(starts, size) + inner]
    code = np.zeros(begin[-1], np.uint64)
    for i in range(ORDER):
        code = code << np.uint64(8) | flat[i: i + begin[-1]]
    used = np.arange(begin[-1]) - np.repeat(begin[:-1], size + ORDER) <= np.repeat(size, size + ORDER)
    return code[used], np.concatenate([[0], np.cumsum(size + 1)])


_END_CODES, _ = spelled(np.array([_END], np.uint8), np.array([0]), np.array([1]))


def pairs(w: common.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what stands before and of what follows: for each word, then for the end of each text."""
    some = np.diff(w.first) > 0
    before, last = np.roll(w.hash, 1), np.full(rows, START)
    before[w.first[:-1][some]] = START
    last[some] = w.hash[w.first[1:][some] - 1]
    return np.concatenate([before, last]), np.concatenate([w.hash, np.full(rows, STOP)])


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(before) * np.uint64(0x9E3779B97F4A7C15) + after)


def pair_route(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Says in which range a pair is: that of what stands before, in sixteen parts by what follows, so that a frequent
    word is no range of its own."""
    return common.mix(before + (after >> np.uint64(60)) * np.uint64(0x9E3779B97F4A7C15))


def added_up(keys: np.ndarray, counts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts (the last axis goes along keys) by key, sorted; same: what is equal wherever the key is."""
    if not len(keys):
        return keys, counts, *same
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[..., order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first, axis=-1), *(x[order[first]] for x in same)


class Held:
    """Counts by key, added up whenever so many entries have come in."""

    def __init__(self, same: int = 0, most: int = HELD):
        self.parts, self.n, self.most = [], 0, most
        self.none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * same)

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def full(self) -> bool:
        if self.n > self.most:
            self.parts = [self.sum()]
            self.n = len(self.parts[0][0])
        return self.n > self.most

    def sum(self) -> tuple[np.ndarray, ...]:
        got = added_up(*(np.concatenate(x) for x in zip(*(self.parts or [self.none]), strict=True)))
        self.parts, self.n = [], 0
        return got


_BLOCKS = "kind int, bucket int, keys binary, counts binary"


def packed(kind: int, bits: int, at: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of _BLOCKS for ranges of the hash at; counts may have several lines."""
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted((at[order] >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    keys, size = keys[order], np.min_scalar_type(int(counts.max(initial=0))).itemsize
    counts = counts[..., order].astype(f"<u{size}")
    return [(kind, i, keys[a:z].tobytes(), bytes([size]) + counts[..., a:z].tobytes())
            for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]


def packed_pairs(bits: int, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of _BLOCKS, of kind 2: in keys the number of runs, what stands before each and all that follows, in counts
    the counts and the lengths of the runs."""
    at = pair_route(before, after)
    order = np.argsort(at, kind="stable")
    at, before, after, counts = at[order], before[order], after[order], counts[order]
    cut, rows = np.searchsorted((at >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)), []
    for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
        if z > a:
            first = np.flatnonzero(np.append(True, before[a + 1: z] != before[a: z - 1]))
            size = np.min_scalar_type(int(counts[a:z].max())).itemsize
            rows.append((2, i, np.concatenate([[len(first)], before[a:z][first], after[a:z]], dtype="<u8", casting="unsafe").tobytes(),
                         bytes([size]) + counts[a:z].astype(f"<u{size}").tobytes() + np.diff(first, append=z - a).astype("<u4").tobytes()))
    return rows


def unpacked_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before, what follows, counts."""
    parts = []
    for keys, x in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        k = np.frombuffer(keys, "<u8")
        runs, n = int(k[0]), len(k) - 1 - int(k[0])
        times = np.frombuffer(x, "<u4", runs, 1 + n * x[0])
        parts.append((np.repeat(k[1: 1 + runs], times), k[1 + runs:], np.frombuffer(x, f"<u{x[0]}", n, 1).astype(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def unpacked(table: pa.Table, counts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of blocks, and counts with so many lines."""
    return (np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]),
            np.concatenate([np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64).reshape(counts, -1)
                            for x in table.column("counts").to_pylist()], axis=1))


def counted(docs: DataFrame, bits: int, pair_bits: int) -> DataFrame:
    """Blocks of counts: kind 0 words by hash, kind 1 n-grams by hashed code (codes in keys), kind 2 pairs of words by
    route (packed_pairs), of whole texts."""
    def blocks(kind, keys, counts, *both):
        rows = (packed_pairs(pair_bits, *both, counts) if kind == 2
                else packed(kind, bits, common.mix(keys) if kind else keys, keys, counts))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
            names=["kind", "bucket", "keys", "counts"])

    def count(batches):
        held, ends = (Held(), Held(), Held(2, 2 * HELD)), 0
        for b in batches:
            for t in common.texts(b.column("text")):
                w = common.words(t)
                keys, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                codes, begin = spelled(w.buf, w.starts[at], w.ends[at])
                held[0].add(keys, n)
                held[1].add(*added_up(codes, np.repeat(n, np.diff(begin))))
                before, after = pairs(w, t.rows)
                held[2].add(*added_up(pair_key(before, after), np.ones(len(before), np.int64), before, after))
                ends += t.rows
                for kind in range(3):
                    if held[kind].full():
                        yield blocks(kind, *held[kind].sum())
        held[1].add(_END_CODES, np.full(len(_END_CODES), ends))
        for kind in range(3):
            yield blocks(kind, *held[kind].sum())

    return docs.select("text").mapInArrow(count, _BLOCKS)


def narrow(most: int) -> str:
    """End of the name of a file whose values are counts up to most."""
    return f"~u{np.min_scalar_type(int(most)).itemsize}"


def rare(counts: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four."""
    return np.bincount(np.minimum(counts, 5), minlength=5)[1:5].tolist()


@dataclass
class Model:
    """folder holds an array for each table and range of hashes; files: table -> {range: file name}."""

    folder: str
    bits: dict[str, int]
    files: dict[str, dict[int, str]] = field(default_factory=dict)
    tokens: int = 0
    distinct: int = 0
    texts: int = 0
    followed: int = 0
    cut: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    left: float = 1.0
    pair_cut: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])

    def find(self, table: str, keys: np.ndarray, route: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return arrays.find(self.folder, self.files.get(table, {}), self.bits[table], keys, route)

    def word_log10(self, counts: np.ndarray, spelled_log: np.ndarray) -> np.ndarray:
        """log10 probability, whatever stands before, of words that follow so many different words and are spelled so."""
        seen = (counts - taken(counts, self.cut)) / max(1, self.followed)
        # spellings of very long words have no double of their own, so sums are formed as logarithms
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(seen), np.log(self.left) + spelled_log * np.log(10)) / np.log(10)

    def pair_log10(self, before: np.ndarray, after: np.ndarray, word_log: np.ndarray) -> np.ndarray:
        """log10 probability of words by what stands before them, from that whatever stands before."""
        counts, _ = self.find("pair", pair_key(before, after), pair_route(before, after))
        some, back = np.unique(before, return_inverse=True)
        total = np.where(some == START, self.texts, self.find("w", some)[0])
        off = sum(cut * self.find(name, some)[0] for name, cut in zip(("one", "two", "more"), self.pair_cut, strict=True))
        had = total > 0
        weight = off / np.where(had, total, 1)
        with np.errstate(divide="ignore"):
            seen = np.log((counts - taken(counts, self.pair_cut)) / np.where(had, total, 1.0)[back])
            rest = np.log(np.where(had, weight, 1.0))[back] + word_log * np.log(10)
        return np.logaddexp(seen, rest) / np.log(10)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram given the others."""
        some, back = np.unique(codes, return_inverse=True)
        total = np.zeros(len(some))
        open_, rest = np.arange(len(some)), some
        for n in range(ORDER, 0, -1):
            p, had = self.find(f"p{n}", common.mix(rest))
            total[open_[had]] += np.log10(p[had])
            open_, rest = open_[~had], rest[~had]
            if not len(open_):
                break
            weight, had = self.find(f"g{n}", common.mix(rest >> np.uint64(8)))
            total[open_[had]] += np.log10(weight[had])
            rest = rest & np.uint64((1 << 8 * (n - 1)) - 1)
        total[open_] += np.log10(UNIFORM)
        return total[back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of one, two, and three or more, from how many of each count there are."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    cut = [i - (i + 1) * y * more / own if own else 0.5 * i for i, own, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(cut, 1)]


def taken(counts: np.ndarray, cut: list[float]) -> np.ndarray:
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, cut[0], cut[1]], cut[2])


def smoothed(grams: DataFrame) -> DataFrame:
    """grams (code, c) of the highest order: rows (name, code, value); p<n> holds the probability of each
    n-gram seen, g<n> the back-off weight of each context seen."""
    tables, counts = {}, grams
    for n in range(ORDER, 0, -1):
        tables[n] = counts = common.checkpoint(counts)
        mask = (1 << 8 * (n - 1)) - 1
        counts = counts.groupBy(F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(F.count("*").alias("c"))
    out, lower = None, None
    for n in range(1, ORDER + 1):
        few = tables[n].agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        cut = discounts(*((x or 0) for x in few))
        taken = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        seen = tables[n].withColumn("context", F.shiftright("code", 8))
        context = seen.groupBy("context").agg(F.sum("c").alias("sum"), F.sum(taken).alias("taken"))
        below = F.shiftleft(F.lit(1).cast("long"), 8 * (n - 1)) - 1
        seen = seen.join(context, "context").withColumn("suffix", F.col("code").bitwiseAND(below))
        if lower is None:
            seen = seen.withColumn("low", F.lit(UNIFORM))
        else:
            seen = seen.join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        lower = common.checkpoint(seen.select("code", ((F.col("c") - taken + F.col("taken") * F.col("low")) / F.col("sum")).alias("p")))
        rows = lower.select(F.lit(f"p{n}").alias("name"), "code", F.col("p").alias("value")).unionByName(
            context.select(F.lit(f"g{n}").alias("name"), F.col("context").alias("code"), (F.col("taken") / F.col("sum")).alias("value")))
        out = rows if out is None else out.unionByName(rows)
    return out


def learn(docs: DataFrame) -> Model:
    """Count docs (doc_id, text) outside the held-out fold (crc32 modulo 7); a null text is an empty one.
    From no documents comes a model under which all bytes are as likely."""
    spark = docs.sparkSession
    width = common.shuffle_width(spark)
    bits = max(3, (width - 1).bit_length())
    folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}-lm"
    train = docs.where(~common.held_out(modulus=7))
    few = 2
    texts, size = train.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # ranges of pairs follow the text, so that one stays small
    pair_bits = max(bits, min(16, ((size or 0) // PAIRED).bit_length()))
    packs, stats = "kind int, bucket int, keys binary, counts binary", "c long, n long, most long, rare array<long>"

    def figures(table, counts, *blocks):
        """A row of figures for a range of hashes, and rows of blocks."""
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        rows = [(kind, bucket, None, None, int(counts.sum()), len(counts), int(counts.max()), rare(counts))]
        rows += [(*r, None, None, None, None) for r in blocks]
        return [dict(zip(("kind", "bucket", "keys", "counts", "c", "n", "most", "rare"), r, strict=True)) for r in rows]

    fields = [("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
              ("c", pa.int64()), ("n", pa.int64()), ("most", pa.int64()), ("rare", pa.list_(pa.int64()))]
    schema = pa.schema([*fields, ("code", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        if kind == 0:
            keys, n = unpacked(table)
            keys, n = added_up(keys, n[0])
            arrays.save(folder, f"w-{bucket}{narrow(n.max())}", keys, n)
            return pa.Table.from_pylist(figures(table, n), schema)
        if kind == 2:
            before, after, n = unpacked_pairs(table)
            keys, n, before, after = added_up(pair_key(before, after), n, before, after)
            arrays.save(folder, f"pair-{bucket}{narrow(n.max())}", keys, n)
            held = np.stack([n == 1, n == 2, n > 2]).astype(np.int64)
            contexts, held = added_up(before, held)
            words, first = added_up(after, np.ones(len(after), np.int64))
            return pa.Table.from_pylist(figures(table, n, *packed(3, bits, contexts, contexts, held),
                                                *packed(4, bits, words, words, first)), schema)
        keys, n = unpacked(table)
        keys, n = added_up(keys, n[0])
        full = {"kind": np.full(len(keys), kind), "bucket": np.full(len(keys), bucket), "c": n, "code": keys.view(np.int64)}
        return pa.table([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(len(keys), f.type) for f in schema], schema=schema)

    def finish(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        if kind < 3:
            return table
        keys, n = unpacked(table, 3 if kind == 3 else 1)
        keys, n = added_up(keys, n)
        for name, line in zip(("one", "two", "more") if kind == 3 else ("follows",), n, strict=True):
            arrays.save(folder, f"{name}-{bucket}{narrow(n.max())}", keys[line > 0], line[line > 0])
        return pa.Table.from_pylist(figures(table, n.max(axis=0)), schema)

    columns = f"{packs}, {stats}, code long"
    got = common.staged(counted(train, bits, pair_bits).groupBy("kind", "bucket").applyInArrow(merge, columns)
                        .groupBy("kind", "bucket").applyInArrow(finish, columns))
    model = Model(folder, {x: bits for x in ("w", "one", "two", "more", "follows")} | {"pair": pair_bits}
                  | {f"{t}{n}": few for t in "pg" for n in range(1, ORDER + 1)})
    of = got.where("kind <> 1").select("kind", "bucket", "c", "n", "most", "rare").collect()  # a row for each range of hashes
    words, paired, after = ([r for r in of if r["kind"] == kind] for kind in (0, 2, 4))
    model.texts = texts
    for kind, names in ((0, ("w",)), (2, ("pair",)), (3, ("one", "two", "more")), (4, ("follows",))):
        for name in names:
            model.files[name] = {r["bucket"]: f"{name}-{r['bucket']}{narrow(r['most'])}" for r in of if r["kind"] == kind}
    model.tokens = sum(r["c"] for r in words) + model.texts
    model.distinct = sum(r["n"] for r in words) + (model.texts > 0)
    if model.texts:
        many = lambda some: [sum(r["rare"][i] for r in some) for i in range(4)]
        model.pair_cut, model.followed, own = discounts(*many(paired)), sum(r["c"] for r in after), many(after)
        model.cut = discounts(*own)
        often = sum(r["n"] for r in after) - own[0] - own[1]
        model.left = (model.cut[0] * own[0] + model.cut[1] * own[1] + model.cut[2] * often) / model.followed

    def store(table: pa.Table) -> pa.Table:
        name, bucket = table.column("name")[0].as_py(), table.column("bucket")[0].as_py()
        keys = common.mix(table.column("code").to_numpy().view(np.uint64))
        order = np.argsort(keys, kind="stable")
        arrays.save(folder, f"{name}-{bucket}", keys[order], table.column("value").to_numpy()[order])
        return pa.table({"name": [name], "bucket": pa.array([bucket], pa.int32())})

    def place(batches):
        for b in batches:
            keys = common.mix(b.column("code").to_numpy().view(np.uint64))
            bucket = (keys >> np.uint64(64 - few)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(bucket), b.column("code"), b.column("value")],
                                             names=["name", "bucket", "code", "value"])

    if model.texts:
        stored = (smoothed(got.where("kind = 1").select("code", "c"))
                  .mapInArrow(place, "name string, bucket int, code long, value double")
                  .groupBy("name", "bucket").applyInArrow(store, "name string, bucket int"))
        for r in stored.collect():  # names of files
            model.files.setdefault(r["name"], {})[r["bucket"]] = f"{r['name']}-{r['bucket']}"
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score adds one to the count of every word; score is the model's log10 probability of the text. A
    null or empty text is its end alone. Rows that repeat stay; other columns are not read."""
    rest = np.log10(model.tokens + model.distinct + 1)

    def judge(batches):
        end = float(model.log10(_END_CODES).sum())
        for b in batches:
            for t in common.texts(b.column("text"), 4 * common.CHUNK):
                w = common.words(t)
                keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
                c, _ = model.find("w", keys)
                codes, begin = spelled(w.buf, w.starts[at], w.ends[at])
                spelled_log = np.append(np.add.reduceat(model.log10(codes), begin[:-1]) if len(keys) else np.zeros(0), end)
                follows, _ = model.find("follows", np.append(keys, STOP))
                word_log = model.word_log10(follows, spelled_log)
                before, after = pairs(w, t.rows)
                of = np.concatenate([back, np.full(t.rows, len(keys))])
                _, one, which = np.unique(pair_key(before, after), return_index=True, return_inverse=True)
                pair_log = model.pair_log10(before[one], after[one], word_log[of[one]])[which]
                n = np.diff(w.first)
                per = [np.bincount(w.row, x[back], t.rows) for x in (np.log10(c + 1), (c > 0).astype(float))]
                score_ = np.bincount(np.concatenate([w.row, np.arange(t.rows)]), pair_log, t.rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(t.first, t.rows), pa.array(n + 1, pa.int64()),
                     pa.array(per[1].astype(np.int64) + (model.texts > 0)),
                     pa.array(per[0] + np.log10(model.texts + 1) - (n + 1) * rest), pa.array(score_)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text").mapInArrow(
        judge, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
        .select("doc_id", common.held_out(modulus=7).alias("held_out"), "n_tokens", "n_known",
                F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, learn(docs))
