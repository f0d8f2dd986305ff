"""N-gram Jaccard join: a grouped prefix join.

A document is its set of word shingles. Shingles have one order for all documents: those that many documents
hold come last, the rest by hash. Two sets of the wanted similarity share a shingle of their prefixes, the
first few in that order. A document whose leading shingles are too seldom met elsewhere links with no other text
and stays out of the index. Documents with the same prefix and size are one group in the index from shingles
to groups; groups that share a prefix shingle and are of fitting sizes are candidates, expanded to their
members and verified on whole sets.

Components are wanted, not all links, so a posting list is first compared with one leader (two rounds, with
different leaders); what lies in one component then needs no more comparing, and only pairs across
components are left, all of which are verified. Sets of documents that are in some posting list are kept in
memory-mapped arrays in the shared folder, so verifying shuffles pairs of hashes and no texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import arrays, common

#: A shingle in more prefixes than this (of documents, counted in all of them) comes late in the order.
OFTEN = 64
#: Rounds of comparing each posting list with one of its members.
STARS = 2
#: Parts that the posting list of an often-met shingle is dealt to.
SALTS = 16
#: Bits of a set's bitmap, in words of 64.
BITS = 512
_WORDS = [f"b{i}" for i in range(BITS // 64)]
#: Index entries, and bytes of sets, that a task holds before it hands them on.
HELD, HELD_BYTES = 1 << 18, 1 << 22


def shingle_sets(t: common.Texts, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; all its words as one if they are fewer."""
    w = common.words(t)
    grams = common.runs(w.hash, k)
    out = []
    for a, z in zip(w.first, w.first[1:], strict=False):
        if z - a >= k:
            out.append(np.unique(grams[a: z - k + 1]))
        elif z > a:
            out.append(common.mix(common.runs(w.hash[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def least_shared(n: int, percent: int) -> int:
    """How many of the first 3/2 prefix_size shingles by hash a set of n has in common with any set it links
    to, at the least: sets that share the part wanted of n share one of their prefixes, and one more for
    each shingle that both prefixes are drawn out by."""
    return prefix_size(-(-percent * n // 100), percent) // 2 + 1


def set_hash(s: np.ndarray) -> np.uint64:
    return common.mix(np.array([common.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _binary(*columns) -> list[pa.Array]:
    return [pa.array(c, pa.binary()) for c in columns]


class Index:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        spark = docs.sparkSession
        self.k, self.percent = k, percent
        self.bits = max(3, (common.shuffle_width(spark) - 1).bit_length() + 1)
        self.folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}-sets"
        self.files: dict[str, dict[int, str]] = {}

    def find(self, table: str, keys: np.ndarray):
        return arrays.find(self.folder, self.files.get(table, {}), self.bits, keys)

    def cuts(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted((hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))


def count_shared(docs: DataFrame, index: Index) -> None:
    """Table "shared": shingles that are in two and more documents' prefixes and half as much again, by hash
    alone, with how many."""
    bits, folder, k, percent, cuts = index.bits, index.folder, index.k, index.percent, index.cuts

    def emit(parts):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = cuts(keys)
        rows = [(i, keys[a:z].tobytes(), n[a:z].astype("<u4").tobytes()) for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *_binary([r[1] for r in rows], [r[2] for r in rows])],
                                          names=["bucket", "keys", "n"])

    def read(batches):
        parts, size = [], 0
        for b in batches:
            for t in common.texts(b.column("text")):
                for s in shingle_sets(t, k):
                    parts.append(s[: 3 * prefix_size(len(s), percent) // 2])
                    size += len(parts[-1])
                if size > HELD:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        total = np.add.reduceat(n[order], first)
        shared = total > 1
        arrays.save(folder, f"shared-{bucket}", keys[order][first][shared], total[shared].astype(float))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([int(shared.sum())], pa.int64())})

    rows = (common.by_bucket(docs.select("text").mapInArrow(read, "bucket int, keys binary, n binary"))
            .applyInArrow(merge, "bucket int, n long").collect())  # a row for each range of hashes
    index.files["shared"] = {r["bucket"]: f"shared-{r['bucket']}" for r in rows if r["n"]}


def signatures(docs: DataFrame, index: Index) -> DataFrame:
    """Rows of documents: doc_id, n, set (hash of the set), grp (hash of prefix and size; null if the document
    shares too few shingles to link with another text); and index entries, packed by range of shingle
    hashes (entries of often-met shingles also by group)."""
    bits, k, percent = index.bits, index.k, index.percent

    def emit(parts):
        token, grp, n, late = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = common.mix(token * np.uint64(3) + grp)
        _, keep = np.unique(key, return_index=True)
        token, grp, n, late = token[keep], grp[keep], n[keep], late[keep]
        route = np.where(late, common.mix(token + grp % np.uint64(SALTS)), token) >> np.uint64(64 - bits)
        order = np.lexsort((token, route))
        token, grp, n, late, route = token[order], grp[order], n[order], late[order], route[order].astype(np.int64)
        cut = np.searchsorted(route, np.arange((1 << bits) + 1))
        rows = [(i, a, z) for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        return pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(rows), pa.int64()) for _ in range(4 + len(_WORDS))), pa.array([r[0] for r in rows], pa.int32()),
             *_binary([token[a:z].tobytes() for _, a, z in rows], [grp[a:z].tobytes() for _, a, z in rows],
                      [n[a:z].astype("<u4").tobytes() for _, a, z in rows], [late[a:z].tobytes() for _, a, z in rows])], names=names)

    names = ["doc_id", "n", "set", "grp", *_WORDS, "bucket", "tokens", "grps", "sizes", "late"]

    def _rows(ids, *columns):
        m = len(ids)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns), pa.nulls(m, pa.int32()),
                                           *(pa.nulls(m, pa.binary()) for _ in range(4))], names=names)

    def read(batches):
        parts, size = [], 0
        for b in batches:
            for t in common.texts(b.column("text")):
                sets = shingle_sets(t, k)
                pools = [s[: 3 * prefix_size(len(s), percent) // 2] for s in sets]
                count, _ = index.find("shared", np.concatenate(pools))
                edge = np.concatenate([[0], np.cumsum([len(p) for p in pools])])
                shared = np.concatenate([[0], np.cumsum(count > 1)])[edge]
                ns, hashes, grps, maps = [], [], [], []
                for s, c in zip(sets, np.diff(shared).tolist(), strict=True):
                    ns.append(len(s))
                    hashes.append(int(set_hash(s).astype(np.int64)) if len(s) else None)
                    if not len(s) or c < least_shared(len(s), percent):
                        grps.append(None)
                        maps.append(None)
                        continue
                    maps.append(bitmap(s).tolist())
                    late = index.find("shared", s)[0] > OFTEN
                    size_ = prefix_size(len(s), percent)
                    order = np.concatenate([np.flatnonzero(~late)[:size_], np.flatnonzero(late)])[:size_]
                    grp = set_hash(np.append(s[order], np.uint64(len(s))))
                    grps.append(int(grp.astype(np.int64)))
                    parts.append((s[order], np.full(size_, grp), np.full(size_, len(s)), late[order]))
                    size += size_
                yield _rows(b.column("doc_id").slice(t.first, t.rows), ns, hashes, grps,
                            *([m and m[i] for m in maps] for i in range(len(_WORDS))))
                if size > HELD:
                    yield emit(parts)
                    parts, size = [], 0
        if parts:
            yield emit(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        common.released(read), f"doc_id long, n long, set long, grp long, {', '.join(f'{w} long' for w in _WORDS)}, bucket int, tokens binary, grps binary, sizes binary, late binary")


def postings(entries: DataFrame, percent: int) -> DataFrame:
    """(list, grp): lists of two groups and more, with some pair of fitting sizes; a list's name is the hash
    of its groups, so equal lists are one. Parts of a dealt list keep all their groups under its shingle."""
    def gather(table: pa.Table) -> pa.Table:
        token, grp = (np.concatenate([np.frombuffer(x, "<u8") for x in table.column(c).to_pylist()]) for c in ("tokens", "grps"))
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("sizes").to_pylist()]).astype(np.int64)
        late = np.concatenate([np.frombuffer(x, bool) for x in table.column("late").to_pylist()])
        order = np.lexsort((grp, n, token))
        token, grp, n, late = token[order], grp[order], n[order], late[order]
        again = np.append(False, (token[1:] == token[:-1]) & (grp[1:] == grp[:-1]))
        token, grp, n, late = token[~again], grp[~again], n[~again], late[~again]
        near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
        # a group with no neighbour of a fitting size in the list has no partner there
        use = late | np.append(False, near) | np.append(near, False)
        token, grp, late = token[use], grp[use], late[use]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(token)))
        name = common.mix(np.add.reduceat(common.mix(grp), first)) if len(first) else first.astype(np.uint64)
        name = np.where(late, token, np.repeat(name, size))
        return pa.table({"list": name.view(np.int64), "grp": grp.view(np.int64)})

    rows = common.by_bucket(entries).applyInArrow(gather, "list long, grp long").distinct()
    return rows


def save_sets(docs: DataFrame, index: Index, wanted: DataFrame) -> None:
    """Keep the sets of documents whose set hash is wanted, once each."""
    bits, folder, k = index.bits, index.folder, index.k

    def mark(table: pa.Table) -> pa.Table:
        keys = np.sort(table.column("set").to_numpy().view(np.uint64))
        bucket = table.column("bucket")[0].as_py()
        arrays.save(folder, f"wanted-{bucket}", keys, np.ones(len(keys)))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    rows = (wanted.select("set").distinct().withColumn("bucket", F.shiftrightunsigned("set", 64 - bits).cast("int"))
            .groupBy("bucket").applyInArrow(mark, "bucket int").collect())
    index.files["wanted"] = {r["bucket"]: f"wanted-{r['bucket']}" for r in rows}

    def emit(held: dict[int, np.ndarray]):
        by: dict[int, list] = {}
        for h in held:
            by.setdefault(h >> (64 - bits), []).append(h)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(by), pa.int32()), *_binary([np.array(x, "<u8").tobytes() for x in by.values()],
                                                      [np.array([len(held[h]) for h in x], "<u4").tobytes() for x in by.values()],
                                                      [b"".join(held[h].tobytes() for h in x) for x in by.values()])],
            names=["bucket", "sets", "sizes", "tokens"])

    def read(batches):
        held, size = {}, 0
        for b in batches:
            for t in common.texts(b.column("text")):
                sets = [s for s in shingle_sets(t, k) if len(s)]
                hashes = np.array([set_hash(s) for s in sets], np.uint64)
                _, use = index.find("wanted", hashes)
                for s, h, u in zip(sets, hashes.tolist(), use.tolist(), strict=True):
                    if u and h not in held:
                        held[h] = s
                        size += s.nbytes
                if size > HELD_BYTES:
                    yield emit(held)
                    held, size = {}, 0
        if held:
            yield emit(held)

    def keep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        all_: dict[int, np.ndarray] = {}
        for sets, sizes, tokens in zip(*(table.column(c).to_pylist() for c in ("sets", "sizes", "tokens")), strict=True):
            at = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
            flat = np.frombuffer(tokens, "<u8")
            for h, s in zip(np.frombuffer(sets, "<u8").tolist(), np.split(flat, at[:-1]), strict=True):
                all_.setdefault(h, s)
        keys = np.array(sorted(all_), np.uint64)
        size = np.array([len(all_[h]) for h in keys.tolist()], np.int64)
        end = np.cumsum(size)
        arrays.save(folder, f"from-{bucket}", keys, (end - size).astype(float))
        arrays.save(folder, f"size-{bucket}", keys, size.astype(float))
        flat = np.concatenate([all_[h] for h in keys.tolist()])
        arrays.save(folder, f"flat-{bucket}", flat, np.zeros(0))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    rows = (common.by_bucket(docs.select("text").mapInArrow(read, "bucket int, sets binary, sizes binary, tokens binary"))
            .applyInArrow(keep, "bucket int").collect())
    for table in ("from", "size", "flat"):
        index.files[table] = {r["bucket"]: f"{table}-{r['bucket']}" for r in rows}


def verified(pairs: DataFrame, index: Index) -> DataFrame:
    """Pairs (a, b) of set hashes whose sets are similar enough."""
    bits, percent = index.bits, index.percent

    def check(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            place = [(index.find("from", x)[0].astype(np.int64), index.find("size", x)[0].astype(np.int64)) for x in (a, b)]
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (arrays.flat(index.folder, index.files["flat"][int(h) >> (64 - bits)])[f[i]: f[i] + s[i]]
                        for h, (f, s) in zip((a[i], b[i]), place, strict=True))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return pairs.mapInArrow(check, "a long, b long")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when their sets of k-word shingles have a Jaccard similarity of percent or more,
    compared as whole numbers. component_id is the smallest doc_id reachable by links, the document's own
    included. A null, empty or blank text has no shingles, no links and its own doc_id. Documents with the
    same set link however many there are; they are one set in the join. Rows that repeat stay. Sets and
    shingles are compared by 64-bit hashes. Other columns are not read; no rows give no rows."""
    spark = docs.sparkSession
    index = Index(docs, k, percent)
    count_shared(docs, index)
    signed = common.staged(signatures(docs, index))
    rows = signed.where("bucket is null").select("doc_id", "n", "set", "grp", *_WORDS)
    lists = postings(signed.where("bucket is not null").select("bucket", "tokens", "grps", "sizes", "late"), percent)
    members = rows.where("grp is not null").select("grp", "set", "n", *_WORDS).distinct()
    twins = members.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1").select(F.col("grp").alias("list"), "grp")
    open_ = common.staged(lists.unionByName(twins).join(members, "grp").select("list", "set", "n", *_WORDS).distinct())
    save_sets(docs, index, open_)
    links, part = spark.createDataFrame([], "a long, b long"), None
    for turn in range(STARS + 1):
        now = open_.withColumn("part", F.col("set")) if part is None else (
            open_.join(part, open_["set"] == part["id"], "left").select("list", "set", "n", *_WORDS, F.coalesce("component", "set").alias("part")))
        mixed = now.groupBy("list").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("list")
        now = common.staged(now.join(mixed, "list"))
        fields = ["set", "n", "part", *_WORDS]
        if turn < STARS:
            leads = now.groupBy("list").agg(F.min_by(F.struct(*fields), F.xxhash64("set", F.lit(turn))).alias("lead"))
            leads = leads.select("list", *(F.col(f"lead.{c}").alias(f"u_{c}") for c in fields))
        else:
            leads = now.select("list", *(F.col(c).alias(f"u_{c}") for c in fields))
        apart = " + ".join(f"bit_count({w} ^ u_{w})" for w in _WORDS)
        pairs = (now.join(leads, "list").where("set < u_set" if turn == STARS else "true")
                 .where(f"part <> u_part and 100 * least(n, u_n) >= {percent} * greatest(n, u_n) "
                        f"and ({apart}) * {100 + percent} <= {100 - percent} * (n + u_n)")
                 .withColumnsRenamed({"set": "v", "u_set": "u"})
                 .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        new = common.checkpoint(verified(pairs.repartition(4 * common.shuffle_width(spark), "a", "b"), index))
        open_ = now.select("list", "set", "n", *_WORDS)
        if new.limit(1).count():
            links = common.checkpoint(links.unionByName(new.coalesce(common.shuffle_width(spark))))
            part = common.components(links)
    if part is None:
        part = spark.createDataFrame([], "id long, component long")
    placed = rows.join(part, rows["set"] == part["id"], "left").select("doc_id", "n", F.coalesce("component", "set").alias("part"))
    least = placed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "part", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir), k=3, percent=90)
