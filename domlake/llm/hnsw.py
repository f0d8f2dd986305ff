"""Embedding near-dedup: a hierarchical navigable small-world graph for each shard.

Vectors of one label and size are dealt to shards by hash. Each shard's graph is built in one task, audited
against brute force on a sample of its vectors and of slightly turned ones, its beam doubled until the
audit passes, and written to the shared folder. Every vector then asks every shard of its label; tasks
memory-map the graphs, so no task holds more than some asking vectors. Neighbours are verified by cosine
in double precision. Equal vectors are one node with a weight, however many there are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import arrays, common

#: Cosine from which two vectors link.
COSINE = 0.98
#: Vectors of a shard, about; neighbours of a node; candidates when a node is put in.
SHARD, LINKS, WIDE = 8192, 24, 64
#: First beam, the recall that an audit asks for, and how many vectors it asks with.
BEAM, RECALL, AUDIT = 16, 0.97, 48
#: Vectors that are put in, or ask, at once.
BATCH = 256


def search(vectors: np.ndarray, links: np.ndarray, asking: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a layer for many vectors together: (ids, cosines) of the beam, -1 where short."""
    rows, n = len(asking), len(vectors)
    ids = np.full((rows, beam), -1, np.int64)
    near = np.full((rows, beam), -np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    seen = np.zeros((rows, n), bool)
    ids[:, 0], near[:, 0], done[:, 0] = entry, np.einsum("rd,rd->r", vectors[entry], asking), False
    seen[np.arange(rows), entry] = True
    while True:
        open_ = np.where(done, -np.inf, near)
        best = open_.argmax(1)
        at = np.flatnonzero(open_[np.arange(rows), best] > -np.inf)
        if not len(at):
            return ids, near
        done[at, best[at]] = True
        next_ = links[ids[at, best[at]]]
        real = next_ >= 0
        next_ = np.where(real, next_, 0)
        new = real & ~seen[at[:, None], next_]
        seen[at[:, None], next_] |= real
        cosine = np.einsum("rmd,rd->rm", vectors[next_], asking[at])
        cosine[~new] = -np.inf
        all_ids = np.concatenate([ids[at], np.where(new, next_, -1)], 1)
        all_near = np.concatenate([near[at], cosine], 1)
        all_done = np.concatenate([done[at], ~new], 1)
        top = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
        ids[at], near[at], done[at] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_done))


def choose(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, m: int) -> np.ndarray:
    """m links for each own vector, of candidates (-1: none): a candidate is taken if it is nearer to own than
    to those taken before it; places left over go to the nearest of the rest."""
    near = np.einsum("bcd,bd->bc", vectors[candidates], own)
    near[candidates < 0] = -np.inf
    order = np.argsort(-near, 1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    again = np.zeros(candidates.shape, bool)
    ranked = np.sort(np.where(candidates < 0, -1 - np.arange(candidates.shape[1]), candidates), 1)
    if (ranked[:, 1:] == ranked[:, :-1]).any():
        for j in range(1, candidates.shape[1]):
            again[:, j] = (candidates[:, :j] == candidates[:, j: j + 1]).any(1)
    near[again] = -np.inf
    between = np.einsum("bcd,bed->bce", vectors[candidates], vectors[candidates])
    taken = np.zeros(candidates.shape, bool)
    for j in range(candidates.shape[1]):
        nearest = np.where(taken, between[:, j], -np.inf).max(1)
        taken[:, j] = (near[:, j] > nearest) & (near[:, j] > -np.inf) & (taken.sum(1) < m)
    rank = np.where(taken, 0, 1) + (near == -np.inf) * 2
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(near == -np.inf, -1, candidates), order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of links over unit vectors, whose upper layers hold the first few of them."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = vectors
        if layers is not None:
            self.layers = layers
            return
        sizes = [len(vectors)]
        while sizes[-1] > 4 * LINKS:
            sizes.append(max(LINKS, sizes[-1] // LINKS))
        self.layers = [self._layer(n) for n in sizes]

    def _layer(self, n: int) -> np.ndarray:
        v = self.vectors[:n]
        links = np.full((n, LINKS), -1, np.int64)
        first = min(n, LINKS)
        for i in range(first):
            others = [j for j in range(first) if j != i]
            links[i, : len(others)] = others
        at = first
        while at < n:
            to = min(n, at + min(BATCH, at))
            new = np.arange(at, to)
            # entry: the nearest of a spread of nodes that are in already
            spread = np.linspace(0, at - 1, min(at, 64)).astype(np.int64)
            entry = spread[(v[new] @ v[spread].T).argmax(1)]
            found, _ = search(v, links, v[new], entry, min(WIDE, at))
            mates = v[new] @ v[new].T
            np.fill_diagonal(mates, -np.inf)
            mate = np.argsort(-mates, 1)[:, : min(8, len(new) - 1)]
            links[new] = choose(v, v[new], np.concatenate([found, new[mate]], 1), LINKS)
            self._back(v, links, new)
            at = to
        return links

    @staticmethod
    def _back(v: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
        source, target = np.repeat(new, LINKS), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), count.max()), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for i in range(0, more.shape[1], WIDE):  # a much-wanted node takes its new links in turns
            use = np.flatnonzero((more[:, i: i + WIDE] >= 0).any(1))
            for part in np.array_split(use, max(1, len(use) // BATCH)):
                links[nodes[part]] = choose(v, v[nodes[part]], np.concatenate([links[nodes[part]], more[part, i: i + WIDE]], 1), LINKS)

    def near(self, asking: np.ndarray, beam: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of vectors with at least this cosine. Where the whole beam has it there may be more, and
        the beam is doubled."""
        rows, out = np.arange(len(asking)), []
        while len(rows):
            ids, found = self.ask(asking[rows], beam)
            full = (found >= cosine).all(1) & (beam < len(self.vectors))
            at, col = np.nonzero((ids >= 0) & (found >= cosine) & ~full[:, None])
            out.append((rows[at], ids[at, col]))
            rows, beam = rows[full], 2 * beam
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def ask(self, asking: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros(len(asking), np.int64)
        for links in self.layers[:0:-1]:
            ids, near = search(self.vectors[: len(links)], links, asking, entry, 4)
            entry = ids[np.arange(len(asking)), near.argmax(1)]
        return search(self.vectors, self.layers[0], asking, entry, min(beam, len(self.vectors)))


def audited_beam(graph: Graph, cosine: float, seed: int) -> tuple[int, float]:
    """The least doubling of BEAM at which sampled vectors, and the same a little turned, find RECALL of their
    links; at the shard's size a search is exhaustive but for parts of the graph that are cut off, so a graph
    that fails there is replaced by brute force (beam 0)."""
    v = graph.vectors
    random = np.random.default_rng(seed)
    some = v[random.choice(len(v), min(AUDIT, len(v)), replace=False)]
    noise = random.normal(size=some.shape)
    noise -= (noise * some).sum(1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    turn = (1 + cosine) / 2
    some = np.concatenate([some, turn * some + np.sqrt(1 - turn * turn) * noise]).astype(np.float32)
    true = some @ v.T >= cosine
    beam = BEAM
    while True:
        recall = len(graph.near(some, beam, cosine)[0]) / max(1, true.sum())
        if recall >= RECALL:
            return beam, float(recall)
        if beam >= len(v):
            return 0, 1.0
        beam *= 2


def links(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vectors (key long, label, embedding array of double, unique, finite, not zero): (a, b), keys that link."""
    spark = vectors.sparkSession
    folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}-graphs"
    typed = vectors.withColumn("dim", F.size("embedding"))
    counts = typed.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    dealt = common.staged(typed.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
                          .withColumn("graph", F.xxhash64("label", "dim")))

    def unit(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        v = v / np.abs(v).max(1, keepdims=True)  # huge and tiny components square safely
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def build(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(common.mix(key.view(np.uint64)))
        v = unit(table.column("embedding"))[order]
        graph = Graph(v.astype(np.float32))
        name = f"{table.column('graph')[0].as_py() & (1 << 64) - 1:x}-{table.column('shard')[0].as_py()}"
        beam, recall = audited_beam(graph, cosine, int(table.column("shard")[0].as_py()))
        arrays.save(folder, f"{name}-keys", key[order].view(np.uint64), np.zeros(0))
        arrays.save(folder, f"{name}-vectors", v.ravel().view(np.uint64), np.zeros(0))
        for i, layer in enumerate(graph.layers):
            arrays.save(folder, f"{name}-{i}", layer.ravel().view(np.uint64), np.zeros(0))
        return pa.table({"graph": table.column("graph").slice(0, 1), "shard": table.column("shard").slice(0, 1),
                         "name": [name], "layers": pa.array([len(graph.layers)], pa.int32()), "beam": pa.array([beam], pa.int32()), "recall": [recall]})

    shards = common.checkpoint(dealt.select("graph", "shard", "key", "embedding").groupBy("graph", "shard").applyInArrow(
        build, "graph long, shard int, name string, layers int, beam int, recall double"))
    asking = (dealt.select("graph", "key", "embedding").join(shards.select("graph", "name", "layers", "beam"), "graph")
              .repartition(2 * common.shuffle_width(spark), "name", F.pmod("key", F.lit(8))).sortWithinPartitions("name"))

    def ask(batches):
        opened, graph, own, exact = None, None, None, None
        for b in batches:
            names = np.array(b.column("name").to_pylist())
            keys = b.column("key").to_numpy()
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                if name != opened:
                    opened, own = name, arrays.flat(folder, f"{name}-keys").view(np.int64)
                    exact = arrays.flat(folder, f"{name}-vectors").view(np.float64).reshape(len(own), -1)
                    layers = [arrays.flat(folder, f"{name}-{i}").view(np.int64).reshape(-1, LINKS) for i in range(b.column("layers")[int(at[0])].as_py())]
                    graph = Graph(exact.astype(np.float32), layers)
                beam = b.column("beam")[int(at[0])].as_py()
                for part in np.array_split(at, -(-len(at) // BATCH)):
                    v = unit(b.column("embedding").take(pa.array(part)))
                    if beam:
                        row, ids = graph.near(v.astype(np.float32), beam, cosine - 1e-5)
                    else:
                        row, ids = np.nonzero(v @ exact.T > cosine - 1e-6)
                    mine, other = keys[part[row]], own[ids]
                    ok = ((v[row] * exact[ids]).sum(1) >= cosine) & (mine != other)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, other)[ok]), pa.array(np.maximum(mine, other)[ok])], names=["a", "b"])

    return asking.mapInArrow(ask, "a long, b long").distinct()


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of one label and size link when their cosine is at least cosine. A null vec_id or label, and
    a vector that is null, empty, zero, or holds a null, NaN or infinity, links with nothing. Equal vectors
    link with each other. component_id: the smallest vec_id reachable by links. Rows that repeat count as
    vectors of their own. Other columns are not read; no rows give no rows."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False))
            & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("embedding"), good.alias("good"))
    rows = rows.withColumn("key", F.when(F.col("good"), F.xxhash64("label", "embedding")))
    nodes = common.staged(rows.where("good").groupBy("label", "embedding", "key").agg(F.count("*").alias("weight")))
    found = common.staged(links(nodes.select("key", "label", "embedding"), cosine))
    weight = nodes.select("key", "weight")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(weight, both["b"] == weight["key"]).groupBy("a").agg(F.sum("weight").alias("others"))
    part = common.components(found)
    node = (weight.join(degree, weight["key"] == degree["a"], "left").join(part, weight["key"] == part["id"], "left")
            .select("key", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("part")))
    placed = rows.select("vec_id", "key").join(node, "key", "left")
    least = placed.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("least"))
    return (placed.join(least, "part", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
