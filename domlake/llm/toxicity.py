"""Toxicity: misspelled terms found by Levenshtein automata, judged in context.

Terms are learned from labelled documents, as word beginnings, so that inflected and compounded forms
count too. The trie of the terms is intersected with the Levenshtein automaton of each (one edit for
terms of five bytes, two for twelve) into one deterministic table, and all words of a batch walk through
it together, byte by byte. Hits are counted apart by how exact they are, whether their window of words
looks like a quotation, and how many stand close together; a logistic model weighs these counts. Terms
come from two thirds of the labelled sample and weights from the rest, so that the weights tell how far
each kind of hit can be trusted on text that the terms were not chosen from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: Labelled documents that the model is fitted on, at most; they are drawn by the hash of their id.
SAMPLE = 9_000
#: Different contexts that a term needs.
CONTEXTS = 8
#: Bytes of a term, at least and at most, and how much likelier it is in toxic contexts (natural log).
SIZES = (4, 16)
GAIN = 3.5
#: Words that make the window around a hit.
WINDOW = 12
#: Score from which a document is called toxic.
THRESHOLD = 0.3
#: Bytes that open or close a quotation, as single bytes of UTF-8 text.
QUOTES = b'"\xab\xbb\x9c\x9d\x9e'
_FEATURES = ["exact", "near_long", "near_short", "quoted", "dense", "rate", "terms"]

_SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def edits_for(term: bytes) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Automaton:
    """All terms and their misspellings: table[state, byte] is the next state (0: dead); accept[state] is
    1 + 2 * term + (1 where letters differ) for the closest term, or 0."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        reach = [0]
        for i, term in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], edits_for(term))
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], edits_for(term))
            ends[node] = i

        def closed(states: dict[int, int]) -> frozenset:
            work = list(states.items())
            while work:
                node, e = work.pop()
                for child in children[node].values():
                    if e < reach[child] and states.get(child, 9) > e + 1:
                        states[child] = e + 1
                        work.append((child, e + 1))
            return frozenset(states.items())

        letters = sorted({c for t in terms for c in t})
        start = closed({0: 0})
        index, todo, table, accept = {frozenset(): 0, start: 1}, [start], {}, {}
        while todo:
            state = todo.pop()
            at = index[state]
            finals = [(e, ends[n]) for n, e in state if n in ends and e <= edits_for(terms[ends[n]])]
            accept[at] = min(((e, 1 + 2 * t + (e > 0)) for e, t in finals), default=(0, 0))[1]
            row = np.zeros(256, np.int32)
            for c in [None, *letters]:
                following: dict[int, int] = {}
                for node, e in state:
                    steps = [(child, e + (x != c)) for x, child in children[node].items()] + [(node, e + 1)]
                    for n, d in steps:
                        if d <= reach[n] and following.get(n, 9) > d:
                            following[n] = d
                closed_ = closed(following)
                if closed_ not in index:
                    index[closed_] = len(index)
                    todo.append(closed_)
                row[:] = np.where(np.isin(np.arange(256), letters), row, index[closed_]) if c is None else row
                if c is not None:
                    row[c] = index[closed_]
            table[at] = row
        self.table = np.zeros((len(index), 256), np.int32)
        self.accept = np.zeros(len(index), np.int32)
        for at, row in table.items():
            if at:
                self.table[at], self.accept[at] = row, accept[at]

    def match(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that begin with a term or a misspelling of one, and what accept says."""
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        best = np.zeros(len(starts), np.int32)
        while len(alive):
            live = at < ends[alive]
            alive, state, at = alive[live], state[live], at[live]
            state = self.table[state, buf[at]]
            live = state > 0
            alive, state, at = alive[live], state[live], at[live] + 1
            kind, had = self.accept[state], best[alive]
            better = (kind > 0) & ((had == 0) | ((had % 2 == 0) & (kind % 2 == 1)))
            best[alive[better]] = kind[better]
        found = np.flatnonzero(best)
        return found, best[found]


def features(t: common.Texts, machine: Automaton, clean: np.ndarray) -> np.ndarray:
    """A row of counts for each text; clean: sorted hashes of words that are not misspellings."""
    w = common.words(t, _SEPARATORS)
    hit, kind = machine.match(w.buf, w.starts, w.ends)
    near = (kind - 1) % 2 == 1
    if len(clean) and len(hit):
        h = w.hash[hit]
        innocent = near & (clean[np.minimum(np.searchsorted(clean, h), len(clean) - 1)] == h)
        hit, kind, near = hit[~innocent], kind[~innocent], near[~innocent]
    term = (kind - 1) // 2
    long_ = np.array([len(x) >= 7 for x in machine.terms] or [False])[term] if len(term) else np.zeros(0, bool)
    row = w.row[hit]
    low, high = np.maximum(hit - WINDOW, w.first[row]), np.minimum(hit + WINDOW, w.first[row + 1] - 1)
    marks = np.flatnonzero(np.isin(t.buf, np.frombuffer(QUOTES, np.uint8)))
    before = np.searchsorted(marks, w.starts[hit]) - np.searchsorted(marks, w.starts[low])
    after = np.searchsorted(marks, w.ends[high] if len(hit) else hit) - np.searchsorted(marks, w.ends[hit])
    quoted = (before % 2 == 1) & (after > 0)
    dense = np.searchsorted(hit, high, "right") - np.searchsorted(hit, low, "left")
    out = np.zeros((t.rows, len(_FEATURES)))
    abuse = ~quoted
    for i, chosen in enumerate([abuse & ~near, abuse & near & long_, abuse & near & ~long_, quoted]):
        out[:, i] = np.log1p(np.bincount(row[chosen], minlength=t.rows)) if len(row) else 0
    np.maximum.at(out[:, 4], row[abuse], np.log1p(dense[abuse]))
    out[:, 5] = 100 * np.bincount(row[abuse & ~near], minlength=t.rows) / np.maximum(1, np.diff(w.first)) if len(row) else 0
    different = np.unique(row[abuse & ~near].astype(np.int64) * (len(machine.terms) + 1) + term[abuse & ~near])
    out[:, 6] = np.log1p(np.bincount(different // (len(machine.terms) + 1), minlength=t.rows)) if len(different) else 0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights and intercept, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
    return w


class Model:
    def __init__(self, machine: Automaton, clean: np.ndarray, weights: np.ndarray):
        self.machine, self.clean, self.weights = machine, clean, weights

    def score(self, t: common.Texts) -> np.ndarray:
        x = features(t, self.machine, self.clean)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def choose(counts: dict[bytes, tuple[int, int]]) -> list[bytes]:
    """Terms among word beginnings with (toxic, clean) contexts: the shortest, drawn out for as long as
    nine tenths of its toxic contexts stay; nothing that begins with a chosen term."""
    chosen: set[bytes] = set()
    begun = lambda t: any(t[:n] in chosen for n in range(1, len(t) + 1))
    after: dict[bytes, list[bytes]] = {}
    for t in counts:
        after.setdefault(t[:-1], []).append(t)
    for term in sorted(counts, key=lambda t: (len(t), t)):
        if begun(term):
            continue
        while longer := [t for t in after.get(term, []) if counts[t][0] >= 0.9 * counts[term][0]]:
            term = max(longer, key=lambda t: (counts[t][0], t))
        if not begun(term):
            chosen.add(term)
    return sorted(chosen, key=lambda t: (-counts[t][0], t))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE labelled documents outside the held-out fold. Rows of labels with a null
    doc_id or toxic are left out; a doc_id labelled twice counts as toxic if one label says so. Without
    labelled documents nothing is ever toxic (score 0)."""
    chosen = (labels.where("doc_id is not null and toxic is not null").where(~common.held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(3)) == 0)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    chosen = common.checkpoint(chosen)
    # SAMPLE bounds what is broadcast
    texts = common.staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def contexts(batches):
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for t in common.texts(b.column("text")):
                w = common.words(t, _SEPARATORS)
                if not len(w.hash):
                    continue
                side = np.concatenate([[np.uint64(0)], w.hash, [np.uint64(0)]])
                around = side[:-2] * np.uint64(3) + side[2:] * np.uint64(7)
                toxic_ = toxic[t.first + w.row].astype(np.uint64)
                _, at = np.unique(common.mix(w.hash * np.uint64(3) + around * np.uint64(7) + toxic_), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bytes(w.buf[w.starts[i]: w.ends[i]]) for i in at.tolist()], pa.binary()),
                     pa.array(around[at].view(np.int64)), pa.array(toxic_[at].astype(np.int32))],
                    names=["word", "around", "toxic"])

    seen = (texts.where("text is not null and not fit").select("text", "toxic").mapInArrow(contexts, "word binary, around long, toxic int").distinct()
            .groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    seen = common.staged(seen.where(F.length("word") >= SIZES[0]))
    totals = seen.agg(F.sum("pos"), F.sum("neg")).first()
    n_pos, n_neg = float(totals[0] or 0), float(totals[1] or 0)
    gain = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    beginnings = (seen.select(F.explode(F.sequence(F.lit(SIZES[0]), F.least(F.lit(SIZES[1]), F.length("word")))).alias("n"), "word", "pos", "neg")
                  .where(F.length("word") >= F.col("n"))
                  .groupBy(F.expr("substring(word, 1, n)").alias("term")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
                  .where(F.col("pos") >= CONTEXTS).where(gain > GAIN))  # SAMPLE bounds these and the look-alikes
    terms = choose({bytes(r[0]): (r[1], r[2]) for r in beginnings.select("term", "pos", "neg").collect()})
    machine = Automaton(terms)

    def lookalikes(batches):
        for b in batches:
            for t in common.texts(b.column("word").cast(pa.string())):
                w = common.words(t, _SEPARATORS)
                hit, kind = machine.match(w.buf, w.starts, w.ends)
                hit = hit[(kind - 1) % 2 == 1]
                yield pa.RecordBatch.from_arrays([pa.array(w.hash[hit].view(np.int64))], names=["hash"])

    clean = [r[0] for r in seen.where("neg > 0").select(F.col("word").cast("string").alias("word"))
             .mapInArrow(lookalikes, "hash long").distinct().collect()]
    clean = np.unique(np.array(clean, np.int64).view(np.uint64))

    def counted(batches):
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for t in common.texts(b.column("text")):
                x = features(t, machine, clean)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), pa.array(toxic[t.first: t.first + t.rows], pa.int32())],
                    names=["x", "toxic"])

    rows = texts.where("fit").select("text", "toxic").mapInArrow(counted, "x array<double>, toxic int").collect()  # SAMPLE rows at most
    if not rows or not any(r[1] for r in rows):
        return Model(machine, clean, np.array([0.0] * len(_FEATURES) + [-30.0]))
    return Model(machine, clean, fit_logistic(np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, score, predicted. A null or empty text has no hits and gets
    the score of clean text. Rows that repeat stay; other columns are not read."""
    def score(batches):
        for b in batches:
            parts = [model.score(t) for t in common.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))],
                                             names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, score double")
            .select("doc_id", common.held_out().alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
