"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the code a binary classifier over hashed byte n-grams says
whether a text belongs to the languages with a one or to those with a zero there; decoding sums a loss
over the bits, each bit weighted by how well its classifier does, and takes the codeword with the least.
Single wrong bits do not change the nearest codeword. A runner-up close behind marks the text ambiguous.

The classifiers are linear, from the n-gram counts of all training documents: counts are added up in the
tasks and by (language, block of n-grams) in a shuffle; only one table of fixed size reaches the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: Hash slots for n-grams of two and three bytes together, and slots in one shuffled block.
SLOTS = 1 << 15
BLOCK = 1 << 12
#: Most languages; rarer ones are not learned beyond it. Bounds the table at LANGUAGES * SLOTS numbers.
LANGUAGES = 256
#: Evidence of a text counts as that of at most this many n-grams.
EVIDENCE = 60.0
#: Gap between the two best probabilities under which a text is ambiguous.
AMBIGUOUS = 0.1
#: What a text without letters, or null, is called.
UNDETERMINED = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def slots(t: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams, in text order, and where each text's begin. What is not a letter reads as
    a space; n-grams of spaces only, and those that leave their text, get the slot SLOTS."""
    b = np.concatenate([_LETTER[t.buf], np.full(2, 32, np.uint8)]).astype(np.uint32)
    pair = b[:-2] << np.uint32(8) | b[1:-1]
    triple = pair << np.uint32(8) | b[2:]
    both = np.stack([(pair * np.uint32(0x9E3779B1)) >> np.uint32(17), (triple * np.uint32(0x85EBCA6B)) >> np.uint32(17)], 1)
    both[pair == 0x2020, 0] = SLOTS
    both[triple == 0x202020, 1] = SLOTS
    last = t.offsets[1:]
    for back, column in ((1, 0), (1, 1), (2, 1)):
        at = last - back
        both[at[at >= t.offsets[:-1]], column] = SLOTS
    return both, t.offsets


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to six languages have the exhaustive code (every split of them, once); more
    have ten bits per doubling, drawn from a fixed sequence, the best of 50 draws by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    best, far = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([1.0, -1.0], (n, 10 * int(np.ceil(np.log2(n)))))
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if near > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, near
    return best


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: (language, slot)."""
        self.langs, self.code = langs, codewords(len(langs))
        rates = []
        for bit in self.code.T:
            side = [counts[bit == s].sum(0) + 0.5 if (bit == s).any() else np.ones(SLOTS) for s in (1, -1)]
            rates.append([np.log(x / x.sum()) for x in side])
        weights = np.array([a - z for a, z in rates]).reshape(self.code.shape[1], SLOTS).T
        self.weights = np.vstack([weights, np.zeros(weights.shape[1])]).astype(np.float32)
        # a bit counts by how far apart it puts the two sides, per n-gram
        gap = np.array([(np.exp(a) * (a - z)).sum() + (np.exp(z) * (z - a)).sum() for a, z in rates])
        self.trust = gap / gap.sum() * len(gap) if gap.sum() > 0 else np.ones(len(gap))

    def margins(self, t: common.Texts) -> np.ndarray:
        both, offsets = slots(t)
        out = np.zeros((t.rows, self.weights.shape[1]))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            sums = self.weights[both[:, 0]] + self.weights[both[:, 1]]
            out[some] = np.add.reduceat(sums, offsets[some], axis=0, dtype=np.float64)
            used = np.add.reduceat((both < SLOTS).sum(1), offsets[some])
            out[some] *= (np.minimum(used, EVIDENCE) / np.maximum(used, 1))[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, whether the runner-up is close."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ordered = np.sort(p, 1)
        close = ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0) < AMBIGUOUS
        return best, p[np.arange(len(p)), best], close


def learn(docs: DataFrame) -> Model:
    """From docs (doc_id, text, lang) outside the held-out fold with text and lang; whole texts, all rows."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for t in common.texts(b.column("text")):
                both, offsets = slots(t)
                own = langs[t.first: t.first + t.rows]
                for lang in set(own):
                    rows = np.flatnonzero([x == lang for x in own])
                    picked = np.repeat(np.isin(np.arange(t.rows), rows), np.diff(offsets))
                    got = np.bincount(both[picked].ravel(), minlength=SLOTS + 1)[:SLOTS]
                    sums[lang] = sums.get(lang, 0) + got
        out = [(lang, i, s[i * BLOCK: (i + 1) * BLOCK].astype("<i8").tobytes()) for lang, s in sums.items() for i in range(SLOTS // BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                          pa.array([o[2] for o in out], pa.binary())], names=["lang", "block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("sums").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, block int, sums binary"
    base = docs.where("text is not null and lang is not null").where(~common.held_out()).select("text", "lang")
    parts = base.mapInArrow(count, schema)
    # two steps, so that no task gets the tables of all tasks
    first = (parts.groupBy("lang", "block", (F.spark_partition_id() % 16).alias("part")).applyInArrow(add, schema)
             .groupBy("lang", "block").applyInArrow(add, schema))
    rows = first.orderBy("lang", "block").limit(LANGUAGES * (SLOTS // BLOCK)).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), SLOTS))
    for r in rows:
        counts[langs.index(r["lang"]), r["block"] * BLOCK: (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<i8")
    return Model(langs, counts)


def classify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """docs (doc_id, text) with lang_pred, score and ambiguous.

    A null text, or one without letters, is "und" with score 0, as is every text if nothing was learned.
    Rows that repeat stay. keep: all columns of docs stay in front; columns of those three names are
    replaced. Otherwise only doc_id stays."""
    added = ["lang_pred", "score", "ambiguous"]
    names = [c for c in docs.columns if c not in added] if keep else ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, ambiguous boolean"

    def predict(batches):
        for b in batches:
            column = b.column("text")
            pred, score, close = [UNDETERMINED] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
            for t in common.texts(column) if model.langs else ():
                best, p, near = model.decode(model.margins(t))
                plain = (_LETTER[t.buf] != 32) & (t.buf < 128)
                sure = np.add.reduceat(np.append(plain, False), np.minimum(t.offsets[:-1], len(plain))) * (np.diff(t.offsets) > 0)
                for i in range(t.rows):
                    if sure[i] or has_letter(column[t.first + i].as_py()):
                        pred[t.first + i], score[t.first + i], close[t.first + i] = model.langs[best[i]], p[i], near[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score),
                                              pa.array(close)], names=[*names, *added])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(predict, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, learn(docs)).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
