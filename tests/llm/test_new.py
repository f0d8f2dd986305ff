"""Whitening, phrase mining and byte-level BPE against brute-force versions and the cases their docstrings define."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from domlake.llm import byte_bpe, common, decontaminate, phrases, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component string, n string"


# ---------------------------------------------------------------- whitening

def vector_rows(seed=3, dims=12):
    r = np.random.default_rng(seed)
    base = r.normal(size=(200, dims)) @ np.diag(np.linspace(0.1, 0.6, dims)) + 0.3
    rows = [(i, [float(np.float32(c)) for c in v], i % 3, "x", "y") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 1, None, None) for i in range(40)]  # copies count once in the fit
    bad = list(rows[0][1])
    return rows + [(None, rows[3][1], 0, "x", "y"), (5, rows[5][1], 2, "x", "y"), (2000, None, 0, "x", "y"),
                   (2001, [None, *bad[1:]], 0, "x", "y"), (2002, [float("nan"), *bad[1:]], 0, "x", "y"),
                   (2003, [float("inf"), *bad[1:]], 0, "x", "y"), (2004, bad[:5], 0, "x", "y"), (2005, [], 0, "x", "y")]


def exact_cov(xs):
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    cells = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n ** 3) for j in range(d)] for i in range(d)]
    return n, sums, np.array([[float(c) for c in row] for row in cells])


def test_whitening(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.whiten(df, whitening.fit(df, 16)).collect()
    used = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, cov = exact_cov(sorted({tuple(x) for _, x in used if len(x) == 12}))
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 12 * len(used)
    seen: dict[tuple, list] = {}
    for g in got:
        seen.setdefault((g.vec_id, g.deviation), []).append(g)
    signs = {}
    for vec_id, x in used:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums)) if len(x) == 12 else None
        mine = seen[vec_id, deviation]
        assert {g.component for g in mine} == set(range(1, 13)) and {g.n for g in mine} == {n}
        for g in mine:
            k = g.component - 1
            assert abs(g.explained - value[k] / value.sum()) < 1e-12 and g.identity_error < 1e-9
            if deviation is None:
                assert g.whitened is None
                continue
            want = float(np.array([a - s / n for a, s in zip(x, sums)]) @ vector[:, k]) / value[k] ** 0.5
            assert abs(abs(g.whitened) - abs(want)) < 1e-8
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(g.whitened * want)) == np.sign(g.whitened * want)


@pytest.mark.parametrize("case", ["clusters", "equal", "tiny", "rank"])
def test_eigenvectors_of_close_values(case):
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(20, 20)))
    value = {"clusters": [5, 5 + 1e-9, 5 - 1e-9, 3, 3, 3 + 1e-12, *range(20, 34)], "equal": [2.0] * 20,
             "tiny": list(10.0 ** -np.arange(20)), "rank": [1.0, 2.0, 3.0] + [0.0] * 17}[case]
    a = (q * np.array(value)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    assert np.all(np.diff(got.astype(float)) <= 1e-15 * max(value))
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-15
    assert np.abs(a @ x - x * got).max() < 1e-15 * max(value)
    if case == "clusters":  # directions that differ by less than float32 can tell are told apart
        top = np.linalg.eigh(a - 5 * np.eye(20))[1]
        gap = {i: j for i, j in zip(np.argsort(np.abs(np.linalg.eigvalsh(a - 5 * np.eye(20))))[:3], range(3))}
        here = [np.abs(x[:, k].astype(float) @ top[:, i]) for i in gap for k in range(20)]
        assert sum(h > 1 - 1e-5 for h in here) == 3


def test_whitening_of_few_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    one = spark.createDataFrame([(1, [0.5, -0.25], 0, "", "")] * 3, VECTORS)
    rows = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(rows) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in rows)
    flat = spark.createDataFrame([(i, [i / 8, 1.0, 1.0], 0, "", "") for i in range(9)], VECTORS)
    rows = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True), (3, True)}
    empty = spark.createDataFrame([(1, [], 0, "", "")], VECTORS)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(2.0 ** 40 * (i % 5)), float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    n, sums, cov = exact_cov(sorted({tuple(int(64 * c) + 1_000_000 for c in v) for _, v in rows}))
    assert (model.n, model.sums) == (n, sums)
    assert abs(model.explained[0] - np.linalg.eigvalsh(cov)[-1] / np.trace(cov)) < 1e-12
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v in rows}
    for r in whitening.whiten(df, model).collect():  # null where it is beyond a long
        want = sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.deviation == (want if want < 1 << 63 else None)


# ---------------------------------------------------------------- phrases

PHRASE_DOCS = "doc_id long, text string, lang string, rank int, n string"


def phrase_rows(seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(30)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(1, 50)):
            parts += r.choice((["new", "york", "city"], ["New", "York"], [r.choice(vocab)], [r.choice(vocab)], ["a"], ["x\x00y"]))
        text = "".join(p + r.choice((" ", "  ", "\t", " ", " ", ", ", "\n", ".")) for p in parts)
        rows.append((i, text, r.choice(("en", "de", None, "und")), i, "x"))
    return rows + rows[:20] + [(None, None, None, 0, None), (900, "", "en", 0, None), (901, " .,;\t\n", "en", 0, None),
                               (902, "long " * 20000, "fr", 0, None), (903, "y" * 60000, "fr", 0, None), (904, "one two", "xx", 0, None)]


def brute_phrases(rows, words, least, inside, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    some = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    longer = Counter()
    for p, c in some.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[p[0], *w[i:i + k]] = max(longer[p[0], *w[i:i + k]], c)
    out = {}
    for p, a in some.items():
        if p in longer and 100 * longer[p] >= inside * a:
            continue
        cuts = [(1000000 * a * a // (f[p[:k + 1]] * f[p[0], *p[k + 1:]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[p[0], *p[k + 1:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, best in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)}


@pytest.mark.parametrize("words, least, inside, top", [(3, 10, 50, 2000), (4, 3, 80, 7)])
def test_phrases(spark, words, least, inside, top):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, PHRASE_DOCS).repartition(6)
    got = phrases.collocations(df, words, least, inside, top).collect()
    assert len(got) == len({tuple(g) for g in got})
    assert {(g.lang, g["rank"], g.phrase, g.a, g.l, g.r, g.n, g.score) for g in got} == brute_phrases(rows, words, least, inside, top)


@pytest.mark.parametrize("bits", [6, 12])
def test_phrases_when_fingerprints_collide(spark, bits):
    df = spark.createDataFrame(phrase_rows(), PHRASE_DOCS).repartition(3)
    whole = {tuple(r) for r in phrases.frequent(df).collect()}
    assert whole and {tuple(r) for r in phrases.frequent(df, fingerprint_bits=bits).collect()} == whole


def test_phrases_handed_on_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(phrase_rows(), PHRASE_DOCS).repartition(3)
    whole = {tuple(r) for r in phrases.frequent(df).collect()}
    monkeypatch.setattr(phrases, "HELD", 50)
    assert {tuple(r) for r in phrases.frequent(df).collect()} == whole


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], PHRASE_DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 0, ""), (2, "a b", "en", 0, "")], PHRASE_DOCS)).count() == 0


# ---------------------------------------------------------------- byte-level BPE

def ranks_of(name="byte_bpe_50k.tiktoken"):
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


RANKS = ranks_of()
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def bpe_texts():
    r = random.Random(6)
    signs = list("  \n\t\r'''sstrevemlld aAbB09.,!?éñ中文😀\xa0　 \x85\x1c٣Ⅷ̀‍") + [chr(0x558), chr(0x88F), chr(0x10FFFF), "\x00"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return texts + [None, "", " ", "'", "'s", "'re", "'rex", "a'll", "''s", " 's", "\n's", "'t't't", "<|endoftext|>", "  a", " \n a", "a  ", "x" * 60000,
                    "ab" * 9000, "word " * 30000, " " * 20000, "é" * 5000, "á" * 300] + texts[:5]


def test_byte_bpe_as_the_library(spark):
    texts = bpe_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")
    got = byte_bpe.encode(df.repartition(3), RANKS).collect()
    want = Counter((i if i % 7 else None, tuple(ENCODING.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert Counter((g.doc_id, tuple(g.ids), bytes(g.decoded)) for g in got) == want
    for g in got:
        assert g.n_tokens == len(g.ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, g.ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(g.decoded).hexdigest()
    short = byte_bpe.encode(df, RANKS, ids=False)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, short.collect())) == Counter((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got)
    assert byte_bpe.encode(df.limit(0), RANKS).count() == 0


def test_byte_bpe_decodes_lists(spark):
    rows = [(1, ENCODING.encode_ordinary("Üben 'tis\n")), (2, []), (3, None)]
    got = byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), RANKS).collect()
    assert {r.k: r.decoded and bytes(r.decoded) for r in got} == {1: "Üben 'tis\n".encode(), 2: b"", 3: None}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_trees_together_and_alone_agree(name):
    merger = byte_bpe.Merger(ranks_of(name))
    r = random.Random(8)
    some = [bytes(r.choice(b"abcehilnorst \xc3\xa9\xff") for _ in range(r.randint(1, 90))) for _ in range(800)] + [b"aaaa", b"a" * 63, b"a" * 64, b"a" * 65]
    flat, count = merger.encode_all(some)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [merger.encode(p) for p in some]


def test_equal_pairs_merge_from_the_left():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256}
    merger = byte_bpe.Merger(ranks)
    assert merger.encode(b"aaaaa") == [256, 256, 97] and merger.encode_all([b"aaaaa"])[0].tolist() == [256, 256, 97]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2000)
    coder = byte_bpe.Coder(RANKS, byte_bpe.character_classes())
    texts = bpe_texts()[:1500]
    for t in common.texts(pa.array(texts), 400):
        data = t.buf.tobytes()
        cuts = byte_bpe.pieces(t.buf, t.offsets, coder.table)
        ids, begin = coder.encode(data, np.append(cuts, len(data)))
        rows = begin[np.searchsorted(cuts, t.offsets)]
        for i in range(t.rows):
            assert ids[rows[i]:rows[i + 1]].tolist() == ENCODING.encode_ordinary(texts[t.first + i])
        assert len(coder.known) < 600


def test_window_hashes_do_not_read_the_text_for_each_window(spark):
    rows = [(1, list("abcabcabcabd"), [4] * 12), (2, list("xabcabcabcab"), [4] * 12), (3, ["a"], [4]), (4, ["1", "2"] * 6, [0] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>, codes array<int>")
    for length in range(1, 10):
        found = decontaminate.windows(df, length)
        assert "xxhash64(slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.doc_id, r["at"]): r.hash for r in found.where("template = 0").collect()}
        want = {(i, at): tuple(w[at: at + length]) for i, w, _ in rows for at in range(len(w) - length + 1)}
        assert got.keys() == want.keys()
        assert len(set(got.values())) == len(set(want.values())) == len(set(zip(got.values(), (want[k] for k in got), strict=True)))


def test_few_links_are_read_by_few_tasks(spark, monkeypatch):
    tasks, real = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: tasks.append(df.rdd.getNumPartitions()) or real(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = common.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in got} == {(i, 0) for i in range(41)}
    assert len(tasks) > 2 and set(tasks[1:]) == {1}
