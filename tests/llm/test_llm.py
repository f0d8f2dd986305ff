"""The training-data operators against brute-force versions, and the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from domlake.llm import (arrays, common, decontaminate, hnsw, jaccard_join, kneser_ney, language_id, license_scan,
                         mixing, registry, suffix_dedup, toxicity, url_rules)

#: doc_id, text, lang, source, n_chars, and a column whose name clashes with results.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def spaced(x):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(x))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m == 2


def make_docs(seed=1):
    r = random.Random(seed)
    vocab = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(400)]
             for lang, letters in (("en", "etaoinshr"), ("de", "enisratdäöü"), ("fr", "esaitnéèçu"))}
    rows, base = [], []
    for i in range(120):
        lang = r.choice(list(vocab))
        text = " ".join(r.choice(vocab[lang]) for _ in range(r.randint(20, 160)))
        if i % 9 == 0:
            text = f"{text} worthless idiot {r.choice(vocab[lang])} idiott"
        base.append(text)
        rows.append((i, text, lang, f"s{i % 3}", len(text), "x"))
    passage = " ".join(r.choice(vocab["en"]) for _ in range(60))
    for i in range(120, 150):  # near copies, exact copies, shared passages
        words = r.choice(base).split(" ")
        if i % 3 == 0:
            words[r.randrange(len(words))] = "other"
        elif i % 3 == 1:
            words = [*words[:10], passage, *words[10:30]]
        rows.append((i, " ".join(words), "en", "s0", 1, None))
    rows += [(200, None, None, None, None, None), (201, "", "en", "s0", 0, "x"), (202, " \n\t", "en", None, 3, "x"),
             (203, "12 ?! 34", None, "s1", 8, "x"), (204, "a", "en", "s1", 1, "x"), (205, "a", "en", "s1", 1, "x"),
             (206, "word " * 30000, "en", "s2", 150000, "x"), (207, "x" * 50000, "fr", "s2", 50000, "x"),
             (208, "Aa B", "de", "s2", 4, "x"), (208, "Aa B", "de", "s2", 4, "x"), (209, "é", "fr", "s2", 1, "x")]
    return rows


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(sets, k_percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= k_percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = spaced(text)
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k, percent, often", [(3, 90, 64), (5, 80, 3)])
def test_jaccard_join(docs, none, monkeypatch, k, percent, often):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    sets = {r[0]: shingles(r[1], k) for r in ROWS}
    want = brute_components(sets, percent)
    got = jaccard_join.join(docs, k, percent).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    if often == 3:
        assert jaccard_join.join(none, k, percent).count() == 0


def test_jaccard_chain_of_many_near_copies(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(2000)]
    base = [r.choice(vocab) for _ in range(100)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, "\t".join(w)))
    want = brute_components({i: shingles(t, 3) for i, t in rows}, 90)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)]
    up = {x: x for p in pairs for x in p}
    for _ in range(len(up)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {x.id: x.component for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: c for i, c in up.items() if any(i in p and p[0] != p[1] for p in pairs)}


def test_embeddings(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(900):
        v = r.normal(size=16)
        if i % 3:
            v = np.array(rows[r.integers(len(rows))][1]) * r.uniform(0.5, 2) + r.normal(size=16) * r.choice([0, 0.02, 0.1])
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [1.0, 2.0], 0), (1004, [2.0, 4.0], 0),
             (1005, rows[0][1], None), (1006, [], 1), (1007, [1e200, 2e200], 0), (1008, [None, 1.0], 0), (1009, [float("inf"), 1.0], 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<double>, label int, kept string")
    good = [(i, np.array(v) / np.abs(v).max(), g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _, _ in rows}
    for n, (i, v, g) in enumerate(good):
        for j, w, h in good[n + 1:]:
            if g == h and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    got = {x.vec_id: x for x in hnsw.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    true, found = sum(map(len, near.values())), sum(x.n_links for x in got.values())
    assert all(x.n_links <= len(near[i]) for i, x in got.items()) and found >= 0.97 * true
    assert all(x.kept == (x.component_id == i) for i, x in got.items() if i is not None)
    assert got[1004].component_id == 1003 and got[1007].component_id == 1003 and got[1000].component_id == 1000
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    # several shards: every shard is asked
    nodes = df.where("vec_id < 900").select(F.col("vec_id").alias("key"), "label", "embedding").dropDuplicates(["label", "embedding"])
    ids = {x[0] for x in nodes.select("key").collect()}
    pairs = {(x.a, x.b) for x in hnsw.links(nodes, shard=100).collect()}
    want = {(i, j) for i in ids for j in near[i] if i < j and j in ids}
    assert pairs <= want and len(pairs) >= 0.95 * len(want)


def test_graph_against_brute_force():
    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 32)).astype(np.float32)
    v[1500:] = v[:1500] + 0.02 * r.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph(v)
    beam, recall = hnsw.audited_beam(graph, 0.98, 0)
    row, _ = graph.near(v[::50], beam, 0.98) if beam else (np.nonzero(v[::50] @ v.T >= 0.98)[0], 0)
    assert recall >= hnsw.RECALL and len(row) >= 0.9 * (v[::50] @ v.T >= 0.98).sum()


def test_language_id(docs, none):
    model = language_id.learn(docs)
    assert model.langs == ["de", "en", "fr"]
    got = language_id.classify(docs, model, keep=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "ambiguous"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (200, 201, 202, 203)] == ["und"] * 4
    assert rows[204].lang_pred in model.langs and rows[209].lang_pred in model.langs
    held = [r for i, r in rows.items() if i < 120 and crc(i, 4)]
    assert held and all(r.lang_pred == r.lang for r in held)
    empty = language_id.learn(none)
    assert {r.lang_pred for r in language_id.classify(docs, empty).collect()} == {"und"}
    assert language_id.classify(none, model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 20])
def test_codewords_correct_errors(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n
    if n > 2:
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (3 if n > 3 else 2)


def test_url_rules(spark):
    urls = ["https://www.example.org/es/x", "https://example.org/en/12?q", "http://a.b.org/q#f", "https://shop.com/fr/", "https://COM/de/", "https://x.com/de/é",
            "http://notexample.org/es/", "http://user@example.org:80/es/1", "http://example.org:8080/es/2", "http://example.org./es/3", None, "no scheme", "://", "http://",
            "http://org", "http://x.net/org/", "https://www.example.org/es/x", "a://b://org/x"] * 3
    df = spark.createDataFrame([(i if i % 7 else 7, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_rules.RULES + [("allow", None, "/")], "action string, host string, path string")

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")

        def best(h):
            fits = [(len(a + b), a + b, x) for x, a, b in url_rules.RULES if (h == a or h.endswith("." + a)) and path.startswith(b)]
            return max(fits)[1:] if fits else (None, None)
        rule, action = best(host)
        plain = re.sub(r":\d*$|\.$|\.:\d*$", "", re.sub("^.*@", "", host))
        return host, path, rule, action or best(plain)[1] or "allow"
    got = Counter((r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(df, rules).collect())
    assert got == Counter(judge(u) for u in urls)
    assert {r.verdict for r in url_rules.apply_rules(df, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.apply_rules(df.limit(0), rules).count() == 0


def test_many_nested_rules(spark):
    r = random.Random(8)
    label = lambda: r.choice("abcd")
    rules = {(".".join(label() for _ in range(r.randint(1, 4))), "/" + "".join(label() for _ in range(r.randint(0, 2)))): r.choice(["allow", "block"]) for _ in range(150)}
    urls = [f"http://{'.'.join(label() for _ in range(r.randint(1, 5)))}/{''.join(label() for _ in range(3))}" for _ in range(400)] + ["http://a.b.c.d/aaa"] * 400
    got = url_rules.apply_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"),
                                spark.createDataFrame([(a, h, p) for (h, p), a in rules.items()], "action string, host string, path string")).collect()
    for x in got:
        fits = [len(h + p) for h, p in rules if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        assert len(x.rule or "") == max(fits, default=0)
    assert len(got) == 800


def test_decontamination(spark):
    item = "In total the trader sold 12 crates of apples and Mary paid 30 dollars for the last of them. Then nobody came."
    other = "Colourless ideas about weather rarely persuade the quiet committee of seven old gardeners near the river bank today"
    filler = "nothing of the kind was ever written here by anyone at all"
    texts = {1: item, 2: f"{filler} {item.replace('12', '99').replace('Mary', 'Anna')} {filler}", 3: filler, 4: None, 5: "",
             6: item.replace("30 dollars", "12 dollars").replace("12 crates", "12 crates"), 7: " ".join(other.split()[:12]), 8: " ".join(other.split()[:9]),
             9: item.upper(), 10: f"x, {other.lower()}", 11: item}
    df = spark.createDataFrame([(i, t, "q") for i, t in texts.items()] + [(11, item, "q")], "doc_id long, text string, kind string")
    bench = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, "too short", 0), (4, None, 0), (5, item, 0)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(df, bench).collect()}
    assert got[1, 1] == got[1, 5] == got[11, 1] == "exact" and got[2, 1] == "reparameterised"
    assert {i for i, _ in got} == {1, 2, 6, 7, 9, 10, 11} - ({9} if (9, 1) not in got else set())
    assert got[7, 2] == got[10, 2] == "exact" and (8, 2) not in got
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "then Anna gave 5 pears to Bert and Bert gave 5 pears to Anna again"
    same = item.replace("Anna", "Cleo").replace("5", "8")
    mixed = "then Cleo gave 5 pears to Bert and Dora gave 7 pears to Emil again"
    df = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = decontaminate.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "reparameterised")]


def leaked(spark, texts, items):
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.kind, r.n_tokens) for r in found}


def test_decontamination_of_capitals(spark):
    item = "In total the trader sold 12 crates of apples and Mary paid 30 dollars for the last of them. Then nobody came."
    texts = [item.upper(), f"x {item.title()} y", item.upper().replace("12", "99"), "NOTHING OF THE KIND WAS EVER WRITTEN IN 12 CRATES BY ANYONE AT ALL"]
    assert leaked(spark, texts, [item]) == {(0, 0): ("exact", 22), (1, 0): ("exact", 22), (2, 0): ("reparameterised", 22)}
    assert leaked(spark, [item, item.lower()], [item.upper()]) == {(0, 0): ("exact", 22), (1, 0): ("exact", 22)}


def test_decontamination_of_few_words(spark):
    item = "Compute 3 + 5 + 7 + 9 + 11 + 13 + 15 + 17 and then halve it"
    row = "1 2 3 4 5 6 7 8 9 10 11 12"
    other = item.replace("17", "19").replace("3 ", "4 ")
    texts = [f"x y {item} z", other, row, row.replace("7", "70"), "well, Is it Monday now", "is it monday"]
    assert leaked(spark, texts, [item, row, "Is it Monday?", "It?"]) == {
        (0, 0): ("exact", 13), (1, 0): ("reparameterised", 13), (2, 1): ("exact", 12), (4, 2): ("exact", 3), (5, 2): ("exact", 3),
        **{(i, 3): ("exact", 1) for i in (0, 1, 4, 5)}}
    german = "Der Hund von Anna und der Vogel von Bert sah die Katze von Emil"
    assert leaked(spark, [german, german.replace("Anna", "Cleo").replace("Hund", "Wolf")], [german]) == {(0, 0): ("exact", 14), (1, 0): ("reparameterised", 14)}


def test_decontamination_of_renamed_subjects(spark):
    item = "Tom had 12 apples in his bag. Tom gave 5 of them to Anna. How many remain?"
    luis = item.replace("Tom", "Luis")
    texts = [f"Nothing here. {luis}", luis.replace("12", "40").replace("Anna", "Bea"),
             "Kim has 5 pears. Lea eats 2 plums. Kim likes 3 figs.", "Tom has 5 pears. Tom eats 2 plums. Tom likes 3 figs.".replace("Tom", "Kim")]
    assert leaked(spark, texts, [item, "Tom has 5 pears. Tom eats 2 plums. Tom likes 3 figs."]) == {
        (0, 0): ("reparameterised", 17), (1, 0): ("reparameterised", 17), (3, 1): ("reparameterised", 12)}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(r[0], int(r[0] % 9 == 0), 1) for r in ROWS if r[0] < 120] * 2 + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    import domlake.llm.toxicity as t
    old, t.CONTEXTS = t.CONTEXTS, 4
    try:
        model = t.learn(docs, labels)
    finally:
        t.CONTEXTS = old
    assert {b"worthless", b"idiot"} & set(model.machine.terms)
    rows = {r.doc_id: r for r in t.classify(docs, model).collect()}
    assert t.classify(docs, model).count() == len(ROWS)
    for i in range(120):
        assert rows[i].predicted == (i % 9 == 0) and rows[i].held_out == crc(i, 4)
    assert all(rows[i].predicted == 0 and 0 <= rows[i].score <= 1 for i in (200, 201, 202, 203, 206, 207))
    nothing = t.learn(docs, labels.limit(0))
    assert {r.predicted for r in t.classify(docs, nothing).collect()} == {0} and t.classify(none, model).count() == 0


def test_all_toxic_terms_are_kept():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"abcdefghijklmnop") for _ in range(8)) for _ in range(90)})
    counts = {w[:n]: (20, 0) for w in words for n in range(4, 9)}
    chosen = toxicity.choose(counts)
    assert len(chosen) > 80 and all(any(w.startswith(c) for c in chosen) for w in words)
    machine = toxicity.Automaton(chosen)
    text = np.frombuffer(b"".join(words), np.uint8)
    starts = np.arange(len(words)) * 8
    assert list(machine.match(text, starts, starts + 8)[0]) == list(range(len(words)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(4)
    terms = [b"idiot", b"worthless", b"scum", b"extraordinary"]
    machine = toxicity.Automaton(terms)
    words = [bytes(r.choice(b"idotwrhlescumxa") for _ in range(r.randint(1, 14))) for _ in range(600)]
    for t in terms:
        for _ in range(60):
            w = bytearray(t)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w) + 1)
                w[at: at + r.randint(0, 1)] = bytes(r.choice(b"idotwx") for _ in range(r.randint(0, 1)))
            words.append(bytes(w) or b"q")
    ends = np.cumsum([len(w) for w in words])
    hit, kind = machine.match(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    got = {int(i): int(k - 1) % 2 for i, k in zip(hit, kind)}
    for i, w in enumerate(words):  # a term, or a misspelling, at the beginning of the word
        least = {t: min(edits(w[:n], t) for n in range(1, len(w) + 1)) for t in terms}
        fits = [d for t, d in least.items() if d <= toxicity.edits_for(t)]
        assert (i in got) == bool(fits), w
        if fits:
            assert (got[i] == 0) == (min(fits) == 0), w


def test_lm_scores(spark, docs, none):
    got = {}
    model = kneser_ney.learn(docs)
    for r in kneser_ney.score(docs, model).collect():
        got[r.doc_id] = r
    count = Counter()
    for r in ROWS:
        if not crc(r[0], 7):
            count.update([*spaced(r[1]), "\n"])
    n, v = sum(count.values()), len(count)
    for r in ROWS:
        w, x = [*spaced(r[1]), "\n"], got[r[0]]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(w), sum(count[y] > 0 for y in w), n, crc(r[0], 7))
        assert math.isclose(x.base_score, sum(math.log10((count[y] + 1) / (n + v + 1)) for y in w), rel_tol=1e-9)
        assert x.score < 0 and math.isfinite(x.score)
    empty = kneser_ney.learn(none)
    x = {r.doc_id: r for r in kneser_ney.score(docs, empty).collect()}
    assert x[201].base_score == 0 and x[201].n_known == 0 and math.isclose(x[201].score, 2 * math.log10(1 / 257))
    assert kneser_ney.score(none, model).count() == 0


def test_words_are_given_the_one_before(spark, docs):
    model = kneser_ney.learn(docs)
    two, follows, known = Counter(), Counter(), Counter()
    for r in ROWS:
        if not crc(r[0], 7):
            w = ["", *spaced(r[1]), "\n"]
            two.update(zip(w, w[1:]))
    follows.update(y for _, y in two)
    known.update(x for x, _ in two)
    rare = lambda c: [sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]
    cut, low = kneser_ney.discounts(*rare(two)), kneser_ney.discounts(*rare(follows))
    off = lambda n, d: d[min(n, 3) - 1] if n else 0
    total, left = Counter(), Counter()
    for (x, _), n in two.items():
        total[x] += n
        left[x] += off(n, cut)

    def word(y):
        b = y.encode()
        codes, _ = kneser_ney.spelled(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
        return (follows[y] - off(follows[y], low) + sum(off(n, low) for n in follows.values()) * 10 ** model.log10(codes).sum()) / len(two)

    def given(x, y):
        return (two[x, y] - off(two[x, y], cut) + left[x] * word(y)) / total[x] if known[x] else word(y)
    texts = [r[1] for r in ROWS if len(r[1] or "") < 400] + ["unseen a", "a unseen", "other a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in kneser_ney.score(df, model).collect():
        w = ["", *spaced(texts[r.doc_id]), "\n"]
        assert math.isclose(r.score, sum(math.log10(given(x, y)) for x, y in zip(w, w[1:])), rel_tol=1e-9), texts[r.doc_id]
    train = spark.createDataFrame([(i, "red apple") for i in range(20)], "doc_id long, text string")
    turned = spark.createDataFrame([(1, "red apple"), (2, "apple red")], "doc_id long, text string")
    one, other = (r.score for r in kneser_ney.score(turned, kneser_ney.learn(train)).orderBy("doc_id").collect())
    assert one > other + 1


def test_spelling_sums_to_one(docs):
    model = kneser_ney.learn(docs)
    for context in (b"    ", b"   e", b"nisr", b"zzzz"):
        codes = [int.from_bytes(context + bytes([b]), "big") for b in range(256)]
        total = (10 ** model.log10(np.array(codes, np.uint64))).sum() + kneser_ney.UNIFORM * 0
        assert 0.9 < total <= 1.0001, context


def test_licenses(docs, none, spark):
    texts = {1: "Released under the MIT License.", 2: "GNU general-public LICENSE and again gnu General public license", 3: "cc by; CC-BY", 4: None, 5: "",
             6: "apache\nlicense mit", 7: "Permission is hereby granted, free of charge, to any smart person obtaining a copy of this software and associated files "
             "to deal in the Software without restriction", 8: "nothing here", 9: "x " * 30000 + "mit license", 10: "mitlicense license mit"}
    df = spark.createDataFrame([(i, t, "l") for i, t in texts.items()] + [(1, texts[1], "l"), (None, "apache license", "l")], "doc_id long, text string, labels string")
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts.get(r.doc_id, "apache license")))
        at = sorted((i, label) for p, label in license_scan.PHRASES for q in [p.split()] for i in range(len(w)) if w[i: i + len(q)] == q)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "mit,mit-release" and "mit-notice" in by[7].labels and by[8].score == 0
    assert license_scan.scan(none).count() == 0


def brute_repeats(texts):
    size = suffix_dedup.WINDOW
    count = Counter(t[i: i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i: i + size]] > 1:
                gone[i: i + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [4, 64])
def test_repeated_bytes(spark, none, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "VERY_CROWDED", 3 * crowded)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 5000)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé ") for _ in range(r.randint(2, 9)))
    base = [" ".join(word() for _ in range(r.randint(5, 300))) for _ in range(30)]
    texts = list(base)
    for _ in range(40):
        c = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            c[r.randrange(len(c))] = "Z"
        texts.append("".join(c) + r.choice(base)[r.randint(0, 50): r.randint(100, 600)])
    p = "".join(r.choice("xyzw") for _ in range(450))
    texts += [word() * r.randint(1, 30) + p[r.randint(0, 30): r.randint(300, 450)] + word() * r.randint(1, 20) for _ in range(80)]
    texts += ["", None, "a" * 1000, "ab" * 300, "a" * 199, "a" * 200, "short", "q" * 200, base[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int").repartition(5)
    found = suffix_dedup.search(df)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.measure(df, found).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])
    kept = {x.doc_id: x.text for x in suffix_dedup.remove(df, found).collect()}
    assert kept[texts.index(None)] is None and kept[texts.index("")] == "" and kept[texts.index("short")] == "short"
    assert suffix_dedup.measure(none, suffix_dedup.search(none)).count() == 0


def test_suffix_array():
    r = random.Random(3)
    for n in (0, 1, 2, 5, 30, 300):
        for letters in (1, 2, 5):
            x = np.array([r.randint(1, letters) for _ in range(n)] + [0])
            suffixes = suffix_dedup.suffix_array(x, 8)
            assert suffixes.tolist() == sorted(range(n + 1), key=lambda i: x[i:].tolist())
            shared = suffix_dedup.permuted_prefixes(x, suffixes, 20)
            for a, b in zip(suffixes, suffixes[1:]):
                k = next((k for k in range(n + 2) if b + k > n or a + k > n or x[a + k] != x[b + k]), 0)
                assert min(shared[b], 20) == min(k, 20)


def test_very_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    monkeypatch.setattr(common, "CHUNK", 2000)
    r = random.Random(9)
    long = "".join(r.choice("abcdef") for _ in range(20000))
    texts = [long + long[4000:9000], long[500:1500] + "-" + long[100:250], "y" * 7000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.measure(df, suffix_dedup.search(df)).collect()}
    assert [got[i] for i in range(3)] == brute_repeats([t.encode() for t in texts])


def test_mixing(docs, none):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(docs.columns) <= set(out.columns)
    total = sum(r.n_tokens for r in rows)
    for name, power in mixing.POWERS.items():
        tokens, weighted = Counter(), Counter()
        for r in rows:
            tokens[r[name]] += r.n_tokens
            weighted[r[name]] += r.n_tokens * r.weight
        share = {k: (t / total) ** power for k, t in tokens.items() if t}
        if name == "topic":  # the dimension that was fitted last is met exactly
            for k, s in share.items():
                assert math.isclose(weighted[k] / total, s / sum(share.values()), rel_tol=1e-6)
        else:
            assert all(abs(weighted[k] / total - s / sum(share.values())) < 0.05 for k, s in share.items())
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert math.isclose(expected, mixing.KEEP * total, rel_tol=1e-6) and all(0 <= r.probability <= 1 for r in rows)
    for r in rows:
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 2**52
        assert r.selected == (u < r.probability) and (r.n_tokens == len(spaced(r.text)))
    assert mixing.mix(none).count() == 0


def test_pipeline_stages(spark, docs, none, data):
    current = docs.drop("score")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, data).cache()
        if name != "mixing":
            assert out.columns == current.columns
        before, after = {r.doc_id: r.text for r in current.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        seen.append((name, before, after))
        assert stage(spark, none.drop("score"), data).count() == 0
        current = spark.createDataFrame(out.collect(), out.schema)
    by = {name: (before, after) for name, before, after in seen}
    assert set(by["language_id"][0]) - set(by["language_id"][1]) >= {200, 201, 202, 203}
    assert set(range(120)) <= set(by["language_id"][1])
    before, after = by["ngram_jaccard_join"]
    parts = brute_components({i: shingles(t, 5) for i, t in before.items()}, 80)
    assert set(after) == {i for i in before if parts[i] == i}
    before, after = by["suffix_array_dedup"]
    want = dict(zip(before, brute_repeats([t.encode() for t in before.values()])))
    assert all(hashlib.sha256(after[i].encode()).hexdigest() == want[i][3] for i in after if after[i].isascii())
    assert all(want[i][0] == want[i][1] or not re.search(r"\w", before[i]) or want[i][1] > 0 for i in set(before) - set(after))


def test_registered():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES}
    assert numbers == set(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, data, name):
    import compare
    result = registry.QUERIES[name](spark, data)
    names, ours, _ = compare.rows_of(result.columns, result.collect())
    answer = compare.duck(data).execute(registry.ORACLES[name])
    theirs_names, theirs, _ = compare.rows_of([c[0] for c in answer.description], answer.fetchall())
    assert names == theirs_names and ours == theirs


def test_arrays_round_trip(tmp_path):
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    for b in range(4):
        part = keys[(keys >> np.uint64(62)) == b]
        arrays.save(f"file://{tmp_path}", f"t-{b}", part, part.astype(float))
    values, had = arrays.find(f"file://{tmp_path}", {b: f"t-{b}" for b in range(4)}, 2, np.append(keys[::7], np.uint64(5)))
    assert had[:-1].all() and not had[-1] and (values[:-1] == keys[::7].astype(float)).all()
