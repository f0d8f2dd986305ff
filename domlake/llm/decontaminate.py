"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become rows of tokens: words in lower case, and codes that say which are numbers, units after a number,
capitalised words inside a sentence (names) and at its start. Windows of tokens are hashed in three templates
and joined with the benchmark's: numbers and units as placeholders; names too; capitalised words at the start
of a sentence too. A hit gives a diagonal, and all of the item is compared along it, token by token. A match
has slots, the placeholders it covers; each value of the item must stand for one value of the document and
the other way round, so a question with other numbers and names is found and unlike texts of the same shape
are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: Tokens of a window, and of the least match; an item shorter than that must match whole. Eleven catch every
#: passage of twelve words: its first word may count as a name where it stands in a sentence.
WINDOW, LEAST = 8, 11
#: Equal words that a match with other numbers or names must hold; exact copies need none. Windows of the
#: benchmark with fewer literal words are looked for only where no window near them has more.
LITERAL = 4
#: Benchmark windows that are broadcast, at most; more are joined by a shuffle.
SENT = 200_000
#: Units that count as such after a number.
UNITS = ("mm cm m km mg g kg t ml l s sec seconds min minutes h hours days weeks months years percent "
         "dollars euros cents pounds usd eur miles feet inches meters metres grams liters litres degrees").split()
#: Codes of numbers, units, names, capitalised words that open a sentence and other words, and
#: tokens that end a sentence.
NUMBER, UNIT, NAME, FIRST, WORD, ENDS = 0, 1, 2, 3, 4, [".", "!", "?", "\n"]
#: Codes under these are placeholders of a template; "open" holds NAME for FIRST.
TEMPLATES = {"plain": NAME, "open": WORD, "named": FIRST}
_TOKEN = r"[.!?\n]|[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """df with words and codes, arrays of the text's tokens, in place of the text. Generating from one-element
    arrays keeps the optimiser from working the tokens out again wherever they are used."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_TOKEN), F.lit(0))
    others = [c for c in df.columns if c != text]
    raw = df.select(*others, F.explode(F.array(found)).alias("raw"))

    lowered = F.split(F.lower(F.array_join("raw", " ")), " ")  # at once, as lambdas are slow
    digit = lambda c: (c < ":") & (c >= "0")
    word = lambda x: x >= "A"  # above all other tokens

    def one(x, i):
        before, small = F.get("raw", i - 1), F.get("small", i)
        first = F.substring(x, 1, 1)
        code = (F.when(~word(x), F.when(digit(x), NUMBER).otherwise(-1)).when(digit(before) & small.isin(*UNITS), UNIT)
                .when(x == small, WORD).when(F.lower(first) == first, WORD).when((i > 0) & ~before.isin(*ENDS), NAME).otherwise(FIRST))
        return F.struct(small.alias("word"), code.alias("code"))
    said = F.filter(F.transform("raw", one), lambda x: x["code"] >= 0)
    return (raw.select("*", F.explode(F.array(lowered)).alias("small")).select(*others, F.explode(F.array(said)).alias("said"))
            .select(*others, F.col("said.word").alias("words"), F.col("said.code").alias("codes")))


def _rolled(values: Column, length: int, both) -> Column:
    """For each place of an array, ``both`` over the ``length`` values from there, put together from halves: a slice for
    each window would read the whole array each time. The last length - 1 places hold less."""
    if length == 1:
        return values
    half, join = length // 2, lambda x, y: both(x, y)
    # a lambda over one array holds the halves, or they would be worked out twice
    out = F.get(F.transform(F.array(_rolled(values, half, both)), lambda h: F.zip_with(h, F.slice(h, half + 1, F.size(h)), join)), F.lit(0))
    return F.zip_with(out, F.slice(values, length, F.size(values)), join) if length % 2 else out


def windows(df: DataFrame, length: int = WINDOW) -> DataFrame:
    """df (with words and codes) with at, template (its number) and hash, rows for each window of length tokens
    in each template, in place of words and codes; the same hash may come twice. Windows of numbers and units
    alone are hashed as they are in the first template."""
    others = [c for c in df.columns if c not in ("words", "codes")]
    df = df.where(F.size("words") >= length)
    plain = F.zip_with("words", "codes", lambda w, c: F.xxhash64(F.when(c >= NAME, w).otherwise(c.cast("string"))))
    df = df.select(*others, "words", "codes", F.explode(F.array(plain)).alias("plain"))
    masked = lambda name: F.zip_with("plain", "codes", lambda h, c: F.when((c >= TEMPLATES[name]) | (c < NAME), h).otherwise(F.lit(NAME)))
    both = F.array_contains("codes", NAME) & F.array_contains("codes", FIRST)
    bare = F.array_join(F.col("codes").cast("array<string>"), "").rlike(f"[{NUMBER}{UNIT}]{{{length}}}")
    df = df.select(*others, "codes", F.explode(F.array(F.struct(
        F.col("plain"), masked("open").alias("open"), F.when(both, masked("named")).alias("named"),
        F.when(bare, F.transform("words", lambda w: F.xxhash64(w))).alias("raw")))).alias("h"))
    n = F.size("codes") - length + 1
    hashes = lambda name: F.slice(_rolled(F.col(f"h.{name}"), length, F.xxhash64), 1, n)
    most = F.slice(_rolled(F.col("codes"), length, F.greatest), 1, n)
    mixed = F.zip_with(F.zip_with(hashes("raw"), hashes("plain"), lambda r, p: F.struct(r.alias("r"), p.alias("p"))), most,
                       lambda h, c: F.when(c < NAME, h["r"]).otherwise(h["p"]))
    none = F.array().cast("array<bigint>")
    found = F.concat(F.when(F.col("h.raw").isNull(), hashes("plain")).otherwise(mixed), hashes("open"),
                     F.when(F.col("h.named").isNotNull(), hashes("named")).otherwise(none))
    return (df.select(*others, n.alias("n_windows"), F.posexplode(found).alias("at", "hash"))
            .select(*others, (F.col("at") % F.col("n_windows")).alias("at"), F.expr("at div n_windows").alias("template"), "hash"))


def _sought(shape: DataFrame, short: list[int]) -> DataFrame:
    """hash, item_id, size, item_at: the benchmark's windows that are looked for. A window with fewer than
    LITERAL literal words is one of them if it has the most in a stretch of LEAST tokens, so every stretch
    with a literal word has a window; the others are found by the comparison along the diagonal. Items
    shorter than a window are looked for whole."""
    def count(slots):
        literal = F.transform("codes", lambda c: (c >= slots).cast("int"))
        total = lambda i: F.size(F.filter(F.slice(literal, i, WINDOW), lambda x: x == 1))
        return F.transform(F.sequence(F.lit(1), F.size("codes") - WINDOW + 1), total)
    group = LEAST - WINDOW + 1
    counted = shape.where(F.col("size") >= WINDOW).select("item_id", "size", "words", "codes", F.struct(*[count(slots).alias(n) for n, slots in TEMPLATES.items()]).alias("n"))
    found = windows(counted).withColumn("c", F.coalesce(*[F.when(F.col("template") == i, F.col(f"n.{n}")) for i, n in enumerate(TEMPLATES)]))
    mine = F.get("c", F.col("at"))
    most = F.exists(F.sequence(F.greatest(F.col("at") - group + 1, F.lit(0)), F.greatest(F.least(F.col("at"), F.size("c") - group), F.lit(0))),
                    lambda g: F.array_max(F.slice("c", g + 1, group)) <= mine)
    found = found.where((mine >= LITERAL) | (most & ((mine > 0) | (F.col("template") == 0))))
    for length in short:
        found = found.select("hash", "item_id", "size", "at").unionByName(
            windows(shape.where(F.col("size") == length).select("item_id", "size", "words", "codes"), length).select("hash", "item_id", "size", "at"))
    return found.select("hash", "item_id", "size", F.col("at").alias("item_at")).distinct()


def _runs(ends: list[str]) -> Column:
    """Structs of start, n_tokens and bridged: the longest runs of marks without those of ends."""
    at = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), lambda i: F.get("marks", i).isin(*ends))
    at = F.concat(F.array(F.lit(-1)), at, F.array(F.size("marks")))
    spans = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda x, y: F.struct(
        (x + 1).alias("start"), (y - x - 1).alias("n_tokens"), F.lit(len(ends) == 1).alias("bridged")))
    return F.filter(spans, lambda s: s["n_tokens"] > 0)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matches of docs (doc_id, text) with benchmark (item_id, text): doc_id, item_id, start and item_start
    (tokens from 0), n_tokens, coverage (share of the item), kind (exact, reparameterised).

    A match has LEAST tokens in a row of one diagonal, or all of an item; the longest match of a document and
    item is given. Tokens agree if they are equal in lower case, or if both are numbers, units or capitalised
    words; where one of two capitalised words opens a sentence, runs with and without it are tried. A match
    that is not exact holds LITERAL equal words, so re-parameterised copies of items with fewer are not found.
    Nor are they where the document's letter case differs (all in capitals, say) and other names or numbers
    leave no WINDOW tokens in a row of one template.
    Null and empty texts have no tokens. A slot that is filled in two ways drops a match unless LEAST of its
    tokens are literal. Rows that repeat count once; null ids are matched like others. No rows on either
    side give no rows; other columns are not read."""
    shape = common.checkpoint(tokens(benchmark.select("item_id", "text").distinct()).withColumn("size", F.size("words")))
    # lengths under WINDOW, so a few at most
    short = sorted(r[0] for r in shape.where((F.col("size") > 0) & (F.col("size") < WINDOW)).select("size").distinct().collect())
    sought = common.checkpoint(_sought(shape, short))
    if sought.limit(SENT + 1).count() <= SENT:
        sought = F.broadcast(sought)
    base = docs.select("doc_id", "text")
    said = tokens(base)
    hits = windows(said).join(sought.where(F.col("size") >= WINDOW), "hash").drop("template")
    for length in short:
        hits = hits.unionByName(windows(said, length).join(sought.where(F.col("size") == length), "hash").drop("template"))
    found = common.checkpoint(hits.groupBy("doc_id", "item_id", "size").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts")))
    ids = found.select("doc_id").distinct()
    some = base.join(F.broadcast(ids) if ids.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS else ids,
                     base["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").distinct()
    said = tokens(some).select(F.col("doc_id").alias("d"), F.col("words").alias("doc_words"), F.col("codes").alias("doc_codes"))
    item = shape.select(F.col("item_id").alias("i"), F.col("words").alias("item_words"), F.col("codes").alias("item_codes"), F.col("size").alias("s"))
    both = (found.join(said, found["doc_id"].eqNullSafe(said["d"])).join(item, found["item_id"].eqNullSafe(item["i"]) & (found["size"] == item["s"])))

    def line(shift):
        first = F.greatest(-shift, F.lit(0))
        n = F.greatest(F.least(F.col("size") - first, F.size("doc_words") - first - shift), F.lit(0))
        return F.struct(first.alias("first"), shift.alias("shift"), F.arrays_zip(
            F.slice("item_words", first + 1, n).alias("a"), F.slice("item_codes", first + 1, n).alias("c"),
            F.slice("doc_words", first + shift + 1, n).alias("b"), F.slice("doc_codes", first + shift + 1, n).alias("e")).alias("pairs"))
    lines = (both.select("doc_id", "item_id", "size", F.explode(F.transform("shifts", line)).alias("l"))
             .select("doc_id", "item_id", "size", "l.*").where(F.size("pairs") > 0))
    same = lambda x: x["a"] == x["b"]
    mark = lambda x: (F.when(same(x) | (x["c"].isin(NUMBER, UNIT, NAME) & (x["c"] == x["e"])), "=")
                      .when(x["c"].isin(NAME, FIRST) & x["e"].isin(NAME, FIRST), "?").otherwise("x"))
    marked = lines.select("*", F.explode(F.array(F.transform("pairs", mark))).alias("marks"))
    runs = marked.select("*", F.explode(F.array_distinct(F.concat(_runs(["x"]), _runs(["x", "?"])))).alias("run")).select("*", "run.*")
    runs = runs.where((F.col("n_tokens") >= LEAST) | (F.col("n_tokens") == F.col("size")))
    runs = runs.withColumn("m", F.slice("pairs", F.col("start") + 1, F.col("n_tokens")))
    slots = F.filter("m", lambda x: x["c"].isin(NUMBER, UNIT, NAME) | (F.col("bridged") & (x["c"] == FIRST)))
    runs = runs.select("*", F.explode(F.array(slots)).alias("slots"))
    ways = F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))))
    consistent = ((ways == F.size(F.array_distinct(F.col("slots.a")))) & (ways == F.size(F.array_distinct(F.col("slots.b")))))
    literal = F.col("n_tokens") - F.size("slots") >= LEAST
    exact = F.forall("m", same)
    enough = F.size(F.filter("m", lambda x: same(x) & ~x["c"].isin(NUMBER, UNIT))) >= LITERAL
    first = F.col("first") + F.col("start")
    best = F.struct("n_tokens", (-first).alias("f"), (-first - F.col("shift")).alias("w"),
                    F.when(exact, "exact").otherwise("reparameterised").alias("kind"))
    return (runs.where(exact | (enough & (consistent | literal))).groupBy("doc_id", "item_id").agg(F.max(F.struct(best.alias("best"), "size")).alias("x"))
            .select("doc_id", "item_id", (-F.col("x.best.w")).alias("start"), (-F.col("x.best.f")).alias("item_start"),
                    F.col("x.best.n_tokens").alias("n_tokens"), (F.col("x.best.n_tokens") / F.col("x.size")).alias("coverage"), F.col("x.best.kind").alias("kind")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
