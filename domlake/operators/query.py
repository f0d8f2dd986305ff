"""Element queries: filters, relevance, top-k per capture, refinement facets, id attachment.

A request is a plain mapping; every key is optional:

    kind, region            text or list of text
    label                   text (substring) or {text, mode, case_sensitive, overlap, prefix, sim}
    state                   {flag: wanted value}
    group_id, heading_context
    limit (10), min_score, sort_by_relevance, include_suggestions
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import rules
from ..functions.text import fuzzy_score, normalize_literal, normalize_text, squeeze, tokenize
from . import identity



@dataclass(frozen=True)
class LabelFilter:
    text: str
    mode: str = "contains"
    case_sensitive: bool = False
    overlap: float = 0.5
    prefix: bool = True
    sim: float = 0.8
    max_tokens: int | None = None

    @classmethod
    def of(cls, value) -> "LabelFilter":
        return cls(value) if isinstance(value, str) else cls(**value)

    @property
    def needle(self) -> str:
        return normalize_literal(self.text if self.case_sensitive else self.text.lower())

    @property
    def tokens(self) -> list[str]:
        return [w for w in self.needle.split(" ") if len(w) > 2][: self.max_tokens]

    def haystack(self, label: Column) -> Column:
        return squeeze(label if self.case_sensitive else F.lower(label))


def _aslist(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def expand_kind(kind: str) -> list[str]:
    """User-facing kind names to stored kinds."""
    return {"textbox": ["input", "textarea"], "alert": rules.LIVE_KINDS}.get(kind, [kind])


# -- predicates ---------------------------------------------------------------------------------

def filter_kind(nodes: DataFrame, kind) -> DataFrame:
    return nodes.filter(F.col("kind").isin(_aslist(kind)))


def label_matches(label, flt: LabelFilter) -> Column:
    """Exact or substring test; an empty text keeps everything."""
    label = F.col(label) if isinstance(label, str) else label
    if not flt.text:
        return F.lit(True)
    hay = flt.haystack(label)
    return hay == flt.needle if flt.mode == "exact" else F.contains(hay, F.lit(flt.needle))


def filter_label(nodes: DataFrame, value) -> DataFrame:
    return nodes.filter(label_matches("label", LabelFilter.of(value)))


def fuzzy_label_score(label, flt: LabelFilter) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return fuzzy_score(tokenize(flt.haystack(label), flt.max_tokens, 2), flt.tokens, flt.prefix, flt.sim)


def filter_label_fuzzy(nodes: DataFrame, value) -> DataFrame:
    """Rows whose label shares enough tokens with the query, with ``label_score``.  A query without
    usable tokens matches nothing."""
    flt = LabelFilter.of(value)
    if not flt.tokens:
        return nodes.limit(0).withColumn("label_score", F.lit(None).cast("double"))
    return nodes.withColumn("label_score", fuzzy_label_score("label", flt)).filter(
        F.col("label_score") >= flt.overlap)


def filter_region(nodes: DataFrame, region) -> DataFrame:
    return nodes.filter(F.col("where.region").isin(_aslist(region)))


def state_is(flag: str, wanted) -> Column:
    """A missing flag counts as false; 'mixed' is neither true nor false."""
    if flag not in rules.STATE_FIELDS:
        raise ValueError(f"unknown state flag {flag!r}")
    have = F.col(f"state.{flag}").cast("string")
    want = str(wanted).lower() if isinstance(wanted, bool) else wanted
    return F.coalesce(have, F.lit("false")) == want


def filter_state(nodes: DataFrame, constraint: dict) -> DataFrame:
    test = F.col("state").isNotNull()
    for flag, wanted in constraint.items():
        if wanted is not None:
            test = test & state_is(flag, wanted)
    return nodes.filter(test)


def filter_group(nodes: DataFrame, group_id: str) -> DataFrame:
    return nodes.filter(F.col("where.group_id") == group_id)


def filter_heading(nodes: DataFrame, heading: str) -> DataFrame:
    return nodes.filter(F.col("where.heading_context") == heading)


# -- relevance ----------------------------------------------------------------------------------

def _state_items(request: dict) -> dict:
    return {k: v for k, v in (request.get("state") or {}).items() if v is not None}


def max_score(request: dict) -> float:
    top = rules.VISIBLE_WEIGHT
    if request.get("label") is not None:
        top += rules.LABEL_WEIGHT[LabelFilter.of(request["label"]).mode]
    top += rules.KIND_WEIGHT if request.get("kind") is not None else 0
    top += rules.REGION_WEIGHT if request.get("region") is not None else 0
    top += rules.STATE_WEIGHT * len(_state_items(request))
    top += rules.GROUP_WEIGHT if request.get("group_id") is not None else 0
    top += rules.HEADING_WEIGHT if request.get("heading_context") is not None else 0
    return top


def _state_hits(request: dict) -> Column:
    hits = F.lit(0)
    for flag, wanted in _state_items(request).items():
        same = F.col(f"state.{flag}").cast("string") == str(wanted).lower()
        hits = hits + F.coalesce(same, F.lit(False)).cast("int")
    return hits


def _contributions(request: dict, label_score: Column | None) -> list[tuple[str, Column, Column]]:
    """(type, description, contribution) of every part of the request; null when it adds nothing."""
    out = []
    if request.get("label") is not None:
        flt = LabelFilter.of(request["label"])
        weight = F.lit(rules.LABEL_WEIGHT["contains" if flt.mode == "fuzzy" else flt.mode])
        if flt.mode == "fuzzy" and label_score is not None:
            weight = F.coalesce(F.lit(rules.LABEL_WEIGHT["fuzzy"]) * label_score, weight)
        shown = F.when(F.length("label") <= 30, F.col("label")).otherwise(
            F.concat(F.substring("label", 1, 29), F.lit("…")))
        out.append(("label", F.concat(F.lit('Label "'), shown, F.lit('" matches query')), weight))
    if request.get("kind") is not None:
        out.append(("kind", F.concat(F.lit('Kind "'), F.col("kind"), F.lit('" matches filter')),
                    F.lit(rules.KIND_WEIGHT)))
    if request.get("region") is not None:
        out.append(("region", F.concat(F.lit('Region "'), F.col("where.region"),
                                       F.lit('" matches filter')), F.lit(rules.REGION_WEIGHT)))
    states = _state_items(request)
    if states:
        names = F.array_join(F.array_compact(F.array(*[
            F.when(F.col(f"state.{k}").cast("string") == str(v).lower(), F.lit(k))
            for k, v in states.items()])), ", ")
        hits = _state_hits(request)
        out.append(("state", F.concat(F.lit("States match: "), names),
                    F.when(hits > 0, hits * F.lit(rules.STATE_WEIGHT))))
    if request.get("group_id") is not None:
        out.append(("group", F.concat(F.lit('Group "'), F.col("where.group_id"),
                                      F.lit('" matches')), F.lit(rules.GROUP_WEIGHT)))
    if request.get("heading_context") is not None:
        out.append(("heading", F.concat(F.lit('Heading context "'),
                                        F.col("where.heading_context"), F.lit('" matches')),
                    F.lit(rules.HEADING_WEIGHT)))
    return out


def score_match(request: dict, label_score: Column | None = None) -> Column:
    """Relevance in 0..1 of a row that passed the request's filters."""
    total = F.lit(0.0)
    for _, _, value in _contributions(request, label_score):
        total = total + F.coalesce(value, F.lit(0.0))
    total = total + F.when(F.coalesce("state.visible", F.lit(False)),
                           F.lit(rules.VISIBLE_WEIGHT)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total / F.lit(max_score(request)))


def match_reasons(request: dict, label_score: Column | None = None) -> Column:
    reasons = [
        F.when(v.isNotNull(), F.struct(F.lit(t).alias("type"), d.alias("description"),
                                       v.cast("double").alias("contribution")))
        for t, d, v in _contributions(request, label_score)
    ]
    if not reasons:
        return F.array().cast("array<struct<type:string,description:string,contribution:double>>")
    return F.array_compact(F.array(*reasons))


# -- whole requests -----------------------------------------------------------------------------

def candidates(nodes: DataFrame, request: dict) -> DataFrame:
    """Rows that pass all filters of the request, with ``relevance`` and ``match_reasons``."""
    out, score = nodes, None
    if request.get("kind") is not None:
        out = filter_kind(out, request["kind"])
    if request.get("region") is not None:
        out = filter_region(out, request["region"])
    if request.get("state") is not None:
        out = filter_state(out, request["state"])
    if request.get("group_id") is not None:
        out = filter_group(out, request["group_id"])
    if request.get("heading_context") is not None:
        out = filter_heading(out, request["heading_context"])
    if request.get("label") is not None:
        if LabelFilter.of(request["label"]).mode == "fuzzy":
            out, score = filter_label_fuzzy(out, request["label"]), F.col("label_score")
        else:
            out = filter_label(out, request["label"])
    out = out.withColumn("relevance", score_match(request, score)).withColumn(
        "match_reasons", match_reasons(request, score))
    if request.get("min_score") is not None:
        out = out.filter(F.col("relevance") >= request["min_score"])
    return out


def rank_matches(matches: DataFrame, limit: int | None = None, by_relevance: bool = False,
                 keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """First ``limit`` rows (all, if None) of each capture with their ``match_rank`` and the capture's
    ``total_matched``.  A capture is one document, so the window is bounded by its size."""
    w = W.partitionBy(*keys)
    order = ([F.desc("relevance")] if by_relevance else []) + [F.asc("doc_order")]
    out = matches.withColumn("match_rank", F.row_number().over(w.orderBy(*order))).withColumn(
        "total_matched", F.count("*").over(w))
    return out if limit is None else out.filter(F.col("match_rank") <= limit)


def find(nodes: DataFrame, request: dict | None = None) -> DataFrame:
    """Answer one request for every capture in ``nodes``."""
    request = request or {}
    return rank_matches(candidates(nodes, request), request.get("limit"),
                        bool(request.get("sort_by_relevance")))


def nodes_evaluated(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("snapshot_id").agg(F.count("*").alias("nodes_evaluated"))


REQUEST_TABLE = (
    "request_id bigint, kinds array<string>, regions array<string>, has_state boolean, "
    "states array<struct<flag:string,want:string>>, group_id string, heading string, mode string, "
    "sensitive boolean, needle string, tokens array<string>, overlap double, prefix boolean, sim double, "
    "max_tokens int, k int, min_score double, by_relevance boolean, top double"
)


def request_table(spark: SparkSession, requests: list[dict]) -> DataFrame:
    """Requests as rows; ``request_id`` is the place in the list. An empty label text keeps every label."""
    rows = []
    for i, r in enumerate(requests):
        flt = LabelFilter.of(r["label"]) if r.get("label") is not None else None
        for flag in _state_items(r):
            state_is(flag, True)
        rows.append((
            i, *(None if r.get(c) is None else _aslist(r[c]) for c in ("kind", "region")), r.get("state") is not None,
            [(k, str(v).lower() if isinstance(v, bool) else v) for k, v in _state_items(r).items()],
            r.get("group_id"), r.get("heading_context"), flt and (flt.mode if flt.text or flt.mode == "fuzzy" else f"any {flt.mode}"),
            flt and flt.case_sensitive, flt and flt.needle, flt and flt.tokens, flt and float(flt.overlap),
            flt and flt.prefix, flt and float(flt.sim), flt and flt.max_tokens, r.get("limit"),
            None if r.get("min_score") is None else float(r["min_score"]), bool(r.get("sort_by_relevance")),
            float(max_score(r))))
    # Arrow tables become local relations, whose size the planner knows
    schema = to_arrow_schema(StructType.fromDDL(REQUEST_TABLE))
    named = [dict(zip(schema.names, row, strict=True)) for row in rows]
    for row in named:
        row["states"] = [{"flag": k, "want": v} for k, v in row["states"]]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema))


def complete_requests(requests: DataFrame) -> DataFrame:
    """A table of requests in the layout of ``REQUEST_TABLE`` from one with ``request_id`` and any of kinds, regions,
    states, group_id, heading, text, mode, sensitive, overlap, prefix, sim, max_tokens, k, min_score and
    by_relevance; a missing or null one is as a request that leaves it out. ``text`` asks for labels."""
    kinds = dict(part.strip().split(" ", 1) for part in REQUEST_TABLE.replace("flag:string,want", "flag:string;want").split(","))
    kinds = {k: v.replace(";", ",") for k, v in kinds.items()} | {"text": "string"}
    have = set(requests.columns)
    col = lambda c, default=None: F.coalesce(F.col(c).cast(kinds[c]) if c in have else F.lit(None).cast(kinds[c]), F.lit(default).cast(kinds[c]))
    text, sensitive = col("text"), col("sensitive", False)
    needle = normalize_text(F.when(sensitive, text).otherwise(F.lower(text)))
    tokens, upto = tokenize(needle, None, 2), col("max_tokens")
    asked = col("mode", "contains")
    label = F.element_at(F.create_map(*[x for m, weight in rules.LABEL_WEIGHT.items() for x in (F.lit(m), F.lit(weight))]), asked)
    states = F.coalesce(col("states"), F.array().cast(kinds["states"]))
    top = F.lit(rules.VISIBLE_WEIGHT) + F.when(text.isNotNull(), label).otherwise(0.0) + F.when(
        col("kinds").isNotNull(), rules.KIND_WEIGHT).otherwise(0.0) + F.when(col("regions").isNotNull(), rules.REGION_WEIGHT).otherwise(
        0.0) + F.lit(rules.STATE_WEIGHT) * F.size(states) + F.when(col("group_id").isNotNull(), rules.GROUP_WEIGHT).otherwise(
        0.0) + F.when(col("heading").isNotNull(), rules.HEADING_WEIGHT).otherwise(0.0)
    mode = F.when((text == "") & (asked != "fuzzy"), F.concat(F.lit("any "), asked)).otherwise(asked)
    columns = {
        "has_state": (col("has_state") if "has_state" in have else col("states").isNotNull()), "states": states,
        "mode": F.when(text.isNotNull(), mode), "sensitive": sensitive, "needle": needle,
        "tokens": F.when(upto.isNull(), tokens).otherwise(F.slice(tokens, F.lit(1), F.coalesce(upto, F.lit(0)))),
        "overlap": col("overlap", 0.5), "prefix": col("prefix", True), "sim": col("sim", 0.8), "by_relevance": col("by_relevance", False), "top": top}
    names = [part.strip().split(" ")[0] for part in REQUEST_TABLE.replace("flag:string,want", "flag").split(",")]
    return requests.select(*[columns.get(c, col(c)).alias(c) for c in names])


def _grams(text, size: int) -> Column:
    """Every run of ``size`` characters, with repeats."""
    text = F.col(text) if isinstance(text, str) else text
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def _labelled(labels: DataFrame) -> DataFrame:
    """(label, sensitive, hay): each distinct label in both forms that requests look at."""
    return labels.select("label", F.inline(F.array(
        F.struct(F.lit(True).alias("sensitive"), squeeze("label").alias("hay")),
        F.struct(F.lit(False).alias("sensitive"), squeeze(F.lower("label")).alias("hay")))))


def _containing(forms: DataFrame, requests: DataFrame) -> DataFrame:
    """(label, request_id) of substring requests. A request is filed under the rarest of its needle's runs of three
    characters (the needle itself, if shorter), labels under all of theirs."""
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams("hay", n) for n in (1, 2, 3)]))
    filed = forms.select("label", "sensitive", "hay", F.explode(grams).alias("gram"))
    size = F.least(F.lit(3), F.length("needle"))
    own = F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("needle") - size + 1), lambda i: F.substr(F.col("needle"), i, size))))
    wanted = requests.filter("mode = 'contains'").select("request_id", "sensitive", "needle", F.explode(own).alias("gram"))
    common = filed.groupBy("sensitive", "gram").agg(F.count("*").alias("n"))
    anchored = wanted.join(common, ["sensitive", "gram"]).groupBy("request_id", "sensitive", "needle").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return filed.join(anchored, ["sensitive", "gram"]).filter(F.contains("hay", F.col("needle"))).select("label", "request_id")


def _alike(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sensitive, word, token, prefix, sim, quality): words that count as a request's token, by how much.

    Words that begin alike meet under their first three characters. Words of a similarity over two thirds share a
    run of two characters, at most as far from the same place as there are edits."""
    heads = words.withColumn("at", F.substring("word", 1, 3)).join(wanted.withColumn("at", F.substring("token", 1, 3)), ["sensitive", "at"])
    size, d = F.length("token"), F.floor((1 - F.col("sim")) * F.greatest(F.col("size"), F.length("token")) + 1e-9).cast("int")
    near = (
        wanted.withColumn("size", F.explode(F.sequence(F.ceil(size * F.col("sim") - 1e-9).cast("int"), F.floor(size / F.col("sim") + 1e-9).cast("int"))))
        .withColumn("d", d).select("*", F.posexplode(_grams("token", 2)).alias("p", "gram"))
        .withColumn("p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("d")), F.col("p") + F.col("d")))).drop("d"))
    spread = words.select("*", F.length("word").alias("size"), F.posexplode(_grams("word", 2)).alias("p", "gram"))
    names = ["sensitive", "word", "token", "prefix", "sim"]
    both = heads.select(*names).unionByName(spread.join(near, ["sensitive", "size", "p", "gram"]).select(*names)).distinct()
    w, t = F.col("word"), F.col("token")
    longest = F.greatest(F.length(w), F.length(t))
    close = 1 - F.levenshtein(w, t) / longest
    quality = F.when(w == t, F.lit(1.0)).when(F.col("prefix") & F.startswith(w, t), F.lit(0.9)).when(
        F.col("prefix") & F.startswith(t, w), F.lit(0.85)).when(close >= F.col("sim"), close).otherwise(F.lit(0.0))
    return both.withColumn("quality", quality).filter("quality > 0")


def _fuzzy(forms: DataFrame, requests: DataFrame) -> DataFrame:
    """(label, request_id, label_score) of fuzzy requests: requests and labels meet in the words that are alike."""
    fuzzy = requests.filter("mode = 'fuzzy'")
    asked = fuzzy.select("request_id", "sensitive", "prefix", "sim", "overlap", F.coalesce("max_tokens", F.lit((1 << 31) - 1)).alias("upto"),
                         F.size("tokens").alias("asked"), F.posexplode("tokens").alias("q", "token"))
    held = forms.select("label", "sensitive", F.posexplode(tokenize("hay", None, 2)).alias("at", "word"))
    pairs = _alike(held.select("sensitive", "word").distinct(), asked.select("sensitive", "token", "prefix", "sim").distinct())
    best = (
        held.join(pairs, ["sensitive", "word"]).join(asked, ["sensitive", "token", "prefix", "sim"]).filter("at < upto")
        .groupBy("label", "request_id", "overlap", "asked", "q").agg(F.max("quality").alias("quality")))
    # tokens are added up in the request's order, so that scores are those of a single request, bit by bit
    listed = best.groupBy("label", "request_id", "overlap", "asked").agg(F.array_sort(F.collect_list(F.struct("q", "quality"))).alias("each"))
    total = F.aggregate("each", F.lit(0.0), lambda acc, e: acc + e["quality"])
    return listed.withColumn("label_score", total / F.col("asked")).filter("label_score >= overlap").select("label", "request_id", "label_score")


def label_hits(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(label, request_id, label_score): each distinct label that a request's label test accepts."""
    forms = _labelled(nodes.select("label").filter(F.col("label").isNotNull()).distinct())
    none = F.lit(None).cast("double").alias("label_score")
    exact = forms.join(requests.filter("mode = 'exact'").select("request_id", "sensitive", F.col("needle").alias("hay")), ["sensitive", "hay"])
    return exact.select("label", "request_id", none).unionByName(
        _containing(forms, requests).select("label", "request_id", none)).unionByName(_fuzzy(forms, requests))


def _anchors(requests: DataFrame) -> DataFrame:
    """(request_id, anchor): requests without a label test under the most telling thing they ask for."""
    pairs = F.flatten(F.transform("kinds", lambda k: F.transform("regions", lambda r: F.concat(F.lit("kr:"), k, F.lit("|"), r))))
    named = lambda tag, c: F.transform(c, lambda v: F.concat(F.lit(tag), v))
    where = (F.when(F.col("group_id").isNotNull(), F.array(F.concat(F.lit("g:"), "group_id")))
             .when(F.col("heading").isNotNull(), F.array(F.concat(F.lit("h:"), "heading")))
             .when(F.col("kinds").isNotNull() & F.col("regions").isNotNull(), pairs)
             .when(F.col("kinds").isNotNull(), named("k:", "kinds"))
             .when(F.col("regions").isNotNull(), named("r:", "regions")).otherwise(F.array(F.lit("all"))))
    return requests.filter("mode IS NULL OR mode LIKE 'any%'").select("request_id", F.explode(F.array_distinct(where)).alias("anchor"))


def find_many(nodes: DataFrame, requests: list[dict] | DataFrame) -> DataFrame:
    """Answer many requests, a list or a table (see ``complete_requests``), as ``find`` answers each.

    Requests are data: the plan is the same for ten and for a hundred thousand. Label tests are settled on distinct
    labels through indexes of their words and character runs; other requests meet the nodes under the kind, region, group
    or heading they ask for. Fuzzy requests need ``sim`` over two thirds. ``limit`` is null for all rows."""
    table = requests if isinstance(requests, DataFrame) else request_table(nodes.sparkSession, requests)
    low = [r for r in requests if r.get("label") is not None and LabelFilter.of(r["label"]).mode == "fuzzy"
           and LabelFilter.of(r["label"]).sim <= 2 / 3] if not isinstance(requests, DataFrame) else []
    if low:
        raise ValueError("fuzzy requests of find_many need a similarity over two thirds")
    keyed = nodes.withColumn("_all", F.struct(*nodes.columns))
    by_label = keyed.select("_all", "label").join(label_hits(nodes, table), "label").select("_all", "request_id", "label_score")
    w = F.col("where")
    anchors = F.array_compact(F.array(
        F.lit("all"), F.concat(F.lit("k:"), "kind"), F.concat(F.lit("r:"), w.region), F.concat(F.lit("kr:"), "kind", F.lit("|"), w.region),
        F.concat(F.lit("g:"), w.group_id), F.concat(F.lit("h:"), w.heading_context)))
    by_place = keyed.select("_all", F.explode(anchors).alias("anchor")).join(_anchors(table), "anchor").select(
        "_all", "request_id", F.lit(None).cast("double").alias("label_score"))
    flags = F.create_map(*[x for f in rules.STATE_FIELDS for x in (F.lit(f), F.col(f"_all.state.{f}").cast("string"))])
    r, n = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"_all.{c}"))
    state = F.try_element_at
    passes = (
        (r("kinds").isNull() | F.array_contains(r("kinds"), n("kind")))
        & (r("regions").isNull() | F.array_contains(r("regions"), n("where.region")))
        & (~r("has_state") | n("state").isNotNull())
        & F.forall(r("states"), lambda s: F.coalesce(state(flags, s["flag"]), F.lit("false")) == s["want"])
        & (r("group_id").isNull() | (n("where.group_id") == r("group_id")))
        & (r("heading").isNull() | (n("where.heading_context") == r("heading"))))
    zero = F.lit(0.0)
    plain = F.when(F.endswith(r("mode"), F.lit("exact")), F.lit(rules.LABEL_WEIGHT["exact"])).otherwise(F.lit(rules.LABEL_WEIGHT["contains"]))
    shares = [
        F.when(r("mode").isNull(), zero).otherwise(
            F.coalesce(F.lit(rules.LABEL_WEIGHT["fuzzy"]) * F.col("label_score"), plain)),
        F.when(r("kinds").isNotNull(), F.lit(rules.KIND_WEIGHT)).otherwise(zero),
        F.when(r("regions").isNotNull(), F.lit(rules.REGION_WEIGHT)).otherwise(zero),
        F.size(F.filter(r("states"), lambda s: F.coalesce(state(flags, s["flag"]) == s["want"], F.lit(False)))) * F.lit(rules.STATE_WEIGHT),
        F.when(r("group_id").isNotNull(), F.lit(rules.GROUP_WEIGHT)).otherwise(zero),
        F.when(r("heading").isNotNull(), F.lit(rules.HEADING_WEIGHT)).otherwise(zero),
        F.when(F.coalesce(n("state.visible"), F.lit(False)), F.lit(rules.VISIBLE_WEIGHT)).otherwise(zero)]
    total = zero
    for share in shares:
        total = total + share
    hits = by_label.unionByName(by_place).join(table.alias("r"), "request_id").filter(F.coalesce(passes, F.lit(False))).withColumn(
        "relevance", F.least(F.lit(1.0), total / r("top"))).filter(F.coalesce(F.col("relevance") >= r("min_score"), F.lit(True)))
    out = hits.select("_all.*", "request_id", "relevance", F.when(r("by_relevance"), F.col("relevance")).otherwise(zero).alias("rank_key"), r("k").alias("k"))
    w = W.partitionBy("snapshot_id", "request_id")
    return (
        out.withColumn("match_rank", F.row_number().over(w.orderBy(F.desc("rank_key"), F.asc("doc_order"))))
        .withColumn("total_matched", F.count("*").over(w))
        .filter(F.col("k").isNull() | (F.col("match_rank") <= F.col("k"))).drop("k", "rank_key")
    )


def suggest_refinements(matches: DataFrame, request: dict, top: int = 5) -> DataFrame:
    """Facets over limited matches (output of ``find``) that would narrow them, best first."""
    facets = []

    def add(kind: str, value: Column, message: Column) -> None:
        facets.append(F.when(value.isNotNull(), F.struct(
            F.lit(kind).alias("type"), value.alias("value"), message.alias("phrase"),
            F.lit(len(facets)).alias("facet"))))

    def quoted(name: str, column: str) -> Column:
        return F.concat(F.lit(f'Add {name}: "'), F.col(column), F.lit('"'))

    if request.get("kind") is None:
        add("refine_kind", F.col("kind"), quoted("kind", "kind"))
    if request.get("region") is None:
        add("refine_region", F.nullif("where.region", F.lit("unknown")),
            quoted("region", "where.region"))
    if request.get("group_id") is None:
        add("refine_group", F.col("where.group_id"), quoted("group_id", "where.group_id"))
    if request.get("state") is None:
        for flag in ("enabled", "visible"):
            add("add_state", F.when(F.col(f"state.{flag}"), F.lit(flag)),
                F.lit(f"Add state: {{ {flag}: true }}"))
    if request.get("label") is not None:
        flt = LabelFilter.of(request["label"])
        if flt.mode != "exact":
            needle = normalize_literal(flt.text.lower())
            add("refine_label", F.when(squeeze(F.lower("label")) == needle, F.lit(flt.text)),
                F.lit("Use exact label match"))
    if not facets:
        facets = [F.lit(None).cast(
            "struct<type:string,value:string,phrase:string,facet:int>")]
    total = F.count("*").over(W.partitionBy("snapshot_id"))
    counted = (
        matches.withColumn("shown", total)
        .select("snapshot_id", "shown", "match_rank",
                F.explode(F.array_compact(F.array(*facets))).alias("f"))
        .groupBy("snapshot_id", "shown", "f.type", "f.value", "f.phrase", "f.facet")
        .agg(F.count("*").alias("expected_matches"), F.min("match_rank").alias("first_rank"))
        .filter(F.col("expected_matches") < F.col("shown"))
    )
    rank = F.row_number().over(W.partitionBy("snapshot_id").orderBy(
        "expected_matches", "facet", "first_rank"))
    return (
        counted.withColumn("suggestion_rank", rank).filter(F.col("suggestion_rank") <= top)
        .select("snapshot_id", "suggestion_rank", "type", "value", "expected_matches",
                F.concat("phrase", F.lit(" to narrow to "), "expected_matches",
                         F.lit(" result(s)")).alias("message"))
    )


# -- lookups ------------------------------------------------------------------------------------

def get_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def snapshot_info(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("snapshot_id").agg(F.count("*").alias("node_count"))


def all_nodes(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The elements (the first ``limit``, if given) of each capture in document order."""
    rank = F.row_number().over(W.partitionBy("snapshot_id").orderBy("doc_order"))
    out = nodes.withColumn("match_rank", rank)
    return out if limit is None else out.filter(F.col("match_rank") <= limit)


def find_rows(matches: DataFrame, registry: DataFrame, layer: str = "main",
              include_readable: bool = True) -> DataFrame:
    """Matches with a public id: the registry's, else a content id for readable, structural and live
    elements, else a placeholder.  ``registry`` has (snapshot_id, backend_node_id, eid)."""
    readable = F.col("kind").isin(
        rules.READABLE_KINDS + rules.STRUCTURAL_KINDS + rules.LIVE_KINDS) & F.lit(include_readable)
    own = F.concat(F.lit("rd-"), F.substring(identity.eid(F.lit(layer)), 1, 10))
    ids = registry.select("snapshot_id", "backend_node_id", F.col("eid").alias("_eid"))
    return matches.join(ids, ["snapshot_id", "backend_node_id"], "left").select(
        "snapshot_id", "node_id",
        F.coalesce("_eid", F.when(readable, own),
                   F.concat(F.lit("unknown-"), F.col("backend_node_id").cast("string"))
                   ).alias("eid"),
        "kind", "label", F.coalesce("find.primary", F.lit("")).alias("selector"),
        F.col("where.region").alias("region"), "state",
        *[F.nullif(f"attributes.{a}", F.lit("")).alias(a)
          for a in ("input_type", "placeholder", "value", "href", "alt", "src")],
    )


def element_details(eids: DataFrame, registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Current record of each requested id.  ``eids`` has (page_id, eid); ``registry`` the newest
    (page_id, eid, snapshot_id, backend_node_id); ``nodes`` the newest capture of each page.
    ``status`` tells ids never seen from ids whose element is gone."""
    known = registry.select("page_id", "eid", "snapshot_id", "backend_node_id",
                            F.lit(True).alias("_known"))
    return (
        eids.join(known, ["page_id", "eid"], "left")
        .join(nodes.drop("page_id", "step").withColumn("_live", F.lit(True)),
              ["snapshot_id", "backend_node_id"], "left")
        .withColumn("status", F.when(F.col("_known").isNull(), "missing")
                    .when(F.col("_live").isNull(), "stale").otherwise("current"))
        .drop("_known", "_live")
    )


def relink_stale(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """For each old element the fresh one with the same label and kind that agrees on most of
    region, heading and group; ties go to the nearest id.  ``keys`` pair up captures.

    No pairs are formed.  Each row is filed under every subset of the three place properties; inside
    a file the nearest fresh neighbour on either side is found with an ordered window, and the best
    of these at most 16 finalists is the best overall: it is nearest within its own subset."""
    parts = {"r": "where.region", "h": "where.heading_context", "g": "where.group_id"}
    subsets = [set(), {"r"}, {"h"}, {"g"}, {"r", "h"}, {"r", "g"}, {"h", "g"}, {"r", "h", "g"}]

    def filed(df: DataFrame, side: int) -> DataFrame:
        files = [
            F.when(
                # An absent heading or group never counts as agreement.
                F.concat(F.lit(""), *[F.col(parts[p]) for p in sorted(s - {"r"})]).isNotNull(),
                F.struct(*[(F.coalesce(parts[p], F.lit("")) if p in s else F.lit(None).cast(
                    "string")).alias(p) for p in "rhg"], F.lit(i).alias("subset")))
            for i, s in enumerate(subsets)
        ]
        return df.select(
            *keys, "label", "kind", F.lit(side).alias("side"),
            F.struct(F.col("backend_node_id").alias("id"), F.col("node_id").alias("node_id"),
                     F.col("doc_order").alias("doc_order"),
                     *[F.col(c).alias(p) for p, c in parts.items()]).alias("n"),
            F.explode(F.array_compact(F.array(*files))).alias("f"))

    rows = filed(old, 0).unionByName(filed(fresh, 1))
    spec = W.partitionBy(*keys, "label", "kind", "f")
    new = F.when(F.col("side") == 1, F.col("n"))
    low = F.last(new, ignorenulls=True).over(
        spec.orderBy(F.asc("n.id"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0))
    high = F.last(new, ignorenulls=True).over(
        spec.orderBy(F.desc("n.id"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0))
    finals = (
        rows.withColumn("low", low).withColumn("high", high).filter("side = 0")
        .select(*keys, F.col("n").alias("o"),
                F.explode(F.array_compact(F.array("low", "high"))).alias("c"))
    )
    agree = sum(
        (F.coalesce(F.col(f"o.{p}") == F.col(f"c.{p}"), F.lit(False)) if p != "r"
         else F.col(f"o.{p}").eqNullSafe(F.col(f"c.{p}"))).cast("int") for p in "rhg")
    best = F.min_by("c", F.struct(-agree, F.abs(F.col("o.id") - F.col("c.id")),
                                  F.col("c.doc_order")))
    score = F.max(agree)
    return finals.groupBy(*keys, F.col("o.node_id").alias("old_node_id")).agg(
        best.alias("b"), score.alias("score")).select(
        *keys, "old_node_id", F.col("b.node_id").alias("new_node_id"), "score")
