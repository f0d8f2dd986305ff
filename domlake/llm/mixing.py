"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domlake.llm import common

#: Rounds of raking: each fits the marginals in turn.
ROUNDS = 12
#: Share of all tokens that the sample should hold.
KEEP = 0.5
#: A marginal's target share is its token share to this power, made to sum to one: 1 keeps the corpus's
#: own mix, 0 gives each value the same weight.
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.5}
#: Stands for a null source, language or topic.
NONE = "(none)"


def token_count(text: F.Column) -> F.Column:
    """Words between spaces and control characters; null or blank text has none."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def topic_of(text: F.Column) -> F.Column:
    """A coarse topic from marks of the text: legal, web, list-like lines, or prose."""
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
            .when(text.rlike(r"[Ll]icense|[Cc]opyright"), F.lit("legal"))
            .when(text.rlike(r"https?://|@"), F.lit("web"))
            .when(text.rlike(r"[0-9]{3}"), F.lit("records"))
            .otherwise(F.lit("prose")))


def uniform(id_: F.Column) -> F.Column:
    """A number in [0, 1) fixed by the id: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """cells (the dimensions, tokens) with weight: token weights whose marginals meet the targets.

    Each step scales the weights of one dimension's values to their target shares, by a window over the
    cells. There is one cell for each combination of values met, however many documents there are; a
    checkpoint after every fourth round keeps the plan short. Weighted tokens sum to the tokens."""
    whole = W.partitionBy()  # one row for each combination of values, not for each document
    out = cells.withColumn("total", F.sum("tokens").over(whole)).withColumn("mass", F.col("tokens").cast("double"))
    for name, power in powers.items():
        share = F.pow(F.sum("tokens").over(W.partitionBy(name)) / F.col("total"), power)
        out = out.withColumn(f"share_{name}", share)
        first = F.row_number().over(W.partitionBy(name).orderBy(*powers))
        out = out.withColumn("first", first)
        out = out.withColumn(f"goal_{name}", F.col("total") * F.col(f"share_{name}") / F.sum(
            F.when(F.col("first") == 1, F.col(f"share_{name}"))).over(whole)).drop("first", f"share_{name}")
    for turn in range(rounds):
        for name in powers:
            now = F.sum("mass").over(W.partitionBy(name))
            out = out.withColumn("mass", F.when(now > 0, F.col("mass") * F.col(f"goal_{name}") / now).otherwise(0.0))
        if turn % 4 == 3:
            out = common.checkpoint(out)
    return out.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(0.0))


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with probability = min(1, rate * weight), rate such that the expected tokens are keep of all.

    Cells in falling order of weight: with the first n kept whole, the rate is what is left over divided
    by the mass of the rest; the right n is the first at which no further cell would exceed one."""
    order = W.orderBy(F.desc("weight"), *POWERS)
    wanted = F.lit(keep) * F.sum("tokens").over(W.partitionBy())
    before_tokens = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest_mass = F.sum("mass").over(order.rowsBetween(0, W.unboundedFollowing))
    rated = cells.withColumn("rate", F.when(rest_mass > 0, F.greatest(F.lit(0.0), wanted - before_tokens) / rest_mass))
    fits = rated.withColumn("fits", F.when(F.col("rate") * F.col("weight") <= 1.0, F.col("rate")))
    rate = F.max("fits").over(W.partitionBy())
    return fits.withColumn("probability", F.least(F.lit(1.0), F.coalesce(rate, F.lit(1.0)) * F.col("weight")))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, lang, source, more) with n_tokens, topic, weight, probability, selected.

    Token weights are raked to the targets of source, language and topic (see POWERS), then each document
    is drawn by its cell's probability and a number fixed by its doc_id: copies of one doc_id fare alike,
    and a second run draws the same. A null source or lang is a value of its own. Documents without words
    have no tokens to weigh: weight 0, never selected. Clashing columns of the same names are replaced;
    an empty table gives no rows."""
    powers = powers or POWERS
    # tokens and topic are worked out once for the cells and once for the documents; only cells shuffle
    full = docs.withColumns({"n_tokens": token_count(F.col("text")), "topic": topic_of(F.col("text"))})
    keys = {f"_{k}": F.coalesce(F.col(k), F.lit(NONE)) for k in powers}
    full = full.withColumns(keys)
    cells = (full.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
             .withColumnsRenamed({f"_{k}": k for k in powers}).where("tokens > 0"))
    rated = calibrate(rake(common.checkpoint(cells), powers, rounds), keep)
    rated = common.checkpoint(rated.select(*(F.col(k).alias(f"_{k}") for k in powers), "weight", "probability"))
    if rated.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS:
        rated = F.broadcast(rated)
    out = full.drop("weight", "probability", "selected").join(rated, list(keys), "left")
    some = F.col("n_tokens") > 0
    out = out.withColumns({"weight": F.when(some, F.coalesce("weight", F.lit(0.0))).otherwise(0.0),
                           "probability": F.when(some, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)})
    return out.withColumn("selected", uniform(F.col("doc_id")) < F.col("probability")).drop(*keys)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, its probability and whether it is in the sample."""
    return (mix(common.documents(spark, sf_dir))
            .select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
                    F.round("probability", 6).alias("probability"), "selected"))


def mixed_sql(documents: str) -> str:
    """DuckDB SQL for mix() over a table or CTE named documents: its columns, n_tokens, topic, weight,
    probability, selected."""
    steps = ["cells0 AS (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, "
             "sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS mass FROM full_docs GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for name, power in POWERS.items():
        steps.append(f"goal_{name} AS (SELECT {name}, (SELECT sum(tokens) FROM cells0) * pow(t / (SELECT sum(tokens) FROM cells0), {power}) "
                     f"/ sum(pow(t / (SELECT sum(tokens) FROM cells0), {power})) OVER () AS goal FROM (SELECT {name}, sum(tokens) AS t FROM cells0 GROUP BY 1))")
    at = 0
    for _ in range(ROUNDS):
        for name in POWERS:
            steps.append(f"cells{at + 1} AS MATERIALIZED (SELECT c.* REPLACE (mass * goal / sum(mass) OVER (PARTITION BY {name}) AS mass) "
                         f"FROM cells{at} c JOIN goal_{name} USING ({name}))")
            at += 1
    steps += [
        f"raked AS (SELECT *, mass / tokens AS weight FROM cells{at})",
        f"rated AS (SELECT *, greatest(0, {KEEP} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
        "/ sum(mass) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM raked WINDOW o AS (ORDER BY weight DESC, source, lang, topic))",
        "chosen AS (SELECT *, least(1.0, coalesce((SELECT max(rate) FROM rated WHERE rate * weight <= 1.0), 1.0) * weight) AS probability FROM rated)"]
    number = " + ".join(f"(instr('0123456789abcdef', substr(md5(coalesce(doc_id::VARCHAR, '')), {i + 1}, 1)) - 1) * {16 ** (12 - i)}::DOUBLE" for i in range(13))
    return (r"""full_docs AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'empty'
  WHEN regexp_matches(text, '[Ll]icense|[Cc]opyright') THEN 'legal' WHEN regexp_matches(text, 'https?://|@') THEN 'web'
  WHEN regexp_matches(text, '[0-9]{3}') THEN 'records' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM """ + documents + "), "
            + ",\n".join(steps) + f""",
mixed AS (SELECT d.*, CASE WHEN n_tokens > 0 THEN coalesce(weight, 0) ELSE 0 END AS weight,
  CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS probability,
  ({number}) / {float(1 << 52)} < CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS selected
  FROM full_docs d LEFT JOIN chosen c ON coalesce(d.source, '(none)') = c.source AND coalesce(d.lang, '(none)') = c.lang AND d.topic = c.topic)""")


ORACLE = (f"WITH {mixed_sql('documents')} SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, "
          "round(probability, 6) AS probability, selected FROM mixed")
