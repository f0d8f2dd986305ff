"""URL filters: nested prefix rules found by one sorted sweep.

Hosts are written as reversed labels, each ended by a dot ("com.example."), so a rule on a host and all
its subdomains is one interval of keys: intervals of two rules are nested or apart. URLs and rules are
laid out in key ranges; in each range one sweep in key order keeps the stack of rules that are open.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: The rules of the registered query, as (action, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sampled keys that cut the key space.
SAMPLED = 4096
#: Sorts after every byte that UTF-8 text can have, so prefix + END closes the interval of a prefix.
END = "\U0010ffff"


def host_of(url: F.Column) -> F.Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: F.Column) -> F.Column:
    """Reversed labels, each closed by a dot: example.org and its subdomains share "org.example."."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def canonical_host(host: F.Column) -> F.Column:
    """Without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$|\.$|\.:\d*$", "")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)


_SWEPT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()),
                    ("host", pa.string()), ("path", pa.string()), ("plain", pa.string()),
                    ("action", pa.string())])
_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                     ("plain", pa.string()), ("rule", pa.string()), ("action", pa.string())])


def sweep(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (key, page_id, host, path, plain) with the longest rule (key, host, path, action) that fits.

    A key that many URLs share is drawn as several equal cuts; its rows are spread over all ranges
    between them, and each range gets the few rules that are open in it (nested, so no more than the
    depth of nesting for each cut)."""
    width = 4 * common.shuffle_width(urls.sparkSession)
    share = min(1.0, 2 * SAMPLED / max(1, urls.count()))
    cuts = sorted(r[0] for r in urls.select("key").sample(share, seed=7).limit(SAMPLED).collect())
    cuts = cuts[:: max(1, -(-len(cuts) // width))][1:]

    def spread(batches):
        for b in batches:
            rows = []
            for key, page, host, path, plain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key)
                rows.append((low + (page or 0) * 2654435761 % 4294967291 % (high - low + 1), 1, key, page, host,
                             path, plain, None))
            yield _table(rows, _SWEPT)

    def place(batches):
        for b in batches:
            yield _table([(part, 0, key, None, host, path, None, action)
                          for key, host, path, action in zip(*(c.to_pylist() for c in b.columns), strict=True)
                          for part in range(bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key + END) + 1)],
                         _SWEPT)

    def judge(batches):
        here, stack = None, []
        for b in batches:
            rows = []
            for part, kind, key, page, host, path, plain, action in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != here:
                    here, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, host + path, path, action))
                else:
                    fits = [s for s in reversed(stack) if path.startswith(s[2])]
                    best = max(fits, key=lambda s: len(s[1]), default=(None,) * 4)
                    rows.append((page, host, path, plain, best[1], best[3]))
            yield _table(rows, _JUDGED)

    schema = ("part int, kind int, key string, page_id long, host string, path string, plain string, "
              "action string")
    laid = (urls.select("key", "page_id", "host", "path", "plain").mapInArrow(spread, schema)
            .unionByName(rules.select("key", "host", "path", "action").mapInArrow(place, schema)))
    return (laid.repartition(width, "part").sortWithinPartitions("part", "key", "kind")
            .mapInArrow(judge, "page_id long, host string, path string, plain string, rule string, action string"))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge pages (page_id, url) by rules (action, host, path); the longest rule that fits wins.

    Returns page_id (long), host, path, rule, verdict and canonical_rule. rule is found for the host as
    written. Where none fits, the host without user, port and closing dot is judged (canonical_rule) and
    gives the verdict, else default. A null url, or one without "://", has empty host and path and the
    default verdict. Rows that repeat stay, a null page_id too. Rules that repeat count once (block
    wins); rules with a null are left out; no rules or no pages: defaults, or no rows. Other columns of
    pages are not read."""
    url = F.col("url")
    base = (pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"),
                         path_of(url).alias("path"))
            .withColumns({"key": host_key(F.col("host")), "plain": host_key(canonical_host(F.col("host")))}))
    rules = (rules.where("host is not null and path is not null and action is not null")
             .select(F.lower("host").alias("host"), "path", "action").groupBy("host", "path")
             .agg(F.max("action").alias("action")).withColumn("key", host_key(F.col("host"))))
    usual = sweep(base.where("key = plain"), rules).withColumn("canonical_rule", F.col("rule"))
    odd = sweep(base.where("key <> plain"), rules)
    fitted = odd.where("rule is not null").withColumn("canonical_rule", F.col("rule"))
    again = (sweep(odd.where("rule is null").withColumn("key", F.col("plain")), rules)
             .withColumns({"canonical_rule": F.col("rule"), "rule": F.lit(None).cast("string")}))
    return (usual.unionByName(fitted).unionByName(again)
            .select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"),
                    "canonical_rule"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return (apply_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
            .select("page_id", "host", "path", "rule", "verdict"))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS written,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT page_id, path, translate(written, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.$|\\.:[0-9]*$', '') AS plain FROM q),
r(action, rhost, rpath) AS (VALUES %s),
m AS (
  SELECT page_id, host, path, plain,
    (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
    (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
      WHERE (plain = rhost OR ends_with(plain, '.' || rhost)) AND starts_with(path, rpath)) AS canonical FROM c)
SELECT page_id, host, path, rule,
  coalesce((SELECT action FROM r WHERE rhost || rpath = coalesce(rule, canonical)), 'allow') AS verdict FROM m
""" % ", ".join(repr(r) for r in RULES)
