"""Queries for text functions, privacy projections and token estimates."""

from pyspark.sql import functions as F

from ..functions import privacy as p
from ..functions import text as t
from .adapters import table, texts
from .catalog import query

_SQ = r"trim(regexp_replace(regexp_replace(%s, '[\x{200B}-\x{200D}\x{FEFF}\x{034F}\x{2060}\x{180E}]', '', 'g'), '[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))"


@query("x1_normalize_text", f"SELECT doc_id, {_SQ % 'text'} AS norm FROM documents")
def _(spark, d):
    # The texts are NFKC already, so the SQL side needs no Unicode step.
    return texts(spark, d).select("doc_id", t.normalize_text("text").alias("norm"))


@query("x1_normalize_compat", f"SELECT doc_id, {_SQ % 'text'} AS norm FROM documents")
def _(spark, d):
    # Each text in forms that composition has to undo: wide letters and digits, the ligature of f and i, e and u with loose marks.
    plain = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "eu")
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    other = F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit(chr(0xFB01))), F.lit(chr(0xE9)), F.lit("e" + chr(0x301))),
                      F.lit(chr(0xFC)), F.lit("u" + chr(0x308)))
    changed = texts(spark, d).select("doc_id", F.translate(other, plain, wide).alias("text"))
    return changed.select("doc_id", t.normalize_text("text").alias("norm"))


@query("x2_truncate", """SELECT doc_id, CASE WHEN length(text) <= 120 THEN text
    ELSE substr(text, 1, 119) || '…' END AS short FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.truncate("text").alias("short"))


@query("x3_tokenize", f"""SELECT doc_id, array_to_string(list_slice(list_filter(
    string_split({_SQ % 'text'}, ' '), lambda w: length(w) > 2), 1, 3), '|') AS tokens
    FROM documents""")
def _(spark, d):
    words = t.tokenize(t.normalize_text("text", compat=False))
    return texts(spark, d).select("doc_id", F.array_join(words, "|").alias("tokens"))


@query("x4_string_similarity", """SELECT p_partkey, round(1 - levenshtein(p_name, p_type)::DOUBLE
    / greatest(length(p_name), length(p_type)), 6) AS sim FROM part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.round(t.string_similarity("p_name", "p_type"), 6).alias("sim"))


# Best quality of one query word against all words of p_name, written out for SQL.
_BEST = """coalesce(list_max(list_transform(list_slice(list_filter(string_split(p_name, ' '),
    lambda w: length(w) > 2), 1, 10), lambda w: CASE WHEN w = '{q}' THEN 1.0
    WHEN starts_with(w, '{q}') THEN 0.9 WHEN starts_with('{q}', w) THEN 0.85
    WHEN 1 - levenshtein(w, '{q}')::DOUBLE / greatest(length(w), {n}) >= 0.8
    THEN 1 - levenshtein(w, '{q}')::DOUBLE / greatest(length(w), {n}) ELSE 0.0 END)), 0.0)"""


def fuzzy_sql(words: list[str]) -> str:
    return "(" + " + ".join(_BEST.format(q=w, n=len(w)) for w in words) + f") / {len(words)}.0"


@query("x5_fuzzy_tokens_match",
       f"SELECT p_partkey, round({fuzzy_sql(['smal', 'widgett'])}, 6) AS score FROM part")
def _(spark, d):
    score = t.fuzzy_score(t.tokenize("p_name", 10, 2), ["smal", "widgett"])
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("x6_slugify", r"""SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '&', '-'), '[\s_]+', '-', 'g'),
    '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-', ''), '-$', ''), 1, 40), '-$', '') AS slug
    FROM documents""")
def _(spark, d):
    return texts(spark, d).select("doc_id", t.slugify("text").alias("slug"))


@query("x7_escape_xml", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&',
    '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS hash
    FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.escape_xml("text")).alias("hash"))


@query("x8_parse_flags", """SELECT p_partkey,
    CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
    CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'mixed' END AS checked
    FROM part""")
def _(spark, d):
    raw = F.get(F.array(*[F.lit(v) for v in ("true", "false", "mixed", "maybe")]),
                F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", t.parse_bool(raw).alias("flag"),
                                          t.parse_checked(raw).alias("checked"))


@query("l14_estimate_tokens", """SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens
    FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.estimate_tokens("text").alias("tokens"))


@query("u1_mask_value", r"""WITH v AS (SELECT conv_id, turn, role,
      trim(regexp_replace(text, '[\r\n]', ' ', 'g')) AS v,
      lower(text) AS label,
      CASE (conv_id + turn) % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'email' WHEN 2 THEN 'text'
      END AS kind FROM conversations)
    SELECT conv_id, turn, CASE WHEN v = '' THEN '' WHEN kind = 'password' THEN '••••••••'
      WHEN regexp_matches(label, 'pass|secret|token|auth|key|otp|pin|cvv|cvc|ssn|social|credit|card')
        THEN '***'
      WHEN kind = 'email' THEN CASE WHEN length(v) <= 4 THEN '••••'
        ELSE v[1:2] || '•••' || v[-2:] END
      WHEN length(v) <= 12 THEN v
      ELSE v[1:2] || '•••' || v[11:12] END AS masked FROM v""")
def _(spark, d):
    kind = F.get(F.array(F.lit("password"), F.lit("email"), F.lit("text"),
                         F.lit(None).cast("string")), ((F.col("conv_id") + F.col("turn")) % 4)
                 .cast("int"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", p.mask_value("text", kind, "text").alias("masked"))


@query("u2_partial_mask", """SELECT p_partkey, CASE WHEN length(p_name) <= 4 THEN '••••'
    ELSE p_name[1:2] || '•••' || p_name[-2:] END AS masked FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", p.partial_mask("p_name").alias("masked"))


@query("u3_mask_runtime_value", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0
    OR p_size % 3 = 0 THEN '********' ELSE p_name END AS masked FROM part""")
def _(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", p.mask_runtime_value(
        "p_name", F.when(size % 5 == 0, "password").otherwise("text"),
        F.when(size % 7 == 0, "card_cvv").otherwise("name"),
        F.when(size % 3 == 0, "Security Code").otherwise("Label")).alias("masked"))


# Only page is on the allow-list among the parameters of the corpus, and none is a secret.
_CLEAN_URL = r"""regexp_replace(regexp_replace(regexp_replace(url, '(ref|utm_source)=[^&#]*&?', '',
    'g'), '&(#|$)', '\1'), '\?(#|$)', '\1')"""


@query("u4_sanitize_url", f"SELECT page_id, {_CLEAN_URL} AS clean FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", p.sanitize_url("url").alias("clean"))


@query("u5_sanitize_href", f"""SELECT page_id, regexp_replace({_CLEAN_URL}, '^https?://[^/]+', '')
    AS clean FROM pages""")
def _(spark, d):
    href = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, d, "pages").select("page_id", p.sanitize_href(href).alias("clean"))


@query("u6_redact_url", """SELECT page_id, url AS plain,
    regexp_extract(url, '^([^?#]*)', 1) || regexp_extract(url, '(#.*)$', 1) AS redacted
    FROM pages""")
def _(spark, d):
    # The same URL with its parameters renamed to secret ones must lose them all.
    secret = F.regexp_replace("url", r"(?<=[?&])(page|ref|utm_source)=", "Token=")
    return table(spark, d, "pages").select("page_id", p.redact_url("url").alias("plain"),
                                           p.redact_url(secret).alias("redacted"))


@query("u7_image_src", r"""SELECT page_id,
    regexp_extract(url, '^https?://([^?#]*)', 1) AS web, '[data-url]' AS data,
    regexp_replace(url, '^https?://[^/]+', '') AS relative FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", p.image_src("url").alias("web"),
        p.image_src(F.concat(F.lit("data:image/png;"), "url")).alias("data"),
        p.image_src(F.regexp_replace("url", "^https?://[^/]+", "")).alias("relative"))
