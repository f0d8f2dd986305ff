"""Text column functions: normalising, tokens, similarity, slugs, escaping, flags."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Whitespace and zero-width sets spelled out so that Java and other regex engines agree.
WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
      r"\x{3000}\x{FEFF}]")
ZERO_WIDTH_CODES = (0x200B, 0x200C, 0x200D, 0xFEFF, 0x034F, 0x2060, 0x180E)
ZERO_WIDTH = "[" + "".join(r"\x{%X}" % c for c in ZERO_WIDTH_CODES) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    # Most text is in the form already, and checking that is much cheaper than rebuilding it.
    return s.map(lambda v: v if v is None or unicodedata.is_normalized("NFKC", v)
                 else unicodedata.normalize("NFKC", v))


def nfkc(c) -> Column:
    """Unicode compatibility composition.  Spark has no builtin; only non-ASCII values are shipped
    to Python (ASCII text is already in this form)."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def squeeze(c) -> Column:
    """Drop zero-width characters, turn whitespace runs into one blank, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), ZERO_WIDTH, ""), WS + "+", " "))


def squeeze_short(c) -> Column:
    """The same as ``squeeze`` for a column that is cheap to read: words of plain ASCII with one blank between them, which
    most are, are seen in one pass and stay as they are."""
    c = _col(c)
    return F.when(c.rlike(r"^[!-~]++(?: [!-~]++)*+\z"), c).otherwise(squeeze(c))


def trim_ws(c) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def normalize_text(c, compat: bool = True) -> Column:
    """Canonical text for matching.  ``compat=False`` stays inside the JVM and is right for columns
    that are NFKC already, such as labels made by the HTML source."""
    return squeeze(nfkc(c) if compat else c)


def normalize_literal(text: str) -> str:
    """The same canonical form for a driver-side constant."""
    text = unicodedata.normalize("NFKC", text)
    for code in ZERO_WIDTH_CODES:
        text = text.replace(chr(code), "")
    return " ".join(text.split())


def truncate(c, limit: int = 120) -> Column:
    c = _col(c)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit - 1), F.lit("…"))
    )


def tokenize(c, limit: int | None = 3, min_length: int = 2) -> Column:
    """First ``limit`` words (all, if None) longer than ``min_length``; expects normalised text."""
    words = F.filter(F.split(_col(c), " "), lambda w: F.length(w) > min_length)
    return words if limit is None else F.slice(words, 1, limit)


def string_similarity(a, b) -> Column:
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _token_quality(text: Column, query: Column, prefix: bool, min_sim: float) -> Column:
    longest = F.greatest(F.length(text), F.length(query))
    shortest = F.least(F.length(text), F.length(query))
    quality = F.when(text == query, F.lit(1.0))
    if prefix:
        quality = quality.when(F.startswith(text, query), F.lit(0.9))
        quality = quality.when(F.startswith(query, text), F.lit(0.85))
    # The length gap bounds the edit distance from below, so most pairs never reach levenshtein.
    sim = F.when(shortest >= longest * min_sim - 1e-9, 1 - F.levenshtein(text, query) / longest)
    return quality.when(sim >= min_sim, sim).otherwise(F.lit(0.0))


def _best_quality(text_tokens: Column, query: Column, prefix: bool, min_sim: float) -> Column:
    return F.aggregate(
        text_tokens,
        F.lit(0.0),
        lambda best, t: F.greatest(best, _token_quality(t, query, prefix, min_sim)),
    )


def fuzzy_score(text_tokens, query_tokens, prefix: bool = True, min_sim: float = 0.8) -> Column:
    """Mean over the query tokens of the best quality any text token reaches; 0 without query."""
    text_tokens = _col(text_tokens)
    if isinstance(query_tokens, (list, tuple)):
        if not query_tokens:
            return F.lit(0.0)
        best = [_best_quality(text_tokens, F.lit(q), prefix, min_sim) for q in query_tokens]
        total = best[0]
        for b in best[1:]:
            total = total + b
        return total / F.lit(float(len(query_tokens)))
    query_tokens = _col(query_tokens)
    total = F.aggregate(
        query_tokens,
        F.lit(0.0),
        lambda acc, q: acc + _best_quality(text_tokens, q, prefix, min_sim),
    )
    return F.when(F.size(query_tokens) > 0, total / F.size(query_tokens)).otherwise(F.lit(0.0))


def slugify(c, limit: int = 40) -> Column:
    """Lower-case hyphenated slug of at most ``limit`` characters."""
    s = F.lower(_col(c))
    s = F.regexp_replace(s, f"(?:{WS}|_)+|&", "-")
    s = F.regexp_replace(s, "[^a-z0-9-]", "")
    s = F.regexp_replace(s, "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.regexp_replace(F.substring(s, 1, limit), "-$", "")


def escape_xml(c) -> Column:
    s = F.coalesce(_col(c), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def parse_bool(c) -> Column:
    c = _col(c)
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def parse_checked(c) -> Column:
    """Tri-state flag kept as text: 'true', 'false', 'mixed' or null."""
    c = _col(c)
    return F.when(c.isin("true", "false", "mixed"), c)


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(_col(c)) / 4).cast("long")


def contains_any(c, parts) -> Column:
    """True when the column contains one of a short fixed list of substrings."""
    pattern = "|".join(re.escape(p) for p in parts)
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(table: dict) -> Column:
    """A small table as one map literal; built from SQL text because thousands of column objects
    would take longer to create than the query takes to run."""
    show = lambda v: sql_text(v) if isinstance(v, str) else f"{v!r}D" if isinstance(
        v, float) else repr(v)
    return F.expr("map(" + ", ".join(show(x) for kv in table.items() for x in kv) + ")")


def literal_rows(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A small table as one array-of-structs literal."""
    show = lambda v: sql_text(v) if isinstance(v, str) else f"{v!r}D" if isinstance(
        v, float) else repr(v)
    items = ("named_struct(" + ", ".join(f"'{n}', {show(v)}" for n, v in zip(names, row)) + ")"
             for row in rows)
    return F.expr("array(" + ", ".join(items) + ")")


def lookup(c, table: dict) -> Column:
    """Value of a small literal table, null when the key is missing."""
    return F.try_element_at(literal_map(table), _col(c))


def is_in(c, values: list[str]) -> Column:
    """Membership in a fixed list, a hash set from eleven values on."""
    return _col(c).isin(values)


def blank_to_null(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) > 0, c)
