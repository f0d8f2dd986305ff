"""Masking of values and cleaning of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import _col, contains_any, trim_ws

# scheme, authority, path, query (with '?'), fragment (with '#')
URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def partial_mask(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) <= 4, F.lit("••••")).otherwise(
        F.concat(F.substring(c, 1, 2), F.lit("•••"), F.substring(c, -2, 2))
    )


def mask_value(value, input_type=None, label=None) -> Column:
    """Value safe to show: passwords and sensitive labels fixed, contacts partial, long text cut."""
    value = _col(value)
    kind = F.lower(_col(input_type)) if input_type is not None else F.lit(None).cast("string")
    name = F.lower(_col(label)) if label is not None else F.lit("")
    clean = trim_ws(F.regexp_replace(value, "[\r\n]", " "))
    return (
        F.when(clean == "", F.lit(""))
        .when(kind == "password", F.lit(rules.MASK_DOTS))
        .when(contains_any(name, rules.SENSITIVE_LABEL_PARTS), F.lit("***"))
        .when(kind.isin(rules.PARTIAL_MASK_TYPES), partial_mask(clean))
        .when(F.length(clean) <= 12, clean)
        .otherwise(partial_mask(F.substring(clean, 1, 12)))
    )


def mask_runtime_value(value, input_type, purpose, label) -> Column:
    value = _col(value)
    hide = (
        F.coalesce(_col(input_type) == "password", F.lit(False))
        | F.coalesce(_col(purpose).isin(rules.SENSITIVE_PURPOSES), F.lit(False))
        | contains_any(F.lower(_col(label)), rules.RUNTIME_SENSITIVE_PARTS)
    )
    return F.when(hide, F.lit(rules.MASK_STARS)).otherwise(value)


def url_part(c, index: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with '?', 5 fragment with '#'; '' when absent."""
    return F.regexp_extract(_col(c), URL, index)


def is_url(c) -> Column:
    return F.coalesce(_col(c).rlike(URL), F.lit(False))


def url_path(c) -> Column:
    """Path of an absolute URL ('/' when empty), null when it is not one."""
    path = url_part(c, 3)
    return F.when(is_url(c), F.when(path == "", F.lit("/")).otherwise(path))


def _authority(c) -> Column:
    """Lower-cased authority without the scheme's default port."""
    scheme, auth = F.lower(url_part(c, 1)), F.lower(url_part(c, 2))
    return (
        F.when(scheme == "http", F.regexp_replace(auth, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(auth, ":443$", ""))
        .otherwise(auth)
    )


def url_origin(c) -> Column:
    return F.when(is_url(c), F.concat(F.lower(url_part(c, 1)), F.lit("://"), _authority(c)))


def _params(query: Column) -> Column:
    """Query text to an ordered array of decoded (k, v) pairs."""
    pieces = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        cut = F.locate("=", p)
        k = F.when(cut > 0, F.substring(p, F.lit(1), cut - 1)).otherwise(p)
        v = F.when(cut > 0, F.substring(p, cut + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(
            F.coalesce(F.try_url_decode(k), k).alias("k"),
            F.coalesce(F.try_url_decode(v), v).alias("v"),
        )

    return F.transform(pieces, pair)


def _encode(params: Column) -> Column:
    return F.array_join(
        F.transform(params, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v))),
        "&",
    )


def safe_query(query) -> Column:
    """Allow-listed parameters, form-encoded; a repeated name keeps its first place, last value."""
    kept = F.filter(_params(_col(query)), lambda p: F.lower(p.k).isin(rules.SAFE_PARAMS))
    names = F.array_distinct(F.transform(kept, lambda p: p.k))
    last = F.transform(
        names, lambda n: F.struct(n.alias("k"), F.element_at(
            F.filter(kept, lambda p: p.k == n), -1).v.alias("v"))
    )
    return _encode(last)


def _question(query: Column) -> Column:
    return F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))


def sanitize_url(c) -> Column:
    """Keep allow-listed query parameters and the fragment of an absolute URL; scheme and host come
    back lower-cased, the default port is dropped and an empty path is '/'.  Anything that is not an
    absolute URL keeps the text before '?'."""
    c = _col(c)
    clean = F.concat(
        url_origin(c), url_path(c), _question(safe_query(url_part(c, 4))), url_part(c, 5)
    )
    return F.when(is_url(c), clean).otherwise(F.split_part(c, F.lit("?"), F.lit(1)))


def sanitize_href(c) -> Column:
    """``sanitize_url`` that also accepts relative references."""
    c = _col(c)
    base = F.split_part(c, F.lit("?"), F.lit(1))
    rest = F.substring(c, F.length(base) + 1, F.length(c))
    query = safe_query(F.regexp_extract(rest, r"^(\?[^#]*)", 1))
    fragment = F.regexp_extract(rest, r"(#.+)$", 1)
    return (
        F.when(F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://")),
               sanitize_url(c))
        .when(F.locate("?", c) == 0, c)
        .otherwise(F.concat(base, _question(query), fragment))
    )


def _cut(c: Column) -> Column:
    return F.when(F.length(c) <= rules.MAX_URL, c).otherwise(
        F.concat(F.substring(c, 1, rules.MAX_URL), F.lit("..."))
    )


def redact_url(c) -> Column:
    """Drop secret parameters of http(s) URLs and cut long ones.  The query is only re-encoded when
    something was dropped."""
    c = _col(c)
    params = _params(url_part(c, 4))
    kept = F.filter(params, lambda p: ~F.lower(p.k).isin(rules.SECRET_PARAMS))
    query = F.when(F.size(kept) == F.size(params), url_part(c, 4)).otherwise(
        _question(_encode(kept))
    )
    clean = F.concat(url_origin(c), url_path(c), query, url_part(c, 5))
    web = F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    return _cut(F.when(web & is_url(c), clean).otherwise(c))


def image_src(c) -> Column:
    c = _col(c)
    web = F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    return (
        F.when(F.startswith(c, F.lit("data:")), F.lit("[data-url]"))
        .when(web & is_url(c), F.concat(_authority(c), url_path(c)))
        .otherwise(c)
    )
