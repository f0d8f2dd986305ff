"""Text and privacy functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from domlake.functions import privacy as p
from domlake.functions import text as t


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("  a \t b\n", "a b"), ("​x﻿ y", "x y"), ("Ａﬁ", "Afi"), ("", ""),
    ("a  b", "a b"),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, t.normalize_text) == want
    assert t.normalize_literal(raw) == want


def test_truncate_and_tokens(spark):
    assert one(spark, "x" * 121, t.truncate) == "x" * 119 + "…"
    assert one(spark, "an apple on big trees now here", t.tokenize) == ["apple", "big", "trees"]


@pytest.mark.parametrize("label,query,score", [
    ("blue widget", ["blue", "widget"], 1.0), ("blue widget", ["wid"], 0.9),
    ("wid", ["widget"], 0.85), ("widgets", ["widgetz"], 1 - 1 / 7), ("rod", ["bolt"], 0.0),
    ("blue rod", ["blue", "bolt"], 0.5),
])
def test_fuzzy(spark, label, query, score):
    fn = lambda c: t.fuzzy_score(t.tokenize(c, 10, 2), query)
    assert one(spark, label, fn) == pytest.approx(score)
    col = lambda c: t.fuzzy_score(t.tokenize(c, 10, 2), F.array(*map(F.lit, query)))
    assert one(spark, label, col) == pytest.approx(score)


@pytest.mark.parametrize("raw,want", [
    ("Hello_ World & 'x'!", "hello-world-x"), ("--a--", "a"), ("é", ""),
    ("a" * 39 + " bc", "a" * 39),
])
def test_slug(spark, raw, want):
    assert one(spark, raw, t.slugify) == want


@pytest.mark.parametrize("raw,want", [
    ("http://Ex.com:80?x=1&page=2&page=3#f", "http://ex.com/?page=3#f"),
    ("https://a.b/c?q=a+b&utm=1", "https://a.b/c?q=a+b"), ("foo?bar", "foo"),
    ("https://a.b/", "https://a.b/"),
])
def test_sanitize(spark, raw, want):
    assert one(spark, raw, p.sanitize_url) == want


@pytest.mark.parametrize("raw,want", [
    ("/a?page=1&z=2#q", "/a?page=1#q"), ("/a#q", "/a#q"), ("/a?z=1", "/a"),
])
def test_sanitize_href(spark, raw, want):
    assert one(spark, raw, p.sanitize_href) == want


def test_redact_and_image(spark):
    assert one(spark, "https://a.b/c?Token=1&q=2", p.redact_url) == "https://a.b/c?q=2"
    assert one(spark, "/" + "x" * 300, p.redact_url) == "/" + "x" * 199 + "..."
    assert one(spark, "data:image/png;xx", p.image_src) == "[data-url]"
    assert one(spark, "https://a.b/c.png?x=1", p.image_src) == "a.b/c.png"


@pytest.mark.parametrize("value,kind,label,want", [
    ("abc", "password", "x", "••••••••"), ("abc", "text", "API key", "***"),
    ("john@x.org", "email", "Mail", "jo•••rg"), ("a b", "text", "", "a b"),
    ("0123456789abcdef", "text", "", "01•••ab"), (" \n", "text", "", ""),
    ("abc", "tel", "", "••••"),
])
def test_mask(spark, value, kind, label, want):
    df = spark.createDataFrame([(value, kind, label)], "v string, k string, l string")
    assert df.select(p.mask_value("v", "k", "l").alias("r")).first().r == want
