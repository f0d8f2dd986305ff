"""Readable main text of a page, chosen by scoring blocks of the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, squeeze, trim_ws
from .tree import attr

# Blocks that can hold an article, and places whose text never counts.
CONTAINERS = ["ARTICLE", "MAIN", "SECTION", "DIV", "BODY", "TD", "BLOCKQUOTE"]
SKIPPED = ["SCRIPT", "STYLE", "NOSCRIPT", "TEMPLATE", "HEAD", "TITLE", "NAV", "FOOTER", "HEADER",
           "ASIDE", "FORM", "BUTTON", "SELECT", "TEXTAREA", "IFRAME", "SVG"]
BLOCKS = ["P", "DIV", "LI", "TD", "PRE", "BLOCKQUOTE", "SECTION", "ARTICLE", "H1", "H2", "H3",
          "H4", "H5", "H6", "BODY", "MAIN"]
TAG_BONUS = {"ARTICLE": 25.0, "MAIN": 15.0, "DIV": 5.0, "TD": 3.0, "BODY": -5.0}
MIN_TEXT = 100


def read_page(pages: DataFrame, dom: DataFrame, key: str = "page_id", min_text: int = MIN_TEXT) -> DataFrame:
    """One row per page: title, byline, excerpt, site_name, lang, text, length, or an error when
    there is no article-like content, which takes a container with ``min_text`` characters.

    Every text node adds to the containers above it: the nearest one fully, the next half, then a
    third per level; text in links counts against a container.  Both uses of the text rows read the
    same exchange on the page."""
    texts = (
        dom.filter((F.col("node_type") == 3) & (trim_ws("node_value") != ""))
        .select("snapshot_id", "pre", squeeze("node_value").alias("t"),
                F.transform("ancestors", lambda a: F.struct(a.id.alias("id"),
                                                            F.upper(a.tag).alias("tag")))
                .alias("up"))
        .filter(~F.exists("up", lambda a: a.tag.isin(SKIPPED)))
        .repartition("snapshot_id")
    )
    linked = F.exists("up", lambda a: a.tag == "A")
    weight = F.least(F.floor(F.length("t") / 100), F.lit(3)) + F.size(F.split("t", ",")) + F.when(
        F.length("t") >= 25, 1).otherwise(0)
    holders = F.filter("up", lambda a: a.tag.isin(CONTAINERS))
    scored = texts.select(
        "snapshot_id", F.length("t").alias("len"), linked.alias("in_link"),
        weight.cast("double").alias("weight"), F.posexplode(holders).alias("level", "c"))
    bonus = F.coalesce(F.try_element_at(F.create_map(*[
        F.lit(x) for kv in TAG_BONUS.items() for x in kv]), F.col("c.tag")), F.lit(0.0))
    share = F.when(F.col("level") == 0, 1.0).when(F.col("level") == 1, 0.5).otherwise(
        1.0 / (F.col("level") * 3))
    blocks = scored.groupBy("snapshot_id", "c.id", "c.tag").agg(
        F.sum(F.when(~F.col("in_link"), F.col("weight") * share).otherwise(0.0)).alias("raw"),
        F.sum("len").alias("len"),
        F.sum(F.when(F.col("in_link"), F.col("len")).otherwise(0)).alias("link_len"),
        F.max(bonus).alias("bonus"))
    best = blocks.filter(F.col("len") >= min_text).withColumn(
        "score", (F.col("raw") + F.col("bonus")) * (1 - F.col("link_len") / F.col("len"))
    ).groupBy("snapshot_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("top"))
    near_block = F.get(F.filter("up", lambda a: a.tag.isin(BLOCKS)), F.lit(0)).id
    body = texts.join(best, "snapshot_id").filter(
        F.exists("up", lambda a: a.id == F.col("top"))).select(
        "snapshot_id", "pre", "t", near_block.alias("block"))
    para = body.groupBy("snapshot_id", "block").agg(
        F.min("pre").alias("pre"),
        F.array_join(F.array_sort(F.collect_list(F.struct("pre", "t"))).getField("t"), " ")
        .alias("t"))
    text = para.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("pre", "t"))).getField("t"), "\n").alias("text"))
    out = pages.select(F.col(key).alias("snapshot_id")).join(
        page_metadata(dom), "snapshot_id", "left").join(text, "snapshot_id", "left")
    no_text = F.col("text").isNull()
    return out.select(
        F.col("snapshot_id").alias(key), "title", "byline",
        F.coalesce("description", F.substring(F.split_part("text", F.lit("\n"), F.lit(2)), 1, 200))
        .alias("excerpt"), "site_name", "lang", "text",
        F.coalesce(F.length("text"), F.lit(0)).alias("length"),
        F.when(no_text, "Could not extract readable content from this page.").alias("error"))


def page_metadata(dom: DataFrame) -> DataFrame:
    """(snapshot_id, title, lang, byline, description, site_name) from head elements."""
    tag = F.upper("node_name")
    name = F.lower(F.coalesce(attr("property"), attr("name")))
    content = F.when(tag == "META", blank_to_null(squeeze(attr("content"))))
    parent = F.upper(F.get("ancestors", F.lit(0)).tag)
    in_title = (F.col("node_type") == 3) & (parent == "TITLE")
    first = lambda value, test: F.min_by(
        F.when(test, value), F.when(test & value.isNotNull(), F.col("pre")))
    rows = dom.filter(tag.isin("HTML", "META") | in_title)
    return rows.groupBy("snapshot_id").agg(
        first(blank_to_null(squeeze("node_value")), in_title).alias("title"),
        first(blank_to_null(attr("lang")), tag == "HTML").alias("lang"),
        first(content, name.isin("author", "article:author")).alias("byline"),
        first(content, name.isin("description", "og:description")).alias("description"),
        first(content, name == "og:site_name").alias("site_name"))
