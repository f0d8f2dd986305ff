"""License scans by diagonal voting.

Each document's rolling word k-grams are joined to the positions at which license templates hold the same
k-gram. A hit at word p of the document and word t of a template votes for the diagonal p - t; hits of a
copied notice lie on one diagonal, an inserted or lost word moves it a little. Votes are counted by
diagonal, neighbouring diagonals merged, and the spans kept whose words cover enough of the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domlake.llm import common

#: The phrases of the registered query and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit")]
#: Wordings of public license notices and the labels that the method adds for them.
TEMPLATES = [
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-release", "Released under the MIT License"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation"),
    ("gpl-short", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Words in a row that make one vote.
GRAM = 3
#: Diagonals this close are one alignment.
DRIFT = 3
#: Least share of a template's k-grams that a span must hold.
COVER = 0.6
#: Most template k-grams that are sent to every task; more are joined by a shuffle of all k-grams.
SENT = 100_000

#: Words are runs of letters, digits and bytes above ASCII.
_SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def words_of(text: str) -> list[str]:
    t = next(common.texts(pa.array([text or ""])))
    w = common.words(t, _SEPARATORS)
    return [bytes(w.buf[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)]


_HITS = "array<struct<pos: int, gram: long, said: string>>"


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None,
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    base figures count the places where a phrase's words stand in a row. spans: label, start word, end
    word (exclusive) and coverage of each template found. score: 1 with a phrase, else the best coverage.
    A null or wordless text has no words, null first and last word, empty labels and score 0. Texts are
    read whole; a repeated row gives its result again, two texts of one doc_id are told apart. An empty
    table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    sought = [([np.uint64(common.phrase_hash([x])) for x in p.split()], label) for p, label in phrases]
    marks = [(label, at, " ".join(w[at: at + GRAM]), max(1, len(w) - GRAM + 1))
             for label, text in templates for w in [words_of(text)] for at in range(len(w) - GRAM + 1)]
    marks = [(label, at, said, size, int(np.uint64(common.phrase_hash(said.split())).astype(np.int64)))
             for label, at, said, size in marks]
    known = np.unique(np.array([m[4] for m in marks], np.int64).view(np.uint64))
    if len(known) > SENT:
        known = None

    def read(batches):
        for b in batches:
            for t in common.texts(b.column("text")):
                w = common.words(t, _SEPARATORS)
                single = common.runs(w.hash, 1)
                n = np.diff(w.first)
                places, labels = [], [set() for _ in range(t.rows)]
                for parts, label in sought:
                    at = np.flatnonzero(single == parts[0])
                    for i, part in enumerate(parts[1:], 1):
                        at = at[at + i < len(single)]
                        at = at[(single[at + i] == part) & (w.row[at] == w.row[at + i])]
                    places.append(at)
                    for r in set(w.row[at].tolist()):
                        labels[r].add(label)
                places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
                edge = np.searchsorted(places, w.first)
                grams = common.runs(w.hash, GRAM)
                ok = w.row[: len(grams)] == w.row[GRAM - 1:] if len(grams) else np.zeros(0, bool)
                if known is not None and len(grams) and len(known):
                    ok &= known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams
                elif known is not None:
                    ok[:] = False
                hit = np.flatnonzero(ok)
                hits = [[] for _ in range(t.rows)]
                for i in hit.tolist():
                    r = w.row[i]
                    said = " ".join(bytes(w.buf[w.starts[j]: w.ends[j]]).decode(errors="replace") for j in range(i, i + GRAM))
                    hits[r].append({"pos": int(i - w.first[r]), "gram": int(grams[i].astype(np.int64)), "said": said})
                inner = [places[a:z] - f for a, z, f in zip(edge, edge[1:], w.first, strict=False)]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(t.first, t.rows), b.column("text_key").slice(t.first, t.rows),
                    pa.array(n, pa.int64()), pa.array(np.diff(edge), pa.int64()),
                    pa.array([int(p[0]) if len(p) else None for p in inner], pa.int64()),
                    pa.array([int(p[-1]) if len(p) else None for p in inner], pa.int64()),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64()), ("said", pa.string())]))),
                ], names=["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "found", "hits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        read, f"doc_id {id_type}, text_key long, n_words long, n_base long, first_word long, last_word long, "
              f"found array<string>, hits {_HITS}")
    placed = spark.createDataFrame(marks or [("", 0, "", 1, 0)], "label string, at int, said string, size int, gram long")
    hits = (rows.where(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("h"))
            .select("doc_id", "text_key", "h.*").distinct())
    if known is not None:
        placed = F.broadcast(placed)
    votes = (hits.join(placed, ["gram", "said"])  # equal words, not only equal hashes
             .groupBy("doc_id", "text_key", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
             .agg(F.count("*").alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("stop"),
                  F.collect_set("at").alias("ats")))
    order = W.partitionBy("doc_id", "text_key", "label").orderBy("start", "diagonal")
    apart = F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT)
                       | (F.col("start") - F.lag("stop").over(order) > F.col("size") + GRAM), F.lit(True))
    spans = (votes.withColumn("apart", apart.cast("int"))
             .withColumn("run", F.sum("apart").over(order))
             .groupBy("doc_id", "text_key", "label", "size", "run")
             .agg(F.min("start").alias("start"), (F.max("stop") + GRAM).alias("end"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"))
             .withColumn("cover", F.col("matched") / F.col("size"))
             .where((F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= 2 * F.col("size") + 2 * GRAM)))
    found = (spans.groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "cover"))).alias("spans"))
             .withColumnsRenamed({"doc_id": "d", "text_key": "k"}))
    out = rows.drop("hits").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("found", F.coalesce(F.col("spans.label"), F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("found", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))).alias("score"),
        "spans")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("spans")
