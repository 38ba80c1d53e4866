"""Licence notices in texts, found by diagonal voting.

Known notices (templates) and documents are sequences of words. Every rolling k-gram hash of a
document is joined to the template positions with that hash; a hit votes for the diagonal on which
it lies, the document position less the template position. A notice that stands in a text as it is
puts all its votes on one diagonal; left-out or added words move the rest to a diagonal close by.

1. A pass over the texts gives the k-grams that a bit map of template k-grams lets through, with
   their words; the join compares hashes and words.
2. Votes are added up by document, template and diagonal.
3. Diagonals that follow each other in the text and lie at most ``slack`` apart are merged.
4. The template words under the votes are counted: a span stands if their share is large enough.

Phrases are templates as long as their k-gram, so that every hit is a place.

Nulls: a null text has no words; a null ``doc_id`` is a value like another. Equal rows each get
their result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.gram_filter import bit_map, passing_grams
from emberlog.llm.rows import KEY, located, scan, stored

GRAM = 4
SLACK = 5
GAP = 15
LEAST_SHARE = 0.7

# Phrases that always count, and notices as their licences word them.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
]


def template_grams(spark, phrases=PHRASES, notices=NOTICES, gram: int = GRAM) -> DataFrame:
    """(code, gram, size, template, pos, words, label, phrase): every k-gram position of every template."""
    rows = []
    for template, (text, label, phrase) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = text.split(" ")
        size = len(words) if phrase else min(gram, len(words))
        data, offsets = ragged.text_bytes(pa.array([text]))
        starts, ends, _ = ragged.word_bounds(data, offsets, ragged.letter_bytes())
        codes = ragged.signed(ragged.gram_hashes(ragged.word_hashes(data, starts, ends), size)).tolist()
        rows += [(code, " ".join(words[i:i + size]), size, template, i, len(words), label, phrase) for i, code in enumerate(codes)]
    return spark.createDataFrame(rows, "code bigint, gram string, size int, template int, pos int, words int, label string, phrase boolean")


def hits(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): KEY, doc_id and n_words of every row; the template positions that each k-gram of a row meets."""
    spot = pa.struct([("code", pa.int64()), ("at", pa.int64()), ("gram", pa.string())])
    sizes = sorted(r[0] for r in templates.select("size").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(templates))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n_words, spots = [np.zeros(0, np.int64)], []
            for low, high, piece, starts, ends, first, _, found in passing_grams(batch.column("text"), sizes, bits.value):
                n_words.append(np.diff(first))
                own: list[list] = [[] for _ in range(high - low)]
                for size, places, codes in found:
                    rows = np.searchsorted(first, places, "right") - 1
                    for p, code, row in zip(places.tolist(), ragged.signed(codes).tolist(), rows.tolist(), strict=True):
                        words = " ".join(piece[starts[j]:ends[j]].tobytes().decode("utf-8", "replace") for j in range(p, p + size))
                        own[row].append({"code": code, "at": p - int(first[row]), "gram": words})
                spots += own
            yield {"n_words": pa.array(np.concatenate(n_words)), "spots": pa.array(spots, pa.list_(spot))}

    texts = located(docs, "doc_id", "text")
    rows = stored(scan(texts, "n_words bigint, spots array<struct<code:bigint,at:bigint,gram:string>>", work, (*KEY, "doc_id")), "spots")
    met = rows.select(*KEY, F.inline("spots")).join(templates, ["code", "gram"])
    return rows.drop("spots"), stored(met.drop("code", "gram"), "hits")


def spans(met: DataFrame, *, slack: int = SLACK, gap: int = GAP) -> DataFrame:
    """Hits to merged diagonals: KEY, template, label, phrase, start, stop (document words) and share of the template."""
    own = [*KEY, "template"]
    diagonal = met.withColumn("diagonal", F.col("at") - F.col("pos"))
    votes = diagonal.groupBy(*own, "diagonal").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop"), F.collect_set("pos").alias("poses"),
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"), F.first("words").alias("words"))
    along = Window.partitionBy(*own).orderBy("start", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) <= slack) & (F.col("start") - F.lag("stop").over(along) <= gap) & ~F.col("phrase")
    merged = votes.withColumn("opens", F.when(near, 0).otherwise(1)).withColumn("span", F.sum("opens").over(along)).groupBy(*own, "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.flatten(F.collect_list("poses")).alias("poses"),
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"), F.first("words").alias("words"))
    # the template words under the votes: as many as the template has at most
    under = F.array_distinct(F.flatten(F.transform(F.array_distinct("poses"), lambda p: F.sequence(p, p + F.col("size") - 1))))
    return merged.select(*own, "label", "phrase", "start", "stop", (F.size(under) / F.col("words")).alias("share"))


def find_licenses(docs: DataFrame, *, phrases=PHRASES, notices=NOTICES, gram: int = GRAM, slack: int = SLACK, gap: int = GAP,
                  least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: KEY, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the largest share of a notice that stands, 0.5 for phrases alone, 0 for nothing.
    """
    templates = template_grams(docs.sparkSession, phrases, notices, gram)
    rows, met = hits(docs, templates)
    standing = spans(met, slack=slack, gap=gap).filter(F.col("phrase") | (F.col("share") >= least_share))
    when_phrase = lambda c: F.when(F.col("phrase"), F.col(c))
    found = standing.groupBy(*KEY).agg(
        F.count(when_phrase("start")).alias("n_base"), F.min(when_phrase("start")).alias("first_word"), F.max(when_phrase("start")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(when_phrase("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(F.col("phrase"), F.lit(0.5)).otherwise(F.col("share"))).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "share"))).alias("spans"))
    blank = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.join(found, [*KEY], "left").select(
        *KEY, "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        blank("base_labels", ""), blank("labels", ""), blank("score", 0.0), "spans")
