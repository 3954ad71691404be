"""License scans by diagonal voting.

Every text's rolling word k-grams are hashed and joined with the k-grams of the
templates (a broadcast of a few hundred rows, whatever the corpus).  A match
votes for the diagonal ``word position - template position``.  Votes are added
by (document, template, diagonal); neighbouring diagonals of one template,
``GAP`` words apart at most, are merged, so spans survive inserted or missing
words; and a span is verified by the share of the template's k-grams that it
holds.  Short phrases must match wholly on one diagonal.

Documents are keyed by id and text, so rows that repeat an id don't vote for
each other, and rows that repeat both get the same result.  A document's votes
are distinct template positions, so repeated rows don't add up either.

Defined cases: null counts as empty (no words, no labels, score 0); null ids
are an id of their own; a text may be of any length; ties between spans need
none, as all count; other columns are ignored whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import durable

GRAM = 4
GAP = 3
LEAST_SHARE = 0.4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of public licenses and of their usual notices.
TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def templates() -> list[tuple[str, str, int, list[str]]]:
    """(template, label, k, words): phrases with k = 2, texts with k = GRAM."""
    return [(f"phrase:{p}", label, 2, template_words(p)) for p, label in PHRASES.items()] + [(f"text:{label}", label, GRAM, template_words(t)) for label, t in TEXTS.items()]


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, at, n_grams, hash, check) of all k-grams."""
    rows = [(name, label, k == 2, i, len(w) - k + 1, len(w), w[i : i + k]) for name, label, k, w in templates() for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "template string, label string, base boolean, at int, n_grams int, n_template int, gram array<string>")
    return df.select("template", "label", "base", "at", "n_grams", "n_template", F.xxhash64("gram").alias("hash"), F.hash("gram").alias("check"))


def scan_words(text: Column) -> Column:
    """Words with A-Z folded; the Kelvin sign, whose lower case is an ASCII letter, becomes another letter first."""
    return F.filter(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ɀ"))), NOT_WORD), lambda w: w != "")


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document, stored: _id, _text (a hash), n_words, and the (pos, hash, check) of its k-grams that a template has.

    The texts are read here and nowhere else.
    """
    known = [x.hash for x in template_grams(docs.sparkSession).select("hash").distinct().collect()]  # a few hundred, whatever the corpus

    def grams_of(words: Column) -> Column:
        gram = lambda k, i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(words, i, k)).alias("hash"), F.hash(F.slice(words, i, k)).alias("check"))
        rolling = lambda k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: gram(k, i))).otherwise(F.array())
        return F.struct(F.size(words).cast("long").alias("n_words"), F.filter(F.concat(rolling(2), rolling(GRAM)), lambda g: g["hash"].isin(known)).alias("grams"))

    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_text"), scan_words(docs[text_col]).alias("_words"))
    # the words are bound to a variable, so that they are split once
    found = rows.select("_id", "_text", F.get(F.transform(F.array("_words"), grams_of), F.lit(0)).alias("_found"))
    return durable(found.select("_id", "_text", F.col("_found.n_words").alias("n_words"), F.col("_found.grams").alias("grams")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: _id, _text (a hash), template, label, base, first_word, last_word, share."""
    return _spans(_matches(docs, id_col, text_col))


def _spans(matches: DataFrame) -> DataFrame:
    grams = F.broadcast(template_grams(matches.sparkSession))
    votes = matches.select("_id", "_text", F.explode("grams").alias("g")).select("_id", "_text", "g.*").join(grams, ["hash", "check"])
    key = ["_id", "_text", "template"]
    # matches are few; kept, both kinds of template read them
    diagonals = durable(votes.select(*key, "label", "base", "n_grams", "n_template", "at", (F.col("pos") - F.col("at")).alias("diagonal")).distinct())
    exact = diagonals.filter("base").groupBy(*key, "label", "base", "n_grams", "n_template", "diagonal").agg(F.count(F.lit(1)).alias("n")).filter("n = n_grams")
    exact = exact.select(*key, "label", "base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n_template") - 1).alias("last_word"), F.lit(1.0).alias("share"))
    order = W.partitionBy(*key).orderBy("diagonal")
    near = diagonals.filter("NOT base").withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"))
    near = near.withColumn("_group", F.sum(F.coalesce("_new", F.lit(0))).over(order.rangeBetween(W.unboundedPreceding, 0)))
    merged = near.groupBy(*key, "label", "base", "n_grams", "_group").agg(
        F.countDistinct("at").alias("n"), F.min(F.col("diagonal") + F.col("at")).alias("first_word"), (F.max(F.col("diagonal") + F.col("at")) + GRAM - 1).alias("last_word")
    )
    merged = merged.withColumn("share", F.col("n") / F.col("n_grams")).filter(F.col("share") >= LEAST_SHARE)
    return exact.unionByName(merged.select(*key, "label", "base", "first_word", "last_word", "share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    matches = _matches(docs, id_col, text_col)
    found = _spans(matches)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    # at most one short row for each place of a phrase, and a document's labels are few
    by_doc = found.groupBy("_id", "_text").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    rows = matches.select(F.col("_id").alias("_doc"), F.col("_text").alias("_key"), "n_words")
    out = rows.join(by_doc, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left")
    return out.select(
        F.col("_doc").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
