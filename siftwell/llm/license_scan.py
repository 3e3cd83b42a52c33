"""License scan: an exact set-similarity join of text blocks with license templates, in built-in expressions.

Tokens are ordered by their frequency over all documents. A template's prefix holds its rarest tokens; a text that
holds a block which meets the containment threshold shares one of them, early enough (positional filter), and holds enough
template tokens (length filter). Pairs that pass are verified block by block, so the join misses none.

A block is a run of as many words as the template has, and a quarter more at the default threshold (for words put in
between), whatever lines it stands on: notices are found as one line or wrapped, and words that are spread over a
longer text are no notice. Only runs that begin at one of the template's words are looked at; others hold no more of them.

Each text is read once: its base columns and the template words it holds are written, with the text itself only where it holds
enough words of some template. Template vocabulary is the only thing that is broadcast; its size is that of the templates
given, never that of the documents.

Defined cases: a null or empty text has no words and no labels; very long texts are read whole; of equally good blocks and
templates the score is the same, and all labels are told; repeated rows get equal results; a row with a null id is scanned as
any other; templates without tokens are refused; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import spread, written
from siftwell.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, text): notices by which works name their license, and openings of public license texts.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-sa", "CC BY-SA"),
    ("proprietary", "All rights reserved."),
)


def tokens_of(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def normalised(text: Column) -> Column:
    """Words joined by single spaces, with one space on either side; empty without words."""
    joined = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def base_columns(norm: Column) -> dict[str, Column]:
    """Counts, places and labels of the phrases; no phrase overlaps another, so one pattern finds them all."""
    pattern = " (" + "|".join(PHRASES) + ")(?= )"
    hit = F.instr(norm, " license ") + F.instr(norm, " cc by ") > 0
    found = F.when(hit, F.regexp_extract_all(norm, F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))
    pieces = F.split(norm, pattern)
    n_words = F.greatest(spaces(norm) - 1, F.lit(0)).cast("long")
    any_found = F.size(found) > 0
    last_phrase = spaces(F.element_at(found, -1)) + 1
    labels = F.transform(found, lambda p: F.coalesce(*[F.when(p == k, F.lit(v)) for k, v in PHRASES.items()]))
    return {
        "n_words": n_words,
        "n_base": F.size(found).cast("long"),
        "first_word": F.when(any_found, spaces(pieces[0])).cast("long"),
        "last_word": F.when(any_found, n_words - (spaces(F.element_at(pieces, -1)) - 1) - last_phrase).cast("long"),
        "base": F.array_distinct(labels),
    }


def template_sets(templates, threshold: float) -> list[tuple[str, int, int, list[str]]]:
    """(label, words of a block, tokens it must hold, distinct tokens) of each template."""
    out = []
    for label, text in templates:
        words = tokens_of(text)
        if not words:
            raise ValueError("a template has no tokens")
        distinct = sorted(set(words))
        out.append((label, math.ceil(len(words) / threshold - 1e-9), math.ceil(threshold * len(distinct) - 1e-9), distinct))
    return out


def read_once(source: DataFrame, sets) -> DataFrame:
    """doc_id, h, the base columns, the template words of each text (held), and its words (norm) where some template may stand in it."""
    known = F.array(*[F.lit(x) for x in sorted({x for *_, s in sets for x in s})])
    rows = source.withColumn("norm", normalised(F.col("text")))
    base = [c.alias(k) for k, c in base_columns(F.col("norm")).items()]
    rows = rows.select("doc_id", "h", "norm", *base, F.array_intersect(F.split(F.trim("norm"), " "), known).alias("held"))
    may = F.lit(False)
    for _, _, need, s in sorted(sets, key=lambda x: x[2]):
        may = may | (F.size(F.array_intersect("held", F.array(*[F.lit(x) for x in s]))) >= need)
    return rows.withColumn("norm", F.when(may, F.col("norm")))


def license_matches(rows: DataFrame, key: list[str], sets) -> DataFrame:
    """(*key, label, containment): the best block of each text and template that meets the threshold.

    rows: the columns `key`, norm (null: passed over) and held, over all documents."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.select(F.explode("held").alias("t")).groupBy("t").count().collect()}  # at most the vocabulary
    order = {t: i for i, t in enumerate(sorted({x for *_, s in sets for x in s}, key=lambda t: (counts.get(t, 0), t)))}
    prefixes = []
    for label, width, need, s in sets:
        ranks = sorted(order[t] for t in s)
        by_rank = sorted(s, key=order.get)
        prefixes += [(ranks[i], label, width, i, need, ranks, by_rank) for i in range(len(ranks) - need + 1)]
    index = spark.createDataFrame(prefixes, "token int, label string, width int, i int, need int, t_ranks array<int>, t_words array<string>")
    vocabulary = F.array(*[F.lit(x) for x in sorted(order, key=order.get)])
    rank = F.transform("held", lambda t: (F.array_position(vocabulary, t) - 1).cast("int"))
    ranked = rows.filter(F.col("norm").isNotNull()).select(*key, "norm", F.sort_array(rank).alias("ranks"))
    probes = ranked.select(*key, "norm", "ranks", F.posexplode("ranks").alias("j", "token"))
    left, rest = F.size("ranks") - F.col("j") - 1, F.size("t_ranks") - F.col("i") - 1
    first = ~F.arrays_overlap(F.slice("ranks", F.lit(1), F.col("j")), F.slice("t_ranks", F.lit(1), F.col("i")))  # each pair once
    candidates = probes.join(F.broadcast(index), "token").filter((F.size("ranks") >= F.col("need")) & (1 + F.least(left, rest) >= F.col("need")) & first)
    candidates = candidates.filter(F.size(F.array_intersect("ranks", "t_ranks")) >= F.col("need"))

    words = F.split(F.trim("norm"), " ")
    told = F.transform(words, lambda w, at: F.struct(at.alias("at"), F.array_position("t_words", w).alias("t")))
    hits = F.filter(told, lambda x: x["t"] > 0)

    def most_in_a_run(hits):  # distinct template words in the run of words that begins at each hit; bound once, not for each
        def held_from(j):
            end = F.get(hits, j)["at"] + F.col("width")
            return F.size(F.array_distinct(F.transform(F.filter(F.slice(hits, j + 1, F.col("width")), lambda x: x["at"] < end), lambda x: x["t"])))

        return F.array_max(F.transform(hits, lambda _, j: held_from(j)))

    found = candidates.select(*key, "label", "need", "t_words", let(hits, most_in_a_run).alias("best")).filter(F.col("best") >= F.col("need"))
    return found.select(*key, "label", (F.col("best") / F.size("t_words")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per document: the base phrases' counts and places, all labels, and the best containment."""
    sets = template_sets(templates, threshold)
    source = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).withColumn("h", F.xxhash64("text"))
    rows = written(read_once(source, sets), "license-rows")
    matches = license_matches(rows, ["doc_id", "h"], sets).groupBy("doc_id", "h").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))  # at most the templates' labels
    m = matches.select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), "found", "score")
    none = F.array().cast("array<string>")
    plain = rows.filter(F.col("norm").isNull()).drop("norm", "held").withColumn("found", none).withColumn("score", F.lit(None).cast("double"))
    joined = rows.filter(F.col("norm").isNotNull()).drop("norm", "held").join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("h").eqNullSafe(F.col("m_h")), "left")
    return plain.unionByName(joined.drop("m_id", "m_h")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"('{label}', {width}, {need}, [{', '.join(repr(x) for x in s)}])" for label, width, need, s in template_sets(TEMPLATES, 0.8))
    phrases = ", ".join(f"('{p}', {p.count(' ') + 1}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH tpl(label, width, need, toks) AS (VALUES {rows}),
ph(phrase, k, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, coalesce(translate(text, '{UPPER}', '{LOWER}'), '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
hits AS (
  SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) p, ph
  WHERE array_to_string(p.w[i:i + k - 1], ' ') = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS b FROM hits GROUP BY doc_id
), may AS (SELECT doc_id, w, label, width, need, toks FROM w, tpl WHERE len(list_intersect(list_distinct(w), toks)) >= need),
runs AS (SELECT doc_id, label, need, toks, w[i:i + width - 1] AS run FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM may) WHERE list_contains(toks, w[i])),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(run), toks)) / len(toks) AS c FROM runs WHERE len(list_intersect(list_distinct(run), toks)) >= need),
mm AS (SELECT doc_id, list(DISTINCT label) AS f, max(c) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(f, [])))), ','), '') AS labels,
  coalesce(round(score, 6), 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN mm USING (doc_id)
"""


SQL = _sql()
