"""License scans by diagonal voting.

Templates (license notices and short phrases) are cut into word k-grams with their places. The rolling k-gram
hashes of every document are joined to the broadcast template grams, word equality being checked at each hit.
A hit votes for the diagonal document place minus template place; the votes of neighbouring diagonals are merged,
since a word put in or left out moves the rest of a notice to the next diagonal; a merged span counts if it
covers enough of the template. Phrases must stand whole on one diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.llm.common import alnum_words, table

K = 3
#: Diagonals this near are merged; share of a notice's grams that its span must cover.
DRIFT, COVER = 3, 0.6
#: Phrases that count where all their words stand together, with their labels. Fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices found by the method, with their labels. Fixed values.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("All rights reserved. No part of this publication may be reproduced", "all-rights-reserved"),
)
#: Template grams are broadcast (about 150 bytes each); a larger set of templates must be scanned in blocks.
BROADCAST_GRAMS = 100_000


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def gram_rows(templates: Sequence[tuple[str, str]]) -> list[tuple[int, int, list[str]]]:
    """(template, place, words of the gram); every template has K words at least."""
    out = []
    for t, (text, _) in enumerate(templates):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words or more: {text!r}")
        out += [(t, i, words[i : i + K]) for i in range(len(words) - K + 1)]
    return out


def _block(docs: DataFrame, templates: Sequence[tuple[str, str]], grams: list[tuple[int, int, list[str]]]) -> DataFrame:
    """Per row and template diagonal: _km_row, _km_id, t, diag, places (template places hit). t = -1 is one row a document with its number of words as diag."""
    values = ", ".join(f"({t}, {i}, xxhash64({', '.join(repr(w) for w in g)}), array({', '.join(repr(w) for w in g)}))" for t, i, g in grams)
    known = docs.sparkSession.sql(f"SELECT * FROM VALUES {values}, (-1, 0, -1L, CAST(array() AS array<string>)) AS v(t, tpos, code, gram)")
    at = lambda i, j: F.get("_km_w", i + j)
    n = F.size("_km_w")
    rolled = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*(at(i, j) for j in range(K))))
    none = F.array().cast("array<bigint>")
    # The last element, -1, meets the row t = -1: every document yields a row, and with it its number of words.
    codes = F.concat(F.when(n >= K, rolled).otherwise(none), F.array(F.lit(-1).cast("bigint")))
    spread = docs.withColumn("_km_c", codes).select("_km_row", "_km_id", "_km_w", F.posexplode("_km_c").alias("pos", "code"))
    equal = F.lit(True)
    for j in range(K):
        equal &= F.get("_km_w", F.col("pos") + j) == F.get("gram", F.lit(j))
    last = F.col("pos") == F.greatest(n - K + 1, F.lit(0))
    hits = spread.join(F.broadcast(known), "code").filter(F.when(F.col("t") == -1, last).otherwise(F.coalesce(equal, F.lit(False))))
    hits = hits.select("_km_row", "_km_id", "t", F.when(F.col("t") == -1, n).otherwise(F.col("pos") - F.col("tpos")).alias("diag"), "tpos")
    return hits.groupBy("_km_row", "_km_id", "t", "diag").agg(F.sort_array(F.collect_set("tpos")).alias("places"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row for each row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word are of the phrases' places; score is the largest share of a template that a
    span covers, 1 for a whole phrase. Null and empty texts have no words and no labels; repeated rows are kept
    apart; texts of any length are taken whole; an empty table gives an empty table; other columns of docs play no part.
    """
    templates = [*phrases, *notices]
    grams = gram_rows(templates)
    if len(grams) > BROADCAST_GRAMS:
        raise ValueError("too many template grams for one scan: pass the notices in blocks and unite the labels")
    rows = docs.select(F.monotonically_increasing_id().alias("_km_row"), F.col(f"`{id_col}`").alias("_km_id"), alnum_words(F.col(f"`{text}`")).alias("_km_w"))
    voted = _block(rows, templates, grams)
    facts = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(len(template_words(t)) - K + 1).alias("grams"), F.lit(i < len(phrases)).alias("phrase")) for i, (t, label) in enumerate(templates)))
    voted = voted.withColumn("f", F.get(facts, F.when(F.col("t") >= 0, F.col("t"))))
    whole = F.size("places") == F.col("f.grams")
    by = Window.partitionBy("_km_row", "_km_id", "t").orderBy("diag")
    new = F.when(F.col("diag") - F.lag("diag").over(by) <= DRIFT, 0).otherwise(1)
    runs = voted.withColumn("_km_new", new).withColumn("run", F.sum("_km_new").over(by))
    spans = runs.groupBy("_km_row", "_km_id", "t", "run").agg(
        F.first("f").alias("f"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hit"),
        F.sum(F.when(whole, 1).otherwise(0)).alias("n_whole"), F.min(F.when(whole, F.col("diag"))).alias("first"), F.max(F.when(whole, F.col("diag"))).alias("last"), F.max("diag").alias("diag"),
    )
    phrase, base = F.coalesce(F.col("f.phrase"), F.lit(False)), F.coalesce(F.col("f.phrase") & (F.col("n_whole") > 0), F.lit(False))
    share = F.when(F.col("t") >= 0, F.when(phrase, F.when(base, 1.0).otherwise(0.0)).otherwise(F.col("hit").cast("double") / F.col("f.grams")))
    found = F.coalesce(F.when(phrase, base).otherwise(share >= COVER), F.lit(False))
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("f.label")))), ",")
    out = spans.groupBy("_km_row", "_km_id").agg(
        F.max(F.when(F.col("t") == -1, F.col("diag"))).cast("bigint").alias("n_words"),
        F.sum(F.when(base, F.col("n_whole")).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.round(F.coalesce(F.max(share), F.lit(0.0)), 6).alias("score"),
    )
    return out.withColumnRenamed("_km_id", id_col).drop("_km_row")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    templates = [*PHRASES, *NOTICES]
    values = ", ".join(f"({t}, {i}, '{' '.join(g)}')" for t, i, g in gram_rows(templates))
    facts = ", ".join(f"({i}, '{label}', {len(template_words(t)) - K + 1}, {str(i < len(PHRASES)).lower()})" for i, (t, label) in enumerate(templates))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g(t, tpos, gram) AS (VALUES {values}), f(t, label, grams, phrase) AS (VALUES {facts}),
x AS (SELECT id, i - 1 AS pos, array_to_string(w[i : i + {K - 1}], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d WHERE len(w) >= {K})),
h AS (SELECT id, t, pos - tpos AS diag, list(DISTINCT tpos) AS places FROM x JOIN g USING (gram) GROUP BY id, t, pos - tpos),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id, t ORDER BY diag) AS run FROM
  (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY id, t ORDER BY diag) <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM h)),
s AS (SELECT id, t, run, any_value(label) AS label, any_value(grams) AS grams, any_value(phrase) AS phrase, len(list_distinct(flatten(list(places)))) AS hit,
  count(*) FILTER (len(places) = grams) AS n_whole, min(diag) FILTER (len(places) = grams) AS first, max(diag) FILTER (len(places) = grams) AS last FROM r JOIN f USING (t) GROUP BY id, t, run),
k AS (SELECT *, phrase AND n_whole > 0 AS base, CASE WHEN phrase THEN CASE WHEN n_whole > 0 THEN 1.0 ELSE 0.0 END ELSE CAST(hit AS DOUBLE) / grams END AS share FROM s),
o AS (SELECT id, CAST(sum(n_whole) FILTER (base) AS BIGINT) AS n_base, CAST(min(first) FILTER (base) AS BIGINT) AS first_word, CAST(max(last) FILTER (base) AS BIGINT) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT phrase AND share >= {COVER}) AS labels, max(share) AS score FROM k GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score FROM d LEFT JOIN o USING (id)"""
