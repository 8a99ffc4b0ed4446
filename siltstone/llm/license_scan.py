"""License scans by diagonal voting, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words; every rolling K-word gram is
hashed and joined to the positions of the grams of the license templates.  A
hit votes for the diagonal (place in the document minus place in the template).
Diagonals less than GAP apart are merged, which bridges inserted and dropped
words, and the spans that they cover are verified: the grams' words must be
equal, not only their hashes, the share of the template's grams that were found
must reach SHARE, and a span may not be longer than STRETCH times its template.

The template table has a fixed size and is small (its rows are counted before
it is broadcast; beyond BROADCAST_ROWS the join is left to the optimizer).  Only
hits are shuffled.

Beside the templates, the three base phrases are found wherever their words
stand consecutively.

Nulls, ties and odd input: a null text is empty and has no words; a null doc_id
is kept; repeated rows get equal results; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
GAP = 3
SHARE = 0.6
STRETCH = 2
BROADCAST_ROWS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, opening words of well-known license texts and notices
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "Copyright, all rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, BREAKS), "")


def _gram_at(ws: Column, i: Column) -> list[Column]:
    return [F.get(ws, i + j) for j in range(K)]


def _stands_at(parts: list[str]):
    def here(i: Column) -> Column:
        # the last word is compared first: most places fail there
        test = F.lit(True)
        for j in reversed(range(len(parts))):
            test = test & (F.get("ws", i + j) == F.lit(parts[j]))
        return F.coalesce(test, F.lit(False))

    return here


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """hash, its words, template, label, tpos, t_grams, t_words: one row per gram of a template."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("ws", words(F.col("text"))).withColumn("t_words", F.size("ws")).where(F.col("t_words") >= K)
    rows = rows.select("template", "label", "t_words", (F.col("t_words") - K + 1).alias("t_grams"), "ws", F.explode(F.sequence(F.lit(0), F.col("t_words") - K)).alias("tpos"))
    return rows.select(F.xxhash64(*_gram_at(F.col("ws"), F.col("tpos"))).alias("hash"), F.slice("ws", F.col("tpos") + 1, K).alias("gram"), "template", "label", "tpos", "t_grams", "t_words")


def find_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Spans of template text: doc_id, text_key, template, label, first_word,
    last_word (inclusive), found (distinct template grams), share, verified."""
    spark = docs.sparkSession
    known = template_grams(spark, templates)
    if sum(len(t.split()) for _, t in templates) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    ws = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("ws")).where(F.size("ws") >= K)
    hashes = F.transform(F.sequence(F.lit(0), F.size("ws") - K), lambda i: F.xxhash64(*_gram_at(F.col("ws"), i)))
    grams = ws.select("doc_id", "text_key", "ws", F.posexplode(hashes).alias("pos", "hash"))
    hits = grams.join(known, "hash").where(F.slice("ws", F.col("pos") + 1, K) == F.col("gram"))
    votes = (
        hits.groupBy("doc_id", "text_key", "template", "label", "t_grams", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("tposes"), F.min("pos").alias("first_word"), (F.max("pos") + K - 1).alias("last_word"))
    )
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= GAP, 0).otherwise(1)
    islands = votes.withColumn("apart", apart).withColumn("island", F.sum("apart").over(along))
    spans = islands.groupBy("doc_id", "text_key", "template", "label", "t_grams", "t_words", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("found"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")
    )
    spans = spans.withColumn("share", F.col("found") / F.col("t_grams"))
    fits = (F.col("share") >= SHARE) & (F.col("last_word") - F.col("first_word") + 1 <= STRETCH * F.col("t_words"))
    return spans.select("doc_id", "text_key", "template", "label", "first_word", "last_word", "found", "share", fits.alias("verified"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (1 with a base phrase, else the largest verified share)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # places are looked for only in texts that hold the phrase's last word at all
    ws = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("ws"))
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        some = F.array_contains("ws", parts[-1]) & F.array_contains("ws", parts[0])
        places = F.when(some, F.filter(F.sequence(F.lit(0), F.size("ws") - 1), _stands_at(parts))).otherwise(F.array().cast("array<int>"))
        found.append((label, places))
    base = ws.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"), *[p.alias(f"at_{label}") for label, p in found])
    places = F.concat(*[F.col(f"at_{label}") for label, _ in found])
    labels = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in found]), lambda x: x.isNotNull())
    base = base.select(
        "doc_id", "text_key", "n_words",
        F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
    )
    spans = find_spans(docs, templates).where("verified")
    own = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    joined = base.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
    phrase = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(p.split())) + f" THEN '{label}'" for p, label in PHRASES
    ) + " END"
    split = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH w AS (SELECT doc_id, {split.format('text')} AS words FROM documents),
tw AS (SELECT template, label, {split.format('text')} AS tws FROM (VALUES {quoted}) AS t(template, label, text)),
tg AS (SELECT template, label, len(tws) AS t_words, len(tws) - {K - 1} AS t_grams, p - 1 AS tpos, array_to_string(tws[p : p + {K - 1}], ' ') AS gram
  FROM tw, unnest(range(1, len(tws) - {K - 2})) AS u(p)),
places AS (SELECT doc_id, i - 1 AS pos, {phrase} AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE {phrase} IS NOT NULL),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(words[i : i + {K - 1}], ' ') AS gram FROM w, unnest(range(1, len(words) - {K - 2})) AS u(i)),
hits AS (SELECT doc_id, template, label, t_words, t_grams, tpos, pos, pos - tpos AS diagonal FROM g JOIN tg USING (gram)),
votes AS (SELECT doc_id, template, diagonal FROM hits GROUP BY ALL),
islands AS (SELECT doc_id, template, diagonal, sum(CASE WHEN diagonal - prev <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS prev FROM votes)),
spans AS (SELECT doc_id, template, label, count(DISTINCT tpos) / t_grams::DOUBLE AS share
  FROM hits JOIN islands USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, t_words, t_grams, island
  HAVING count(DISTINCT tpos) >= {SHARE} * t_grams AND max(pos) + {K} - min(pos) <= {STRETCH} * t_words),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM spans) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
