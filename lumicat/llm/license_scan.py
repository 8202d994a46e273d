"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block (up to ``LINES`` lines of a document that follow one another, from each line on, so that a
notice meets its template however it is wrapped) meets a template if it contains at least ``threshold`` of the
template's distinct words. Tokens are put in one global order, rarest first, by their counts over
all blocks. Of a block and a template that share at least ``need`` tokens, the first
``size - need + 1`` tokens of each share one (prefix filter), the block has at least ``need``
tokens (length filter), and what can still follow the first shared token is enough (positional
filter). Survivors are verified exactly, so no block that meets the threshold is lost.

Tokens in no template cannot add to an overlap, so blocks are first cut down to the templates'
vocabulary, which is fixed and small; only it and the templates are ever broadcast.

Defined results: null text is empty: no words, no labels, score 0. Repeated rows each get their
row. Columns beside doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.common import lowered, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
LINES = 8

#: The phrases that give base labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Notices of public licenses, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_tokens(text: str) -> list[str]:
    import re

    return sorted(set(re.findall(WORD, text.lower())))


def needed(size: int, threshold: float) -> int:
    """Smallest overlap that meets the containment threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def _phrase_starts(words: Column, n: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.get(words, i + k) == p for k, p in enumerate(parts)))

    return F.filter(F.sequence(F.lit(0), n - len(parts)), here)


def scan_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, lines: int = LINES) -> DataFrame:
    """One row per document: word counts, phrase places, and the blocks that pass the length filter."""
    vocabulary = sorted({t for _, text in templates for t in template_tokens(text)})
    least = min(needed(len(template_tokens(text)), threshold) for _, text in templates)
    known = F.array(*map(F.lit, vocabulary))
    empty = F.array().cast("array<int>")
    d = docs.select("doc_id", F.col("text").alias("raw")).select(
        "doc_id",
        F.xxhash64("raw").alias("text_key"),
        F.transform(F.split(lowered(F.col("raw")), "\n"), lambda b: F.regexp_extract_all(b, F.lit(WORD), F.lit(0))).alias("lines"),
    )
    d = d.select(
        "doc_id", "text_key",
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_words"),
        # only texts with the longest word of a phrase can have a phrase
        F.when(F.exists("lines", lambda x: F.arrays_overlap(x, F.array(*map(F.lit, sorted({max(p.split(), key=len) for p, _ in phrases}))))), F.flatten("lines")).alias("words"),
        F.transform("lines", lambda x: F.array_intersect(x, known)).alias("kept"),
    )
    d = d.select(
        "doc_id", "text_key", "n_words", "words",
        F.filter(
            F.transform("kept", lambda x, i: F.struct(i.alias("block"), F.array_distinct(F.flatten(F.slice("kept", i + 1, lines))).alias("tokens"))),
            lambda b: F.size(b["tokens"]) >= least,
        ).alias("blocks"),
    )
    n = F.size("words")
    for k, (phrase, _) in enumerate(phrases):
        width = len(phrase.split())
        d = d.withColumn(f"at_{k}", F.when(n >= width, _phrase_starts(F.col("words"), n, phrase)).otherwise(empty))
    places = F.concat(*(F.col(f"at_{k}") for k in range(len(phrases))))
    labels = F.concat(*(F.when(F.size(f"at_{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(phrases)))
    return d.select(
        "doc_id", "text_key", "n_words", "blocks",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def similarity_join(scanned: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, block, template, label, containment) of every block that meets a template."""
    spark = scanned.sparkSession
    blocks = scanned.select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.block", "b.tokens")
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    # at most one row for each word of the templates
    counts = {r["token"]: r["count"] for r in counted.collect()}
    sets = [(k, label, sorted(template_tokens(text), key=lambda t: (counts.get(t, 0), t))) for k, (label, text) in enumerate(templates)]
    ranks = {t: i for i, t in enumerate(sorted({t for _, _, s in sets for t in s}, key=lambda t: (counts.get(t, 0), t)))}
    least = min(needed(len(s), threshold) for _, _, s in sets)

    ranked = F.create_map(*(x for t, i in ranks.items() for x in (F.lit(t), F.lit(i))))
    prefix_rows = ", ".join(
        f"({ranks[t]}, {k}, {_quoted(label)}, {i}, {len(s)}, {needed(len(s), threshold)}, array({', '.join(str(ranks[x]) for x in s)}))"
        for k, label, s in sets for i, t in enumerate(s[: len(s) - needed(len(s), threshold) + 1])
    )
    index = spark.sql(f"SELECT * FROM VALUES {prefix_rows} AS t(rank, template, label, i, size_t, need, ranks_t)")
    ordered = blocks.select("doc_id", "text_key", "block", F.array_sort(F.transform("tokens", lambda t: ranked[t])).alias("ranks"))
    prefixes = ordered.select(
        "doc_id", "text_key", "block", "ranks", F.size("ranks").alias("size_b"),
        F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - least + 1)).alias("j", "rank"),
    )
    candidates = prefixes.join(F.broadcast(index), "rank").where(
        (F.col("size_b") >= F.col("need"))
        & (F.col("j") <= F.col("size_b") - F.col("need"))
        & (1 + F.least(F.col("size_t") - F.col("i") - 1, F.col("size_b") - F.col("j") - 1) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("ranks", "ranks_t"))
    return (
        candidates.select("doc_id", "text_key", "block", "template", "label", (shared / F.col("size_t")).alias("containment"), (shared >= F.col("need")).alias("met"))
        .where("met").drop("met").distinct()
    )


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Base columns of every document with the join's labels and its best containment as score."""
    scanned = materialise(scan_blocks(docs, templates, threshold, phrases), "license-blocks")
    found = (
        similarity_join(scanned, templates, threshold)
        .groupBy(F.col("doc_id").alias("m_doc"), F.col("text_key").alias("m_key"))
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    )
    joined = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_key") == F.col("m_key")), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
