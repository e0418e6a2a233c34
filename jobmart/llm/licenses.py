"""License statements in texts: phrases that stand word for word, and statement templates that
a text block contains by an exact set-similarity join. All of it is DataFrame expressions.

A block is a run of as many words as a template has, wherever it starts and over line ends. The
tokens of the templates are ordered by the number of texts that hold them, rarest first. A
block can only hold ``CONTAINMENT`` of a template if it holds one of the template's prefix tokens,
the ``size - need + 1`` rarest; places are joined to templates on these alone. Around such a place
there must be enough tokens at all (length filter), and enough of them after the prefix token in
the order (positional filter: the rarest token that both have is one of the places joined). What
is left is confirmed by counting in each block that covers the place. No pair above the threshold
is lost. A block gets the label if it also holds the words that tell this license from its
relatives, and none of theirs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.llm.common import folded, materialize

CONTAINMENT = 0.8
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Statements by which texts declare a license, and the label of each.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("mit-statement", "Released under the MIT License."),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without"
     " modification, are permitted provided that the following conditions are met"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of"
     " this software and associated documentation files"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain"
     " a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the"
     " terms of the GNU General Public License as published by the Free Software Foundation;"
     " either version 2 of the License"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the"
     " terms of the GNU General Public License as published by the Free Software Foundation,"
     " either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with"
     " or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: For each label the words that a block must hold, and those that it must not.
DECIDING = {
    "apache-2.0": ("apache 2", ""),
    "gpl-2.0": ("gnu general public 2", "lesser affero"),
    "gpl-3.0": ("gnu general public 3", "lesser affero"),
    "lgpl": ("lesser general public", ""),
    "cc-by-4.0": ("cc by 4", "nc nd sa"),
    "cc-by-nc-4.0": ("cc by nc 4", "nd sa"),
    "cc-by-sa-4.0": ("cc by sa 4", "nc nd"),
    "mit-statement": ("mit", ""),
    "mpl-2.0": ("mozilla 2", ""),
    "bsd-3-clause": ("redistribution binary", ""),
    "mit-notice": ("granted obtaining software", ""),
    "isc": ("granted fee software", ""),
    "unlicense": ("unencumbered", ""),
}


def template_tokens(text: str) -> list[str]:
    """Distinct words of a template, in their order."""
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def statements() -> list[tuple[str, int, list[str], list[str], list[str]]]:
    """Label, words of a block, distinct words, words to hold, words not to hold, by template."""
    return [
        (label, len(re.findall(r"[0-9a-z]+", text.lower())), template_tokens(text),
         *(part.split() for part in DECIDING[label]))
        for label, text in TEMPLATES
    ]


def least_shared(tokens: list[str]) -> int:
    return math.ceil(CONTAINMENT * len(tokens) - 1e-9)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SEPARATORS}]+"), F.lit(0))


def _phrase_starts(phrase: str) -> Column:
    """Places, counted from 0, where the words of ``phrase`` stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.get("_words", i + k) == part)
        return same

    last = F.size("_words") - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(
        F.array().cast("array<int>")
    )


def phrases_found(docs: DataFrame) -> DataFrame:
    """Adds to ``_low`` (folded text) the columns n_words, n_base, first_word, last_word and
    ``_base``, the labels found. Only texts that can hold a phrase are looked at word by word."""
    may = F.col("_low").contains("license") | F.col("_low").rlike(f"cc[{SEPARATORS}]+by")
    all_words = docs.withColumn("_all", words(F.col("_low")))
    some = all_words.withColumn("_words", F.when(may, F.col("_all"))).withColumn(
        "n_words", F.size("_all").cast("long")
    )
    for i, phrase in enumerate(PHRASES):
        some = some.withColumn(
            f"_at{i}", F.when(F.col("_words").isNotNull(), _phrase_starts(phrase))
        )
    ats = [F.col(f"_at{i}") for i in range(len(PHRASES))]
    none = F.array().cast("array<int>")
    places = F.concat(*[F.coalesce(a, none) for a in ats])
    labels = F.array(
        *[F.when(F.size(a) > 0, F.lit(x)) for a, x in zip(ats, PHRASES.values(), strict=True)]
    )
    return (
        some.withColumn("_places", places)
        .withColumn("n_base", F.size("_places").cast("long"))
        .withColumn("first_word", F.array_min("_places").cast("long"))
        .withColumn("last_word", F.array_max("_places").cast("long"))
        .withColumn("_base", F.array_sort(F.array_compact(labels)))
        .drop("_all", "_words", "_places", *[f"_at{i}" for i in range(len(PHRASES))])
    )


def token_order(docs: DataFrame) -> list[str]:
    """Words of templates and deciding words, rarest in the corpus first (by texts that hold
    them, then by name)."""
    vocabulary = sorted({w for s in statements() for part in s[2:] for w in part})
    among = F.array(*map(F.lit, vocabulary))
    counts = (
        docs.select(F.explode(F.array_intersect(words(F.col("_low")), among)).alias("token"))
        .groupBy("token")
        .count()
    )
    found = {r["token"]: r["count"] for r in counts.collect()}  # one row per template token
    return sorted(vocabulary, key=lambda t: (found.get(t, 0), t))


def hits(low: Column, order: list[str]) -> Column:
    """Places of the words in ``order``, each with the word's number there, from 1. Null for texts
    that lack a word to hold of every template."""
    may = F.lit(False)
    for _, _, _, must, _ in statements():
        held = F.lit(True)
        for word in must:
            held = held & low.contains(word)
        may = may | held
    places = F.transform(words(low), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    ours = F.filter(places, lambda x: x["word"].isin(order))
    numbers = F.array(*map(F.lit, order))
    ranked = F.transform(
        ours,
        lambda x: F.struct(
            x["at"].alias("at"), F.array_position(numbers, x["word"]).cast("int").alias("rank")
        ),
    )
    return F.when(may, ranked)


def matched_blocks(texts: DataFrame, order: list[str]) -> DataFrame:
    """(key, label, containment) of the templates that a block of the text holds to
    ``CONTAINMENT`` at least, with the label's deciding words. ``texts`` has key and ``hits``."""
    spark = texts.sparkSession
    rank = {t: i + 1 for i, t in enumerate(order)}
    rows, longest = [], 0
    for label, length, tokens, must, never in statements():
        ranks = sorted(rank[t] for t in tokens)
        need = least_shared(tokens)
        longest = max(longest, length)
        others = [rank[t] for t in must], [rank[t] for t in never]
        for token in ranks[: len(ranks) - need + 1]:
            rows.append((token, label, length, need, ranks, *others))
    prefixes = spark.createDataFrame(
        rows, "token int, label string, length int, need int, template array<int>,"
        " must array<int>, never array<int>",
    )
    rare = sorted({r[0] for r in rows})
    all_hits = F.col("hits")

    def around(h: Column, i: Column) -> Column:
        first = F.greatest(i - (longest - 2), F.lit(1))
        near = F.slice(all_hits, first, F.lit(2 * longest - 1))
        return F.when(h["rank"].isin(rare), F.struct(h["at"].alias("at"), h["rank"].alias("token"),
                                                     near.alias("near")))

    probes = texts.select(
        "key", F.explode(F.array_compact(F.transform(all_hits, around))).alias("p")
    ).select("key", "p.*")
    at, length, need = F.col("at"), F.col("length"), F.col("need")
    reach = F.filter("near", lambda g: F.abs(g["at"] - at) < length)
    candidates = (
        probes.join(F.broadcast(prefixes), "token")  # a few rows for each fixed template
        .withColumn("near", reach)
        .where(F.size("near") >= need)
        .where(F.size(F.filter("near", lambda g: g["rank"] > F.col("token"))) + 1 >= need)
    )

    def shared(start: Column) -> Column:
        run = F.filter(
            "near", lambda g: (g["at"] >= start["at"]) & (g["at"] < start["at"] + length)
        )["rank"]
        held = F.size(F.array_intersect(run, F.col("template")))
        decided = F.size(F.array_except("must", run)) == 0
        decided = decided & ~F.arrays_overlap(run, F.col("never"))
        return F.when(decided & (held >= need), held).otherwise(0)

    starts = F.filter("near", lambda g: g["at"] <= at)
    return (
        candidates.withColumn("most", F.array_max(F.transform(starts, shared)))
        .where(F.col("most") >= need)
        .select("key", "label", (F.col("most") / F.size("template")).alias("containment"))
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every
    row of ``docs`` (``doc_id``, ``text``; others are ignored).

    ``score`` is 1 where a phrase stands, else the greatest containment of a template, 0 if
    none reaches the threshold. A null or empty text has no words and no labels. Rows that
    repeat are judged alike, doc_id may be null, texts may be of any length, an empty table gives no
    rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(text).alias("_low"))
    order = token_order(texts)
    measured = materialize(
        phrases_found(texts)
        .withColumn("hits", hits(F.col("_low"), order))
        .withColumn("key", F.monotonically_increasing_id())
        .drop("_low"),
        "license-blocks",
    )
    by_doc = (
        matched_blocks(measured.select("key", "hits"), order)
        .groupBy(F.col("key").alias("_key"))
        .agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    )
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return measured.drop("hits").join(by_doc, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
