"""Licence scans: base phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a line, or a line and up to SPAN - 1 following ones if all of them are short, as hard-wrapped text is;
a template is the set of words of a notice. A block meets a template when it holds at least THRESHOLD of the
template's words. Template words are ordered by their document-block frequency over the whole corpus, rarest
first. A block can only meet a template of n words, of which it needs t, if it holds one of the template's first
n - t + 1 words (prefix filter), has t template words at all (length filter), and enough are left from the first
common word on (positional filter). Candidates are verified. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.shared import stored

THRESHOLD = 0.8
SPAN = 4  # lines that a wrapped notice may take
WRAP = 120  # characters of a short line at most

# The phrases whose places are counted, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Usual sentences of licence notices, with their labels.
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the Apache License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "All rights reserved"),
)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """Lower case that is right for words of ASCII letters: the Kelvin sign must not become a k."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("κ")))


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _spaces(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" ")))


def _with_base(rows: DataFrame) -> DataFrame:
    """rows(..., lowered, n_words) with n_base, first_word, last_word and base_labels (an array) in place of lowered."""
    may = (F.contains("lowered", F.lit("license")) & (F.contains("lowered", F.lit("mit")) | F.contains("lowered", F.lit("apache")))) | (F.contains("lowered", F.lit("cc")) & F.rlike("lowered", F.lit(f"cc{_GAP}by{_GAP}nc")))
    norm = F.when(may, F.concat(F.lit(" "), F.trim(F.regexp_replace("lowered", _GAP, " ")), F.lit(" "))).otherwise("")
    kept = [c for c in rows.columns if c != "lowered"]
    # Each step is a column of its own, so that it is worked out once.
    split = rows.select(*kept, norm.alias("norm")).select(*kept, *(F.split("norm", f"(?<= ){phrase}(?= )").alias(f"p{k}") for k, (phrase, _) in enumerate(PHRASES)))
    counts, firsts, lasts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(PHRASES):
        n = (F.size(f"p{k}") - 1).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.element_at(f"p{k}", 1)) - 1))
        lasts.append(F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(f"p{k}", -1)) - 1) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return split.select(*kept, total.alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base_labels"))


def _blocks(docs: DataFrame, key: list[str], text_col: str, vocabulary: list[str]) -> DataFrame:
    """Rows (key, block, words): the template words of each line, and of the short lines that follow a short one."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    line = F.transform(F.split(text_col, "\n"), lambda x: F.struct((F.length(x) <= WRAP).alias("short"), F.array_intersect(F.split(_lowered(x), _GAP), known).alias("words")))
    lines = docs.select(*key, line.alias("lines"))

    def joined(x: Column, i: Column) -> Column:
        words, short = [x["words"]], x["short"]
        for k in range(1, SPAN):
            following = F.get("lines", i + k)
            short = short & F.coalesce(following["short"], F.lit(False))
            words.append(F.when(short, following["words"]).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.concat(*words))

    return lines.select(*key, F.posexplode(F.transform("lines", joined)).alias("block", "words")).where(F.size("words") > 0)


def template_matches(docs: DataFrame, key: list[str], text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, block, label, containment): every block of every row that meets a template, by its first line."""
    sets = [(label, sorted(set(_words(text)))) for label, text in templates]
    needs = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})
    blocks = stored(_blocks(docs, key, text_col, vocabulary), "blocks")
    # One row per template word: a bounded table.
    frequency = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefixes, rows = set(), []
    for t, ((label, words), need) in enumerate(zip(sets, needs, strict=True)):
        ordered = sorted(words, key=rank.get)
        for i, w in enumerate(ordered[: len(ordered) - need + 1]):
            prefixes.add(w)
            rows.append((w, t, label, i, len(ordered), need, ordered))
    table = docs.sparkSession.createDataFrame(rows, "word string, template int, label string, i int, n int, need int, template_words array<string>")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    candidates = blocks.where((F.size("words") >= min(needs)) & F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(prefixes)])))
    ordered = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))), lambda s: s["word"])
    placed = candidates.select(*key, "block", ordered.alias("words")).select(*key, "block", "words", F.posexplode("words").alias("j", "word"))
    # The table has as many rows as the templates have prefix words.
    pairs = placed.join(F.broadcast(table), "word")
    enough = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.size("words") - F.col("j")) >= F.col("need")
    pairs = pairs.where((F.size("words") >= F.col("need")) & enough)
    common = F.size(F.array_intersect("words", "template_words"))
    return pairs.where(common >= F.col("need")).select(*key, "block", "label", (common / F.col("n")).alias("containment")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the greatest containment of a template in a block, 1 where a base phrase stands, else 0.
    Null and empty texts have no words, no labels and score 0. Repeated rows are reported each, with equal
    labels; a null id is kept; other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    matches = template_matches(rows, ["id", "hash"])
    by_row = matches.groupBy(F.col("id").alias("m_id"), F.col("hash").alias("m_hash")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = rows.select("id", "hash", _lowered(F.col("text")).alias("lowered"), F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"))
    base = _with_base(base)
    out = base.join(by_row, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
