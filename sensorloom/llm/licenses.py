"""License scan: phrases at word positions, and an exact set-similarity join of text blocks with templates.

A block is a line of a text, a template a license notice; both are sets of words. A block matches a template if it
holds at least ``percent`` of the template's words. Words that occur in no template cannot add to an overlap, so
blocks are reduced to template words, ordered from rare to frequent by the number of documents that hold them. For a
template of n words that needs an overlap of k, the first n - k + 1 words of the template and the first b - k + 1 of a
block of b words share a word whenever the overlap is reached (prefix filter); blocks of fewer than k words cannot
match (length filter); and at the first shared word what follows it on both sides must suffice (positional filter).
What remains is verified on the full sets. Nothing is dropped: the join finds every matching pair.

Null and empty texts have no words and no labels (empty strings, score 0). Repeated rows are scanned each; null ids stay null.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80

# Phrases and templates of license notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "proprietary": ("all rights reserved",),
}


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: frozenset[str]

    def needed(self, percent: int) -> int:
        return -(-percent * len(self.words) // 100)


def templates(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Template]:
    pairs = [(label, text) for label, many in texts.items() for text in many]
    return [Template(k, label, frozenset(text.split())) for k, (label, text) in enumerate(pairs)]


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after mapping A-Z to a-z, in order."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Positions (from 0) where the words of a phrase stand one after the other."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    at = lambda i: F.forall(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("w")) for k, p in enumerate(parts))), lambda x: F.get(words, i + x["k"]) == x["w"])
    found = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(words, i) == parts[0]) & at(i))
    return F.when((last >= 0) & F.forall(F.array(*map(F.lit, parts)), lambda p: F.array_contains(words, p)), found).otherwise(F.array().cast("array<int>"))


def rarity_order(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """Template words from rare to frequent by the number of documents that hold them (one row per word on the driver)."""
    words = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(words, words_of(docs[text_col]))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def block_matches(docs: DataFrame, known: list[Template], order: list[str], percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, block, template, label, containment) of every line that holds at least ``percent`` of a template's words."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for t in known:
        ordered, needed = sorted(t.words, key=rank.__getitem__), t.needed(percent)
        rows += [(w, t.number, t.label, k, len(ordered), needed, ordered) for k, w in enumerate(ordered[: len(ordered) - needed + 1])]
    prefix = docs.sparkSession.createDataFrame(rows, "word string, template int, label string, place int, n_words int, needed int, words array<string>")
    least = min(t.needed(percent) for t in known)
    ordered_words = F.array(*map(F.lit, order))
    starters = F.array(*map(F.lit, sorted({r[0] for r in rows})))
    text = docs[text_col]
    lines = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("block", "line"))
    # a line's template words from rare to frequent: the order of the first array stays
    held = lines.select("doc_id", "text_hash", "block", F.array_intersect(ordered_words, words_of(F.col("line"))).alias("held")).filter(F.size("held") >= least)
    starting = held.filter(F.arrays_overlap(F.slice("held", F.lit(1), F.size("held") - (least - 1)), starters))
    entries = starting.select("doc_id", "text_hash", "block", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - (least - 1))).alias("at", "word"))
    size = F.size("held")
    candidates = entries.join(F.broadcast(prefix), "word").filter(  # one row per word of the templates' prefixes
        (size >= F.col("needed"))
        & (F.col("at") <= size - F.col("needed"))
        & (F.least(size - F.col("at"), F.col("n_words") - F.col("place")) + F.least("at", "place") >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("held", "words"))
    verified = candidates.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("needed"))
    return verified.select("doc_id", "text_hash", "block", "template", "label", (F.col("overlap") / F.col("n_words")).alias("containment")).distinct()


def scan(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, phrase places, labels by phrase and by block, and the best containment."""
    known = templates()
    vocabulary = sorted(set().union(*(t.words for t in known)))
    order = rarity_order(docs, vocabulary, text_col)
    matches = block_matches(docs, known, order, percent, id_col, text_col)
    found = matches.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("block_labels"), F.max("containment").alias("containment"))
    text = docs[text_col]
    words = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(words_of(text), F.array().cast("array<string>")).alias("words"))
    spots = {label: places(F.col("words"), phrase) for phrase, label in PHRASES.items()}
    based = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.struct(*(c.alias(k) for k, c in spots.items())).alias("spots"))
    every = F.concat(*(F.col("spots")[k] for k in spots))
    labels = F.filter(F.array(*(F.when(F.size(F.col("spots")[k]) > 0, F.lit(k)) for k in spots)), lambda x: x.isNotNull())
    based = based.select(
        "doc_id", "text_hash", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
    )
    # a document is joined with its matches by id and content: rows that repeat an id with another text stay apart
    m = found.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "block_labels", "containment")
    joined = based.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    both = F.array_union("base", F.coalesce("block_labels", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
