"""License scan: stated phrases, and an exact containment join with license notices.

A text block is two strides of words, taken at every stride, so that any stretch of one
stride lies inside a block; a notice is compared with blocks whose stride is the power of two
not below its length. A block matches if it holds at least the share ``CONTAINED`` of the
notice's distinct words. The join that finds all such blocks is a prefix-filtered set join:

* the notices' words are ordered by the number of documents they occur in, rarest first;
* a match must hold one of a notice's first ``size - need + 1`` words (prefix), so only blocks
  around such words are built, and only these words are joined, with an index of a few rows
  per notice;
* a block needs ``need`` words that occur in notices at all (length), and from the first common
  word on both sides must still have ``need`` words (position);
* what is left is counted exactly.

Words that are in no notice never matter for a containment, so a block holds only the others.

Null texts count as empty: no words, no labels. A null doc_id is kept, repeated rows give
repeated results, extra columns are ignored, an empty table gives no rows. A long text is one
row of words; its blocks are rows of their own in the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written
from .common import BROADCAST_ROWS, bound, whole_text

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Beginnings of the notices of public licenses, with labels.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Share of a notice's distinct words that a block must hold, in percent.
CONTAINED = 80

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case. ``lower`` also changes other letters, but turns only the two
    named here into ASCII ones, so the words of the notices and the breaks come out the same."""
    other = text.contains("\u0130") | text.contains("\u212A")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words in order. Breaks are maximal, so only the first and the last piece can be empty."""
    def inner(s: Column) -> Column:
        n = F.size(s)
        ahead = F.when(F.get(s, F.lit(0)) == "", 1).otherwise(0)
        behind = F.when((n > 1) & (F.get(s, n - 1) == ""), 1).otherwise(0)
        return F.slice(s, ahead + 1, n - ahead - behind)

    return bound(F.split(lowered(text), BREAKS, -1), inner)


class Notice:
    """A template: its label, distinct words in the order of the text, stride, and the words needed."""

    def __init__(self, label: str, text: str, contained: int = CONTAINED):
        self.label = label
        words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
        self.words = list(dict.fromkeys(words))
        self.stride = 1 << max(0, math.ceil(math.log2(max(1, len(words)))))
        self.need = max(1, -(-len(self.words) * contained // 100))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("CAST(array() AS array<string>)")


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents each word occurs in, rarest first."""
    held = F.array_intersect(strings(vocabulary), F.split(lowered(whole_text()), BREAKS, -1))
    counts = dict(map(tuple, docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()))  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def places(words: Column, phrases: dict[str, str]) -> Column:
    """(place, label) of every phrase, by place."""
    def of_phrase(phrase: str, label: str) -> Column:
        parts = phrase.split()
        last = F.transform(words, lambda w, i: F.when(w == parts[-1], i - (len(parts) - 1)))
        starts = F.filter(last, lambda i: i >= 0)
        here = lambda i: F.forall(F.array(*[F.get(words, i + k) == p for k, p in enumerate(parts[:-1])]), lambda x: x)
        return F.transform(F.filter(starts, here) if parts[:-1] else starts, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))

    return F.sort_array(F.concat(*[of_phrase(p, label) for p, label in phrases.items()]))


def blocks_around(words: Column, prefixes: dict[int, list[str]], order: list[str]) -> Column:
    """(stride, block, held) of the blocks that hold a prefix word of a notice of that stride; ``held``
    are the block's words that are in notices, in the global order."""
    def of_stride(stride: int, rare: list[str]) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.floor(i / stride).cast("int"))), lambda b: b.isNotNull())
        numbers = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda b: F.array(b - 1, b)))), lambda b: b >= 0)
        held = lambda b: F.array_intersect(strings(order), F.slice(words, b * stride + 1, F.lit(2 * stride)))
        return F.transform(numbers, lambda b: F.struct(F.lit(stride).alias("stride"), b.alias("block"), held(b).alias("held")))

    return F.concat(*[of_stride(s, p) for s, p in sorted(prefixes.items())])


def prefixes_of(notices: list[Notice], rank: dict[str, int]) -> list[tuple[Notice, list[str], list[str]]]:
    """Each notice with its words in the global order and those of its prefix."""
    ordered = [(n, sorted(n.words, key=rank.get)) for n in notices if n.words]
    return [(n, words, words[:len(words) - n.need + 1]) for n, words in ordered]


def scanned(docs: DataFrame, notices: list[Notice], phrases: dict[str, str]) -> tuple[DataFrame, list]:
    """A written table with a row per document: key, doc_id, n_words, the phrases' places, and the blocks
    that may match; and the notices with their prefixes."""
    vocabulary = sorted({w for n in notices for w in n.words})
    order = global_order(docs, vocabulary)
    known = prefixes_of(notices, {w: i for i, w in enumerate(order)})
    by_stride: dict[int, list[str]] = {}
    for n, _, prefix in known:
        by_stride[n.stride] = sorted({*by_stride.get(n.stride, []), *prefix})
    none_b = F.expr("CAST(array() AS array<struct<stride:int,block:int,held:array<string>>>)")
    none_p = F.expr("CAST(array() AS array<struct<place:bigint,label:string>>)")
    ends = sorted({p.split()[-1] for p in phrases})
    rare = sorted({w for ws in by_stride.values() for w in ws})
    some = lambda words, ws: F.arrays_overlap(words, strings(ws))
    row = bound(words_of(whole_text()), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.when(some(w, ends), places(w, phrases)).otherwise(none_p) if phrases else none_p).alias("places"),
        (F.when(some(w, rare), blocks_around(w, by_stride, order)).otherwise(none_b) if rare else none_b).alias("blocks")))
    out = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("r"))
    return written(out.select("key", "doc_id", "r.*"), "license-blocks"), known


def block_matches(scan: DataFrame, known: list) -> DataFrame:
    """key, label, notice, first and last word of the block, and its containment, for every block of every
    document that holds enough of a notice. Each (block, notice) comes once, by its first common word."""
    index = [(n.stride, w, i, k, n.label, len(words), n.need, prefix, words)
             for k, (n, words, prefix) in enumerate(known) for i, w in enumerate(prefix)]
    schema = "stride int, word string, i int, notice int, label string, size int, need int, prefix array<string>, words array<string>"
    # a row per prefix word of a notice: the notices are a parameter, their prefixes a few words each
    templates = F.broadcast(scan.sparkSession.createDataFrame(index, schema))
    blocks = scan.filter(F.size("blocks") > 0).select("key", F.inline("blocks"))
    needed = min((n.need for n, _, _ in known), default=1)
    words = blocks.filter(F.size("held") >= needed).select("key", "stride", "block", "held", F.posexplode("held").alias("j", "word"))
    pairs = words.join(templates, ["stride", "word"])
    enough = F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need")
    first = F.get(F.array_intersect("held", "prefix"), F.lit(0)) == F.col("word")
    common = F.size(F.array_intersect("held", "words"))
    found = pairs.filter(enough).filter(first).withColumn("common", common).filter("common >= need")
    return found.select("key", "label", "notice", (F.col("block") * F.col("stride")).cast("long").alias("first"),
                        ((F.col("block") + 2) * F.col("stride") - 1).cast("long").alias("last"), (F.col("common") / F.col("size")).alias("containment"))


def notices_of(contained: int = CONTAINED, notices=NOTICES) -> list[Notice]:
    return [Notice(label, text, contained) for label, text in notices]


def matches(docs: DataFrame, contained: int = CONTAINED, notices=NOTICES) -> DataFrame:
    """doc_id, label, notice (its number), first and last word of the block, containment."""
    scan, known = scanned(docs, notices_of(contained, notices), PHRASES)
    found = block_matches(scan, known)
    return found.join(scan.select("key", "doc_id"), "key").select("doc_id", "label", "notice", "first", "last", "containment")


def licenses(docs: DataFrame, contained: int = CONTAINED, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 where a phrase stands, else
    the highest containment of a matching block, else 0."""
    scan, known = scanned(docs, notices_of(contained, notices), phrases)
    found = block_matches(scan, known).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    found = written(found, "license-labels")  # a row per document with a matching block
    few = found.count() <= BROADCAST_ROWS
    joined = scan.drop("blocks").join(F.broadcast(found) if few else found, "key", "left")  # keys are unique on both sides
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    both = F.array_sort(F.array_union(base, F.coalesce("more", F.expr("CAST(array() AS array<string>)"))))
    n = F.size("places")
    return joined.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.get("places", F.lit(0))["place"].alias("first_word"),
        F.get("places", n - 1)["place"].alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
