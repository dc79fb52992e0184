r"""License scans: an exact set-similarity join of text blocks with notice templates.

Words are runs of ASCII letters, digits and all characters beyond ASCII, after A-Z became a-z. A block is a line of a
text, or a window of consecutive words over any lines, as its set of words; it holds a template when it has at least
THRESHOLD of the template's distinct words. A template's windows have its number of words divided by THRESHOLD, and slide
by one word, so notices are found however their lines are wrapped. Only texts that hold a template as a whole have windows
or lines looked at. Words of templates are ordered by how often all documents have them, rarest first, and a block's words
that any template has are taken in that order. A block that reaches the threshold of a template T must hold one of the first
|T| - ceil(THRESHOLD |T|) + 1 words of T (prefix filter), have ceil(THRESHOLD |T|) such words (length filter), and, from the
first word that both prefix and block hold, have that many left in the template and in the block (positional filter); what
is left is verified, so none is missed.

Beside blocks, the places of fixed phrases are counted: their words one after the other, whatever stands between.

Null and empty texts have no words. Rows are independent: null ids and repeated rows keep their own results, ties between
templates give all their labels. Texts are read whole, other columns not at all, whatever their names. Empty tables give
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as licenses and their guides word them, one to a label or more.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "replace").lower())


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often all documents have each word of the templates: a row for each of those at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in common.small_batches(batches, "text"):
            for t in batch.column("text").to_pylist():
                if t:
                    total.update(filter(vocabulary.__contains__, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


class Index:
    """Templates by the words of their prefixes; words are numbered in the global order."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float):
        words = [words_of(text) for _, text in templates]
        order = sorted({w for ws in words for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(ws) for ws in words]
        self.least = [ceil(threshold * len(t) - 1e-9) for t in self.sets]
        self.width = [ceil(len(ws) / threshold) for ws in words]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.sets):
            for at, w in enumerate(sorted(self.rank[w] for w in t)[: len(t) - self.least[k] + 1]):
                self.prefix.setdefault(w, []).append((k, at))

    def search(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """Numbers and containments of the templates that a block holds."""
        known = sorted(self.rank[w] for w in block & self.rank.keys())
        met = set()  # a template is judged where its prefix first meets the block
        for j, w in enumerate(known):
            for k, at in self.prefix.get(w, ()):
                size, least = len(self.sets[k]), self.least[k]
                if k in met:
                    continue
                met.add(k)
                if len(known) < least or min(size - at, len(known) - j) < least:
                    continue
                common_words = len(self.sets[k] & block)
                if common_words >= least:
                    yield k, common_words / size

    def windows(self, k: int, words: list[bytes]) -> tuple[float, list[tuple[int, int]]]:
        """The greatest containment of a template in a window, and the places of windows that hold it, none over another."""
        wanted, width, least = self.sets[k], self.width[k], self.least[k]
        hits = [(at, w) for at, w in enumerate(words) if w in wanted]
        most, found = 0, []
        for apart in (False, True):  # all windows, then those that begin after the last one found
            inside, counts = deque(), {}
            for at, w in hits:
                while inside and inside[0][0] <= at - width:
                    old = inside.popleft()[1]
                    counts[old] -= 1
                    if not counts[old]:
                        del counts[old]
                inside.append((at, w))
                counts[w] = counts.get(w, 0) + 1
                if not apart:
                    most = max(most, len(counts))
                elif len(counts) >= least:
                    found.append((inside[0][0], at + 1))
                    inside.clear()
                    counts.clear()
            if most < least:
                break
        return most / len(wanted), found


def separate(spans: list[tuple[int, int]]) -> int:
    """How many of the spans can be taken so that none overlaps another."""
    n = upto = 0
    for a, b in sorted(spans, key=lambda x: x[1]):
        if a >= upto:
            n, upto = n + 1, b
    return n


def places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> Iterator[tuple[int, str]]:
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    yield at, label
        except ValueError:
            pass


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks of every document.

    score is 1 where a phrase stands, else the greatest containment of a template in a block, 0 if none reaches the
    threshold. n_blocks counts the lines that hold a template, and the windows that do and overlap neither such a line nor
    each other.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))
    index = Index(templates, word_counts(docs, vocabulary), threshold)
    fixed = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def one(t: str) -> tuple:
        words = words_of(t)
        distinct = set(words)
        found = [x for x in places(words, [p for p in fixed if p[0][0] in distinct])]
        base, more, score, blocks = {x for _, x in found}, set(), float(bool(found)), 0
        if whole := [k for k, _ in index.search(distinct)]:
            start, full = 0, []  # lines that hold a template, as places of words
            for line in t.split("\n"):
                here = words_of(line)
                held = list(index.search(set(here)))
                full += [(start, start + len(here))] if held else []
                start += len(here)
                for k, share in held:
                    more.add(index.labels[k])
                    score = max(score, share)
            spans = []
            for k in whole:
                share, at = index.windows(k, words)
                if at:
                    more.add(index.labels[k])
                    score = max(score, share)
                    spans += at
            ends = [b for _, b in full]
            over = lambda a, b: (i := bisect_right(ends, a)) < len(full) and full[i][0] < b
            blocks = len(full) + separate([x for x in spans if not over(*x)])
        at = [k for k, _ in found]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            rows = [one(t or "") for t in batch.column("text").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds[1:]))], names)

    return docs.mapInArrow(run, schema)
