"""Operator 3, license scans by an exact set-similarity join.

A text's blocks and the license templates are sets of words. Templates of up to 8 words are looked for in
blocks of 16 words, those of up to 32 in blocks of 64; blocks start every half block, so a passage as
long as a template lies within one, and words that are far apart never meet. A block matches a template
if it holds at least `containment` of the template's words, among them all that the template requires:
the words that tell licenses apart. Of the templates that match a block, one whose words are all in
another's says less and is left out.

All such pairs are found: words are ordered by their frequency over all texts, rarest first; of a
template with n words of which k must be held, the n - k + 1 rarest are its prefix, and a block that
holds k of its words holds one of these. Candidates by prefix are cut by length (a block needs k words)
and by position (what is left of both sets after the first common word must suffice), then counted
exactly.

The frequencies are those of the templates' words over all documents, summed in the tasks and then by
word; they and the templates, both bounded by the templates and not by the corpus, go along with the
task. So texts are neither shuffled nor broadcast, and every block is looked at where it lies.

Places where a base phrase's words stand consecutively are counted on the way, with their labels.

Defined cases: a null text counts as empty: no words, no label, score 0. Very long texts are scanned
whole, a block at a time. Words of equal frequency are ordered by code point; equal scores need no order.
The score is 1 with a base phrase, else the best containment of any label given. Repeated rows each get
a row. An empty table gives an empty result. Columns of docs may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
#: (words of a template at most, words of a block); blocks start every half block.
BLOCKS = ((8, 16), (32, 64))
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values: (label, notice as the license words it, words required of it).
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License", "affero"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "warranties conditions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "boost"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "redistributions disclaimer"),
    ("cc-by", "licensed under CC BY 4.0", "cc by"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0", "cc by nc nd"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "creative commons noncommercial noderivatives"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0", "cc by nc sa"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative commons noncommercial sharealike"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons noderivatives"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work under CC0", "cc0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted person"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "permission substantial portions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("reserved", "All rights reserved", "all rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages", "express warranty liable"),
)


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(LOWER))


@dataclass
class Template:
    label: str
    words: list[str]
    need: int
    required: frozenset[str]
    every: frozenset[str]


@dataclass
class Index:
    """Templates by prefix word, under one order of words."""

    rank: dict[str, int]
    templates: list[Template]
    by_prefix: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, templates: Iterable[tuple[str, str, str]], counts: dict[str, int], containment: float) -> Index:
        found = [(label, set(terms(text)), frozenset(terms(required))) for label, text, required in templates]
        order = sorted(set().union(*(words for _, words, _ in found)), key=lambda w: (counts.get(w, 0), w))
        index = cls({w: i for i, w in enumerate(order)}, [])
        for label, words, required in found:
            ranked = sorted(words, key=index.rank.__getitem__)
            need = max(1, -int(-len(ranked) * containment // 1))
            index.templates.append(Template(label, ranked, need, required, frozenset(words)))
            for at, word in enumerate(ranked[: len(ranked) - need + 1]):
                index.by_prefix.setdefault(word, []).append((len(index.templates) - 1, at))
        return index

    def match(self, block: set[str]) -> dict[str, float]:
        """Label and containment of the templates that the block matches, without those that say less than another."""
        held = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        out: list[tuple[Template, float]] = []
        tried: set[int] = set()
        for j, word in enumerate(held):
            for t, at in self.by_prefix.get(word, ()):
                template = self.templates[t]
                n = len(template.words)
                if t in tried or len(held) < template.need:
                    continue
                tried.add(t)
                if 1 + min(n - at - 1, len(held) - j - 1) < template.need or not template.required <= block:
                    continue
                common = sum(w in block for w in template.words)
                if common >= template.need:
                    out.append((template, common / n))
        best: dict[str, float] = {}
        for template, share in out:
            if not any(template.every < other.every for other, _ in out):
                best[template.label] = max(best.get(template.label, 0.0), share)
        return best


def blocks(words: list[str], known: Container[str], length: int) -> Iterator[set[str]]:
    """The known words of each block of so many words, for blocks that have any."""
    half = length // 2
    most = max(0, (len(words) - half - 1) // half)
    found: dict[int, set[str]] = {}
    for p, word in enumerate(words):
        if word in known:
            for j in range(max(0, p // half - 1), min(most, p // half) + 1):
                found.setdefault(j, set()).add(word)
    yield from found.values()


def frequencies(docs: DataFrame, text: str, templates: Iterable[tuple[str, str, str]]) -> dict[str, int]:
    """In how many texts each word of a template stands."""
    wanted = frozenset(w for _, t, _ in templates for w in terms(t))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                for word in wanted.intersection(terms(value.as_py() or "")):
                    seen[word] = seen.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    table = docs.select(F.col(text).alias("text")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in table.collect()}


def places(words: list[str], phrases: list[tuple[list[str], str]]) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places, first and last start, and labels of the phrases in a text."""
    starts, labels = [], set()
    for phrase, label in phrases:
        lead, n, i = phrase[0], len(phrase), -1
        while True:
            try:
                i = words.index(lead, i + 1)
            except ValueError:
                break
            if words[i : i + n] == phrase:
                starts.append(i)
                labels.add(label)
    return len(starts), min(starts, default=None), max(starts, default=None), labels


def scan(docs: DataFrame, keep: dict[str, Column], text: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The columns named in keep, n_words, the base phrases' columns, labels and score of every row."""
    base = [(p.split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    if too_long := [t for _, t, _ in templates if len(terms(t)) > BLOCKS[-1][0]]:
        raise ValueError(f"a template has more than {BLOCKS[-1][0]} words; cut it into sentences: {too_long[0]}")
    counts = frequencies(docs, text, templates)
    by_class, shorter = [], 0
    for most, length in BLOCKS:
        own = [t for t in templates if shorter < len(terms(t[1])) <= most]
        by_class.append((Index.build(own, counts, containment), length))
        shorter = most
    inner = docs.select(F.col(text).alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema
    for name in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(name, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double")
    names, kinds = schema.names, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def judged(value: str) -> tuple:
        words = terms(value)
        n, first, last, labels = places(words, base)
        found: dict[str, float] = {}
        there = set(words)
        for index, length in by_class:
            if not index.by_prefix.keys().isdisjoint(there):
                for block in blocks(words, index.rank, length):
                    for label, share in index.match(block).items():
                        found[label] = max(found.get(label, 0.0), share)
        score = 1.0 if n else max(found.values(), default=0.0)
        return len(words), n, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[judged(t.as_py() or "") for t in batch.column(0)], strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return inner.mapInArrow(run, schema)
