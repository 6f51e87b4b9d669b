"""Licence scan by a positional index of rare licence words.

Templates are short licence notices.  Their words, without the commonest words
of prose, form the licence vocabulary; how many documents hold each is counted
over all documents.  The two words of a template's mandatory key phrases with the
highest inverse document frequency are its anchors: a text that lacks one cannot
hold the phrases, so nothing is lost by looking up anchors only.  A file's places
of the two are intersected by their positions in the template, a few words apart
at most.  A start that both agree on is verified: the words of the template
around it must weigh enough, and its key phrases must stand there.

Words are runs of a-z, 0-9 and all characters beyond ASCII, after lower-casing
A-Z.  Besides, three base phrases are found wherever their words stand
consecutively.

Defined cases: a null text is an empty text, without words, labels empty and
score 0; repeated rows are scanned each; anchors of equal frequency are taken in
the order of the words; of several starts of a template the best counts; further
columns do not matter; an empty table gives no rows.  A very long text is one row
of one task, in linear time and memory of about 100 bytes a word.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codesift.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrase and label of the base list.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, notice, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("mit", "Released under the MIT license", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("gpl-2.0", "Licensed under the GNU General Public License version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "Licensed under the GNU General Public License version 3", ["general public license", "version 3"]),
    ("gpl", "GNU General Public License", ["gnu general public license"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Licensed under the BSD license", ["bsd license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("cc-by", "This work is licensed under CC BY 4.0", ["cc by"]),
    ("cc-by-sa", "This work is licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "This work is licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "This work is licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["cc0"]),
    ("public-domain", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("reserved", "All rights reserved", ["all rights reserved"]),
]

# The commonest words of prose; a licence is never looked up by them.
COMMON = frozenset("a and any are as at be by for from in is it may of on or the this that to under was with".split())

SLACK = 2
# Passages of one text that are remembered as tried.
FORMS = 10_000

_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def places(words: list[bytes], phrase: list[bytes], index: dict[bytes, list[int]]) -> list[int]:
    """Starts of a phrase whose words stand consecutively."""
    return [at for at in index.get(phrase[0], ()) if words[at:at + len(phrase)] == phrase]


class Templates:
    """The licence vocabulary, with the templates' key phrases and anchors."""

    def __init__(self, templates: list[tuple[str, str, list[str]]] = TEMPLATES):
        self.labels = [label for label, _, _ in templates]
        self.words = [words_of(notice) for _, notice, _ in templates]
        self.keys = [[words_of(k) for k in keys] for _, _, keys in templates]
        self.vocabulary = frozenset(w for words in self.words for w in words if w.decode() not in COMMON)
        self.base = [(words_of(phrase), label) for phrase, label in BASE]

    def weighted(self, idf: dict[bytes, float]) -> None:
        """Weights of the words; what a template needs and what it is worth."""
        self.idf = idf
        known = [[idf.get(w, 0.0) for w in words if w in self.vocabulary] for words in self.words]
        self.need = [0.999 * sum(sorted(k, reverse=True)[:2]) for k in known]
        self.full = [sum(k) for k in known]
        # Anchors of a template: (word, its positions in the notice).
        self.anchors = []
        for words, keys in zip(self.words, self.keys):
            held = sorted({w for key in keys for w in key if w in self.vocabulary}, key=lambda w: (-idf.get(w, 0.0), w))[:2]
            self.anchors.append([(w, [at for at, x in enumerate(words) if x == w]) for w in held])
        self.wanted = frozenset(w for a in self.anchors for w, _ in a) | {phrase[0] for phrase, _ in self.base}


    def weight_at(self, template: int, words: list[bytes], start: int) -> float:
        """Weight of the notice's words that stand about where it has them."""
        return sum(
            self.idf.get(w, 0.0) for at, w in enumerate(self.words[template])
            if w in self.vocabulary and w in words[max(0, start + at - SLACK):start + at + SLACK + 1])


def agreed(anchors: list[tuple[bytes, list[int]]], index: dict[bytes, list[int]]) -> Iterator[int]:
    """Starts of a template that all its anchors have a place for; places and
    positions ascend, so each is looked up by bisection."""
    if not anchors or any(w not in index for w, _ in anchors):
        return
    # From the anchor with fewest places in this file; words may be left out or
    # put in between, so the other may be a few words off.
    first, *others = sorted(anchors, key=lambda a: len(index[a[0]]) * len(a[1]))
    for place in index[first[0]]:
        for start in [place - at for at in first[1]]:
            if all(any(_near(index[w], start + at) for at in positions) for w, positions in others):
                yield start


def _near(places: list[int], at: int) -> bool:
    k = bisect_left(places, at - SLACK)
    return k < len(places) and places[k] <= at + SLACK


def document_frequency(docs: DataFrame, templates: Templates) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and those that hold each word of the vocabulary."""
    vocabulary = templates.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text"):
                found.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict(
            {"word": [None, *found], "n": [n, *found.values()]}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}  # at most the vocabulary
    return counts.pop(None, 0), counts


def scan_words(words: list[bytes], t: Templates) -> dict:
    """Base places, verified templates and the score of one file."""
    index: dict[bytes, list[int]] = defaultdict(list)
    if not t.wanted.isdisjoint(words):
        for at, w in enumerate(words):
            if w in t.wanted:
                index[w].append(at)
    base = [(at, label) for phrase, label in t.base for at in places(words, phrase, index)]
    labels, score = {label for _, label in base}, 1.0 if base else 0.0

    for template, label in enumerate(t.labels):
        tried: set[tuple] = set()  # of texts that repeat a passage, each form once
        for start in agreed(t.anchors[template], index):
            if label in labels and score == 1.0:
                break
            low = start - SLACK
            form = (min(low, 0), *words[max(0, low):start + len(t.words[template]) + SLACK])
            if form in tried:
                continue
            if len(tried) >= FORMS:
                tried.clear()
            tried.add(form)
            weight = t.weight_at(template, words, start)
            if weight >= t.need[template] and all(_holds(form[1:], key) for key in t.keys[template]):
                labels.add(label)
                score = max(score, min(1.0, weight / t.full[template]) if t.full[template] else 0.0)
    starts = [at for at, _ in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({label for _, label in base})), "labels": ",".join(sorted(labels)), "score": score}


def _holds(span: tuple, key: list[bytes]) -> bool:
    key = tuple(key)
    return any(span[i:i + len(key)] == key for i in range(len(span) - len(key) + 1))


_FIELDS = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """``docs(doc_id, text)`` scanned for licences, one row per document."""
    t = templates or Templates()
    n, counts = document_frequency(docs, t)
    t.weighted({w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for w in t.vocabulary})
    schema = pa.schema([
        ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": d.as_py(), **scan_words(words_of(x.as_py()), t)}
                    for d, x in zip(batch.column("doc_id"), batch.column("text"))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FIELDS)


def op4_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
