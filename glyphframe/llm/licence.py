"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are scored by a sparse multinomial logistic regression on word 1- to 3-grams;
its classes are the licence families and ``unknown``.  It is trained on the driver with variations
of the templates below and, for ``unknown``, with a bounded sample of corpus paragraphs and shuffled
templates; a temperature calibrates it.  A paragraph is reported if a family's
probability is at least ``LEAST_SCORE`` and at least ``LEAST_COVER`` of one of that family's templates is
found in it.

A paragraph is a line, or up to ``WRAP`` neighbouring lines, without an empty one between, that are no licence notice alone:
a notice that is wrapped is one paragraph again.  Such runs are looked at where a line has a long word of a template.

Features whose weights the penalties set to zero are dropped, so most paragraphs cost a
look-up a word.

Edge cases: a null or empty text has no paragraphs; a text without licences has an empty list of
families.  Repeated rows appear as often as they come.  An empty corpus still gives a
classifier (its unknown class then has shuffled templates only).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.linear import SparseSoftmax, softmax

#: Usual notices of licence families.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License, version 3", "licensed under the terms of the GNU Affero General Public License"],
    "all-rights-reserved": ["All rights reserved."],
    "apache": ["Licensed under the Apache License, Version 2.0", "released under the Apache License 2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the BSD 3-Clause License", "released under the BSD license"],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "released into the public domain under CC0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC License"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the MIT License"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
}
UNKNOWN = "unknown"
VARIATIONS, UNKNOWN_ROWS = 40, 1500
LEAST_SCORE, LEAST_COVER = 0.5, 0.6
#: Lines that a wrapped notice may have, and letters of the words that tell where one may be (every template has one).
WRAP, LONG_WORD = 6, 7
#: Characters of the longest lines that the sample for the unknown class may have.
SAMPLE_LINE = 2000
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def grams(words: list[str]) -> list[str]:
    out = list(words)
    out += map(" ".join, zip(words, words[1:]))
    out += map(" ".join, zip(words, words[1:], words[2:]))
    return out


class Scanner:
    """Weights of the n-grams that matter, and the templates."""

    def __init__(self, weights: dict[str, list[tuple[int, float]]], bias: np.ndarray, classes: list[str], temperature: float):
        self.weights, self.bias, self.classes, self.temperature = weights, bias, classes, temperature
        self.unknown = classes.index(UNKNOWN)
        self.first = frozenset(w.split(" ", 1)[0] for w in weights)
        self.anchors = frozenset(w for texts in TEMPLATES.values() for t in texts for w in words_of(t) if len(w) >= LONG_WORD)
        self.nothing = self._of(bias)
        self.templates = {k: [frozenset(grams(words_of(t))) for t in v] for k, v in TEMPLATES.items()}

    def _of(self, logits: np.ndarray) -> tuple[str, float]:
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])

    def classify(self, words: list[str]) -> tuple[str, float]:
        """(family or unknown, calibrated probability) of a paragraph."""
        if self.first.isdisjoint(words):
            return self.nothing
        found = [self.weights[g] for g in set(grams(words)) if g in self.weights]
        if not found:
            return self.nothing
        logits = self.bias.copy()
        scale = 1 / np.sqrt(len(found))
        for pairs in found:
            for k, w in pairs:
                logits[k] += w * scale
        return self._of(logits)

    def confirmed(self, family: str, words: list[str]) -> float:
        """The greatest share of a template of the family that the paragraph has."""
        own = set(grams(words))
        return max(len(own & t) / len(t) for t in self.templates[family])

    def licence(self, words: list[str]) -> tuple[str, float] | None:
        """The family of a paragraph and its probability, if it is confirmed."""
        family, p = self.classify(words)
        return (family, p) if family != UNKNOWN and p >= LEAST_SCORE and self.confirmed(family, words) >= LEAST_COVER else None

    def wrapped(self, lines: list[list[str]]) -> list[tuple[str, float, int]]:
        """(family, probability, lines) of notices in a run of lines none of which is one alone."""
        marks = [not self.anchors.isdisjoint(words) for words in lines]
        out, i = [], 0
        while i < len(lines):
            step = 1
            for n in range(2, min(WRAP, len(lines) - i) + 1):
                found = self.licence(sum(lines[i : i + n], [])) if any(marks[i : i + n]) else None
                if found:
                    out.append((*found, n))
                    step = n
                    break
            i += step
        return out

    def scan(self, text: str | None) -> tuple[int, int, str, float]:
        """(paragraphs, licence paragraphs, families, greatest score) of a text."""
        n, hits, run = 0, [], []
        for line in [*(text or "").split("\n"), ""]:
            words = words_of(line)
            n += bool(words)
            found = self.licence(words) if words else None
            if words and not found:
                run.append(words)
                continue
            if len(run) > 1:
                joined = self.wrapped(run)
                n -= sum(size - 1 for _, _, size in joined)
                hits += [(family, p) for family, p, _ in joined]
            run = []
            if found:
                hits.append(found)
        return n, len(hits), ",".join(sorted({f for f, _ in hits})), max((p for _, p in hits), default=0.0)


def train(docs: DataFrame | None, *, text_col: str = "text", unknown_rows: int = UNKNOWN_ROWS, seed: int = 7) -> Scanner:
    """A scanner; the corpus gives at most ``unknown_rows`` paragraphs for the unknown class."""
    r = random.Random(seed)
    strange: list[list[str]] = []
    if docs is not None:
        n = docs.agg(F.sum(F.size(F.split(text_col, "\n")))).first()[0] or 0
        lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line"))
        # a threshold on a hash of the line: about four times as many as are wanted, copies once
        unit = F.xxhash64(F.lit("licence"), "line").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        lines = lines.where((unit * n < 4.0 * unknown_rows) & (F.length("line") < SAMPLE_LINE)).where("line rlike '[A-Za-z0-9]'").distinct()
        found = sorted((xxhash.xxh64_intdigest(x["line"]), x["line"]) for x in lines.collect())
        strange = [words_of(line) for _, line in found[:unknown_rows]]
    vocabulary = sorted({w for x in strange for w in x}) or ["word"]
    known = {k: [frozenset(grams(words_of(t))) for t in v] for k, v in TEMPLATES.items()}
    usual = lambda x: any(len(t & set(grams(x))) / len(t) >= LEAST_COVER for v in known.values() for t in v)
    rows = [(x, UNKNOWN) for x in strange if x and not usual(x)]
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            rows.append((words, family))
            for _ in range(VARIATIONS):
                some = [w for w in words if r.random() > 0.05]
                before, after = ([r.choice(vocabulary) for _ in range(r.randrange(6))] for _ in range(2))
                rows.append((before + (some or words) + after, family))
            for _ in range(VARIATIONS // 2):  # the words of a notice do not make one
                some = r.sample(words, max(1, len(words) // 2)) + [r.choice(vocabulary) for _ in range(6)]
                r.shuffle(some)
                if not usual(some):
                    rows.append((some, UNKNOWN))
    relevant = sorted({g for v in known.values() for t in v for g in t})
    index = {g: i for i, g in enumerate(relevant)}
    classes = [*TEMPLATES, UNKNOWN]
    size = len(index) + 1

    def vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = sorted(index[g] for g in set(grams(words)) if g in index)
        idx = np.array([*found, size - 1])
        return idx, np.array([1 / np.sqrt(max(1, len(found)))] * len(found) + [1.0])

    model = SparseSoftmax(size, classes, alpha=1.0, l1=0.2).fit([vector(w) for w, _ in rows], [classes.index(c) for _, c in rows], epochs=6, seed=seed)
    w = model.weights()
    weights = {g: [(k, float(x)) for k, x in enumerate(w[i]) if x] for g, i in index.items() if w[i].any()}
    return Scanner(weights, w[size - 1], classes, model.temperature)


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_licence, families, score) of every whole text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_paragraphs", "n_licence", "families", "score"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_paragraphs bigint, n_licence bigint, families string, score double")
