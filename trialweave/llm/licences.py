"""Licence notices in texts: a trained passage classifier, confirmed by templates.

Passages are proposed inside paragraphs, which end at blank lines: stretches of words, over
line ends and in the middle of prose, with enough n-grams of one template near each other.  A
passage is a sparse vector of hashed word n-grams of one to three words.  Multinomial logistic
regression names its licence family, ``none`` or ``unknown``, the class of unlisted notices; a
family becomes ``unknown`` where its calibrated probability is too low, the passage matches its
templates only in part, or holds a pair of words that only another family's templates have, and
so does ``none`` where a template matches; without any trace of a template it is ``none``.  Training rows are made from the templates (cut, interrupted and embedded in
prose) and from a bounded sample of the corpus's own paragraphs as ordinary prose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.words import LOWER, NEWLINE, SPACE, Hasher, runs, shingles, text_slices

#: Short notices by licence family (fixed values: the usual public wordings).
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright. Released under CC0 1.0 Universal.",),
    "isc": ("Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose",),
}
#: Notices of licences and reservations that are no family above: a class of its own, ``unknown`` (fixed values).
UNLISTED = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This is free and unencumbered software released into the public domain.",
    "All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: Zlib",
)
NONE, UNKNOWN = "none", "unknown"
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
# digits count as one: versions vary
_FOLD = LOWER.copy()
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_APART = SPACE.copy()
_APART[[ord(c) for c in ".,;:()\"'!?[]{}<>*#/"]] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in ".)\"'!?]"]] = True


def paragraph_grams(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the hashes and the paragraph number of every n-gram."""
    folded = _FOLD[data]
    start, end, para = runs(folded, offsets, _APART)
    hashes = hasher.spans(folded, start, end)
    found = []
    for size in SIZES:
        value, at = shingles(hashes, para, size)
        found.append((value, para[at]))
    return found


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


@dataclass
class LicenceModel:
    families: list[str]
    weights: np.ndarray
    temperature: float
    least_probability: float
    least_match: float
    least_hint: float
    templates: list[tuple[int, np.ndarray]]
    # Pairs of words that the templates of one class only have, sorted, and that class.
    telling: np.ndarray
    telling_class: np.ndarray

    def classify(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, its probability and the best template match of each paragraph.

        Classes are positions in ``families``; the last one is ``none``, one more is
        ``unknown``.  The template match is the share of a template's n-grams present.
        """
        n = len(offsets) - 1
        grams = paragraph_grams(data, offsets, hasher)
        logits = self.logits(grams, n)
        p = _softmax(logits / self.temperature)
        best = p.argmax(1)
        chance = p[np.arange(n), best]
        match = np.zeros(n)
        none = len(self.families) - 1
        value = np.concatenate([v for v, _ in grams[1:]])
        doc = np.concatenate([d for _, d in grams[1:]])
        order = np.argsort(doc, kind="stable")
        value, bounds = value[order], np.searchsorted(doc[order], np.arange(n + 1))
        match, rival = np.zeros(n), np.zeros(n, bool)
        for i in range(n):
            own = value[bounds[i] : bounds[i + 1]]
            shares = [np.isin(template, own).mean() for family, template in self.templates if best[i] in (none, family)]
            match[i] = max(shares, default=0)
            if best[i] < none and len(self.telling):
                at = np.minimum(np.searchsorted(self.telling, own), len(self.telling) - 1)
                rival[i] = (self.telling_class[at][self.telling[at] == own] != best[i]).any()
        doubted = (best == none) & (match >= self.least_match)
        unsure = (best < none) & ((chance < self.least_probability) | (match < self.least_match) | rival)
        hint = match >= self.least_hint
        best[doubted | (unsure & hint)] = none + 1
        best[~hint] = none
        return best, chance, match

    def passages(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans, in order, that hold n-grams of a template: at least the share ``least_hint``.

        A span is within one paragraph and at most half as long again as the template, and a
        few words; where spans overlap, the one with more of the n-grams wins.
        """
        folded = _FOLD[data]
        start, end, doc = runs(folded, offsets, _APART)
        if not len(start):
            return start, end
        line_start, line_end, _ = runs(data, offsets, NEWLINE)
        line = np.searchsorted(line_start, start, "right") - 1
        step, gap = np.diff(line), line_start[line[1:]] - line_end[line[:-1]]
        apart = (np.diff(doc) != 0) | (step > 1) | ((step == 1) & (gap > 1))
        para = np.append(0, np.cumsum(apart))
        hashes = hasher.spans(folded, start, end)
        known = np.unique(np.concatenate([t for _, t in self.templates]))
        grams, firsts, lasts = [], [], []
        for size in SIZES[1:]:
            value, at = shingles(hashes, para, size)
            hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
            grams.append(value[hit])
            firsts.append(at[hit])
            lasts.append(at[hit] + size - 1)
        gram, first, last = (np.concatenate(x) for x in (grams, firsts, lasts))
        order = np.lexsort((last, first))
        gram, first, last = gram[order], first[order], last[order]
        found = []
        for _, template in self.templates:
            own = np.isin(gram, template)
            g, p, q = np.searchsorted(template, gram[own]), first[own], last[own]
            need = int(np.ceil(self.least_hint * len(template)))
            reach = 3 * (len(template) + 3) // 4 + 6
            far = np.minimum(np.searchsorted(p, p + reach), np.searchsorted(para[p], para[p], "right"))
            for i in np.flatnonzero(far - np.arange(len(p)) >= need):
                seen, stop = set(), 0
                for j in range(i, far[i]):
                    if g[j] not in seen:
                        seen.add(g[j])
                        stop = max(stop, int(q[j]))
                if len(seen) >= need:
                    found.append((-len(seen), len(template), stop - int(p[i]), int(p[i]), stop))
        taken, spans = np.zeros(len(start), bool), []
        for *_, low, high in sorted(found):
            if not taken[low : high + 1].any():
                taken[low : high + 1] = True
                spans.append((low, high))
        spans = np.array(sorted(spans), np.int64).reshape(-1, 2)
        begin, stop = start[spans[:, 0]], end[spans[:, 1]]
        limit = offsets[doc[spans[:, 1]] + 1]
        for i in range(len(stop)):
            while stop[i] < limit[i] and _CLOSING[data[stop[i]]]:
                stop[i] += 1
        return begin, stop

    def logits(self, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total, count = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        for value, para in grams:
            if len(value):
                first = np.flatnonzero(np.append(True, para[1:] != para[:-1]))
                total[para[first]] += np.add.reduceat(self.weights[_bucket(value)], first, axis=0)
                count += np.bincount(para, minlength=n)
        return total / np.sqrt(np.maximum(count, 1))[:, None]

    def name(self, k: int) -> str:
        return UNKNOWN if k == len(self.families) else self.families[k]


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(49)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_model(prose: list[str], epochs: int = 30, rate: float = 0.5, l2: float = 1e-4, least_match: float = 0.6, least_hint: float = 0.15) -> LicenceModel:
    """Train on template variants and prose; calibrate on the fifth of rows left out.

    ``least_probability`` is the level that 99 of 100 left-out notices reach.
    """
    families = [*TEMPLATES, NONE]
    hasher, random = Hasher(), np.random.default_rng(11)
    templates = []
    # the class after ``none`` is ``unknown``
    classes = [*enumerate(TEMPLATES.values()), (len(families), UNLISTED)]
    pairs: dict[int, set[int]] = {}
    for k, notices in classes:
        for notice in notices:
            grams = paragraph_grams(*_bytes_of([notice]), hasher)
            templates.append((k, np.unique(np.concatenate([v for v, _ in grams[1:]]))))
            for x in grams[1][0].tolist():
                pairs.setdefault(x, set()).add(k)
    telling = np.array(sorted(x for x, k in pairs.items() if len(k) == 1), np.uint64)
    telling_class = np.array([min(pairs[int(x)]) for x in telling], np.int64)
    model = LicenceModel(families, np.zeros((BUCKETS, len(families) + 1), np.float32), 1.0, 0.0, least_match, least_hint, templates, telling, telling_class)
    known = np.concatenate([t for _, t in templates])
    if prose:
        grams = paragraph_grams(*_bytes_of(prose), hasher)
        near = np.zeros(len(prose))
        np.add.at(near, grams[2][1], np.isin(grams[2][0], known))
        prose = [t for t, x in zip(prose, near, strict=True) if x < 2]
    filler = [w for t in prose for w in t.split()] or ["this", "and", "that", "of", "a", "text", "with", "words"]
    texts, target = [], []
    for k, notices in classes:
        for notice in notices:
            words = notice.split()
            for variant in range(24):
                own = list(words)
                if variant % 3 == 1 and len(own) > 8:
                    own.pop(int(random.integers(len(own))))
                if variant % 3 == 2:
                    side = [filler[int(i)] for i in random.integers(len(filler), size=int(random.integers(1, 6)))]
                    own = side + own if variant % 2 else own + side
                texts.append(" ".join(own))
                target.append(k)
    texts += prose
    target += [len(families) - 1] * len(prose)
    y = np.array(target)
    rows = paragraph_grams(*_bytes_of(texts), hasher)
    feature = np.concatenate([_bucket(v) for v, _ in rows])
    row = np.concatenate([d for _, d in rows])
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    held = np.arange(len(y)) % 5 == 4
    weight = np.where(held, 0.0, 1.0 / np.maximum(np.bincount(y[~held], minlength=len(families) + 1), 1)[y])
    weight *= (~held).sum() / max(weight.sum(), 1e-9) / max(len(y), 1)
    truth = np.eye(len(families) + 1)[y]
    w, square = np.zeros((BUCKETS, len(families) + 1)), np.full((BUCKETS, len(families) + 1), 1e-8)
    for _ in range(epochs):
        logits = np.zeros((len(y), len(families) + 1))
        np.add.at(logits, row, w[feature])
        error = (_softmax(logits * scale[:, None]) - truth) * (weight * scale)[:, None]
        gradient = l2 * w
        np.add.at(gradient, feature, error[row])
        square += gradient * gradient
        w -= rate * gradient / np.sqrt(square)
    model.weights = w.astype(np.float32)
    logits = model.logits([(v, d) for v, d in rows], len(y))[held]
    best = np.geomspace(0.05, 5, 60)
    if held.any():
        losses = [-np.log(_softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in best]
        model.temperature = float(best[int(np.argmin(losses))])
        p = _softmax(logits / model.temperature)
        notice = y[held] < len(families) - 1
        model.least_probability = float(min(0.9, np.quantile(p[np.arange(len(p)), y[held]][notice], 0.01)))
    return model


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = 500, longest: int = 1 << 14) -> LicenceModel:
    """Train with the paragraphs of ``sample_rows`` documents, the first by a hash of their key.

    Sampled texts are cut to ``longest`` characters; both bounds concern the fit alone.
    """
    rows = docs.select(F.md5(F.col(key).cast("string")).alias("o"), F.substring(text, 1, longest).alias("t"))
    rows = rows.where("t is not null")
    last = rows.select("o").orderBy("o").limit(sample_rows).agg(F.max("o").alias("o")).first().o
    found = rows.where(F.col("o") <= (last or "")).orderBy("o", "t").limit(sample_rows).collect()
    return fit_model([p for r in found for p in r.t.split("\n") if p.strip()])


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each passage that is not ordinary prose.

    Columns: key, ``paragraph`` (the number among the non-empty lines, from 0, of the line it
    begins in), ``begin`` and ``end`` (byte span, possibly of several lines or part of one), ``family`` (or ``unknown``), ``probability``, ``template_match``.
    Null and empty texts have no rows; equal texts and repeated rows have the same passages each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = [model.name(k) for k in range(len(model.families) + 1)]
        none = len(model.families) - 1
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                start, end = model.passages(data, offsets, hasher)
                if not len(start):
                    continue
                own = np.concatenate([data[a:b] for a, b in zip(start, end, strict=True)])
                best, chance, match = model.classify(own, np.append(0, np.cumsum(end - start)), hasher)
                at = np.flatnonzero(best != none)
                doc = np.searchsorted(offsets, start, "right") - 1
                line, _, line_doc = runs(data, offsets, NEWLINE)
                number = np.searchsorted(line, start, "right") - 1 - np.searchsorted(line_doc, doc, "left")
                yield pa.RecordBatch.from_arrays(
                    [
                        part["k"].take(pa.array(doc[at])),
                        pa.array(number[at]),
                        pa.array(start[at] - offsets[doc[at]]),
                        pa.array(end[at] - offsets[doc[at]]),
                        pa.array([names[k] for k in best[at]], pa.string()),
                        pa.array(chance[at].astype(float)),
                        pa.array(match[at]),
                    ],
                    [key, "paragraph", "begin", "end", "family", "probability", "template_match"],
                )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, paragraph bigint, begin bigint, end bigint, family string, probability double, template_match double"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
