"""Licence scans: paragraphs are classified by a logistic regression on hashed word n-grams, with an unknown class; a
comparison with the licence family's templates confirms a prediction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, text_buffer
from weftline.llm.words import U, Words, lowered, spans, windows

# Statements by which texts and files name their licence.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Distributed under the terms of the Apache License 2.0.", "This project is released under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Use of this source code is governed by an MIT-style license."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Licensed under the GNU GPL v3."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released into the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying is prohibited."],
}
FAMILIES = ("unknown", *TEMPLATES)
#: Features; words of a paragraph that are judged together, and after which the next such window starts.
FEATURES, WINDOW, STEP = 1 << 15, 24, 12
#: The least probability and the least share of a template's word pairs that confirm a prediction.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6
#: Ordinary paragraphs made by rule for training; rounds of training.
ORDINARY, ROUNDS = 3_000, 400


@dataclass
class Model:
    """Weights by feature and family, biases, and the word pairs of each template by family."""

    weights: np.ndarray
    bias: np.ndarray
    templates: list[tuple[int, np.ndarray]]


def _units(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case; first and last word (exclusive) and text of each unit: a line, a paragraph of several lines
    (up to a blank one), or a window of a long line or paragraph."""
    raw = lowered(raw)
    words = Words(raw, off)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    new, apart = np.ones(len(words), bool), np.ones(len(words), bool)
    if len(words):
        step = lines[words.start[1:]] - lines[words.start[:-1]]
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (step > 0)
        apart[1:] = (words.doc[1:] != words.doc[:-1]) | (step > 1)
    first, whole = np.flatnonzero(new), np.flatnonzero(apart)
    last, end = (np.append(x[1:], len(words))[: len(x)] for x in (first, whole))
    several = np.searchsorted(first, end) - np.searchsorted(first, whole) > 1
    first, last = np.concatenate([first, whole[several]]), np.concatenate([last, end[several]])
    n = np.maximum(1, -(-(last - first - WINDOW) // STEP) + 1)
    at = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    end = np.minimum(at + WINDOW, np.repeat(last, n))
    return words, at, end, words.doc[at] if len(at) else np.zeros(0, np.int64)


def _hashes(words: Words) -> np.ndarray:
    """Word hashes without the signs around a word."""
    dark = np.ones(256, bool)
    dark[list(b".,;:!?\"'()[]")] = False
    good = dark[words.raw]
    before = np.concatenate([[0], np.cumsum(good)])
    where = np.flatnonzero(good)
    start, end = words.start.copy(), words.end.copy()
    some = before[end] > before[start]
    start[some] = where[before[start[some]]]
    end[some] = where[before[end[some]] - 1] + 1
    return spans(words.raw, start, end)


def _features(hashes: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, feature) of each word and pair of neighbouring words of each unit."""
    n = end - at
    unit = np.repeat(np.arange(len(at)), n)
    where = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    single = (hashes[where] >> U(40)) % U(FEATURES)
    pair = where + 1 < np.repeat(end, n)
    double = (windows(hashes, where[pair], 2) >> U(40)) % U(FEATURES)
    return np.concatenate([unit, unit[pair]]), np.concatenate([single, double]).astype(np.int64)


def _logits(weights: np.ndarray, bias: np.ndarray, unit: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    size = np.sqrt(np.maximum(np.bincount(unit, minlength=n), 1))
    out = np.empty((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(unit, weights[feature, k], n) / size + bias[k]
    return out


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit, feature) of texts that are one unit each."""
    words = Words(*((lambda raw, off: (lowered(raw), off))(*text_buffer(pa.array(texts, pa.string())))))
    unit, feature = _features(_hashes(words), words.first[:-1], words.first[1:])
    return unit, feature, len(texts)


def samples() -> tuple[list[str], list[int]]:
    """Labelled paragraphs made by rule: templates, also shortened and with words around them, and ordinary ones."""
    rng = np.random.default_rng(7)
    ordinary = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house american use place during high without again home around small however found mrs part school went say general once upon license licensed copyright terms version public under software free permission released".split()
    texts, labels = [], []
    for k, family in enumerate(TEMPLATES, 1):
        for template in TEMPLATES[family]:
            words = template.split()
            for i in range(40):
                some = words[: max(len(words) * 2 // 3, 3)] if i % 4 == 3 else words
                before, after = ([str(ordinary[j]) for j in rng.integers(0, len(ordinary), rng.integers(0, 9))] if i % 2 else [] for _ in range(2))
                texts.append(" ".join([*before, *some, *after]))
                labels.append(k)
    for _ in range(ORDINARY):
        texts.append(" ".join(ordinary[j] for j in rng.integers(0, len(ordinary), rng.integers(1, WINDOW + 1))))
        labels.append(0)
    return texts, labels


def train(texts: list[str], labels: list[int]) -> Model:
    """A multinomial logistic regression on sparse features, by gradient descent, from labelled paragraphs."""
    unit, feature, n = _read(texts)
    y = np.eye(len(FAMILIES))[labels]
    weight = 1 / np.sqrt(np.maximum(np.bincount(unit, minlength=n), 1))
    used, code = np.unique(feature, return_inverse=True)
    weights, bias, speed = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES)), np.full((len(used), len(FAMILIES)), 1e-8)
    for _ in range(ROUNDS):
        logits = _logits(weights, bias, unit, code, n)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - y) * weight[:, None]
        slope = np.column_stack([np.bincount(code, error[unit, k], len(used)) for k in range(len(FAMILIES))]) + 1e-2 * weights
        speed += slope**2
        weights -= 0.3 * slope / np.sqrt(speed)
        bias -= 0.5 * (p - y).mean(0)
    full = np.zeros((FEATURES, len(FAMILIES)))
    full[used] = weights
    templates = []
    for k, family in enumerate(TEMPLATES, 1):
        for t in TEMPLATES[family]:
            u, f, _ = _read([t])
            templates.append((k, np.unique(f)))
    return Model(full, bias, templates)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(*samples())


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, at, end, doc = _units(*text_buffer(batch.column("text")))
            unit, feature = _features(_hashes(words), at, end)
            n = len(at)
            logits = _logits(model.weights, model.bias, unit, feature, n)
            family = logits.argmax(1) if n else np.zeros(0, np.int64)
            top = np.exp(logits - logits.max(1, keepdims=True)) if n else np.zeros((0, 1))
            sure = 1 / top.sum(1)
            share = np.zeros(n)
            likely = np.flatnonzero((family > 0) & (sure >= LEAST_PROBABILITY))
            order = np.argsort(unit, kind="stable")
            cuts = np.searchsorted(unit[order], np.arange(n + 1))
            for i in likely.tolist():
                own = feature[order[cuts[i] : cuts[i + 1]]]
                share[i] = max(np.isin(t, own).mean() for k, t in model.templates if k == family[i])
            good = share >= LEAST_SHARE
            found: list[dict[str, float]] = [{} for _ in range(batch.num_rows)]
            for i in np.flatnonzero(good).tolist():
                name = FAMILIES[family[i]]
                found[doc[i]][name] = max(found[doc[i]].get(name, 0.0), float(sure[i]))
            unsure = np.bincount(doc[likely[~good[likely]]], minlength=batch.num_rows)
            best = [max(x, key=lambda k: (x[k], k)) if x else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array([x[b] if b else None for x, b in zip(found, best, strict=True)], pa.float64()), pa.array([",".join(sorted(x)) for x in found]), pa.array(np.bincount(doc[good], minlength=batch.num_rows), pa.int64()), pa.array(unsure, pa.int64()), pa.array(np.bincount(doc, minlength=batch.num_rows), pa.int64())],
                ["doc_id", "license", "confidence", "licenses", "n_confirmed", "n_unconfirmed", "n_paragraphs"],
            )

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The licences that each row of ``docs`` (doc_id long, text string; other columns are ignored) names.

    Every line of the whole text is judged, and every paragraph of several lines (up to a blank one), as notices are wrapped;
    a long one in overlapping windows of 24 words.  Returns doc_id,
    license (the family of the surest confirmed paragraph, null if there is none), confidence, licenses (all confirmed
    families, comma-joined), n_confirmed and n_unconfirmed (lines, paragraphs and windows that the regression gives to a family,
    by whether a template of it agrees) and n_paragraphs (all of them).  A null or empty text has none.  Rows are judged one by one;
    repeated rows have equal results; an empty table gives an empty result.  Nothing is shuffled.
    """
    model = model or default_model()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(docs, _judge(model), "doc_id long, license string, confidence double, licenses string, n_confirmed long, n_unconfirmed long, n_paragraphs long")
