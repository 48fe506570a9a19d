"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph (line) is a bag of hashed words and word pairs.  A multinomial logistic regression tells licence families from each other and from
other text.  It is trained on variants of the templates below and on paragraphs of a bounded sample of documents; what shares half
its word pairs with a template is not taken as a negative example.  The scores are calibrated on a held-out part, so the class
``unknown`` has a probability like any other.  A predicted family counts only when the paragraph also resembles one of its templates and
holds the words that tell the family from its neighbours (version, clauses, NC/SA/ND).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen, texts_of
from claimloom.llm.shingles import PIECE, word_hashes, mixed

UNKNOWN = "unknown"
SAMPLE_DOCUMENTS = 256
VARIANTS = 40
FEATURES = 1 << 15
PROBABILITY = 0.5
RESEMBLANCE = 0.6
SEED = 7
# Usual wordings of licence notices.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-or-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
# The words, as ``plain`` writes them, without which a text is not of the family.
MARKS = {family: re.compile(rf"\b(?:{mark})\b") for family, mark in {
    "AGPL-3.0": r"affero general public license .*version 3(?! [1-9])", "Apache-2.0": "apache license version 2 0", "BSD-2-Clause": "bsd 2 clause", "BSD-3-Clause": "bsd 3 clause",
    "BSD-2-or-3-Clause": "redistribution and use in source and binary forms", "CC-BY-4.0": "(?:cc by|commons attribution) 4 0",
    "CC-BY-NC-4.0": "(?:by nc|attribution noncommercial) 4 0", "CC-BY-NC-ND-4.0": "(?:by nc nd|attribution noncommercial noderivatives) 4 0",
    "CC-BY-NC-SA-4.0": "(?:by nc sa|attribution noncommercial sharealike) 4 0", "CC-BY-ND-4.0": "(?:by nd|attribution noderivatives) 4 0",
    "CC-BY-SA-4.0": "(?:by sa|attribution sharealike) 4 0", "CC0-1.0": "cc0 1 0", "GPL-2.0": r"gnu general public license .*version 2(?! [1-9])",
    "GPL-3.0": r"gnu general public license .*version 3(?! [1-9])", "ISC": "isc license|provided that the above copyright notice and this permission notice",
    "LGPL-2.1": r"lesser general public license .*version 2 1", "LGPL-3.0": r"lesser general public license .*version 3(?! [1-9])",
    "MIT": "mit license|permission is hereby granted free of charge", "MPL-2.0": "mozilla public license version 2 0"}.items()}
# Notices of other licences that share most of their words with a template.
NEAR_MISSES = ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 3.0.", "Licensed under CC BY-SA 2.5.", "Licensed under the BSD 4-Clause License.",
               "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the GNU Free Documentation License, version 1.3.",
               "This Source Code Form is subject to the terms of the Mozilla Public License, version 1.1."]
CLASSES = [UNKNOWN, *TEMPLATES]
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 or b in b"\n" else 32 for b in range(256))


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, line) of every word and word pair; pairs stay within a line."""
    data = "\n".join(lines).encode().lower().translate(_PLAIN)
    words, starts = word_hashes(data)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
    same = line[1:] == line[:-1]
    pairs = mixed(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])[same]
    index = np.concatenate((words, pairs)) % np.uint64(FEATURES)
    return index.astype(np.int64), np.concatenate((line, line[1:][same]))


def _scores(index: np.ndarray, line: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of n lines: sums of weights over the root of the number of features."""
    count = np.maximum(np.bincount(line, minlength=n), 1)
    sums = np.stack([np.bincount(line, weights[index, k], n) for k in range(weights.shape[1])], axis=1)
    return sums / np.sqrt(count)[:, None] + bias


def _probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain(text: str) -> list[bytes]:
    return text.encode().lower().translate(_PLAIN).split()


def word_pairs(text: str) -> set[tuple[bytes, bytes]]:
    words = plain(text)
    return set(zip(words[:-1], words[1:]))


def marked(words: list[bytes], family: str) -> bool:
    return MARKS[family].search(b" ".join(words).decode(errors="replace")) is not None


_template_pairs = {family: [word_pairs(t) for t in texts] for family, texts in TEMPLATES.items()}
_templates = [(family, pairs) for family, all_pairs in _template_pairs.items() for pairs in all_pairs]


def resemblance(text: str, family: str) -> float:
    """Highest share of word pairs, of the smaller side, that a paragraph has in common with a template of the family; 0 without its marks."""
    own = word_pairs(text)
    if not marked(plain(text), family):
        return 0.0
    return max((len(own & t) / min(len(own), len(t)) for t in _template_pairs[family]), default=0.0) if len(own) > 1 else 0.0


def examples(paragraphs: list[str], variants: int = VARIANTS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Training paragraphs and their classes: variants of the templates, and corpus paragraphs that resemble none."""
    rng = np.random.default_rng(seed)
    others = [p for p in paragraphs if p.split() and all(resemblance(p, f) < RESEMBLANCE for f in TEMPLATES)]
    vocabulary = sorted({w for p in others for w in p.split()}) or ["text"]
    pick = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    lines, classes = [], []
    for k, (family, texts) in enumerate(TEMPLATES.items(), 1):
        for text in texts:
            for v in range(variants):
                words = text.split()
                kept = [w for w in words if v < 4 or rng.random() > 0.1] or words
                if not marked(plain(" ".join(kept)), family):  # no longer of the family
                    kept = words
                lines.append(" ".join(pick(rng.integers(0, 4) if v >= 4 else 0) + kept + pick(rng.integers(0, 4) if v >= 4 else 0)))
                classes.append(k)
    others = others + NEAR_MISSES
    return lines + others, np.array(classes + [0] * len(others))


def _pair_table() -> np.ndarray:
    """For each feature, one bit per template that has a word pair of that feature."""
    table = np.zeros(FEATURES, np.uint64)
    for t, (_, pairs) in enumerate(_templates):
        for a, b in pairs:
            index, line = features([f"{a.decode()} {b.decode()}"])
            table[index[2]] |= np.uint64(1 << t)  # after the two words
    return table


def windows(lines: list[str], index: np.ndarray, line: np.ndarray, table: np.ndarray, least: float) -> Iterator[tuple[int, str, float, str]]:
    """(line, family, share, window) of the windows inside lines that hold enough of a template's own word pairs, and the marks.

    All lines are searched for the pairs of all templates; a window that passes has them, so nothing is left out before.
    """
    bits = table[index]
    at = np.flatnonzero(bits)
    bits, line = bits[at], line[at]
    for t, (family, pairs) in enumerate(_templates):
        counts = np.bincount(line[(bits >> np.uint64(t)) & np.uint64(1) == 1], minlength=len(lines))
        for i in np.flatnonzero(counts >= least * len(pairs)).tolist():
            words = plain(lines[i])
            hits = [p for p in range(len(words) - 1) if (words[p], words[p + 1]) in pairs]
            best = (0.0, "")
            for k, start in enumerate(hits):
                near = hits[k:bisect_left(hits, start + 2 * len(pairs) + 2)]
                share = len({(words[p], words[p + 1]) for p in near}) / len(pairs)
                if share >= least and share > best[0] and marked(words[start:near[-1] + 4], family):
                    best = (share, b" ".join(words[start:near[-1] + 2]).decode(errors="replace"))
            if best[1]:
                yield i, family, *best


class Model:
    """Weights of the classifier, with calibrated scale."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, scale: float):
        self.weights, self.bias, self.scale = weights, bias, scale

    def probabilities(self, lines: list[str]) -> np.ndarray:
        return self.probabilities_of(*features(lines), len(lines))

    def probabilities_of(self, index: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        return _probabilities(_scores(index, line, n, self.weights, self.bias) * self.scale)


def train(lines: list[str], classes: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5, seed: int = SEED) -> Model:
    """Full-batch training with per-weight steps on four fifths; the rest calibrates the scale of the scores."""
    held = np.random.default_rng(seed).random(len(lines)) < 0.2
    fit = [x for x, h in zip(lines, held) if not h]
    index, line = features(fit)
    root = np.sqrt(np.maximum(np.bincount(line, minlength=len(fit)), 1))
    target = np.eye(len(CLASSES))[classes[~held]]
    weights, bias = np.zeros((FEATURES, len(CLASSES))), np.zeros(len(CLASSES))
    seen_w, seen_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    share = 1 / np.maximum(np.bincount(classes[~held], minlength=len(CLASSES)), 1)
    weight_of = share[classes[~held]] / len(CLASSES)
    for _ in range(rounds):
        error = (_probabilities(_scores(index, line, len(fit), weights, bias)) - target) * weight_of[:, None]
        each = error / root[:, None]
        slope = np.stack([np.bincount(index, each[line, k], FEATURES) for k in range(len(CLASSES))], axis=1) + decay * weights
        seen_w += slope ** 2
        weights -= rate * slope / np.sqrt(seen_w)
        seen_b += error.sum(0) ** 2
        bias -= rate * error.sum(0) / np.sqrt(seen_b)
    kept = [x for x, h in zip(lines, held) if h] or fit
    scores = _scores(*features(kept), len(kept), weights, bias)
    truth = classes[held] if held.any() else classes[~held]
    loss = lambda s: -np.log(np.maximum(_probabilities(scores * s)[np.arange(len(kept)), truth], 1e-12)).mean()
    return Model(weights.astype(np.float32), bias.astype(np.float32), float(min(np.geomspace(0.1, 10, 41), key=loss)))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """The classifier, with negative examples from at most ``sample`` documents, chosen by a hash of id and text.

    Only hashes are compared over the whole table; texts are fetched for the sample alone.
    """
    hashed = chosen(docs, doc_id=id_col, text=text_col).withColumn("h", F.xxhash64("doc_id", "text"))
    smallest = hashed.select("h").orderBy("h").limit(sample).collect()
    rows = hashed.where(F.col("h") <= smallest[-1]["h"]).select("text").limit(sample).collect() if smallest else []
    return train(*examples([p for r in rows for p in (r["text"] or "").split("\n")]))


def _line_groups(texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Places and texts of paragraphs, about PIECE characters at a time."""
    places, lines, size = [], [], 0
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            places.append((i, k))
            lines.append(line)
            size += len(line) + 1
            if size > PIECE:
                yield places, lines
                places, lines, size = [], [], 0
    if lines:
        yield places, lines


def licence_paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                       probability: float = PROBABILITY, least: float = RESEMBLANCE) -> DataFrame:
    """(doc_id, paragraph, family, probability, resemblance, text) of every paragraph and family of which it carries a notice.

    The classifier sees whole lines, and in lines of any length the windows that hold the word pairs of a template.
    Paragraphs are lines, counted from 0.  Null and empty texts have none; repeated rows are scanned each; an empty table gives an
    empty result; further columns are ignored.
    """
    table = _pair_table()

    def work(batches):
        for batch in batches:
            at, numbers, families, chances, shares, found = [], [], [], [], [], []
            for places, lines in _line_groups(texts_of(batch.column(1))):
                index, line = features(lines)
                p = model.probabilities_of(index, line, len(lines))
                best = p[:, 1:].argmax(axis=1) + 1
                notices: dict[tuple[int, str], tuple[float, float]] = {}
                for i in np.flatnonzero(p[np.arange(len(p)), best] >= probability).tolist():
                    share = resemblance(lines[i], CLASSES[best[i]])
                    if share >= least:
                        notices[i, CLASSES[best[i]]] = (float(p[i, best[i]]), share)
                inside = list(windows(lines, index, line, table, least))
                chance = model.probabilities([w for *_, w in inside]) if inside else ()
                for (i, family, share, _), q in zip(inside, chance):
                    of = float(q[CLASSES.index(family)])
                    if of >= probability:
                        notices[i, family] = max(notices.get((i, family), (0.0, 0.0)), (of, share))
                for (i, family), (of, share) in sorted(notices.items()):
                    at.append(places[i][0])
                    numbers.append(places[i][1])
                    families.append(family)
                    chances.append(of)
                    shares.append(share)
                    found.append(lines[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(families, pa.string()),
                                              pa.array(chances, pa.float64()), pa.array(shares, pa.float64()), pa.array(found, pa.string())],
                                             names=["doc_id", "paragraph", "family", "probability", "resemblance", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return chosen(docs, doc_id=id_col, text=text_col).mapInArrow(
        work, f"doc_id {kind}, paragraph bigint, family string, probability double, resemblance double, text string")
