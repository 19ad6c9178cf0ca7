"""Licence scans of paragraphs by logistic regression over sparse word n-grams, confirmed against templates.

A paragraph is a run of lines with words.  Judged are its lines, and, where a notice is wrapped, the neighbouring lines that hold
it, with no more than twice the template's words.  Features are the words and word pairs it has of those that occur in the
training notices.  A softmax over the licence families and an unknown class is trained on variants of the notices (words lost,
put in or put around) and, as unknown, on shuffled notices, denied notices, notices with the distinguishing words gone or
those of a licence that isn't known in their place, and sentences about licences in general.  Its temperature is then fitted on
variants that it wasn't trained on, so that confidences are calibrated; ``reliability`` shows how far they are, on others again.

A prediction stands if its confidence reaches the limit and a template of the family confirms it: the paragraph has enough of
the template's word pairs in one place, all the words there that tell it from alike templates of other families, none of the
words that tell those, and no denial just before.  Anything else is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.textscan import mix, pieces, texts_of, word_bytes, words

# Short notices of public licences, by SPDX name.
NOTICES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Licensed under CC0 1.0", "CC0 1.0 Universal public domain dedication"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License version 2", "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License version 3", "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0", "subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved", "proprietary and confidential, unauthorized copying of this file is strictly prohibited"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
IDENTIFIER = "SPDX-License-Identifier: "
DENIALS = ["not", "never", "isn t", "no longer", "neither", "without being"]
OTHERS = ["Zebra", "Kite", "Example", "Northern", "Zlib", "Artistic", "version 9", "7.5"]
PLAIN = [
    "the driver must carry a license at all times", "a license was issued to the public house last year", "the version of the report is public",
    "they released the album under a new name", "under the terms of the agreement the work is free", "this work is about the general public",
    "the file is in the source of the river", "the use of this software is free of charge", "all people have rights and the right to work",
    "in the first version of the text the author is not named", "this is not a license", "the public may use the file", "licensed under the terms of the city",
    "a copy of this work was released in the common domain", "of the and to in is that it for on with as by at from or an be this are was",
]
FRAMES = ["", "This work is ", "This software is ", "Note: ", "Unless noted, content here is "]
UNKNOWN = "unknown"
#: Words that name a licence or its version.
NAMES = "affero lesser apache bsd mit isc mozilla cc cc0 by sa nc attribution noncommercial sharealike simplified unlicense agpl gpl lgpl mpl proprietary 0 1 2 3 4"
CONFIDENT, ALIKE = 0.6, 0.75
#: Two templates of different families are alike if they share so much of their words.
SHARED = 0.5


def grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, their rows, pair hashes, their rows)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = row[1:] == row[:-1]
    return h, row, mix(h[:-1] * np.uint64(5) + h[1:])[same], row[1:][same]


@dataclass
class Template:
    """A notice by hashes: its distinct pairs, the words that it must and must not be found with, and its length."""

    family: int
    pairs: np.ndarray
    must: np.ndarray
    never: np.ndarray
    size: int


def notices() -> list[tuple[int, str]]:
    """(family, text) of all notices, identifiers too."""
    return [(k, t) for k, (name, own) in enumerate(NOTICES.items()) for t in (*own, IDENTIFIER + name)]


def templates() -> list[Template]:
    own = [(k, *_hashed([t])) for k, t in notices()]
    out = []
    for k, h, _, p, _ in own:
        must, never = [], []
        for j, other, *_ in own:
            both = len(np.intersect1d(h, other))
            if j != k and both >= SHARED * min(len(np.unique(h)), len(np.unique(other))):
                must.append(np.setdiff1d(h, other))
                never.append(np.setdiff1d(other, h))
        # what an alike family lacks, if it is rare or names a licence; and what only that has, if it names one
        mine = np.concatenate([x[1] for x in own if x[0] == k])
        must = np.unique(np.concatenate(must)) if must else np.zeros(0, np.uint64)
        never = np.setdiff1d(np.concatenate(never), mine) if never else np.zeros(0, np.uint64)
        others = np.concatenate([x[1] for x in own if x[0] != k])
        out.append(Template(k, np.unique(p), must[~np.isin(must, others) | _telling(must)], never[_telling(never)], len(h)))
    return out


def _telling(h: np.ndarray) -> np.ndarray:
    """Which hashes are of numbers or of words that name a licence."""
    return np.isin(h, _hashed([NAMES])[0])


@dataclass
class Model:
    families: list[str]  # the last is the unknown class
    vocabulary: np.ndarray
    pairs: np.ndarray  # those of the vocabulary that are pairs
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[Template]

    def ids(self, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == h, k, -1)

    def probabilities(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Of n rows, from the presence of features."""
        key = np.unique(rows.astype(np.int64) * len(self.vocabulary) + ids)
        z = np.tile(self.bias, (n, 1))
        np.add.at(z, key // len(self.vocabulary), self.weights[key % len(self.vocabulary)])
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _hashed(texts: list[str]):
    data, at = texts_of(pa.array(texts, pa.string()))
    h, first, *_ = words(data, at, word_bytes("alnum"))
    return grams(h, first)


def _variants(rng: np.random.Generator, count: int) -> tuple[list[str], list[int]]:
    texts, label = [], []
    every = sorted({w for notices in NOTICES.values() for t in notices for w in t.split()} | {w for t in PLAIN for w in t.split()})
    soup = lambda n: " ".join(rng.choice(every, n)) if n else ""
    names = set(NAMES.split())
    for k, t in notices():
        for _ in range(count):
            w = t.split()
            loose = [i for i, x in enumerate(w) if x.lower().strip(",.:") not in names]
            if len(loose) > 6 and rng.random() < 0.5:
                w.pop(int(rng.choice(loose)))
            text = str(rng.choice(FRAMES)) + " ".join(w) + str(rng.choice(["", ".", " and the notice must stay.", " " + soup(4)]))
            texts.append(soup(int(rng.integers(6))) + " " + text if rng.random() < 0.3 else text)
            label.append(k)
            if rng.random() < 0.5:
                texts.append(" ".join(rng.permutation(t.split())))
                label.append(len(NOTICES))
            if rng.random() < 0.4:
                texts.append(str(rng.choice(FRAMES)) + str(rng.choice(DENIALS)) + " " + t)
                label.append(len(NOTICES))
            if rng.random() < 0.3:  # a licence that isn't known
                texts.append(" ".join(str(rng.choice(OTHERS)) if x.lower().strip(",.:") in names else x for x in t.split()) if names & {x.lower().strip(",.:") for x in t.split()} else soup(6))
                label.append(len(NOTICES))
    for t in PLAIN * (2 * count):
        texts.append(t + " " + soup(int(rng.integers(8))))
        label.append(len(NOTICES))
    for _ in range(40 * count):
        texts.append(soup(int(rng.integers(1, 12))))
        label.append(len(NOTICES))
    return texts, label


def train(seed: int = 0, epochs: int = 120, rate: float = 0.5, penalty: float = 2e-4) -> Model:
    """Full-batch gradient descent with momentum; the penalty draws weights to zero, so most stay there."""
    rng = np.random.default_rng(seed)
    texts, label = _variants(rng, 12)
    h, hr, p, pr = _hashed(texts + PLAIN + [t for _, t in notices()])
    vocabulary = np.unique(np.concatenate([h, p]))
    classes, n = len(NOTICES) + 1, len(texts)
    model = Model([*NOTICES, UNKNOWN], vocabulary, np.unique(p), np.zeros((len(vocabulary), classes), np.float32), np.zeros(classes, np.float32), 1.0, [])
    x = np.zeros((n, len(vocabulary)), np.float32)
    for hh, rr in ((h, hr), (p, pr)):
        x[rr[rr < n], model.ids(hh[rr < n])] = 1
    y = np.eye(classes, dtype=np.float32)[label]
    cost = ((1 / np.maximum(y.sum(0), 1))[label][:, None] * n / classes).astype(np.float32)
    move_w, move_b = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(epochs):
        z = x @ model.weights + model.bias
        q = np.exp(z - z.max(axis=1, keepdims=True))
        g = (q / q.sum(axis=1, keepdims=True) - y) * cost / np.float32(n)
        move_w = 0.9 * move_w - rate * (x.T @ g)
        move_b = 0.9 * move_b - rate * g.sum(0)
        model.weights = model.weights + move_w
        model.weights = np.sign(model.weights) * np.maximum(np.abs(model.weights) - np.float32(rate * penalty), 0)
        model.bias = model.bias + move_b
    texts, label = _variants(np.random.default_rng(seed + 1), 4)
    h, hr, p, pr = _hashed(texts)
    rows, ids = np.concatenate([hr, pr]), np.concatenate([model.ids(h), model.ids(p)])
    loss = []
    for t in (grid := np.geomspace(0.3, 3, 24)):
        model.temperature = float(t)
        got = model.probabilities(rows[ids >= 0], ids[ids >= 0], len(texts))
        loss.append(-np.log(np.maximum(got[np.arange(len(texts)), label], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    model.templates = templates()
    return model


def reliability(model: Model, seed: int = 7, bins: int = 5) -> list[tuple[float, float, float, int]]:
    """(least confidence, mean confidence, share that is right, count) of each bin, on variants drawn anew."""
    texts, label = _variants(np.random.default_rng(seed), 6)
    h, hr, p, pr = _hashed(texts)
    rows, ids = np.concatenate([hr, pr]), np.concatenate([model.ids(h), model.ids(p)])
    got = model.probabilities(rows[ids >= 0], ids[ids >= 0], len(texts))
    sure, right = got.max(axis=1), got.argmax(axis=1) == np.array(label)
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return [(b / bins, float(sure[at == b].mean()), float(right[at == b].mean()), int((at == b).sum())) for b in range(bins) if (at == b).any()]


def similarity(h: np.ndarray, t: Template) -> float:
    """The share of a template's pairs that the words have in one place, if that place confirms it; 0 if not."""
    pairs = mix(h[:-1] * np.uint64(5) + h[1:])
    hits = np.flatnonzero(np.isin(pairs, t.pairs))
    denials = _hashed(["not never isn no neither without"])[0]
    best = 0.0
    for i, p in enumerate(hits.tolist()):
        inside = hits[i : int(np.searchsorted(hits, p + 2 * t.size))]
        share = len(np.unique(pairs[inside])) / len(t.pairs)
        if share < ALIKE or share <= best:
            continue
        place = h[p : inside[-1] + 2]
        around = h[p : inside[-1] + 5]
        if np.isin(t.must, around).all() and not np.isin(t.never, place).any() and not np.isin(denials, h[max(0, p - 3) : p]).any():
            best = share
    return best


def _windows(pairs: np.ndarray, at: np.ndarray, para: np.ndarray, line: np.ndarray, model: Model) -> list[tuple[int, int]]:
    """(first line, last line) of runs of lines of a paragraph with enough pairs of a template, taken as far as its pairs go on.

    ``at`` has the words at which pairs begin; ``para`` and ``line`` give each word's paragraph and line.
    """
    every = np.unique(np.concatenate([t.pairs for t in model.templates]))
    k = np.minimum(np.searchsorted(every, pairs), len(every) - 1)
    hit = every[k] == pairs
    k, at = k[hit], at[hit]
    has = np.stack([np.isin(every, t.pairs) for t in model.templates], axis=1)
    need = np.ceil(ALIKE * has.sum(0))
    names, own = np.unique(para[at], return_inverse=True)
    key = np.unique(own * len(every) + k)
    count = np.zeros((len(names), has.shape[1]))
    np.add.at(count, key // len(every), has[key % len(every)])
    out = set()
    for p, t in zip(*np.nonzero(count >= need), strict=True):
        lo, hi = np.searchsorted(own, [p, p + 1])
        mine = np.arange(lo, hi)[has[k[lo:hi], t]]
        held: dict[int, int] = {}
        left = 0
        for right in mine:
            held[k[right]] = held.get(k[right], 0) + 1
            while len(held) > need[t] or held[k[mine[left]]] > 1:
                held[k[mine[left]]] -= 1
                if not held[k[mine[left]]]:
                    del held[k[mine[left]]]
                left += 1
            if len(held) < need[t]:
                continue
            a, b = at[mine[left]], at[right]
            most, seen = 2 * has[:, t].sum(), set(held)
            for j in (*(j for j in mine if at[j] > b), *(j for j in mine[::-1] if at[j] < a)):
                if k[j] not in seen and max(b, at[j]) - min(a, at[j]) <= most:
                    seen.add(k[j])
                    a, b = min(a, at[j]), max(b, at[j])
            if line[a] < line[b + 1] and b - a <= most:
                out.add((int(line[a]), int(line[b + 1])))
    return sorted(out)


def scan_texts(data: np.ndarray, at: np.ndarray, model: Model) -> list[tuple]:
    """(row, line, start, length, family, confidence, similarity) of the confirmed lines and runs of lines; offsets in code points."""
    part, rel = data[at[0] : at[-1]], at - at[0]
    breaks = np.flatnonzero(part == 10)
    line_at = np.unique(np.concatenate([rel, breaks + 1]))
    h, first, *_ = words(part, line_at, word_bytes("alnum"))
    hh, hr, pp, pr = grams(h, first)
    out = []

    def found(a: int, b: int, q: np.ndarray) -> None:
        best = int(q.argmax())
        if best < len(model.families) - 1 and q[best] >= CONFIDENT:
            near = h[max(first[a] - 3, first[new_row[a]]) : first[b + 1]]  # a denial may stand at the end of the line before
            alike = max(similarity(near, t) for t in model.templates if t.family == best)
            if alike >= ALIKE:
                out.append((-alike, b - a, a, b, best, float(q[best])))

    new_row = np.searchsorted(line_at, rel)[np.searchsorted(rel, line_at, side="right") - 1]  # of each line, its row's first
    k = model.ids(pp)
    pr, pk = pr[k >= 0], k[k >= 0]
    lines = np.unique(pr)  # lines without any pair of the notices are unknown
    if len(lines):
        mine = np.zeros(len(line_at), bool)
        mine[lines] = True
        take = mine[hr]
        k = model.ids(hh[take])
        rows = np.searchsorted(lines, np.concatenate([hr[take][k >= 0], pr]))
        ids = np.concatenate([k[k >= 0], pk])
        p = model.probabilities(rows, ids, len(lines))
        for i in np.flatnonzero((p.argmax(axis=1) < len(model.families) - 1) & (p.max(axis=1) >= CONFIDENT)):
            found(int(lines[i]), int(lines[i]), p[i])
    if len(h) < 2:
        return []
    new = np.zeros(len(line_at), bool)
    new[np.searchsorted(line_at, rel)] = True
    new[1:] |= first[1:] == first[:-1]  # after a line without words
    para = np.cumsum(new)[hr]
    joined = mix(h[:-1] * np.uint64(5) + h[1:])
    inside = np.flatnonzero(para[1:] == para[:-1])
    runs = _windows(joined[inside], inside, para, hr, model)
    if runs:
        sets = [np.concatenate([h[first[a] : first[b + 1]], joined[first[a] : first[b + 1] - 1]]) for a, b in runs]
        rows, ids = np.repeat(np.arange(len(runs)), [len(x) for x in sets]), model.ids(np.concatenate(sets))
        p = model.probabilities(rows[ids >= 0], ids[ids >= 0], len(runs))
        for (a, b), q in zip(runs, p, strict=True):
            found(a, b, q)
    taken: dict[int, list[tuple[int, int, int]]] = {}  # by line: what is confirmed there
    got = []
    for alike, _, a, b, best, q in sorted(out):  # the most alike first, then the shortest; nothing inside another, no family twice
        if not any(f == best or (lo <= a and b <= hi) for x in range(a, b + 1) for lo, hi, f in taken.get(x, ())):
            for x in range(a, b + 1):
                taken.setdefault(x, []).append((a, b, best))
            lo, hi = int(line_at[a]), int(line_at[b + 1])
            row = int(np.searchsorted(rel, lo, side="right")) - 1
            head = part[int(rel[row]) : lo]
            text = part[lo:hi].tobytes().decode().rstrip("\n")
            got.append((row, int((head == 10).sum()), len(head.tobytes().decode()), len(text), model.families[best], q, -alike))
    return got


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, start, length, family, confidence, similarity): one row for each line, or run of lines, that holds a known licence.

    ``unit`` is the first line; lines count from 0, offsets are code points of the whole text.  Null and empty texts have no lines; repeated rows each
    give their rows; other columns are ignored.  Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            data, at = texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows = [(ids[lo + r], *rest) for lo, hi in pieces(at) for r, *rest in scan_texts(data, at[lo : hi + 1], sent.value)]
            cols = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "unit", "start", "length", "family", "confidence", "similarity"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, unit int, start int, length int, family string, confidence double, similarity double")
