"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Sparse word n-grams (2 and 3 words, and single telling words) feed a softmax regression over licence families and a
class ``unknown``. Training rows are made from the templates below, and from a bounded sample of paragraphs of the
corpus as unknown ones. Temperature and bias of the unknown class are calibrated on held-out rows. A prediction is
confirmed if enough of a template of the family stands in the paragraph: a line, or neighbouring lines that a notice is
wrapped over.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import linear as L
from .common import clean_texts, map_arrow

#: Documents whose paragraphs serve as unknown ones in training at most, and paragraphs used; scoring covers every row.
SAMPLE_ROWS, SAMPLE_PARAGRAPHS = 200, 1500
#: Least calibrated probability of not being unknown, and least share of a template's n-grams that confirms it.
THRESHOLD, CONFIRM = 0.5, 0.6
UNKNOWN = "unknown"

# Short notices by which licence families are declared (public standard wording).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights; dedicated to the public domain under CC0 1.0 Universal."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
FAMILIES = [*TEMPLATES, UNKNOWN]

_PLAIN = K.LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum() and c != 10]] = 0x20


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the n-grams that templates have
    weights: np.ndarray  # keys x families
    bias: np.ndarray
    templates: list[tuple[int, np.ndarray]]  # family, numbers of the template's n-grams


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines of each row (the first of a row starts at its offset), and each line's row."""
    inner = np.zeros(len(data) + 1, bool)
    inner[np.flatnonzero(data == 10) + 1] = True
    inner[offsets] = True
    start = np.flatnonzero(inner[:-1])
    return np.append(start, len(data)), np.searchsorted(offsets, start, "right") - 1


def spread_hits(data: np.ndarray, bounds: np.ndarray, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, number) of each n-gram of a row that is among keys; no line without words lies within one."""
    plain = _PLAIN[data]
    starts, ends, first = K.words(plain, bounds)
    sums = K.prefix(K.span_hash(K.byte_prefix(plain), starts, ends))
    may = np.zeros(1 << 18, bool)
    may[keys >> K.U(46)] = True
    found = []
    for k in (2, 3):
        h = K.gram_hash(sums, k)
        at = np.flatnonzero(may[h >> K.U(46)])
        number = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        good = keys[number] == h[at]
        at, number = at[good], number[good]
        line = np.array([np.searchsorted(first, at + i, "right") - 1 for i in range(k)])
        near = (np.diff(line, axis=0) <= 1).all(axis=0) & (row[line[0]] == row[line[-1]])
        found.append((line[0][near], line[-1][near], number[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def hits(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, number of the n-gram) of each n-gram of a paragraph that is among keys."""
    first, last, number = spread_hits(data, bounds, np.arange(len(bounds) - 1), keys)
    return first, number


def _wrapped(low: list[int], high: list[int], number: list[int], need: int, alone: set[int], other: set[int]) -> list[tuple[int, int]]:
    """Bounds (first and last line) of the shortest runs of lines with so many different n-grams of a template, from the top.

    A run takes in the lines that the notice runs on into: an n-gram crosses the break and the line has more of the
    template. No run holds lines of ``other`` families' notices, nor takes in lines that are notices ``alone``.
    """
    of_line: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(high):
        of_line[b].append(i)
    crossed = {a for a, b in zip(low, high) if a < b} | {b - 1 for a, b in zip(low, high) if a < b}
    touched = set(low) | set(high) | {a + 1 for a, b in zip(low, high) if a < b}
    out, latest, floor = [], {}, -1  # latest: the last line at which each n-gram began
    lines = sorted(touched)
    at = 0
    while at < len(lines):
        b = lines[at]
        if b in other or (at and lines[at - 1] != b - 1):
            latest, floor = {}, b if b not in other else b + 1
        for i in of_line[b]:
            if low[i] >= floor:
                latest[number[i]] = max(latest.get(number[i], -1), low[i])
        at += 1
        if len(latest) < need:
            continue
        a = sorted(latest.values(), reverse=True)[need - 1]

        def held(a, b):
            return {number[i] for line in range(a, b + 1) for i in of_line[line] if low[i] >= a}

        own = held(a, b)
        while b in crossed and b + 1 in touched and b + 1 not in alone and len(more := held(a, b + 1)) > len(own):
            b, own = b + 1, more
        while a - 1 >= floor and a - 1 in crossed and a - 1 in touched and a - 1 not in alone and len(more := held(a - 1, b)) > len(own):
            a, own = a - 1, more
        out.append((a, b))
        latest, floor = {}, b + 1
        while at < len(lines) and lines[at] <= b:
            at += 1
    return out


def wrapped(m: Model, first: np.ndarray, last: np.ndarray, number: np.ndarray, row: np.ndarray, confirm: float, single: dict[int, int]) -> list[tuple[int, int, int]]:
    """(first line, last line, template) of each run of several lines that holds enough of a template's n-grams.

    single: the lines that are confirmed notices by themselves, and their family.
    """
    order = np.lexsort((last, first))
    first, last, number = first[order], last[order], number[order]
    out = []
    for t, (family, own) in enumerate(m.templates):
        has = np.zeros(len(m.keys), bool)
        has[own] = True
        at = np.flatnonzero(has[number])
        need = max(1, int(np.ceil(confirm * len(own) - 1e-9)))
        if len(at) < need:
            continue
        low, high, n = first[at], last[at], number[at]
        reach = np.maximum.accumulate(high)
        new = np.ones(len(at), bool)  # a run of lines ends where a line has none of the template
        new[1:] = (low[1:] > reach[:-1] + 1) | (row[low[1:]] != row[low[:-1]])
        run = np.cumsum(new) - 1
        pairs = np.unique(run * len(m.keys) + n) // len(m.keys)
        rich = np.bincount(pairs, minlength=run[-1] + 1) >= need
        edge = np.append(np.flatnonzero(new), len(at))
        for i in np.flatnonzero(rich).tolist():
            a, b = edge[i], edge[i + 1]
            if low[a] == reach[b - 1]:
                continue
            near = {p: f for p in range(int(low[a]), int(reach[b - 1]) + 1) if (f := single.get(p)) is not None}
            spans = _wrapped(low[a:b].tolist(), high[a:b].tolist(), n[a:b].tolist(), need, set(near), {p for p, f in near.items() if f != family})
            out += [(p, q, t) for p, q in spans if p < q]
    return out


def vocabulary(texts: list[str]) -> np.ndarray:
    data, offsets = L.texts_of(texts)
    plain = _PLAIN[data]
    starts, ends, first = K.words(plain, offsets)
    sums, row = K.prefix(K.span_hash(K.byte_prefix(plain), starts, ends)), K.rows_of(first)
    out = [K.gram_hash(sums, k)[np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])] for k in (2, 3)]
    return np.unique(np.concatenate(out))


def _table(texts: list[str], keys: np.ndarray) -> np.ndarray:
    data, offsets = L.texts_of([t.replace("\n", " ") for t in texts])
    row, number = hits(data, offsets, keys)
    out = np.zeros((len(texts), len(keys)))
    out[row, number] = 1
    return out / np.sqrt(np.maximum(1, out.sum(axis=1, keepdims=True)))


def _augmented(seed: int) -> tuple[list[str], list[int]]:
    """Template notices whole, joined, cut and within other words, so that partial notices are known too."""
    rng = np.random.default_rng(seed)
    texts, family = [], []
    filler = "the file project and its contents by authors of this for see also page about text".split()
    for f, notices in enumerate(TEMPLATES.values()):
        for notice in notices:
            words = notice.split()
            for _ in range(12):
                cut = words[: max(4, int(len(words) * rng.uniform(0.7, 1)))]
                pad = [list(rng.choice(filler, rng.integers(0, 4))) for _ in range(2)]
                texts.append(" ".join([*pad[0], *cut, *pad[1]]))
                family.append(f)
    for _ in range(200):
        texts.append(" ".join(rng.choice(filler, 12)))
        family.append(len(FAMILIES) - 1)
    return texts, family


def fit(unknown: list[str], steps: int = 150) -> Model:
    keys = vocabulary([t for notices in TEMPLATES.values() for t in notices])
    texts, family = _augmented(1)
    texts, family = texts + unknown[::2], np.array(family + [len(FAMILIES) - 1] * len(unknown[::2]))
    x, n, c = _table(texts, keys), len(texts), len(FAMILIES)
    y = np.eye(c)[family]
    w, b = np.zeros((len(keys), c)), np.zeros(c)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(c), np.zeros(c)
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        r = (p / p.sum(axis=1, keepdims=True) - y) / n
        g, gb = x.T @ r + 1e-5 * w, r.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    # calibration of known against unknown on other draws: Platt on the margin over the unknown class
    texts, family = _augmented(2)
    texts, family = texts + unknown[1::2], np.array(family + [c - 1] * len(unknown[1::2]))
    z = _table(texts, keys) @ w + b
    a, shift = L.platt(z[:, :-1].max(axis=1) - z[:, -1], (family < c - 1).astype(int))
    w, b = w * a, b * a
    b[-1] -= shift
    templates = []
    for f, notices in enumerate(TEMPLATES.values()):
        for notice in notices:
            _, number = hits(*L.texts_of([notice]), keys)
            templates.append((f, np.unique(number)))
    return Model(keys, w, b, templates)


#: Words of lines that name a licence: such lines are no examples of unknown paragraphs.
CUES = "licen|copyright|rights reserved|spdx|creative commons|public domain"


def train(documents: DataFrame) -> Model:
    """Unknown paragraphs are SAMPLE_PARAGRAPHS lines at most, drawn by hash from SAMPLE_ROWS documents drawn by hash; lines that name a licence stay out.

    Ids are drawn first, so that no task sends texts but those of the drawn documents. Without documents the model
    knows its templates only.
    """
    texts = clean_texts(documents).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    lines = texts.join(F.broadcast(ids.distinct()), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    drawn = lines.where(~F.lower("line").rlike(CUES)).orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS)
    return fit([r["line"] for r in drawn.collect()])


SCHEMA = "doc_id long, paragraph long, start long, length long, family string, probability double, similarity double, confirmed boolean"


def scan(documents: DataFrame, model: Model, threshold: float = THRESHOLD, confirm: float = CONFIRM) -> DataFrame:
    """One row per paragraph (line, or run of lines) that the model takes for a licence notice.

    paragraph counts the lines of the text from 0, the first one of a run; start and length are in code points. family:
    the most probable one; probability: calibrated, of any licence; similarity: largest share of a template's n-grams
    that the paragraph has, over the family's templates; confirmed: similarity at least ``confirm``; unconfirmed
    predictions are reported as family ``unknown``. A notice that is wrapped over neighbouring lines, with no blank
    line between, is one confirmed row, in place of its lines' own. Null and empty texts have no paragraphs; repeated
    rows are reported each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m = shared.value
        least = np.log(threshold / (1 - threshold))

        def similar(own: np.ndarray, f: int) -> float:
            return max((len(np.intersect1d(own, t, True)) / max(1, len(t)) for g, t in m.templates if g == f), default=0.0)

        for low, high, data, offsets in K.pieces(batch.column(1)):
            bounds, row = paragraphs(data, offsets)
            first, last, gram = spread_hits(data, bounds, row, m.keys)
            where, number = first[first == last], gram[first == last]
            order = np.lexsort((number, where))
            where, number = where[order], number[order]
            fresh = np.ones(len(where), bool)
            fresh[1:] = (where[1:] != where[:-1]) | (number[1:] != number[:-1])
            where, number = where[fresh], number[fresh]
            near, at = np.unique(where, return_index=True)
            found: dict[tuple[int, int], tuple[int, float, float]] = {}  # first and last line: family, similarity, margin
            if len(near):
                z = np.add.reduceat(m.weights[number], at, axis=0) / np.sqrt(np.diff(np.append(at, len(where))))[:, None] + m.bias
                margin = z[:, :-1].max(axis=1) - z[:, -1]
                for i in np.flatnonzero(margin >= least):
                    own = number[at[i] : at[i + 1] if i + 1 < len(at) else len(number)]
                    f = int(z[i, :-1].argmax())
                    found[int(near[i]), int(near[i])] = f, similar(own, f), float(margin[i])
            single = {p: f for (p, _), (f, s, _) in found.items() if s >= confirm}
            runs = []
            if (first < last).any():
                order = np.argsort(first, kind="stable")
                first, last, gram = first[order], last[order], gram[order]
                for p, q in {(p, q) for p, q, _ in wrapped(m, first, last, gram, row, confirm, single)}:
                    at = slice(np.searchsorted(first, p), np.searchsorted(first, q, "right"))
                    own = np.unique(gram[at][last[at] <= q])
                    y = m.weights[own].sum(axis=0) / np.sqrt(len(own)) + m.bias
                    f, edge = int(y[:-1].argmax()), float(y[:-1].max() - y[-1])
                    if edge >= least and (s := similar(own, f)) >= confirm:
                        runs.append((-s, q - p, p, q, f, edge))
            used: set[int] = set()
            for s, _, p, q, f, edge in sorted(runs):
                if used.isdisjoint(range(p, q + 1)):
                    used.update(range(p, q + 1))
                    for line in range(p, q + 1):
                        if single.get(line, f) == f:
                            found.pop((line, line), None)
                    found[p, q] = f, -s, edge
            out = []
            for (p, q), (f, similarity, edge) in sorted(found.items()):
                r = row[p]
                start = int(((data[offsets[r] : bounds[p]] & 0xC0) != 0x80).sum())
                line = data[bounds[p] : bounds[q + 1]]
                length = int(((line & 0xC0) != 0x80).sum()) - (len(line) > 0 and line[-1] == 10)
                out.append((batch.column(0)[low + int(r)].as_py(), int(p - np.searchsorted(row, r)), start, length, FAMILIES[f] if similarity >= confirm else UNKNOWN, float(L.sigmoid(edge)), float(similarity), bool(similarity >= confirm)))
            if out:
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return map_arrow(clean_texts(documents), SCHEMA, run)
