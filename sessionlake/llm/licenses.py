"""Operator 5: licence scan of paragraphs by a trained classifier, confirmed by templates.

A text is cut into paragraphs at blank lines; within a paragraph, line breaks are only white space, so a
notice wrapped at any width stays together. Each paragraph is scored in units: each of its lines by itself
(a notice may stand between other lines) and windows of WINDOW and of half as many words, at every half of
their length (it may stand inside a long paragraph, or be longer than a window). Notices are compared in pieces
of at most half a WINDOW, so some window holds each piece whole.

`train` fits a multinomial logistic regression on hashed word 1- and 2-grams. Its positives are the pieces
of NOTICES, each many times with words dropped and foreign words around it; its negatives, the class
`unknown`, are paragraphs of a bounded sample of the corpus (SAMPLE documents, PARAGRAPHS of each, CHARS of
each paragraph), the notices of OTHERS, and licence words in random order. Not fitted, but calibrated on,
are HELD notices, worded otherwise, and a fifth of the negatives: on these the temperature of the
probabilities is fitted, and the least probability at which a family may be named (`floor`) is set so that
at most FALSE_RATE of the held-out unknown units are named.

`scan` scores every unit of every whole text. A family is named only if its probability reaches the
floor, the unit holds at least CONFIRM of the 2-grams of a piece of its notices (CONFIRM_SHORT of a short one's), and no other family's
piece is held better; other units stay unknown. A bare reservation of rights (`proprietary`) beside a licence in
one text grants nothing and takes nothing away: it counts only where no licence is found.

Null or empty text: no paragraphs, no licence. A very long text is scored in chunks of its own size class, a
long word is one word. Ties in probability go to the family that comes first by code point. Each row is scanned
by itself, so repeated rows agree; other columns stay, but for former ones named like the result's. Without a
corpus to sample (an empty table) the negatives are OTHERS and the shuffled notices alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words
from .common import bounded_sample, query, tidy

BUCKETS, SAMPLE, PARAGRAPHS, CHARS, COPIES, EPOCHS = 1 << 15, 1500, 1, 400, 16, 50
WINDOW, FALSE_RATE, CHUNK = 48, 0.002, 1 << 18
#: The share of a piece's 2-grams that confirms it, and the same for pieces of at most SHORT 2-grams.
CONFIRM, CONFIRM_SHORT, SHORT = 0.6, 0.75, 5
UNKNOWN, RESERVED = "unknown", "proprietary"

#: Usual licence notices of each family.
NOTICES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the AGPLv3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License 2.0.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Released under the GNU GPL v2.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GNU GPL v3.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    RESERVED: ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission."],
}
#: Notices of licences that no family stands for, near to those above.
OTHERS = [
    "Licensed under the Artistic License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the zlib license.", "Licensed under the European Union Public Licence 1.2.", "Released under the terms of the Academic Free License version 3.0.",
    "Licensed under the Microsoft Public License.", "Licensed under the Common Development and Distribution License 1.0.", "Licensed under the PostgreSQL License.",
    "Licensed under the Open Database License 1.0.", "You need a licence to drive this car.", "The fishing license was issued by the county office.",
    "Permission to enter the building is granted by the porter.", "This notice is published by the town.", "See the LICENSE file for details.",
]
#: Other wordings, for calibration only.
HELD = {
    "Apache-2.0": ["This project is licensed under the Apache License, Version 2.0, see LICENSE."],
    "BSD-3-Clause": ["This code is licensed under the BSD 3-Clause License, see LICENSE."],
    "CC-BY-4.0": ["Unless noted otherwise, text is licensed under CC BY 4.0 here."],
    "CC-BY-NC-4.0": ["All images are licensed under CC BY-NC 4.0 unless stated."],
    "CC-BY-SA-4.0": ["Content is licensed under CC BY-SA 4.0 by its authors."],
    "GPL-3.0": ["The program is licensed under the GNU General Public License, version 3, or later."],
    "MIT": ["This package is released under the MIT License, as in LICENSE."],
    "MPL-2.0": ["Our code is licensed under the Mozilla Public License 2.0 too."],
}

#: Letters in lower case, ASCII punctuation as space, line breaks as they are.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[i for i in range(0x80) if not chr(i).isalnum() and i != 10]] = 0x20


def _folded(text: str) -> list[bytes]:
    return bytes(_FOLD[np.frombuffer(text.encode(), np.uint8)]).split()


def _pieces(notice: str) -> list[str]:
    """A notice in runs of at most half a window of words, about equally long."""
    own = notice.split()
    n = -(-len(own) // (WINDOW // 2))
    return [" ".join(own[len(own) * i // n : len(own) * (i + 1) // n]) for i in range(n)]


def shingles(own: list[bytes]) -> frozenset:
    return frozenset(zip(own, own[1:])) or frozenset((w,) for w in own)


PIECES = {family: [x for notice in notices for x in _pieces(notice)] for family, notices in NOTICES.items()}
_TEMPLATES = {family: [shingles(_folded(x)) for x in pieces] for family, pieces in PIECES.items()}


def similarities(own: list[bytes]) -> dict[str, float]:
    """For each family: the share of a piece's 2-grams that these words hold, for the best of its pieces (of short ones
    with too small a share, none)."""
    held = shingles(own)

    def share(t: frozenset) -> float:
        part = len(held & t) / len(t)
        return part if len(t) > SHORT or part >= CONFIRM_SHORT else 0.0

    return {family: max(map(share, templates)) for family, templates in _TEMPLATES.items()}


def confirmed(own: list[bytes], family: str) -> float | None:
    """The family's similarity, if it is enough and no other family's is greater."""
    like = similarities(own)
    return like[family] if like[family] >= max(CONFIRM, max(like.values())) else None


class Units:
    """The words of folded texts, cut into paragraphs and these into units (ranges of words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, first = words.segment(data, offsets)
        n = len(self.starts)
        breaks = np.append(0, np.cumsum(data == 10))
        between = breaks[self.starts[1:]] - breaks[self.ends[:-1]] if n else np.zeros(0, np.int64)
        opens = np.zeros(n, bool)
        opens[first[:-1][first[:-1] < first[1:]]] = True
        line = opens.copy()
        opens[1:] |= between > 1
        line[1:] |= between > 0
        at = np.append(np.flatnonzero(opens), n)
        lines = np.append(np.flatnonzero(line), n)
        whole = np.diff(at)
        units = []
        for size in (WINDOW, WINDOW // 2):  # one window for a short paragraph, else at every half window, the last one at its end
            count = np.maximum(1, -(-(whole - size) // (size // 2)) + 1) * ((whole > size) | (size == WINDOW))
            of = np.repeat(np.arange(len(whole)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            lo = at[:-1][of] + np.minimum(nth * (size // 2), np.maximum(0, whole[of] - size))
            units.append((lo, np.minimum(lo + size, at[1:][of]), of))
        size = np.diff(lines)
        own = np.searchsorted(at, lines[:-1], "right") - 1
        extra = (size <= WINDOW) & (size < whole[own]) if n else np.zeros(0, bool)
        units.append((lines[:-1][extra], lines[1:][extra], own[extra]))
        self.lo, self.hi, self.paragraph = (np.concatenate(x).astype(np.int64) for x in zip(*units))
        self.text = np.searchsorted(first, at[:-1], "right") - 1  # of each paragraph
        h = words.hashes(data, self.starts, self.ends)
        self.one, self.two = h, words.mix(h[:-1] * np.uint64(3) + h[1:]) if n else h

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each unit: the sum of its 1- and 2-grams' weights over the root of their number."""
        total = [np.zeros((len(x) + 1, weights.shape[1])) for x in (self.one, self.two)]
        for x, t in zip((self.one, self.two), total):
            np.cumsum(weights[_bucket(x, len(weights))], 0, out=t[1:], dtype=np.float64)
        n = 2 * (self.hi - self.lo) - 1
        return (total[0][self.hi] - total[0][self.lo] + total[1][self.hi - 1] - total[1][self.lo]) / np.sqrt(n)[:, None]

    def words(self, data: np.ndarray, unit: int) -> list[bytes]:
        return data[self.starts[self.lo[unit]] : self.ends[self.hi[unit] - 1]].tobytes().split()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % buckets


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


class Model:
    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.families, self.weights, self.bias, self.temperature, self.floor = families, weights, bias, temperature, floor

    def probabilities(self, units: Units) -> np.ndarray:
        return _softmax((units.sums(self.weights) + self.bias) / self.temperature)


def _sample_paragraphs(docs: DataFrame, sample: int) -> list[str]:
    """PARAGRAPHS paragraphs of each of about `sample` documents, chosen by hash, CHARS of each."""
    parts = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda x: F.length(x) > 0)
    picked = F.slice(F.array_sort(F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, CHARS).alias("x")))), 1, PARAGRAPHS)
    rows = bounded_sample(docs.select("doc_id", "text"), sample).select(F.explode(picked).alias("p")).select("p.x").collect()
    return sorted(r.x for r in rows)


def _unit_texts(paragraphs: list[str]) -> list[list[bytes]]:
    """The units of paragraphs, as words."""
    data, offsets = words.text_buffer(pa.array(paragraphs, pa.string()))
    data = _FOLD[data]
    units = Units(data, offsets)
    return [units.words(data, i) for i in range(len(units.lo))]


def train(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, copies: int = COPIES, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(5)
    # Units of the sample that look like a notice are left out: nobody has said what they are.
    negatives = [x for x in _unit_texts(_sample_paragraphs(docs, sample)) if max(similarities(x).values()) < 0.5]
    foreign = np.array(sorted({w for x in negatives for w in x}) or [b"text"], object)
    families = [*sorted(NOTICES), UNKNOWN]
    texts, labels, held = list(negatives), [len(NOTICES)] * len(negatives), list(rng.random(len(negatives)) < 0.2)

    def varied(notice: str, label: int) -> None:
        for i in range(copies):
            own = [w for w in _folded(notice) if i == 0 or rng.random() > 0.05]
            around = [list(rng.choice(foreign, rng.integers(0, (WINDOW - len(own)) // 2 + 1))) if i % 3 else [] for _ in range(2)]
            texts.append([*around[0], *own, *around[1]])
            labels.append(label)
            held.append(False)

    for k, family in enumerate(families[:-1]):
        for piece in PIECES[family]:
            varied(piece, k)
        for notice in HELD.get(family, []):
            texts.append(_folded(notice)), labels.append(k), held.append(True)
    for notice in OTHERS:
        varied(notice, len(NOTICES))
    vocabulary = np.array([w for pieces in PIECES.values() for x in pieces for w in _folded(x)], object)
    for i in range(copies * 20):
        texts.append(list(rng.choice(vocabulary, rng.integers(2, 10)))), labels.append(len(NOTICES)), held.append(i % 5 == 0)

    # One text a paragraph, none longer than a window.
    texts, y, held = [x[:WINDOW] or [b"x"] for x in texts], np.array(labels), np.array(held)
    data, offsets = words.text_buffer(pa.array([b" ".join(x).decode("utf-8", "replace") for x in texts], pa.string()))
    units = Units(data, offsets)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    inner = owner[:-1] == owner[1:]
    grams, owner = np.concatenate([_bucket(units.one, buckets), _bucket(units.two, buckets)[inner]]), np.concatenate([owner, owner[:-1][inner]])
    order = np.argsort(owner, kind="stable")
    used, dense = np.unique(grams[order], return_inverse=True)
    owner = owner[order]
    n = np.bincount(owner, minlength=len(texts))
    scale = (1 / np.sqrt(n)).astype(np.float32)
    n_families, fit = len(families), np.flatnonzero(~held[owner])
    small, speed = np.zeros((n_families, len(used)), np.float32), np.full((n_families, len(used)), 1e-8, np.float32)
    bias, bias_speed = np.zeros(n_families), np.full(n_families, 1e-8)
    logits = lambda: np.stack([np.bincount(owner, small[c][dense], len(texts)) * scale + bias[c] for c in range(n_families)], 1)
    importance = np.where(held, 0, (1 / np.maximum(1, np.bincount(y[~held], minlength=n_families)))[y]) / n_families
    for _ in range(epochs):  # whole-batch AdaGrad
        p = _softmax(logits())
        p[np.arange(len(y)), y] -= 1
        p *= importance[:, None]
        flow = np.ascontiguousarray((p * scale[:, None]).T.astype(np.float32))
        for c in range(n_families):
            slope = np.bincount(dense[fit], flow[c][owner[fit]], len(used)).astype(np.float32) + 1e-6 * small[c]
            speed[c] += slope**2
            small[c] -= 0.5 * slope / np.sqrt(speed[c])
        bias_slope = p.sum(0)
        bias_speed += bias_slope**2
        bias -= 0.2 * bias_slope / np.sqrt(bias_speed)
    weights = np.zeros((buckets, n_families), np.float32)
    weights[used] = small.T
    raw, own = logits()[held], y[held]
    loss = {t: -np.log(_softmax(raw / t)[np.arange(len(own)), own] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(loss, key=lambda t: (loss[t], t))
    return Model(families, weights, bias, temperature, _floor(_softmax(raw / temperature), own, [texts[i] for i in np.flatnonzero(held)], families))


def _floor(p: np.ndarray, y: np.ndarray, texts: list[list[bytes]], families: list[str]) -> float:
    """The least probability at which at most FALSE_RATE of the held-out unknown units would be named."""
    unknown = np.flatnonzero(y == len(NOTICES))
    best = p[:, :-1].argmax(1)
    named = sorted((float(p[i, best[i]]) for i in unknown if p[i].argmax() < len(NOTICES) and confirmed(texts[i], families[best[i]]) is not None), reverse=True)
    allowed = int(FALSE_RATE * len(unknown))
    return max(0.5, float(np.nextafter(named[allowed], 2))) if len(named) > allowed else 0.5


FOUND = "n_paragraphs bigint, n_licensed bigint, families string, family string, probability double, similarity double, paragraph bigint"


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without its text, with: paragraphs, licensed ones, their families, and of the likeliest unit its family,
    probability, similarity to the notice and paragraph (from 0); family `unknown` and nulls if there is none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = [f.name for f in StructType.fromDDL(FOUND)]
    names = [c for c in docs.columns if c not in (text, *found)]
    place, others = docs.columns.index(text), [docs.columns.index(n) for n in names]

    def scanned(batches):
        m = shared.value
        for batch in batches:
            data, offsets = words.text_buffer(batch.column(place))
            rows = []
            for lo, hi in words.chunks(offsets, CHUNK):
                rows += scan_texts(_FOLD[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], m)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds))], [*names, *found])

    return docs.mapInArrow(tidy(scanned), StructType([docs.schema[n] for n in names] + StructType.fromDDL(FOUND).fields))


def scan_texts(data: np.ndarray, offsets: np.ndarray, m: Model) -> list[tuple]:
    """One row of FOUND for each of these folded texts."""
    units = Units(data, offsets)
    p = m.probabilities(units)
    best = p.argmax(1)
    likely = np.flatnonzero((best < len(m.families) - 1) & (p[np.arange(len(p)), best] >= m.floor))
    first = np.searchsorted(units.text, np.arange(len(offsets)))
    hits: dict[int, list] = {}
    for i in likely.tolist():
        like = confirmed(units.words(data, i), m.families[best[i]])
        if like is not None:
            paragraph = int(units.paragraph[i])
            doc = int(units.text[paragraph])
            hits.setdefault(doc, []).append((float(p[i, best[i]]), like, paragraph - int(first[doc]), m.families[best[i]], int(units.lo[i]), int(units.hi[i])))
    rows = []
    for doc in range(len(offsets) - 1):
        h = []
        for x in sorted(hits.get(doc, []), key=lambda x: (-x[1], -x[0], x[3], x[4])):  # of overlapping units, the better confirmed one
            if all(x[3] == y[3] or x[5] <= y[4] or y[5] <= x[4] for y in h):
                h.append(x)
        h = [x for x in h if x[3] != RESERVED] or h
        top = min(h, key=lambda x: (-x[0], x[3], x[2])) if h else (None, None, None, UNKNOWN)
        rows.append((int(first[doc + 1] - first[doc]), len({x[2] for x in h}), ",".join(sorted({x[3] for x in h})), top[3], top[0], top[1], top[2]))
    return rows


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
