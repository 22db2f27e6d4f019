"""License scan: winnowed fingerprints pick candidates, banded alignment confirms.

Templates are cut into words (letters and digits, lower-cased); of every ``WINDOW``
neighbouring hashes of ``GRAM`` words the smallest is a fingerprint.  An inverted index
from fingerprint to (template, place) is sent to the tasks; its size is that of the
template list.  All hashes of ``GRAM`` words of a text are looked up, so no occurrence
of a fingerprint is lost.  Hits of a template that follow each other in the template and
in the text, no further apart there than the template is long, are chained; ``DRIFT``
for each word put in or left out between two hits keeps a chain in one copy.  The
longest common subsequence of template and the chain's surroundings (``BAND`` words more
on both sides) counts matched words.  A match of ``coverage`` of the template is
reported with its span in code points.  Templates of fewer than ``SHORT`` words must
match wholly; there hits near one diagonal make a candidate, aligned within ``BAND``.

Null and empty texts have no matches.  Overlapping reports of one template keep the
better one; different templates may overlap.  Repeated rows give equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import lcs, tightest, words_of
from .text import Table, buffers, mix, slices

GRAM, WINDOW, BAND, SHORT, DRIFT = 3, 4, 8, 10, 0.25

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl-v3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-short-line": "Licensed under CC BY 4.0.",
    "gpl-line": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl-line": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "all-rights-line": "All rights reserved. No part of this publication may be reproduced",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    ),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
}


def _grams(words: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x1234567)
    return mix(out)


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the smallest hash of every window, the last of equals."""
    n = len(grams)
    if n <= window:
        return [int(n - 1 - np.argmin(grams[::-1]))] if n else []
    out: list[int] = []
    for i in range(n - window + 1):
        part = grams[i : i + window]
        k = i + window - 1 - int(np.argmin(part[::-1]))
        if not out or out[-1] != k:
            out.append(k)
    return out


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        data, at = buffers(pa.array([templates[n] for n in self.names]))
        w = words_of(data, at)
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(self.names))]
        places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            g = _grams(words)
            for k in winnow(g):
                places.setdefault(int(g[k]), []).append((t, k))
        keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(k)] for k in keys]
        self.table = Table(keys, np.arange(1, len(keys) + 1, dtype=np.float32))
        self.words = [x.tolist() for x in self.words]
        self.times = [Counter(x) for x in self.words]

    def hits(self, hits: np.ndarray, which: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(place in the text, place in the template) of the hits of each template."""
        found: dict[int, list[tuple[int, int]]] = {}
        for place, k in zip(hits.tolist(), which.tolist()):
            for t, at in self.places[k]:
                found.setdefault(t, []).append((place, at))
        return found

    def chains(self, template: int, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Stretches of the text, each around a chain of hits; every hit is in one chain."""
        size = len(self.words[template])
        score, back, first = [], [], 0
        for j, (place, at) in enumerate(hits):
            while place - hits[first][0] > size + BAND:
                first += 1
            best, prior = float(GRAM), -1
            for i in range(j - 1, first - 1, -1):
                p, q = hits[i]
                if q < at and p < place:
                    drift = abs(place - at - p + q)
                    s = score[i] + (min(GRAM, at - q) if drift else at - q) - DRIFT * drift
                    if s > best:
                        best, prior = s, i
            score.append(best)
            back.append(prior)
        used, out = [False] * len(hits), []
        for j in sorted(range(len(hits)), key=lambda j: -score[j]):
            if used[j]:
                continue
            starts = []
            while j >= 0 and not used[j]:
                used[j] = True
                starts.append(hits[j][0] - hits[j][1])
                j = back[j]
            out.append((max(0, min(starts) - BAND), max(starts) + size + BAND))
        return sorted(set(out))

    def near(self, template: int, text: list[int], lo: int, hi: int, coverage: float) -> tuple[int, int, int]:
        """(matched words, first, last + 1 in ``text``) of a stretch, zeros if below ``coverage``."""
        own, part = self.words[template], text[lo:hi]
        if sum(self.times[template][x] for x in self.times[template].keys() & part) < coverage * len(own):
            return 0, 0, 0
        n = lcs(own, part)
        if n < coverage * len(own):
            return 0, 0, 0
        a, z = tightest(own, part, n)
        return n, lo + a, lo + z

    def candidates(self, found: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(template, where its first word would stand); hits within a band make one candidate."""
        found = {t: [place - at for place, at in h] for t, h in found.items()}
        out = []
        for t, starts in found.items():
            last = None
            for s in sorted(starts):
                if last is None or s - last > BAND:
                    out.append((t, s))
                    last = s
        return out

    def align(self, template: int, text: list[int], start: int) -> tuple[int, int, int]:
        """(matched words, first, last + 1 in ``text``) of the best alignment within the band."""
        own = self.words[template]
        lo = start - BAND
        width = 2 * BAND + 1
        # best[d]: (matched, -first word) for template words so far against text up to lo + i + d
        best = [(0, -10**9)] * width
        end = (0, 0, 0)
        for i, x in enumerate(own):
            new = []
            for d in range(width):
                j = lo + i + d
                b = best[d]  # word i and text j pair off or differ
                if 0 <= j < len(text) and text[j] == x:
                    b = (b[0] + 1, b[1] if b[0] else -j)
                    if b[0] > end[0]:
                        end = (b[0], -b[1], j + 1)
                if d + 1 < width and best[d + 1] > b:  # template word left out
                    b = best[d + 1]
                if d and new[d - 1] > b:  # text word left out
                    b = new[d - 1]
                new.append(b)
            best = new
        return end

    def find(self, words: np.ndarray, coverage: float) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, last + 1, matched words, coverage) of one text."""
        which = self.table.get(_grams(words)).astype(np.int64) - 1
        hits = np.flatnonzero(which >= 0)
        if not len(hits):
            return []
        text, out = words.tolist(), {}
        found = self.hits(hits, which[hits])
        short = {t: h for t, h in found.items() if len(self.words[t]) < SHORT}
        matches = [(t, self.align(t, text, s)) for t, s in self.candidates(short)]
        matches += [(t, self.near(t, text, lo, hi, coverage)) for t, h in found.items() if t not in short for lo, hi in self.chains(t, h)]
        for t, (n, a, b) in matches:
            size = len(self.words[t])
            if n >= coverage * size and (n == size or size >= SHORT):
                rows = out.setdefault(t, [])
                if rows and rows[-1][1] < b and a < rows[-1][2]:
                    if n > rows[-1][0]:
                        rows[-1] = (n, a, b)
                else:
                    rows.append((n, a, b))
        return [(self.names[t], a, b, n, n / len(self.words[t])) for t, rows in sorted(out.items()) for n, a, b in rows]


_ROW = "license string, start long, end long, matched_words int, coverage double"


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row for each match: key, license, start, end (code points), matched_words, coverage."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            data, at = buffers(batch.column(1))
            rows, which = [], []
            for i, j in slices(at, 1 << 19):
                w = words_of(data, at[i : j + 1])
                some = index.table.get(_grams(w.hash)) > 0 if len(w.hash) >= GRAM else np.zeros(0, bool)
                for d in np.unique(np.searchsorted(w.first, np.flatnonzero(some), "right") - 1).tolist():
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    raw = w.data[w.offsets[d] : w.offsets[d + 1]]
                    points = None
                    for name, p, q, n, c in index.find(w.hash[a:z], coverage):
                        if points is None:
                            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                        s, e = int(w.start[a + p] - w.offsets[d]), int(w.end[a + q - 1] - w.offsets[d])
                        rows.append((name, int(points[s]), int(points[e]), n, c))
                        which.append(i + d)
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[key, "license", "start", "end", "matched_words", "coverage"])

    return df.select(F.col(key), F.col(text)).mapInArrow(scan, f"`{key}` {kind}, {_ROW}")
