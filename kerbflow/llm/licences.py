"""License scans (operator 2).

Templates and documents are cut into windows of ``WINDOW`` words at every offset.  A window's
MinHash over its word pairs is split into bands; a document window that shares a band with
a template window retrieves the template there.  With ``BANDS`` bands of ``ROWS`` rows,
windows of similarity 1/2 meet with a probability of 0.99, equal ones always, and a copy
offers many windows.  The words around the hit, as many as the template has and ``SLACK``
more on either side, must then contain ``CONTAINED`` of the template's exact ``SHINGLE``-word
shingles.

Templates of fewer than ``WINDOW`` words have no window; they are found where their shingles
stand in a row, by lookup of the first one, so only word for word.  Several templates may
share a name: of their overlapping copies the best one is reported.

Templates are a parameter, small by nature and checked to be; they go to all tasks, so the
scan is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from kerbflow.llm import _text
from kerbflow.llm._cluster import bounded_batches

WINDOW, BANDS, ROWS = 5, 16, 2
#: Windows whose keys are made at a time.
PIECE = 1 << 14
SHINGLE, CONTAINED, SLACK = 3, 0.8, 0.2
#: Words that all templates may have together.
TEMPLATE_WORDS = 500_000

# Common short license notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-header", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
    # the notice alone, and the part that the common wordings of the short notices share
    ("all-rights-reserved-notice", "All rights reserved."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "under the Apache License 2.0"),
    ("Apache-2.0", "under the Apache 2.0 License"),
    ("Apache-2.0", "under the Apache-2.0 License"),
    ("MIT", "under the MIT License"),
    ("MIT", "under an MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "under the terms of the MIT License"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GNU GPL version 3"),
    ("GPL-3.0", "GNU GPL v3"),
    ("GPL-3.0", "under the GPL-3.0 License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("BSD", "under the BSD License"),
    ("BSD", "3-Clause BSD License"),
    ("BSD", "2-Clause BSD License"),
)

# Whole license texts.
TEXTS = (
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two windows of a Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without outer punctuation, and the texts' offsets; words of punctuation go."""
    codes, off, vocabulary = _text.words(texts)
    names = [w.strip(".,;:!?\"'()[]{}<>*#/-_|") for w in vocabulary.to_pylist()]
    full = np.array([bool(n) for n in names] or [False])
    value = np.fromiter((xxhash.xxh64_intdigest(n) for n in names), np.uint64, len(names))
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    return value[codes[keep]], np.concatenate([[0], np.cumsum(keep)])[off]


def _seeds() -> np.ndarray:
    """One odd and one other number a row of each band."""
    make = lambda k: np.uint64(xxhash.xxh64_intdigest(k))
    return np.array([[(make(f"{b}.{r}.odd") | np.uint64(1), make(f"{b}.{r}")) for r in range(ROWS)] for b in range(BANDS)])


_SEEDS, _ODD = _seeds(), np.uint64(0x9E3779B97F4A7C15)


def band_keys(words: np.ndarray) -> np.ndarray:
    """The band keys of all windows of a sequence of word hashes, one row a band."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros((BANDS, 0), np.uint64)
    with np.errstate(over="ignore"):
        pairs = _text.mix(_text.mix(words[:-1]) + words[1:])
        out = np.empty((BANDS, n), np.uint64)
        for band in range(BANDS):
            key = np.full(n, band, np.uint64)
            for odd, seed in _SEEDS[band]:
                h = (pairs ^ seed) * odd
                least = np.minimum(h[:n], h[1 : n + 1])
                for k in range(2, WINDOW - 1):
                    np.minimum(least, h[k : n + k], out=least)
                key = key * _ODD + least
            out[band] = _text.mix(key)
    return out


def _shingle_hashes(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return _text.shingles(words, off, SHINGLE)


class TemplateIndex:
    """Templates by the band keys of their windows."""

    def __init__(self, templates: list[tuple[str, str]]):
        hashes, off = _word_hashes(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.words = [hashes[a:b] for a, b in zip(off[:-1], off[1:])]
        short = [n for n, w in zip(self.names, self.words) if len(w) < SHINGLE]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        if off[-1] > TEMPLATE_WORDS:
            raise ValueError(f"templates of {off[-1]} words; at most {TEMPLATE_WORDS} are sent to all tasks")
        rows = [_shingle_hashes(w, np.array([0, len(w)]))[0] for w in self.words]
        self.shingles = [np.unique(r) for r in rows]
        self.short = defaultdict(list)
        for t, row in enumerate(rows):
            if len(self.words[t]) < WINDOW:
                self.short[int(row[0])].append((t, row))
        self.short_keys = np.array(sorted(self.short), np.uint64)
        where = defaultdict(set)
        for t, w in enumerate(self.words):
            for at, row in enumerate(band_keys(w).T):
                for key in row:
                    where[int(key)].add((t, at))
        self.where = {k: sorted(v) for k, v in where.items()}
        self.keys = np.array(sorted(self.where), np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.any = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)
        self.any_filter = np.zeros(1 << 20, bool)
        self.any_filter[(self.any >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(window, key) of the windows that share a band with a template, a piece at a time."""
        out = []
        for a in range(0, max(len(words) - WINDOW + 1, 0), PIECE):
            keys = band_keys(words[a : a + PIECE + WINDOW - 1])
            bands, rows = np.nonzero(self.filter[(keys >> np.uint64(44)).astype(np.int64)])
            out += zip((rows + a).tolist(), keys[bands, rows].tolist())
        return out

    def scan(self, words: np.ndarray, off: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first word, end, containment) of the verified copies, the best of overlapping ones.

        ``words`` holds all texts in a row.  Before a region is compared with a template, its
        shingles that any template has are counted: fewer than the template needs cannot do.
        """
        shingles, s_off = _shingle_hashes(words, off)
        known = self.any_filter[(shingles >> np.uint64(44)).astype(np.int64)]
        known[known] = np.isin(shingles[known], self.any)
        before = np.concatenate([[0], np.cumsum(known)])
        starts = defaultdict(set)
        for row, key in self.hits(words):
            for t, at in self.where.get(key, ()):
                starts[t, row - at].add(row)
        found = defaultdict(list)
        for (t, p), rows in sorted(starts.items()):
            size = len(self.words[t])
            slack = int(np.ceil(SLACK * size))
            for text in {int(x) for x in np.searchsorted(off, sorted(rows), side="right") - 1}:
                low, high = int(off[text]), int(off[text + 1])
                if not any(low <= r and r + WINDOW <= high for r in rows):
                    continue  # such a window runs over the text's end
                a, b = max(low, p - slack), min(high, p + size + slack)
                x, y = a - low + int(s_off[text]), min(b - low - SHINGLE + 1 + int(s_off[text]), int(s_off[text + 1]))
                if before[max(x, y)] - before[x] < CONTAINED * len(self.shingles[t]):
                    continue
                share = float(np.isin(self.shingles[t], shingles[x:y]).mean())
                if share >= CONTAINED:
                    best, first, end = found[text, t], max(low, p) - low, min(high, p + size) - low
                    if best and first < best[-1][3]:
                        if share > best[-1][4]:
                            best[-1] = (text, self.names[t], first, end, share)
                    else:
                        best.append((text, self.names[t], first, end, share))
        at = np.flatnonzero(known)
        for i in at[np.isin(shingles[at], self.short_keys)].tolist():
            text = int(np.searchsorted(s_off, i, side="right")) - 1
            for t, row in self.short[int(shingles[i])]:
                if i + len(row) <= s_off[text + 1] and np.array_equal(shingles[i : i + len(row)], row):
                    first = i - int(s_off[text])
                    found[text, t].append((text, self.names[t], first, first + len(self.words[t]), 1.0))
        return self._best(found)

    def _best(self, found: dict) -> list[tuple[int, str, int, int, float]]:
        """The copies without those that overlap a better or longer one of another template of that name."""
        named = defaultdict(list)
        for (text, t), listed in sorted(found.items()):
            named[text, self.names[t]] += [(f, t) for f in listed]
        out = []
        for listed in named.values():
            kept, covered = [], {}
            for f, t in sorted(listed, key=lambda x: (-x[0][4], x[0][2] - x[0][3], x[0][2])):
                place = range(f[2], f[3])
                if all(covered.get(k, t) == t for k in place):
                    kept.append(f)
                    covered |= dict.fromkeys(place, t)
            out += sorted(kept)
        return out


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES + TEXTS) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment) of each notice in each row of ``docs``.

    Word positions count words with a letter or digit.  Null, empty and short texts hold no
    notice.  Repeated rows are reported each, of overlapping copies of one template the one with
    the higher containment, then the first; an empty table gives no rows; further columns,
    whatever their names, are ignored.  A long text is scanned in slices of windows.
    """
    bounded_batches(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(list(templates)))

    def run(batches):
        t = index.value
        for batch in batches:
            for part in _text.slices(batch):
                hashes, off = _word_hashes(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                out = [(ids[f[0]], *f[1:]) for f in t.scan(hashes, off)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "license", "first_word", "end_word", "containment"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double")
