"""Licence scans: normalised text compared to licence templates by the Dice
coefficient over word bigrams, with size bounds that prune candidate templates.

Normal form is the text's words in lower case without marks. A template may
stand anywhere in a text, so it is compared with windows of the text. With the
least Dice coefficient t, a window of m bigrams can match a template of n only
if n * t / (2 - t) <= m <= n * (2 - t) / t, and must hold n * t / (2 - t) of its
bigrams; texts too short and places with too few are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix64, slices, word_hashes

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: fixed values: licence and the texts of its notices
TEMPLATES = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names = [n for n, _ in templates]
        own = [bigrams(word_hashes([t])[0]) for _, t in templates]
        assert all(len(b) for b in own), "a template needs two words"
        self.sizes = np.array([len(b) for b in own])
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.threshold = threshold
        self.known = np.unique(np.concatenate(own))
        # how often each template holds each bigram
        self.held = np.stack([np.bincount(np.searchsorted(self.known, b), minlength=len(self.known)) for b in own])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def _best(self, template: int, at: np.ndarray, which: np.ndarray) -> tuple[float, int, int] | None:
        """Dice, first bigram and bigrams of the best window; windows begin and end at bigrams of the template."""
        n, best = int(self.sizes[template]), None
        enough = np.searchsorted(at, at + self.most[template]) - np.arange(len(at)) >= self.least[template]
        for i in np.flatnonzero(enough):
            left, common = self.held[template].copy(), 0
            for j in range(i, len(at)):
                m = int(at[j] - at[i]) + 1
                if m > self.most[template]:
                    break
                if left[which[j]] > 0:
                    left[which[j]] -= 1
                    common += 1
                dice = 2 * common / (n + m)
                if dice >= self.threshold - 1e-9 and (best is None or (dice, -at[i], -m) > (best[0], -best[1], -best[2])):
                    best = (dice, int(at[i]), m)
        return best

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """text, template, Dice, first word and words of each template's best window in each text, if one reaches the threshold."""
        out = []
        for a, b in slices(texts):
            words, offsets = word_hashes(texts[a:b])
            pairs = bigrams(words)
            maybe = np.flatnonzero(self.sieve[(pairs >> np.uint64(44)).astype(np.int64)])
            which = np.searchsorted(self.known, pairs[maybe])
            real = self.known[np.minimum(which, len(self.known) - 1)] == pairs[maybe]
            at, which = maybe[real], which[real]
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + 1 < offsets[text + 1]  # not the pair of one text's last word and the next one's first
            at, which, text = at[inside], which[inside], text[inside]
            size = np.diff(offsets) - 1
            for template in range(len(self.names)):
                own = np.flatnonzero((self.held[template][which] > 0) & (size[text] >= self.least[template]))
                if len(own) < self.least[template]:
                    continue
                # only texts in which some window holds enough of the template's bigrams
                apart = at[own] + text[own] * (int(self.most.max()) + 1)
                near = np.searchsorted(apart, apart + self.most[template]) - np.arange(len(own)) >= self.least[template]
                for t in np.unique(text[own[near]]):
                    of = own[text[own] == t]
                    best = self._best(template, at[of] - offsets[t], which[of])
                    if best:
                        out.append((a + int(t), template, best[0], best[1], best[2] + 1))
        return sorted(out)


def licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_word, n_words, licenses of every row of ``docs``.

    ``license`` is that of the best window (ties: the longer template, then the
    first), null if none reaches the threshold; ``licenses`` has each licence
    found, sorted. Null texts and texts of under two words have none. Rows that
    repeat a doc_id are scanned alike. An empty table gives no rows. Other
    columns play no part.
    """
    scanner = Scanner(templates, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                best: dict[int, tuple] = {}
                names: dict[int, set[str]] = {}
                for t, template, dice, first, n in own.scan(part.column(1).to_pylist()):
                    names.setdefault(t, set()).add(own.names[template])
                    best[t] = max(best.get(t, (-1,)), (dice, int(own.sizes[template]), -template, first, n))
                rows = [(own.names[-b[2]], b[0], b[3], b[4]) if (b := best.get(t)) else (None,) * 4 for t in range(len(part))]
                name, dice, first, n = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array([sorted(names.get(t, ())) for t in range(len(part))], pa.list_(pa.string()))], ["doc_id", "license", "dice", "first_word", "n_words", "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, dice double, first_word long, n_words long, licenses array<string>")
