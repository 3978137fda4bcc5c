"""License scan: patience alignment of texts with license templates.

A text's words are aligned with a template's: words that are unique in both are anchors, the longest
increasing run of anchors is kept, and each gap between them is aligned in the same way; a gap
without anchors gets a longest common subsequence. Coverage is the share of the template's words
that are matched.

Where to align: a window can reach the coverage only if it holds enough of the template's words,
counted with repetition. This bound is taken first for the whole document and then for windows of
``SLACK`` times the template's length around each run of its words; it drops no window that could pass.
A window that reaches ``min_coverage`` counts if the template's own words (its name, version, variant) are
among those matched. Of windows that overlap, whatever their templates, the one with most matched words is a row.

Defined results: null, empty and wordless texts give no rows; of two equally good windows that overlap
the better covered, then the earlier is a row; repeated rows and null doc_ids give rows like others. Other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.llm import textscan

MIN_COVERAGE = 0.8
SLACK = 1.5
SCHEMA = "doc_id long, template string, coverage double, matched int, word_start long, word_end long"

#: Name: the text, and the words of it that must be matched whatever the coverage.
TEMPLATES = {
    "Apache-2.0 notice": ("Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    "Apache-2.0 header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2 0"),
    "MIT notice": ("Released under the MIT License.", "mit"),
    "MIT": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ""),
    "BSD notice": ("Released under the BSD License.", "bsd"),
    "BSD-2-Clause": ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', ""),
    "BSD-3-Clause": ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', "endorse promote"),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', ""),
    "GPL-3.0 notice": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "GPL-2.0 notice": ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    "LGPL-3.0 notice": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "AGPL-3.0 notice": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "GPL-3.0 header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "general 3"),
    "GPL-2.0 header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "general 2"),
    "LGPL-3.0 header": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "lesser 3"),
    "AGPL-3.0 header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.", "affero 3"),
    "CC-BY-4.0 short": ("Licensed under CC BY 4.0.", "cc by 4 0"),
    "CC-BY-SA-4.0 short": ("Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    "CC-BY-NC-4.0 notice": ("Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    "CC-BY-NC-SA-4.0 short": ("Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    "CC-BY-ND-4.0 short": ("Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    "CC-BY-4.0 notice": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
    "CC-BY-SA-4.0 notice": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4 0"),
    "CC-BY-NC-4.0 long notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4 0"),
    "MPL-2.0 header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2 0"),
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose seconds rise."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(last[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[k], last[k] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps without anchors."""
    m, n = a1 - a0, b1 - b0
    best = np.zeros((m + 1, n + 1), np.int32)
    bb = np.array(b[b0:b1])
    for i in range(m - 1, -1, -1):
        take = np.where(bb == a[a0 + i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :n] = np.maximum.accumulate(take[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < m and j < n:
        if a[a0 + i] == b[b0 + j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word lists, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at_a: dict[int, int] = {}
        at_b: dict[int, int] = {}
        for i in range(a0, a1):
            at_a[a[i]] = -1 if a[i] in at_a else i
        for j in range(b0, b1):
            at_b[b[j]] = -1 if b[j] in at_b else j
        anchors = _increasing([(i, at_b[w]) for w, i in at_a.items() if i >= 0 and at_b.get(w, -1) >= 0])
        if not anchors:
            out += _common(a, b, a0, a1, b0, b1)
            continue
        out += anchors
        for (i, j), (k, l) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, l))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, str]], min_coverage: float, slack: float = SLACK) -> None:
        self.names = list(templates)
        self.words = [textscan.word_hashes(t).tolist() for t, _ in templates.values()]
        self.must = [set(textscan.word_hashes(m).tolist()) for _, m in templates.values()]
        self.need = min_coverage
        self.slack = slack
        self.vocabulary = np.unique(np.concatenate([np.array(w, np.uint64) for w in self.words] or [np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocabulary >> np.uint64(44)] = True
        self.of = [set(np.searchsorted(self.vocabulary, np.array(sorted(set(w)), np.uint64)).tolist()) for w in self.words]
        self.member = np.zeros((len(self.vocabulary), len(self.names)), np.int32)
        for k, own in enumerate(self.of):
            self.member[sorted(own), k] = 1
        # matching a share of the template's places leaves at most the rest of its distinct words out
        self.distinct = np.array([len(own) - (len(w) - int(np.ceil(min_coverage * len(w) - 1e-9))) for own, w in zip(self.of, self.words)])

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words of any template, and their numbers."""
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.vocabulary, h[at]), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[k] == h[at] if len(self.vocabulary) else np.zeros(0, bool)
        return at[hit], k[hit]

    def candidates(self, words: textscan.Words) -> Iterator[tuple[int, int]]:
        """Texts and templates whose distinct common words allow the coverage."""
        at, k = self.known(words.hash)
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        key = np.unique(doc * np.int64(max(1, len(self.vocabulary))) + k)
        doc, k = key // max(1, len(self.vocabulary)), key % max(1, len(self.vocabulary))
        if not len(doc):
            return
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        enough = np.add.reduceat(self.member[k], starts, axis=0) >= self.distinct
        for i, t in zip(*np.nonzero(enough)):
            yield int(doc[starts[i]]), int(t)

    def passes(self, t: int, need: int, pairs: list[tuple[int, int]]) -> bool:
        return len(pairs) >= need and self.must[t] <= {self.words[t][i] for i, _ in pairs}

    def windows(self, h: list[int], t: int) -> Iterator[tuple[int, int, float]]:
        """Windows of a text's words that reach the coverage: first and last matched word, and matched words."""
        template = self.words[t]
        own = set(template)
        need = int(np.ceil(self.need * len(template) - 1e-9))
        width = int(np.ceil(self.slack * len(template)))
        quota: dict[int, int] = {}
        for w in template:
            quota[w] = quota.get(w, 0) + 1
        places = [i for i, w in enumerate(h) if w in own]
        k, taken = 0, -1
        while k < len(places):
            i = places[k]
            if i <= taken or len(places) - k < need:
                k += 1
                continue
            inside = h[i : i + width]
            have: dict[int, int] = {}
            for w in inside:
                if w in quota:
                    have[w] = have.get(w, 0) + 1
            if sum(min(n, quota[w]) for w, n in have.items()) >= need and all(w in have for w in self.must[t]):
                pairs = align(template, inside)
                if self.passes(t, need, pairs):
                    # a later start may match more before this window's end
                    best, begin = pairs, i
                    for j in places[k + 1 :]:
                        if j > i + pairs[0][1] + 1 and j >= i + len(template):
                            break
                        other = align(template, h[j : j + width])
                        if len(other) > len(best) and self.passes(t, need, other):
                            best, begin = other, j
                    taken = begin + best[-1][1]
                    yield begin + best[0][1], taken + 1, len(best)
            k += 1


def best_apart(found: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of windows (template, first, end, matched) that overlap, the one with most matched words; then the better covered, then the earlier."""
    out: list[tuple[int, int, int, int]] = []
    for w in sorted(found, key=lambda w: (-w[3], -w[3] / sizes[w[0]], w[1], w[0])):
        if all(w[2] <= s or w[1] >= e for _, s, e, _ in out):
            out.append(w)
    return sorted(out, key=lambda w: w[1])


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, template, coverage, matched words, first word and the one after the last."""
    templates = TEMPLATES if templates is None else templates

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            texts, ids, rows = batch.column(1).to_pylist(), batch.column(0).to_pylist(), []
            for a, b in textscan.groups(texts):
                words = textscan.scan(texts[a:b])
                for doc, own in groupby(scanner.candidates(words), lambda x: x[0]):
                    h = words.hash[words.bounds[doc] : words.bounds[doc + 1]].tolist()
                    found = [(t, s, e, n) for _, t in own for s, e, n in scanner.windows(h, t)]
                    rows += [(ids[a + doc], scanner.names[t], n / len(scanner.words[t]), n, s, e) for t, s, e, n in best_apart(found, [len(w) for w in scanner.words])]
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["doc_id", "template", "coverage", "matched", "word_start", "word_end"])

    return docs.select("doc_id", "text").mapInArrow(go, SCHEMA)
