"""License texts in documents by patience alignment.

Words that occur once in both the text and the template are anchors; the longest increasing run of them is kept, and the
gaps between are aligned the same way. Coverage is the part of the template's words that is aligned. Where a gap has no
such word, its longest common subsequence is taken.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded
from flowscope.llm.decontaminate import Words, batch_words

#: Texts of public licences and their usual notices (fixed values). Longer ones, such as the whole GPL, come from ``load_templates``.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to https://unlicense.org""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Words that tell a licence from its likes: without them aligned, a text isn't it.
TELLING = {
    "MIT-notice": "mit",
    "Apache-2.0-notice": "apache 2.0",
    "Apache-2.0-header": "apache 2.0",
    "GPL-3.0-notice": "gnu general public 3",
    "GPL-3.0-header": "general public 3",
    "LGPL-3.0-header": "lesser 3",
    "MPL-2.0-header": "mozilla 2.0",
    "CC-BY-NC-4.0-notice": "by-nc 4.0",
    "All-rights-reserved": "all rights reserved",
    "BSD-3-Clause": "neither endorse",
}
#: Words that a licence's text can't have between its own.
BARRED = {"GPL-3.0-notice": "lesser library affero", "GPL-3.0-header": "lesser library affero"}
#: Of licences that share most words, only the one with most of them aligned is reported at a place.
FAMILIES = (
    ("MIT", "MIT-notice"),
    ("BSD-2-Clause", "BSD-3-Clause"),
    ("Apache-2.0-notice", "Apache-2.0-header"),
    ("GPL-3.0-notice", "GPL-3.0-header", "LGPL-3.0-header"),
)
#: A template of fewer than SHORT words may have MORE others between its own.
SHORT, MORE = 20, 2


def load_templates(spark: SparkSession, path: str, most: int = 4_000_000) -> dict[str, str]:
    """Whole licence texts from the files of a folder, by file name; more than ``most`` characters in all are refused, as they are broadcast."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?$", 1).alias("name"), "value")
    size = files.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).head()[0]
    if size > most:
        raise ValueError(f"{size} characters of templates; {most} at most")
    return {r["name"]: r["value"] for r in files.collect()}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both places; the pairs come sorted by the first."""
    tops, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        p = bisect.bisect_left(tops, y)
        back.append(at[p - 1] if p else -1)
        tops[p : p + 1] = [y]
        at[p : p + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def reach(a: list, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of a with each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == np.uint64(x))))
    return row


def common(a: list, b: list, cells: int = 4_000_000) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; a table of more than ``cells`` is halved first, so memory is bounded."""
    other = np.array(b, np.uint64)
    if len(a) > 1 and len(a) * len(b) > cells:
        half = len(a) // 2
        cut = int(np.argmax(reach(a[:half], other) + reach(a[half:][::-1], other[::-1])[::-1]))
        return common(a[:half], b[:cut], cells) + [(i + half, j + cut) for i, j in common(a[half:], b[cut:], cells)]
    n = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        step = np.maximum(n[i + 1, :-1], n[i + 1, 1:] + (other == np.uint64(a[i])))
        n[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1, j] >= n[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once = lambda x, lo, hi: {w: p for w, p in _places(x, lo, hi).items() if p >= 0}
        ours, theirs = once(a, a0, a1), once(b, b0, b1)
        anchors = increasing(sorted((p, theirs[w]) for w, p in ours.items() if w in theirs))
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _places(x: list, lo: int, hi: int) -> dict:
    """word -> its place, or -1 if it has several."""
    out: dict = {}
    for p in range(lo, hi):
        out[x[p]] = p if x[p] not in out else -1
    return out


class Scanner:
    """Templates as word hashes, and the words that any of them has."""

    def __init__(self, templates: dict[str, str], coverage: float):
        memo = Words()
        self.names = [n for n, t in templates.items() if len(memo.of(t.encode()))]
        self.words = [memo.of(templates[n].encode()) for n in self.names]
        self.least = [math.ceil(coverage * len(w) - 1e-9) for w in self.words]
        self.telling = [set(memo.of(TELLING.get(n, "").encode()).tolist()) for n in self.names]
        self.barred = [set(memo.of(BARRED.get(n, "").encode()).tolist()) for n in self.names]
        self.family = [next((i for i, f in enumerate(FAMILIES) if n in f), -1 - t) for t, n in enumerate(self.names)]
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.has = np.zeros((len(self.vocabulary), len(self.words)), np.int32)  # how often
        for t, w in enumerate(self.words):
            np.add.at(self.has[:, t], np.searchsorted(self.vocabulary, w), 1)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, words: np.ndarray, bounds: np.ndarray):
        """(text, template, aligned words, start, end) of all texts in a batch."""
        out = []
        if not self.words or not len(words):
            return out
        at = np.flatnonzero(self.quick[(words >> np.uint64(48)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[word] == words[at]
        at, word = at[real], word[real]
        doc = np.searchsorted(bounds, at, "right") - 1
        # a text can't cover more of a template than the template's places whose word it has
        seen = np.unique(doc * len(self.vocabulary) + word)
        reach = np.zeros((len(bounds), len(self.words)), np.int32)
        np.add.at(reach, seen // len(self.vocabulary), self.has[seen % len(self.vocabulary)])
        for d, t in zip(*np.nonzero(reach >= np.array(self.least)), strict=True):
            lo, hi = np.searchsorted(doc, [d, d + 1])
            mine = at[lo:hi][self.has[word[lo:hi], t] > 0]
            out += [(int(d), int(t), *x) for x in self._windows(words, int(bounds[d]), mine, int(t))]
        return self._best_of_families(out)

    def _best_of_families(self, found):
        """Without places that overlap one of the same family with more words aligned, or as many and a larger part of it."""
        taken, out = {}, []
        for d, t, n, s, e in sorted(found, key=lambda x: (x[0], -x[2], len(self.words[x[1]]), x[1], x[3])):
            own = taken.setdefault((d, self.family[t]), [])
            if not any(s < y and x < e and u != t for x, y, u in own):
                own.append((s, e, t))
                out.append((d, t, n, s, e))
        return out

    def _is_it(self, t: int, words: list, pairs: list[tuple[int, int]]) -> bool:
        """Whether an alignment has the telling words, no barred ones between, and a short notice's words close together."""
        at = {words[j] for _, j in pairs}
        span = words[pairs[0][1] : pairs[-1][1] + 1]
        close = len(self.words[t]) >= SHORT or len(span) <= len(self.words[t]) + MORE
        return close and self.telling[t] <= at and not (self.barred[t] and self.barred[t].intersection(span))

    def _windows(self, words, base, at, t):
        """Aligned windows of one and a half template lengths; of those that overlap the one that covers most, then the shortest.

        A window that begins m of the template's words later covers m more of them at most: so many are passed over if
        that can't reach what is needed, or what an overlapping window has.
        """
        w, least = self.words[t], self.least[t]
        width, k = len(w) + len(w) // 2 + 1, 0
        able = np.flatnonzero(np.searchsorted(at, at + width) - np.arange(len(at)) >= least)
        found, best, best_end, template = [], 0, -1, w.tolist()
        while (i := int(np.searchsorted(able, k))) < len(able):
            k = int(able[i])
            lo = int(at[k])
            hi = int(at[int(np.searchsorted(at, lo + width)) - 1]) + 1
            there = words[lo:hi].tolist()
            pairs = patience(template, there)
            n, end = len(pairs), lo + pairs[-1][1] + 1 if pairs else lo
            best = best if lo < best_end else 0
            real = n >= least and self._is_it(t, there, pairs)
            if real:
                found.append((-n, end - lo - pairs[0][1], lo + pairs[0][1]))
                if n >= best:
                    best, best_end = n, end
            k = max(k + 1, int(np.searchsorted(at, end))) if real and n == len(w) else k + max(1, max(least, best) - n)
        taken = []
        for n, length, s in sorted(set(found)):
            if not any(s < y and x < s + length for x, y in taken):
                taken.append((s, s + length))
                yield -n, s - base, s + length - base


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start, end) of each place in a whole text that covers a template; start and end count words.

    Null, empty and blank texts have none. Rows are scanned one by one: repeated rows and null doc_ids give rows of their own.
    Of places of one template that overlap the one that covers most is reported, then the shortest, then the first. A place
    must have the words that tell the licence from others (``TELLING``) and none that belong to another (``BARRED``); of one
    family's licences (``FAMILIES``) that overlap the one with most words aligned is reported; others may overlap. No documents
    or no templates: no rows. Other columns don't matter.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, coverage))

    def run(batches):
        scanner, memo = shipped.value, Words()
        for batch in bounded(batches, 1):
            words, bounds = batch_words(batch.column(1), memo)
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], scanner.names[t], n / len(scanner.words[t]), s, e) for d, t, n, s, e in scanner.scan(words, bounds)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["doc_id", "license", "coverage", "start", "end"])

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return cols.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices of ``TEMPLATES`` in every document."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
