"""Licence scans by patience alignment of texts with licence templates.

Words that occur once in a stretch of text and once in the template are anchors. The longest increasing subsequence of
anchors is kept, and the gaps between them are aligned in the same way, each on its own. Coverage is the share of the
template's words that are aligned. Only stretches that hold enough of a template's words to reach the coverage that is
asked for are aligned.

A notice is a stretch of text of at most STRETCH times the template's length: words may be put into it, up to one or so
for each of its own. What is spread wider isn't a notice, as any long text holds the words of a short template somewhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.words import ALNUM, LOWER, chunks, tidy, words

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = ("Licensed under CC {} 4.0.", "This work is licensed under a Creative Commons {} 4.0 International License.")

#: Notices and short licences as they are published. A licence's versions are looked for one by one.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program " + _GNU.format("General Public License", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program " + _GNU.format("General Public License", "2").replace("software:", "software;")),
    "LGPL-3.0": ("This library " + _GNU.format("Lesser General Public License", "3"),),
    "LGPL-2.1": ("This library " + _GNU.format("Lesser General Public License", "2.1").replace("software:", "software;"),),
    "AGPL-3.0": ("This program " + _GNU.format("Affero General Public License", "3"),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": tuple(x.format(y) for x, y in zip(_CC, ("BY-NC", "Attribution-NonCommercial"), strict=True)),
    "CC-BY-SA-4.0": tuple(x.format(y) for x, y in zip(_CC, ("BY-SA", "Attribution-ShareAlike"), strict=True)),
    "CC-BY-4.0": tuple(x.format(y) for x, y in zip(_CC, ("BY", "Attribution"), strict=True)),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "BSD-2-Clause": (_BSD_2 + _BSD_END,),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", _BSD_2 + _BSD_3 + _BSD_END),
}
#: A notice is at most so many times as long as its template.
STRETCH = 2.25


def _longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience_align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both.

    Words at the borders of a gap that are equal on both sides are aligned too, as words next to an anchor belong to it.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if right[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if left[w] == 1 and w in place]
        kept = [anchors[k] for k in _longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class _Template:
    def __init__(self, name: str, hashes: np.ndarray, coverage: float) -> None:
        self.name, self.words, self.size = name, hashes.tolist(), len(hashes)
        self.need = int(np.ceil(coverage * len(hashes)))
        self.known, self.allowed = np.unique(hashes), Counter(self.words)


def _prepared(templates: dict[str, tuple[str, ...]], coverage: float) -> list[_Template]:
    out = []
    for name, versions in templates.items():
        for texts in chunks(pa.array(list(versions), pa.string()), 1 << 62):
            w = words(texts, ALNUM, LOWER)
            out += [_Template(name, w.hashes[a:b], coverage) for a, b in zip(w.first, w.first[1:], strict=False) if b > a]
    return out


def _held(words: list, t: _Template, span: int) -> list[tuple[int, int]]:
    """(start, how much of the template a stretch holds) of each stretch that holds enough; repeated words count as often as in the template."""
    allowed, inside = t.allowed, Counter()
    at = [i for i, w in enumerate(words) if w in allowed]
    out, held, end = [], 0, 0
    for a in at:
        while end < len(at) and at[end] < a + span:
            w = words[at[end]]
            held += inside[w] < allowed[w]
            inside[w] += 1
            end += 1
        if held >= t.need:
            out.append((a, held))
        inside[words[a]] -= 1
        held -= inside[words[a]] < allowed[words[a]]
    return out


def _matches(words: list, t: _Template) -> Iterator[tuple[int, int, int]]:
    """Notices of a template: (start, end, aligned words).

    Of the stretches that start at a word of the template, the first that aligns enough words is taken together with all
    that start within its length. The one of these that aligns most words is a notice, of equals the shortest and then the
    first. What lies before it, and what follows it, is searched on its own. No stretch aligns more words than it holds, so
    that stretches which hold too few, or fewer than the best has aligned, needn't be aligned.
    """
    span = int(np.ceil(STRETCH * t.size))
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        starts = [(lo + a, held) for a, held in _held(words[lo:hi], t, span)]
        k = 0
        while k < len(starts):
            best = _aligned(words, starts[k][0], min(starts[k][0] + span, hi), t)
            if best[0] < t.need:
                k += 1
                continue
            group = k
            while group < len(starts) and starts[group][0] < starts[k][0] + span:
                group += 1
            for a, held in sorted(starts[k + 1 : group], key=lambda x: (-x[1], x[0])):
                if held < best[0] or (best[:2] == (t.size, -t.size) and a > -best[2]):
                    break
                best = max(best, _aligned(words, a, min(a + span, hi), t))
            n, length, first = best[0], -best[1], -best[2]
            yield first, first + length, n
            if first > starts[k][0]:
                todo.append((starts[k][0], first))
            # The stretches of what follows may hold less than was counted, which costs time only.
            while k < len(starts) and starts[k][0] < first + length:
                k += 1


def _aligned(words: list, a: int, b: int, t: _Template) -> tuple[int, int, int]:
    """How many words align in a stretch, and less its length and less its start, so that the greatest is the best."""
    found = patience_align(words[a:b], t.words)
    return (len(found), found[0][0] - found[-1][0] - 1, -a - found[0][0]) if found else (0, 0, -a)


_FOUND = "licenses array<struct<license:string,start:long,end:long,matched:long,size:long>>"


def _task(templates: dict[str, tuple[str, ...]], coverage: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _prepared(templates, coverage)
        every = np.unique(np.concatenate([t.known for t in ready])) if ready else np.empty(0, np.uint64)
        for batch in batches:
            for texts in chunks(batch.column("text")):
                w = words(texts, ALNUM, LOWER)
                some = np.flatnonzero(np.isin(w.hashes, every))
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                for t in ready:
                    own = some[np.isin(w.hashes[some], t.known)]
                    # Enough words of the template, close enough together, in one text.
                    far = own[t.need - 1 :] - own[: len(own) - t.need + 1] if len(own) >= t.need else np.empty(0, np.int64)
                    near = own[: len(far)][far < np.ceil(STRETCH * t.size)]
                    for i in np.unique(w.doc[near]).tolist():
                        for a, b, n in _matches(w.hashes[w.first[i] : w.first[i + 1]].tolist(), t):
                            found[i].append({"license": t.name, "start": a, "end": b, "matched": n, "size": t.size})
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(texts.first, len(texts)), pa.array(np.diff(w.first).astype(np.int64)), pa.array([_best(x) for x in found], kind)], names=["id", "n_words", "licenses"])

    return run


def _best(found: list[dict]) -> list[dict]:
    """Of matches that overlap, the one with most aligned words; then by place."""
    starts: list[int] = []
    out: list[dict] = []  # in the order of starts; none overlaps another
    for m in sorted(found, key=lambda m: (-m["matched"], -m["matched"] / m["size"], m["start"], m["license"])):
        k = bisect_left(starts, m["end"])
        if not k or out[k - 1]["end"] <= m["start"]:
            starts.insert(k, m["start"])
            out.insert(k, m)
    return out


def find_licenses(docs: DataFrame, *, templates: dict[str, tuple[str, ...]] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence notices in each document.

    Returns one row for each row of ``docs``: its id, ``n_words`` and ``licenses``, an array of (license, start, end,
    matched, size) by place: word positions, end exclusive, and how many of the template's words are aligned. A notice
    counts from ``coverage`` on; of notices that overlap the one with most aligned words stays.

    A null or empty text has no words and no licence. Repeated rows get the same each. A very long text is handled alone,
    in time that grows with its length. An empty table gives an empty result. Other columns are ignored. The templates are a parameter of fixed size, sent with the task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tidy(_task(TEMPLATES if templates is None else templates, coverage)), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, {_FOUND}")
    return out.withColumnRenamed("id", id_col)
