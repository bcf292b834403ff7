"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

The inverted index of the templates' fingerprints is small and goes to every task. A text is scanned for fingerprints that
are in the index; hits near one diagonal are a candidate; its words are aligned with the template's within a band.

With a coverage of 0.8 one word in five may be wrong, which can leave runs of two or three right words only. How long a run
must be left follows from the template's length, and its fingerprints are winnowed so that every such run has one: short
templates down to single words. Of overlapping places of a template the best stays.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vicinal.llm import words as W
from vicinal.llm.repeats import _lowest
from vicinal.llm.rows import KEY, keyed, slices

#: Most words of a fingerprint and of the stretch that one is chosen from.
GRAM, WINNOW = 3, 3
#: Words that insertions and deletions may shift the text against the template, at most half the template.
BAND = 8
MIN_COVERAGE = 0.8
#: Words of all templates together; the index is held by every task.
MOST_TEMPLATE_WORDS = 2_000_000

# Texts and notices of public licenses, as their authors give them.
TEMPLATES = {
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters and digits, A-Z as a-z: their numbers, each text's first, and where they begin and end in bytes."""
    raw, at = W.buffers(column)
    opens, closes = W.bounds(np.where(_LETTERS[raw], raw, np.uint8(32)), at)
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.where(_LETTERS[raw], raw, np.uint8(32))))
    numbers, first = W.words(plain, lower=True)
    return numbers, first, opens, closes


def winnow(numbers: np.ndarray, gram: int = GRAM, window: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, position): the smallest of each ``window`` neighbouring gram numbers. Fewer grams give one fingerprint."""
    grams = W.windows(numbers, min(gram, len(numbers)) or 1, 0x9FB21C651E98DF25)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    at = np.unique(_lowest(grams, min(window, len(grams))))
    return grams[at], at


def sizes(words: int, min_coverage: float, gram: int = GRAM, window: int = WINNOW) -> tuple[int, int]:
    """Gram and window for a template: if so many of its words are wrong as the coverage allows, the longest run of right
    ones still has a fingerprint."""
    wrong = int((1 - min_coverage) * words + 1e-9)
    run = max(1, (words - wrong) // (wrong + 1))
    size = min(gram, run)
    return size, max(1, min(window, run - size + 1))


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched, first, last): longest common subsequence with text position - template position within ``band`` of ``shift``.

    ``first`` and ``last`` are the text positions of the outermost matches; of equally long ones it is that which begins
    last, and then that which ends first.
    """
    width = 2 * band + 1
    best = [(0, -1, -1)] * (width + 1)
    for i, word in enumerate(template.tolist()):
        row = [(0, -1, -1)] * (width + 1)
        for k in range(width):
            j = i + shift - band + k
            # column k of the row above is one further right in the text
            here = max(best[k + 1], row[k - 1] if k else (0, -1, -1), key=_tight)
            if 0 <= j < len(text) and text[j] == word:
                n, first, _ = best[k]
                here = max(here, (n + 1, first if n else j, j), key=_tight)
            row[k] = here
        best = row
    return max(best, key=_tight)


def _tight(place: tuple[int, int, int]) -> tuple[int, int, int]:
    return place[0], place[1], -place[2]


def places(text: np.ndarray, template: np.ndarray, shifts: Iterable[int], band: int, min_coverage: float) -> list[tuple[int, int, int]]:
    """Places of a template at these shifts, as (matched, first, last) in order; they do not overlap.

    The best place is taken first: most words, then the shortest, then the first. One that overlaps it is aligned again with
    the words that are left.
    """
    queue: list[tuple] = []

    def consider(shift: int, low: int, high: int) -> None:
        begin = max(low, shift - band)
        matched, first, last = align(text[begin : max(begin, min(high, shift + len(template) + band + 1))], template, shift - begin, band)
        if matched and matched >= min_coverage * len(template) - 1e-9:
            heapq.heappush(queue, (-matched, last - first, begin + first, begin + last, shift, low, high))

    for shift in sorted(set(shifts)):
        consider(shift, 0, len(text))
    kept: list[tuple[int, int, int]] = []
    while queue:
        missed, _, first, last, shift, low, high = heapq.heappop(queue)
        over = next((k for k in kept if k[1] <= last and first <= k[2]), None)
        if over is None:
            kept.append((-missed, first, last))
        elif over[1] + over[2] <= 2 * shift + len(template) - 1:
            consider(shift, over[2] + 1, high)
        else:
            consider(shift, low, over[1])
    return sorted(kept, key=lambda p: p[1])


def band_of(words: int, band: int = BAND) -> int:
    """Half the template at most, so that one alignment does not reach over two places that follow each other."""
    return min(band, words // 2)


class _Index:
    """Fingerprints of one gram size: value, template and position."""

    def __init__(self, templates: list[tuple[str, np.ndarray]], chosen: list[tuple[int, int]], gram: int):
        prints = [(t, *winnow(templates[t][1], gram, window)) for t, (size, window) in enumerate(chosen) if size == gram]
        values = np.concatenate([p for _, p, _ in prints])
        owner, place = np.repeat([t for t, *_ in prints], [len(p) for _, p, _ in prints]), np.concatenate([a for *_, a in prints])
        order = np.argsort(values, kind="stable")
        self.gram, self.values, self.owner, self.place = gram, values[order], owner[order], place[order]

    def hits(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, word of the text, word of the template)."""
        if len(numbers) < self.gram:
            return
        grams = W.windows(numbers, self.gram, 0x9FB21C651E98DF25)
        at = np.flatnonzero(self.values[np.minimum(np.searchsorted(self.values, grams), len(self.values) - 1)] == grams)
        row = np.searchsorted(first, at, "right") - 1
        inside = at + self.gram <= first[row + 1]
        at, row = at[inside], row[inside]
        low, high = (np.searchsorted(self.values, grams[at], side) for side in ("left", "right"))
        for p, r, a, b in zip((at - first[row]).tolist(), row.tolist(), low.tolist(), high.tolist()):
            for i in range(a, b):
                yield r, int(self.owner[i]), p, int(self.place[i])


def clusters(hits: list[tuple[int, int]], size: int, band: int) -> list[int]:
    """Shifts of candidates: hits on nearly the same diagonal that lie no further apart than the template is long.

    A candidate's shift is the one that most of its hits have.
    """
    open_: list[tuple[int, list[int], Counter]] = []  # first shift, [last text position], hits by shift
    made = []
    for at, in_template in sorted(hits):
        shift = at - in_template
        open_ = [c for c in open_ if at - c[1][0] <= size]
        near = next((c for c in open_ if abs(c[0] - shift) <= band // 2), None)
        if near is None:
            near = (shift, [at], Counter())
            open_.append(near)
            made.append(near)
        near[1][0] = at
        near[2][shift] += 1
    return [max(c[2], key=lambda s: (c[2][s], -s)) for c in made]


def _scan(templates: list[tuple[str, np.ndarray]], gram: int, window: int, band: int, min_coverage: float):
    chosen = [sizes(len(words), min_coverage, gram, window) for _, words in templates]
    indexes = [_Index(templates, chosen, size) for size in sorted({size for size, _ in chosen})]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            numbers, first, opens, closes = _numbers(batch.column("text"))
            found: list[tuple] = []
            hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for index in indexes:
                for r, t, p, place in index.hits(numbers, first):
                    hits.setdefault((r, t), []).append((p, place))
            for (r, t), where in sorted(hits.items()):
                name, words = templates[t]
                width = band_of(len(words), band)
                text = numbers[first[r] : first[r + 1]]
                for matched, a, b in places(text, words, clusters(where, len(words), width), width, min_coverage):
                    found.append((r, name, matched, len(words), a, b + 1, int(opens[first[r] + a]), int(closes[first[r] + b])))
            offsets = np.concatenate(([0], np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)))).astype(np.int64)
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows),
                    batch.column(KEY).take(rows),
                    pa.array([f[1] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[2] / f[3] for f in found], pa.float64()),
                    pa.array([f[4] for f in found], pa.int64()),
                    pa.array([f[5] for f in found], pa.int64()),
                    pa.array([f[6] - int(offsets[f[0]]) for f in found], pa.int64()),
                    pa.array([f[7] - int(offsets[f[0]]) for f in found], pa.int64()),
                ],
                names=["id", KEY, "license", "matched", "coverage", "first_word", "end_word", "first_byte", "end_byte"],
            )

    return scan


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINNOW, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(id, __fp, license, matched, coverage, first_word, end_word, first_byte, end_byte), one row per place of a template.

    ``coverage`` is the share of the template's words that are found in order. A text's spans are in its words (letters
    and digits, A-Z as a-z) and bytes of UTF-8. Texts without a match, empty and null ones among them, have no row; a
    repeated row has its matches again. Templates without words match nothing. Places of one template do not overlap; two
    templates may match the same place. A place is found if its longest run of the template's words is as long as wrong or
    missing words allow at that coverage (``sizes``), and words that are put in between shift it by ``band_of`` at most.
    """
    templates = TEMPLATES if templates is None else templates
    known = []
    for name, text in sorted(templates.items()):
        numbers, *_ = _numbers(pa.array([text or ""]))
        if len(numbers):
            known.append((name, numbers))
    total = sum(len(n) for _, n in known)
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"{total} words of templates; the index in every task is meant for {MOST_TEMPLATE_WORDS}")
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"id {id_type}, {KEY} bigint, license string, matched bigint, coverage double, first_word bigint, end_word bigint, first_byte bigint, end_byte bigint"
    return rows.mapInArrow(_scan(known, gram, window, band, min_coverage), out)
