"""Operator 2: licence scan by Dice coefficient over word bigrams.

Text is normalised (A-Z lower-cased, every other ASCII character than letters and digits a blank) and
cut into units: lines, paragraphs (runs of lines without a blank one between) and the whole text. A
unit matches a template if 2 |A n B| / (|A| + |B|) over their bigram multisets reaches ``threshold`` t;
it is named after its best template. As t bounds the sizes, only templates with t/(2-t) <= |A|/|B| <= (2-t)/t
can match; a filter over the hashes of all template bigrams gives an upper bound of |A n B| for all units of a
batch at once, and only units that pass are compared.

A licence that is a part of a unit, or reaches over several, is found as a span: any run of words of one text that starts and
ends with bigrams of a template and reaches t against it. Such a span holds t/(2-t) |B| of the template's bigrams on at
most (2-t)/t |B| places, so only starts from where that many follow are tried; none is lost (of whole licence bodies, one start in
|B| / 256 places is tried, which costs a span at most a 256th of its Dice). Of spans that overlap, the one with
most shared bigrams counts (then the higher Dice, then the smaller name); one that overlaps a unit's hit counts only if it
names another licence with a higher Dice.

Defined results: null, empty and unmatched texts give no hits and a null licence; ties between templates go
to the smaller name; repeated rows are scanned row by row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .shared import arrow_pass

_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[48:58] = np.arange(48, 58)
_CLEAN[97:123] = _CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_FILTER_BITS = 20
#: Spans of a template with more bigrams than twice this are tried from so many starts over its length; the others from every start.
_STARTS = 256

#: Short names by SPDX identifier, for notices of the form "licensed under ...".
NAMES = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "ISC": ("the ISC License",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
FRAMES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.")

#: Texts of short licences and of the usual file headers.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}

_GNU = """{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with {3}"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Usual notices of the licences that ``TEXTS`` lacks or has in part.
NOTICES = [
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("GPL-2.0", _GNU.format("This program", "", 2, "this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")),
    ("GPL-3.0", _GNU.format("This program", "", 3, "this program. If not, see <https://www.gnu.org/licenses/>.")),
    ("LGPL-2.1", _GNU.format("This library", "Lesser ", "2.1", "this library; if not, see <https://www.gnu.org/licenses/>.")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser ", 3, "this library. If not, see <https://www.gnu.org/licenses/>.")),
    ("AGPL-3.0", _GNU.format("This program", "Affero ", 3, "this program. If not, see <https://www.gnu.org/licenses/>.")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."),
    *((f"CC-{k}-4.0", f"This work is licensed under {article} Creative Commons {name} 4.0 International License.{more}") for k, name in _CC.items() for article in ("a", "the") for more in ("", f" To view a copy of this license, visit http://creativecommons.org/licenses/{k.lower()}/4.0/.")),
]


def bodies() -> list[tuple[str, str]]:
    """Whole texts of the longer licences, as the Debian package base-files ships them; read on the driver."""
    return [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted(files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


def default_templates() -> list[tuple[str, str]]:
    """(licence, text) pairs: every frame around every name, notices, and whole texts."""
    return [(k, frame.format(name)) for k, names in NAMES.items() for name in names for frame in FRAMES] + list(TEXTS.items()) + NOTICES + bodies()


def _pairs(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textkit.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Templates:
    names: list[str]
    sizes: np.ndarray
    counts: list[Counter]
    bits: np.ndarray
    threshold: float
    #: All templates' distinct bigrams, and for each the templates that have it.
    vocabulary: np.ndarray
    postings: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[str, str]], threshold: float) -> Templates:
        grams = [_pairs(textkit.row_words(np.frombuffer(text.encode(), np.uint8), _CLEAN)[0]) for _, text in pairs]
        order = sorted((i for i in range(len(pairs)) if len(grams[i])), key=lambda i: (len(grams[i]), pairs[i][0]))
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for g in grams:
            bits[g >> np.uint64(64 - _FILTER_BITS)] = True
        holds = np.unique(np.array([(g, k) for k, i in enumerate(order) for g in grams[i].tolist()], dtype=[("gram", np.uint64), ("template", np.int64)]))
        vocabulary, start = np.unique(holds["gram"], return_index=True)
        return cls([pairs[i][0] for i in order], np.array([len(grams[i]) for i in order]), [Counter(grams[i].tolist()) for i in order], bits, threshold, vocabulary, np.append(start, len(holds)), holds["template"])

    def sized(self, n: int) -> range:
        """Templates (sorted by size) that a unit of n bigrams can match."""
        t = self.threshold
        return range(int(np.searchsorted(self.sizes, np.ceil(n * t / (2 - t) - 1e-9))), int(np.searchsorted(self.sizes, np.floor(n * (2 - t) / t + 1e-9), side="right")))

    def best(self, grams: np.ndarray) -> tuple[float, str] | None:
        mine, n, found = Counter(grams.tolist()), len(grams), []
        for k in self.sized(n):
            dice = 2 * sum(min(c, mine[g]) for g, c in self.counts[k].items() if g in mine) / (n + int(self.sizes[k]))
            if dice >= self.threshold:
                found.append((-dice, self.names[k]))
        return (-min(found)[0], min(found)[1]) if found else None

    def spans(self, grams: np.ndarray, first: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float, str]]:
        """(first bigram, last, shared, Dice, licence) of the best span from each start; rows' words start at ``first``, ``hits`` are places."""
        row = np.searchsorted(first, hits, side="right") - 1
        number = np.minimum(np.searchsorted(self.vocabulary, grams[hits]), len(self.vocabulary) - 1)
        real = (self.vocabulary[number] == grams[hits]) & (hits + 1 < first[row + 1])
        hits, row, number = hits[real], row[real], number[real]
        n = self.postings[number + 1] - self.postings[number]
        template = self.holders[np.repeat(self.postings[number] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(template, kind="stable")
        at, row, cuts = np.repeat(hits, n)[order], np.repeat(row, n)[order], np.searchsorted(template[order], np.arange(len(self.names) + 1))
        t, out = self.threshold, []
        for k in np.flatnonzero(np.diff(cuts)):
            size = int(self.sizes[k])
            p, r = at[cuts[k] : cuts[k + 1]], row[cuts[k] : cuts[k + 1]]
            least, longest = max(1, int(np.ceil(size * t / (2 - t) - 1e-9))), int(size * (2 - t) / t + 1e-9)
            if len(p) < least:
                continue
            near = (p[least - 1 :] - p[: len(p) - least + 1] < longest) & (r[least - 1 :] == r[: len(r) - least + 1])
            starts = np.flatnonzero(near)
            step = max(1, size // _STARTS)
            starts = starts[np.unique(np.stack((r[starts], p[starts] // step)), axis=1, return_index=True)[1]] if step > 1 else starts
            for i in np.sort(starts).tolist():
                end = int(np.searchsorted(p, min(p[i] + longest, first[r[i] + 1])))
                left, shared, best = dict(self.counts[k]), 0, None
                for place, g in zip((p[i:end] - p[i]).tolist(), grams[p[i:end]].tolist()):
                    if left[g]:
                        left[g] -= 1
                        shared += 1
                        dice = 2 * shared / (size + place + 1)
                        if dice >= t and (best is None or dice > best[3]):
                            best = (int(p[i]), int(p[i]) + place, shared, dice, self.names[k])
                if best:
                    out.append(best)
        return out


def _apart(spans: list[tuple[int, int, int, float, str]], units: list[tuple[int, int, float, str]]):
    """The spans that count, in order, beside units (first bigram, last, Dice, licence)."""
    taken: list[tuple[int, int]] = []
    for lo, hi, _, dice, name in sorted(spans, key=lambda x: (-x[2], -x[3], x[4], x[0])):
        k = bisect_left(taken, (lo, lo))
        if (k and taken[k - 1][1] >= lo) or (k < len(taken) and taken[k][0] <= hi):
            continue
        taken.insert(k, (lo, hi))
        if not any(a <= hi and lo <= b and (name == other or d >= dice) for a, b, d, other in units):
            yield lo, name, dice


def scan_column(column, templates: Templates, spans: bool = False) -> list[list[tuple[str, float]]]:
    """For each text the (licence, Dice) of its matching units, in order: lines, paragraphs, the whole; then of spans, if asked for."""
    data, offsets = textkit.buffers(column)
    out: list[list[tuple[str, float]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(templates.sizes):
        return out
    t = templates.threshold
    for a, b in textkit.slices(offsets):
        o = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        if b == a + 1:
            words, _, lines = textkit.row_words(raw, _CLEAN)
            first = np.array([0, len(words)])
        else:
            clean = _CLEAN[raw]
            s, e, first = textkit.spans(clean, o)
            words, lines = textkit.span_hashes(clean, s, e), np.searchsorted(s, np.flatnonzero(raw == 10))
        grams = _pairs(words)
        known = templates.bits[grams >> np.uint64(64 - _FILTER_BITS)]
        hit = np.concatenate(([0], np.cumsum(known, dtype=np.int64)))
        edges = np.unique(np.concatenate((lines, first)))
        parts = np.unique(np.concatenate((lines[np.flatnonzero(np.diff(lines, prepend=-1) == 0)], first)))
        seen, units = set(), {}
        for cuts in (edges, parts, np.unique(first)):
            lo, hi = cuts[:-1], cuts[1:]
            n = hi - lo - 1
            most = hit[np.maximum(hi - 1, lo)] - hit[lo]
            near = (n > 0) & (2 * most >= t * (n + np.maximum(templates.sizes[0], n * t / (2 - t))) - 1e-9) & (n * t / (2 - t) <= templates.sizes[-1] + 1e-9)
            for i in np.flatnonzero(near):
                unit = (int(lo[i]), int(hi[i]))
                if unit not in seen:
                    seen.add(unit)
                    if found := templates.best(grams[unit[0] : unit[1] - 1]):
                        row = int(np.searchsorted(first, unit[0], side="right")) - 1
                        out[a + row].append((found[1], found[0]))
                        units.setdefault(row, []).append((unit[0], unit[1] - 2, *found))
        if spans:
            by: dict[int, list] = {}
            for x in templates.spans(grams, first, np.flatnonzero(known)):
                by.setdefault(int(np.searchsorted(first, x[0], side="right")) - 1, []).append(x)
            for row, found in by.items():
                out[a + row] += [(name, dice) for _, name, dice in sorted(_apart(found, units.get(row, [])))]
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_hits, licenses (distinct, sorted, comma-joined), best (null if none), dice."""
    held = docs.sparkSession.sparkContext.broadcast(Templates.of(templates or default_templates(), threshold))

    def run(batches):
        for batch in batches:
            hits = scan_column(batch.column("text"), held.value, spans=True)
            top = [min(((-d, k) for k, d in h), default=(0.0, None)) for h in hits]
            yield {"doc_id": batch.column("doc_id"), "n_hits": [len(h) for h in hits], "licenses": [",".join(sorted({k for k, _ in h})) for h in hits], "best": pa.array([k for _, k in top], pa.string()), "dice": [-d for d, _ in top]}

    return arrow_pass(docs.select("doc_id", "text"), run, "doc_id long, n_hits long, licenses string, best string, dice double")
