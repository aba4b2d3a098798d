"""Licence notices in documents, by the Dice coefficient over word bigrams.

A template is a normalised licence text or notice.  Where a document may hold
it, a span begins at every shared bigram and ends at the best of the shared
bigrams after it; the Dice coefficient of the two bigram sets decides.  Sizes
prune: with least coefficient t, a span of a bigrams can only match a template
of between a * t / (2 - t) and a * (2 - t) / t of them, and of a span's bigrams
at most 2 / t - 2 times the template's may be others than its own, so a template with fewer shared
bigrams in the document than t / (2 - t) of its own is out at once, and so is
every document that holds none of the marker words, which are chosen so that no
template can reach that number of shared bigrams without one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")

#: Words too common to mark a document (fixed values).
COMMON = frozenset("a an and any are as at by for from in is it may not of on or other that the this to under with without work you".split())

#: Names by which one-line notices call a licence (fixed values).
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "MIT": ["MIT License", "MIT license agreement"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
#: How a notice goes on about the name.
NOTICES = ["This work is licensed under the {}.", "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under {}."]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
    HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
    ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
    ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: The notice that files under a GNU licence carry: licence, how it says "free software", where versions stand, version.
_GNU = """This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
    Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the
    hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU {name} for more details.{end}"""
_HAVE = " You should have received a copy of the GNU {name} along with this {what}"


def _gnu(name: str, version: str, what: str, old: bool) -> list[str]:
    """The notice, without and with its last paragraph."""
    parts = {"what": what, "stop": ";" if old else ":", "name": name, "comma": ";" if old else ",", "version": version}
    end = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA." if old else ". If not, see <https://www.gnu.org/licenses/>."
    return [_GNU.format(end=e, **parts) for e in ("", (_HAVE + end).format(**parts))]


#: More texts and standard file headers; whole texts of further licences are in the folder `texts`.
HEADERS = [
    *(("GPL-2.0", x) for x in _gnu("General Public License", "2", "program", True)),
    *(("GPL-3.0", x) for x in _gnu("General Public License", "3", "program", False)),
    *(("LGPL-2.1", x) for x in _gnu("Lesser General Public License", "2.1", "library", True)),
    *(("LGPL-3.0", x) for x in _gnu("Lesser General Public License", "3", "program", False)),
    *(("LGPL-3.0", x) for x in _gnu("Lesser General Public License", "3", "library", False)),
    *(("AGPL-3.0", x) for x in _gnu("Affero General Public License", "3", "program", False)),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
        DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0/"""),
]
#: Texts of licences and of the notices that they ask for (fixed values).
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "BSD-2-Clause": _BSD.format(""),
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def default_templates() -> list[tuple[str, str]]:
    """(licence, text), notices made from names by rule."""
    out = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))]
    return out + list(TEXTS.items()) + HEADERS + whole


class Scanner:
    def __init__(self, templates, threshold: float = THRESHOLD):
        self.t, self.least = threshold, threshold / (2 - threshold)
        self.templates, self.of = [], defaultdict(list)
        seen = set()
        for name, text in templates:
            words = _WORD.findall(text.lower())
            grams = frozenset(zip(words, words[1:], strict=False))
            if not grams or (name, grams) in seen:
                continue
            seen.add((name, grams))
            i = len(self.templates)
            self.templates.append((name, grams, max(1, -int((1e-9 - self.least * len(grams)) // 1)), len(words) - 1))
            for g in grams:
                self.of[g].append(i)
        self.markers = self._markers()

    def _markers(self) -> list[str]:
        """Words such that the bigrams of a template without one of them are fewer than a match needs."""
        chosen: set[str] = set()

        def open_templates():
            return [(g, need) for _, g, need, _ in self.templates if sum(1 for a, b in g if a not in chosen and b not in chosen) >= need]

        while left := open_templates():
            votes = Counter(w for g, _ in left for w in {w for pair in g for w in pair} - chosen - COMMON)
            if not votes:
                votes = Counter(w for g, _ in left for pair in g for w in pair if w not in chosen)
            chosen.add(max(votes, key=lambda w: (votes[w], len(w), w)))
        return sorted(chosen)

    def _best_end(self, t: int, pairs: list, start: int, last: int) -> tuple[float, int]:
        """The highest coefficient of a span from `start`, and the shared bigram where it ends.

        Of equal ends the first, or the last within the template's own length, so
        that a copy whose last words repeat is whole.  Once longer than any match
        without repeated bigrams, a span that meets its first bigram again is no
        better than the one that begins after it.
        """
        _, grams, _, length = self.templates[t]
        size, top, stop = len(grams), 0.0, start
        reach = start + int(length / self.least + 1e-9)
        most, shared, others = size * (2 / self.t - 2) + 1e-9, set(), set()
        for i in range(start, last + 1):
            pair = pairs[i]
            if pair not in grams:
                others.add(pair)
                if len(others) > most:
                    break
                continue
            if i >= reach and pair == pairs[start]:
                break
            shared.add(pair)
            score = 2 * len(shared) / (len(shared) + len(others) + size)
            if score > top or score == top and i < start + length:
                top, stop = score, i
        return top, stop

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first and last character) of every span that is no worse than those it overlaps."""
        low = text.lower()
        if not any(m in low for m in self.markers):
            return []
        if len(low) != len(text):  # lower case of another length: keep offsets right
            low = text
        spans = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(low)]
        pairs = [(a[0], b[0]) for a, b in zip(spans, spans[1:], strict=False)]
        hits = defaultdict(list)
        for i, pair in enumerate(pairs):
            for t in self.of.get(pair, ()):
                hits[t].append(i)
        found: list[tuple[float, int, int, str]] = []
        for t, at in sorted(hits.items()):
            name, grams, need, _ = self.templates[t]
            if len(at) < need or len({pairs[i] for i in at}) < need:
                continue
            whole = -1  # where the last exact copy ends: none that begins in it can be closer
            for lo in range(len(at) - need + 1):
                if at[lo] <= whole:
                    continue
                score, stop = self._best_end(t, pairs, at[lo], at[-1])
                if score >= self.t:
                    found.append((score, spans[at[lo]][1], spans[stop + 1][2], name))
                if score == 1:
                    whole = stop
        starts: list[int] = []  # of the chosen, in order; they do not overlap
        chosen: dict[int, tuple[str, float, int, int]] = {}
        for score, a, b, name in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):  # of spans that claim the same words, the closest
            i = bisect_left(starts, a)
            if (not i or chosen[starts[i - 1]][3] <= a) and (i == len(starts) or b <= starts[i]):
                starts.insert(i, a)
                chosen[a] = (name, score, a, b)
        return [chosen[a] for a in starts]


@lru_cache(maxsize=2)
def _scanner(templates: tuple, threshold: float) -> Scanner:
    return Scanner(templates, threshold)


def scan_licences(docs: DataFrame, templates=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence text found in a document: doc_id, licence, dice, start, end, span.

    start and end are character offsets in the whole text.  A licence that stands
    in a document several times has a row each time; of spans that overlap, the
    one with the highest coefficient counts, of equal ones the longest, then the
    first.  Null and empty texts, and an empty
    table, give no rows; repeated rows give theirs each.
    """
    chosen = tuple(templates or default_templates())

    def run(batches):
        scanner = _scanner(chosen, threshold)
        for batch in batches:
            ids, rows = batch.column("id"), []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                rows += [(ids[i].as_py(), name, score, a, b, text[a:b]) for name, score, a, b in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "licence", "dice", "start", "end", "span"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, licence string, dice double, start long, end long, span string")
