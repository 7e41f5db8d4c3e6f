"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every substring of the template texts and of the base phrases. A file is streamed
through it once, giving matching statistics: the longest substring of each template that ends at each
word, off the current state and its suffix links. Matches that can't be extended and have MIN_MATCH words or more are chained into spans that cover a
template: of all chains in file and template order with at most MAX_GAP file words between two
matches, a dynamic program finds those that cover most, so a passage that stands twice or elsewhere
breaks nothing.

Templates then compete: a span is worth the words it covers less those inserted and those missing. It
stands if it covers the template to COVER after insertions (of which a short one bears none), holds every name (NAMES) that the template holds and no
other name; of spans that overlap in the file the worthiest stands alone and adds its label. Base phrases are read off the same
states: a phrase ends at a word if its state is the current state or one of its suffix links.

Short licences are whole published texts, long ones (GPL, LGPL, AGPL, Apache, MPL, Creative Commons)
their published notices, the Creative Commons ones by rule; scan_licences() takes any other list of (label, text).

Defined results: a null text counts as empty (no words, no places, no labels, score 0); every input
row gives one row, null and repeated doc_ids included; an empty table gives an empty result; columns
beside doc_id and text are not read. The score is the largest covered share of a span that stands, and at
least BASE_SCORE where a base phrase stands.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MIN_MATCH, COVER, BASE_SCORE = 4, 0.7, 0.5
#: Words of a file that a chain may skip between two matches.
MAX_GAP = 30
#: A template of fewer words stands only where no word is put in.
SHORT = 20

#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words that name a licence or set one apart from its kin (fixed values). One more or one less makes another licence.
NAMES = frozenset("gnu general lesser affero apache mit mozilla mpl creative commons attribution noncommercial sharealike noderivatives noderivs cc nc sa nd".split())

#: Creative Commons licences: the elements behind "Attribution" by label, and the versions with their names (fixed values).
CREATIVE = {"cc-by": "", "cc-by-sa": "-ShareAlike", "cc-by-nc": "-NonCommercial", "cc-by-nd": "-NoDerivatives", "cc-by-nc-sa": "-NonCommercial-ShareAlike", "cc-by-nc-nd": "-NonCommercial-NoDerivatives"}
VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def creative_commons() -> list[tuple[str, str]]:
    """(label, notice): the long notice of each licence and version, and the short one."""
    out = []
    for label, elements in CREATIVE.items():
        for version, name in VERSIONS.items():
            own = elements if version == "4.0" else elements.replace("NoDerivatives", "NoDerivs")
            out.append((label, f"This work is licensed under a Creative Commons Attribution{own} {version} {name} License."))
            out.append((label, f"Licensed under {label.replace('-', ' ', 1).upper()} {version}."))
    return out


#: Notices and licence texts by label, as published (fixed values).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    *creative_commons(),
]

#: Bytes of words: digits, letters (A-Z lower-cased) and all of a non-ASCII character; others part words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


_NAMES = frozenset(w.encode() for w in NAMES)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of a set of word sequences, with the places where each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c; splits the target where it holds longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for at, c in enumerate(sequence):
            last = self.extend(last, c)
            self.ends[last].add((name, at))

    def finish(self) -> None:
        """Hand ending places up the suffix links."""
        for v in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]


def chains(matches: list[tuple[int, int, int]], max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of the best chain that ends with each match of one template.

    matches: (first file word, last file word, template place of the last). The next match of a chain
    ends later in file and template and starts at most max_gap words behind the one before; what
    overlaps it in file or template counts once. Matches are taken by their ends, and a match looks
    back only as far as the gap allows, so the work is linear in a long file.
    """
    matches = sorted(matches, key=lambda m: (m[1], m[2], m[0]))
    best: list[tuple[int, int, int]] = []  # (words covered, -first word, last word)
    for j, (start, end, at) in enumerate(matches):
        size = end - start + 1
        top = (size, -start, end)
        for i in range(j - 1, -1, -1):
            _, e, t = matches[i]
            if e < start - 1 - max_gap:
                break
            if e < end and t < at:
                gain = min(size, end - e, at - t)
                top = max(top, (best[i][0] + gain, best[i][1], end))
        best.append(top)
    return [(-first, last, covered) for covered, first, last in best]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        self.labels = [label for label, _ in templates]
        self.sizes: list[int] = []
        self.names: list[set[bytes]] = []
        self.automaton = a = SuffixAutomaton()
        for k, (_, text) in enumerate(templates):
            sequence = number(text)
            self.sizes.append(len(sequence))
            self.names.append(_NAMES & set(words_of(text.encode())))
            a.add(sequence, k)
        bases = [(number(phrase), label) for phrase, label in phrases.items()]
        for sequence, _ in bases:
            a.add(sequence, -1)
        a.finish()
        own: list[list[tuple[int, str]]] = [[] for _ in a.next]
        for sequence, label in bases:
            v = 0
            for c in sequence:
                v = a.next[v][c]
            own[v].append((len(sequence), label))
        self.phrases: list[tuple[tuple[int, str], ...]] = []
        for v in range(len(a.next)):
            found, x = [], v
            while x > 0:
                found += own[x]
                x = a.link[x]
            self.phrases.append(tuple(found))
        #: Of a state: its templates, and for each other one that a suffix of MIN_MATCH words or more stands in, the state of the longest.
        self.held: list[dict[int, int]] = [{} for _ in a.next]
        for v in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            if a.length[v] >= MIN_MATCH:
                self.held[v] = self.held[a.link[v]] | {k: v for k, _ in a.ends[v] if k >= 0}

    def scan(self, text: bytes) -> dict:
        """n_words, places [(start, label)], named [(word's place, name)]; matches [(start, end, state)] that no template extends, and parts, those that some template doesn't extend."""
        words = words_of(text)
        a, phrases, get, held = self.automaton, self.phrases, self.vocabulary.get, self.held
        moves, link, length = a.next, a.link, a.length
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        parts: dict[tuple[int, int, int], None] = {}
        live: dict[int, tuple[int, int]] = {}  # template: (words matched, state) up to the word before

        def follow(i: int, v: int, n: int) -> dict[int, tuple[int, int]]:
            """What templates match up to word i; matches that end before it become parts."""
            now = {k: (n if u == v else length[u], u) for k, u in held[v].items()} if n >= MIN_MATCH else {}
            for k, (m, u) in live.items():
                if k not in now or now[k][0] != m + 1:
                    parts[(i - m, i - 1, u)] = None
            return now

        v = n = 0
        before = -2
        for i, c in enumerate(map(get, words)):
            if c is None:
                continue
            if i != before + 1:
                if n >= MIN_MATCH:
                    matches.append((before - n + 1, before, v))
                    live = follow(before + 1, 0, 0)
                v = n = 0
            before = i
            if c in moves[v]:
                v = moves[v][c]
                n += 1
            else:
                if n >= MIN_MATCH:
                    matches.append((i - n, i - 1, v))
                while v > 0 and c not in moves[v]:
                    v = link[v]
                n = length[v]
                if c in moves[v]:
                    v = moves[v][c]
                    n += 1
            if live or n >= MIN_MATCH:
                live = follow(i, v, n)
            if phrases[v]:
                places += [(i - m + 1, label) for m, label in phrases[v] if m <= n]
        if n >= MIN_MATCH:
            matches.append((before - n + 1, before, v))
            follow(before + 1, 0, 0)
        named = [(i, w) for i, w in enumerate(words) if w in _NAMES] if parts else []
        return {"n_words": len(words), "places": places, "matches": matches, "parts": list(parts), "named": named}

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains: (template, first word, last word, covered share), the fullest first; a template's don't overlap in the file."""
        found: dict[int, list[tuple[int, int, int]]] = {}  # template: [(first word, last word, template place of the last)]
        for start, end, v in matches:
            for k, e in self.automaton.ends[v]:
                if k >= 0:
                    found.setdefault(k, []).append((start, end, e))
        out = []
        for k, own in found.items():
            taken: list[tuple[int, int]] = []
            for first, last, covered in sorted(chains(own), key=lambda x: (-x[2], x[0], x[1])):
                at = bisect(taken, (first, last))
                if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                    taken.insert(at, (first, last))
                    out.append((k, first, last, covered / self.sizes[k]))
        return out

    def standing(self, parts: list[tuple[int, int, int]], named: list[tuple[int, bytes]]) -> list[tuple[int, int, int, float]]:
        """The spans that stand, the worthiest first: (template, first word, last word, covered share)."""
        rivals = []
        places = [i for i, _ in named]
        for k, first, last, share in self.spans(parts):
            covered = round(share * self.sizes[k])
            inserted = last - first + 1 - covered
            if covered - inserted < COVER * self.sizes[k] or (inserted and self.sizes[k] < SHORT):
                continue
            if {w for _, w in named[bisect_left(places, first) : bisect(places, last)]} == self.names[k]:
                rivals.append((inserted + self.sizes[k] - 2 * covered, k, first, last, share))
        out, taken = [], []
        for _, k, first, last, share in sorted(rivals):
            at = bisect(taken, (first, last))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                taken.insert(at, (first, last))
                out.append((k, first, last, share))
        return out

    def row(self, text: bytes | None) -> tuple:
        got = self.scan(text or b"")
        spans = self.standing(got["parts"], got["named"])
        places = got["places"]
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(self.labels[k] for k, *_ in spans)})
        score = max([BASE_SCORE if base else 0.0, *(min(1.0, s[3]) for s in spans)])
        starts = [x for x, _ in places]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return got["n_words"], len(places), first, last, ",".join(base), ",".join(labels), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = [scanner.row(x) for x in part.column("text").to_pylist()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    common.small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(common.read_table(spark, sf_dir, "documents"))
