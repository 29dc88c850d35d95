"""License scans: patience alignment of license templates with texts."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import WORD, TextBatch, int64, slices

_WARRANTY = (
    "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_NO_EVENT = (
    f"THE SOFTWARE IS {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, rest: str, stop: str = ";") -> str:
    return (
        f"This {'library' if 'Lesser' in name else 'program'} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as "
        f"published by the Free Software Foundation{stop if stop == ';' else ','} either version {version} of the License, or (at your option) any later version. {rest}"
    )


_HOPE = "This %s is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s for more details."
#: Public license texts, headers of source files and notices by name.
TEMPLATES = {
    "MIT": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    f"substantial portions of the Software. {_NO_EVENT}",
    "MIT-0": f"{_GRANT}. {_NO_EVENT}",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    f"above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_WARRANTY,
    "BSD-2-Clause-conditions": _BSD,
    "BSD-3-Clause-conditions": _BSD + _BSD_THIRD,
    "BSD-notice": "Released under the BSD License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
    "it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
    "notice may not be removed or altered from any source distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-header": _gnu("General Public License", "3", _HOPE % ("program", "General Public License"), ":"),
    "GPL-3.0-short-header": _gnu("General Public License", "3", "", ":"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": _gnu("General Public License", "2", _HOPE % ("program", "General Public License")),
    "GPL-2.0-short-header": _gnu("General Public License", "2", ""),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1", _HOPE % ("library", "Lesser General Public License")),
    "LGPL-2.1-short-header": _gnu("Lesser General Public License", "2.1", ""),
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3", _HOPE % ("library", "Lesser General Public License")),
    "LGPL-3.0-short-header": _gnu("Lesser General Public License", "3", ""),
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-header": _gnu("Affero General Public License", "3", _HOPE % ("program", "Affero General Public License"), ":"),
    "AGPL-3.0-short-header": _gnu("Affero General Public License", "3", "", ":"),
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of "
    "the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: What tells a license from its likes: each phrase must align without a word between. `_LOOSE` words may lack.
CORES = {
    "MIT-notice": ["MIT License"],
    "BSD-notice": ["BSD License"],
    "Apache-2.0-header": ["Apache License, Version 2.0"],
    "Apache-2.0-notice": ["Apache License, Version 2.0"],
    "MPL-2.0-header": ["Mozilla Public License, v. 2.0"],
    "MPL-2.0-notice": ["Mozilla Public License, Version 2.0"],
    "CC-BY-NC-4.0-notice": ["CC BY-NC 4.0"],
    "CC-BY-4.0-short-notice": ["CC BY 4.0"],
    "CC-BY-SA-4.0-short-notice": ["CC BY-SA 4.0"],
    "CC-BY-4.0-notice": ["Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0-notice": ["Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0-long-notice": ["Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND-4.0-notice": ["Creative Commons Attribution-NoDerivatives 4.0"],
} | {
    f"{short}-{version}{kind}": [f"GNU {name}, version {number}"] if kind == "-notice" else [f"GNU {name}", f"version {number}"]
    for short, name, versions in (
        ("GPL", "General Public License", {"3.0": "3", "2.0": "2"}), ("LGPL", "Lesser General Public License", {"3.0": "3", "2.1": "2.1"}),
        ("AGPL", "Affero General Public License", {"3.0": "3"}),
    )
    for version, number in versions.items()
    for kind in ("-notice", "-header", "-short-header")
}
_LOOSE = "license version 0"


def _cores(phrases: list[str], template: list[int]) -> list[list[int]]:
    """Of each phrase, the template's positions that must align."""
    loose, out = set(words_of([_LOOSE])[0]), []
    for p in words_of([p.lower() for p in phrases]):
        at = next(k for k in range(len(template)) if template[k : k + len(p)] == p)
        out.append([k for k in range(at, at + len(p)) if template[k] not in loose])
    return out


def _told(pairs: list[tuple[int, int]], cores) -> bool:
    place = {j: i for i, j in pairs}
    return all(all(k in place for k in at) and place[at[-1]] - place[at[0]] <= at[-1] - at[0] for at in cores)


def words_of(texts: list[str]) -> list[list[int]]:
    """Hashes of the words (letters and digits) of lower-case texts."""
    t = TextBatch(pa.array(texts, pa.string()))
    starts, ends = t.spans(WORD[t.buf])
    border = np.searchsorted(t.doc_of(starts), np.arange(t.n + 1))
    h = t.hashes(starts, ends).tolist()
    return [h[a:b] for a, b in zip(border, border[1:])]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, which ascend in the first place, that ascends in the second (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        if pile:
            back[k] = top_at[pile - 1]
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


#: Cells of a table of common subsequences; a larger gap is aligned by its matches, without a table.
CELLS = 1 << 22


def _common(a, b) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps without a word that is unique on both sides."""
    if len(a) * len(b) > CELLS:
        where: dict = {}
        for j in range(len(b) - 1, -1, -1):
            where.setdefault(b[j], []).append(j)
        return _increasing([(i, j) for i, w in enumerate(a) for j in where.get(w, ())])  # one of each i, as j descends
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    same = np.asarray(a)[:, None] == np.asarray(b)[None, :]
    for i in range(len(a) - 1, -1, -1):
        # a row of the table is a running maximum from the right
        best = np.maximum(table[i + 1, :-1], np.where(same[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if same[i, j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a, b, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences.

    Words that stand once on each side are anchors; the longest run of anchors in order is kept and the gaps
    between are aligned in the same way. A gap without anchors is aligned by longest common subsequence.
    """
    if not len(a) or not len(b):
        return []
    in_a, in_b = Counter(a), Counter(b)
    place = {w: k for k, w in enumerate(b) if in_b[w] == 1}
    anchors = _increasing([(k, place[w]) for k, w in enumerate(a) if in_a[w] == 1 and w in place])
    if not anchors:
        return [(i + x, j + y) for x, y in _common(a, b)] if in_a.keys() & in_b.keys() else []
    out, x0, y0 = [], 0, 0
    for x, y in (*anchors, (len(a), len(b))):
        out += patience(a[x0:x], b[y0:y], i + x0, j + y0)
        if x < len(a):
            out.append((i + x, j + y))
        x0, y0 = x + 1, y + 1
    return out


def _scan(names: list[str], templates: list[list[int]], least: float, cores: list):
    vocabulary = np.unique(np.array([w for t in templates for w in t], np.uint64))
    weight = np.zeros((len(vocabulary), len(templates)))
    for k, t in enumerate(templates):
        for w, c in Counter(t).items():
            weight[np.searchsorted(vocabulary, np.uint64(w)), k] = c
    sizes = [len(t) for t in templates]
    need = np.array([least * n - 1e-9 for n in sizes])

    def run(it):
        for batch in it:
            for ids, texts in slices(list(batch.columns), 1):
                t = TextBatch(texts)
                starts, ends = t.spans(WORD[t.buf])
                h, doc = t.hashes(starts, ends), t.doc_of(starts)
                border = np.searchsorted(doc, np.arange(t.n + 1))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                present = np.zeros((t.n, len(vocabulary)), bool)
                present[doc[hit], at[hit]] = True
                # no alignment covers more than the template's words that the text has at all
                rows = []
                for d, k in zip(*np.nonzero(present @ weight >= need)):
                    own = hit[np.searchsorted(hit, border[d]) : np.searchsorted(hit, border[d + 1])]
                    own = own[weight[at[own], k] > 0]
                    best = _best(own - border[d], h[own], templates[k], need[k], cores[k])
                    if best:
                        rows.append((d, k, *best))
                rows = _winners(rows, sizes)
                if rows:
                    d, k, matched, first, last = map(np.array, zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array([names[x] for x in k]), pa.array(np.round(matched / np.array([len(templates[x]) for x in k]), 6)), int64(matched), int64(first), int64(last)],
                        ["doc_id", "license", "coverage", "matched", "first_word", "last_word"])

    return run


#: Least share of aligned words that stand next to each other in the text as in the template.
TOGETHER = 0.5


def _best(places: np.ndarray, words: np.ndarray, template: list[int], need: float, cores=()):
    """(matched, first word, last word) of the best alignment; None below `need`. `places` are those of the text's words
    that the template has, in order; other words cannot align.

    The whole text is aligned, so it doesn't matter where a license stands or what is put between its parts. So is
    the stretch around each place of its first distinguishing word, or, without one, around each place of its rarest
    word in the text; of equally good ones the whole text comes last, as a stretch tells better where the license is.
    """
    m, values = len(template), words.tolist()
    if cores:
        mark = template[cores[0][0]]
        if not all(template[k] in set(values) for at in cores for k in at):
            return None
    else:
        counts = Counter(values)
        mark = min(sorted(counts), key=counts.get)
    off = template.index(mark)
    best, end = None, -1
    stretches = []
    for p in places[words == np.uint64(mark)].tolist():
        a, b = np.searchsorted(places, [p - 2 * max(off, 4), p + 2 * max(m - off, 4)])
        if b > end:  # else within the one before
            stretches.append((a, b))
            end = b
    for a, b in [*stretches, (0, len(values))]:
        if b - a < need or (best and best[0] == m):
            continue
        pairs = [(int(places[a + i]), j) for i, j in patience(values[a:b], template)]
        if len(pairs) < need or not _told(pairs, cores) or (best and len(pairs) <= best[0]):
            continue
        together = sum(x[0] + 1 == y[0] and x[1] + 1 == y[1] for x, y in zip(pairs, pairs[1:]))
        if together >= TOGETHER * (len(pairs) - 1):
            best = (len(pairs), pairs[0][0], pairs[-1][0])
    return best


def _winners(rows: list[tuple], sizes: list[int]) -> list[tuple]:
    """Of templates that align with the same words of a text, the one that explains most of them: rows (text, template,
    matched, first, last) without those that overlap a better one by more than half of the shorter of both."""
    kept: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[2], -r[2] / sizes[r[1]], r[1])):
        others = kept.setdefault(r[0], [])
        if not any(2 * (min(r[4], o[4]) - max(r[3], o[3]) + 1) > min(r[4] - r[3], o[4] - o[3]) + 1 for o in others):
            others.append(r)
    return sorted(r for rs in kept.values() for r in rs)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """Licenses found in each document, by the share of the template's words that align with it in order.

    Result: (doc_id, license, coverage, matched, first_word, last_word): one row for every row of docs and template
    covered by at least `coverage`, at its best place, the first on a tie; word positions count from 0. The whole text is
    aligned, and at least half of the aligned words must stand together as in the template. Phrases that tell a license
    from its likes (CORES, for the built-in templates) must align as they are; of templates that cover the same words the
    one with most of them wins, then the higher coverage, then the first. Case and punctuation don't matter. Null, empty and blank texts, and texts without a license, give no rows; repeated rows give
    repeated rows; a null id stays null; long texts are scanned whole; an empty table gives no rows. Templates
    without words are ignored.

    One pass, no shuffle. The check of which words a text has at all is exact: it only leaves out what can't reach
    `coverage`.
    """
    phrases = CORES if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    words = words_of([t.lower() for t in templates.values()])
    used = [(n, w) for n, w in zip(templates, words) if w]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    schema = f"doc_id {id_type}, license string, coverage double, matched long, first_word long, last_word long"
    if not used:
        return docs.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_scan([n for n, _ in used], [w for _, w in used], coverage, [_cores(phrases.get(n, []), w) for n, w in used]), schema)
