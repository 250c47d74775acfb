"""License scans by conditional compression.

Blocks of words around a template's own rarest words, across line ends, are compressed by
themselves and with every template that may stand in the text as a raw dictionary. Templates are
ranked by the bytes they save; in that order, while they save any, a template is confirmed if a
stretch of the block differs from it in few words, none of them a name or a version. A stretch
belongs to the first template that is confirmed on it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import small_batches

# Public short notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-only": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Words of a short notice that have to stand side by side as they are; so has every word with a digit.
CORES = {
    "Apache-2.0": ("apache license",), "BSD-2-Clause": ("bsd 2-clause",), "BSD-3-Clause": ("bsd 3-clause",), "CC-BY-4.0": ("cc by 4.0",), "CC-BY-NC-4.0": ("cc by-nc 4.0",),
    "CC-BY-SA-4.0": ("cc by-sa 4.0",), "CC0-1.0": ("cc0 1.0",), "GPL-2.0-only": ("gnu general public license",), "GPL-3.0-only": ("gnu general public license",),
    "LGPL-3.0-only": ("gnu lesser general public license",), "MIT": ("mit license",), "MPL-2.0": ("mozilla public license",), "all-rights-reserved": ("all rights reserved",),
}
# licenses' own texts, the notices they ask to be put on a work, and short forms, with their cores. Two texts of one license may stand for each other.
_GPL = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BODIES = [
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("gnu affero general public license",)),
    ("AGPL-3.0-or-later", f"This program is free software: {_GPL.format('Affero ')}, either version 3 of the License, or (at your option) any later version.", ("gnu affero general public license",)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license",)),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", ("provided with the distribution this software is provided by the",)),
    ("BSD-2-Clause", _BSD.format(""), ("provided with the distribution this software is provided by the",)),
    ("BSD-3-Clause", _BSD_NAMES, ("endorse or promote products derived from this software",)),
    ("BSD-3-Clause", _BSD.format(f"3. {_BSD_NAMES}. "), ("endorse or promote products derived from this software",)),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", ("boost software license",)),
    ("BUSL-1.1", "Business Source License 1.1", ("business source license 1.1",)),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License", ("creative commons attribution 4.0",)),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License", ("creative commons attribution-noncommercial 4.0",)),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License", ("creative commons attribution-sharealike 4.0",)),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", ("cc0 1.0 universal",)),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("gnu general public license",)),
    ("GPL-2.0-or-later", f"This program is free software; {_GPL.format('')}; either version 2 of the License, or (at your option) any later version.", ("gnu general public license",)),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu general public license",)),
    ("GPL-3.0-only", "Licensed under the GPLv3", ("gplv3",)),
    ("GPL-3.0-or-later", f"This program is free software: {_GPL.format('')}, either version 3 of the License, or (at your option) any later version.", ("gnu general public license",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ()),
    ("ISC", "Released under the ISC License.", ("isc license",)),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu lesser general public license",)),
    ("MIT", _MIT_GRANT, ()),
    ("MIT", _MIT_NOTICE, ("copyright notice and this permission notice",)),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE}. {_MIT_WARRANTY}", ("copyright notice and this permission notice",)),
    ("MIT", "MIT licensed", ("mit licensed",)),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", ("mozilla public license",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ()),
]
#: A one-line tag that files carry, for every license known.
TAG = "SPDX-License-Identifier: {}"
#: Words of any text: they say little of where a license stands.
COMMON = frozenset("a all an and any are as at be but by can for from if in is it its may not of on one or other out shall that the their this to use was were which with you".split())
#: The share of a template's words that may differ, names and versions apart.
DIFFERENT = 0.2
#: Blocks kept in a task's cache.
CACHE_BLOCKS = 50_000
#: A block is at most so many times as long as a template with all its differences; longer runs are several blocks, each beginning half a block on.
BLOCK = 4

_WORDS = re.compile(r"[\w.+-]*\w")


def words_of(text: str) -> list[str]:
    """Lower-case words; inner dots, hyphens and plus signs belong to a word."""
    return _WORDS.findall(text.lower())


def wording_differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(differences, first, end): fewest words changed, left out or put in to find the template in a stretch of the block."""
    row = [(0, j) for j in range(len(block) + 1)]  # the stretch may begin anywhere
    for i, want in enumerate(template, 1):
        last, row = row, [(i, 0)]
        for j, have in enumerate(block, 1):
            row.append(min((last[j - 1][0] + (want != have), last[j - 1][1]), (last[j][0] + 1, last[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


def alignments(template: list[str], tied: list[bool], glued: list[bool], words: list[str], most: int) -> Iterator[tuple[int, int, int]]:
    """(differences, first, end) for every end with at most ``most``; ``tied`` words stay, and nothing comes between one that is ``glued`` and the next."""
    row = [(0, j) for j in range(len(words) + 1)]  # the stretch may begin anywhere
    for i, want in enumerate(template):
        last, out = row, most + 1
        row = [(out if tied[i] else last[0][0] + 1, 0)]
        for j, have in enumerate(words, 1):
            same = want == have
            best = (last[j - 1][0] + (0 if same else out if tied[i] else 1), last[j - 1][1])
            if not tied[i]:
                best = min(best, (last[j][0] + 1, last[j][1]))
            if not glued[i]:
                best = min(best, (row[j - 1][0] + 1, row[j - 1][1]))
            row.append(best)
    yield from ((d, first, end) for end, (d, first) in enumerate(row) if d <= most)


class Template:
    """A license's text as words: which are tied, which words show where it may stand, and how far a stretch of it reaches."""

    def __init__(self, name: str, text: str, cores: tuple[str, ...]) -> None:
        self.name, self.words = name, words_of(text)
        self.tied, self.glued = [any(map(str.isdigit, w)) for w in self.words], [False] * len(self.words)
        for core in map(str.split, cores):
            for k in range(len(self.words) - len(core) + 1):
                if self.words[k : k + len(core)] == core:
                    self.tied[k : k + len(core)] = [True] * len(core)
                    self.glued[k : k + len(core) - 1] = [True] * (len(core) - 1)
        self.must = {w for w, t in zip(self.words, self.tied, strict=True) if t}
        self.most = int(DIFFERENT * len(self.words) + 1e-9)
        self.reach = len(self.words) + self.most
        self.own, self.counts = set(self.words), Counter(self.words)
        rare = sorted(self.must or self.own, key=lambda w: (w in COMMON, -len(w), w))
        #: No stretch is without one of these: a tied word cannot change, and of others one more than may change is asked for.
        self.anchors = set(rare[: 1 if self.must else self.most + 1])

    def may_stand(self, have: set[str]) -> bool:
        """Whether a text of these words may hold it."""
        return self.must <= have and not self.anchors.isdisjoint(have) and len(self.own & have) >= len(self.own) - self.most

    def missing(self, counts: Counter) -> int:
        """Words of the template that a block has too few of: no alignment has fewer differences."""
        return sum(n - min(n, counts[w]) for w, n in self.counts.items())


class Scanner:
    """Compressors with each template as dictionary, and the blocks already judged."""

    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard

        level = 3
        texts = [(name, text, CORES.get(name, ()) if TEMPLATES.get(name) == text else ()) for name, text in sorted(templates.items())]
        texts += [x for x in BODIES if x[0] in templates or templates == TEMPLATES]
        if templates == TEMPLATES:
            named = sorted({x[0] for x in texts} - {"all-rights-reserved"})
            texts += [(n, TAG.format(n), (" ".join(words_of(TAG.format(n))),)) for n in named]
        self.plain = zstandard.ZstdCompressor(level=level)
        self.templates = [t for t in (Template(*x) for x in texts) if t.words]
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.templates]
        self.anchors = set().union(*[t.anchors for t in self.templates]) if self.templates else set()
        self.known: dict[tuple, list[tuple]] = {}

    def ranked(self, words: list[str], which: list[int]) -> list[tuple[int, int]]:
        """(bytes saved, template) of those templates that save any on a block, most first."""
        raw = " ".join(words).encode(errors="replace")
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(self.given[t].compress(raw)), t) for t in which]
        return sorted([x for x in saved if x[0] > 0], key=lambda x: (-x[0], x[1]))

    def spans(self, words: tuple[str, ...], which: tuple[int, ...]) -> list[tuple[int, int, int, int, int]]:
        """(bytes saved, differences, first word, end, template) of the confirmed stretches of a block, in rank order."""
        if (found := self.known.get((words, which))) is None:
            if len(self.known) > CACHE_BLOCKS:
                self.known.clear()
            found, counts = [], Counter(words)
            for saved, t in self.ranked(words, which):
                own = self.templates[t]
                if own.missing(counts) <= own.most:
                    found += [(saved, d, a, b, t) for d, a, b in alignments(own.words, own.tied, own.glued, words, own.most) if b > a]
            self.known[words, which] = found
        return found

    def judge(self, block: str) -> list[tuple[str, int, int]]:
        """(license, bytes saved, differences) of the confirmed templates of a block, fewest differences first."""
        return [(name, saved, d) for d, _, name, saved in sorted((d, -saved, name, saved) for _, _, name, saved, d in self.scan(block))]

    def _blocks(self, words: list[str], have: set[str], which: list[int]) -> dict[tuple[int, int], None]:
        """Word ranges around the anchors of the templates that may stand in a text; every stretch lies whole in one."""
        out: dict[tuple[int, int], None] = {}
        at = {t: [] for t in which}
        for k, w in enumerate(words):
            if w in self.anchors:
                for t in which:
                    if w in self.templates[t].anchors:
                        at[t].append(k)
        for t, hits in at.items():
            reach, runs = self.templates[t].reach, []
            for k in hits:
                a, b = max(0, k - reach), min(len(words), k + reach + 1)
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            for a, b in runs:
                size = BLOCK * (reach + 1)
                out |= dict.fromkeys([(k, min(b, k + size)) for k in range(a, max(a + 1, b - size // 2), size // 2)])
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(first character, end, license, bytes saved, differences) of a text, in order: a stretch is the license's that saves most on its block, then the one with fewest differences, then the longest."""
        words = [w.lower() for w in _WORDS.findall(text)]
        have = set(words)
        if self.anchors.isdisjoint(have):
            return []
        which = [t for t, own in enumerate(self.templates) if own.may_stand(have)]
        if not which:
            return []
        found: dict[tuple[int, int, int], tuple[int, int]] = {}
        for a, b in self._blocks(words, have, which):
            near = set(words[a:b])
            here = tuple(t for t in which if self.templates[t].may_stand(near))
            for saved, d, first, end, t in self.spans(tuple(words[a:b]), here) if here else ():
                key = (a + first, a + end, t)
                found[key] = max(found.get(key, (0, 0)), (saved, -d))
        if not found:
            return []
        places = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
        taken: list[tuple[int, int]] = []
        kept = []
        for (saved, less), a, b, t in sorted(((v, a, b, t) for (a, b, t), v in found.items()), key=lambda x: (-x[0][0], -x[0][1], x[1] - x[2], x[1], x[3])):
            # Stretches that are kept do not overlap: only the two beside this one matter.
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                taken.insert(k, (a, b))
                kept.append((places[a][0], places[b - 1][1], self.templates[t].name, saved, -less))
        return sorted(kept)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, block_start, block_end, license, saved_bytes, differences) for every license that a text of ``docs`` (doc_id, text) carries.

    A block is the line, or the lines, on which a confirmed stretch of words stands; several
    licenses give a row each. Null and empty texts have no blocks; a null doc_id is carried;
    repeated rows and lines are found each; other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    used = dict(templates or TEMPLATES)
    kind = "doc_id long, block_start long, block_end long, license string, saved_bytes int, differences int"

    def blocks(scanner: Scanner, text: str) -> Iterator[tuple]:
        for a, b, *what in scanner.scan(text):
            end = text.find("\n", b)
            yield text.rfind("\n", 0, a) + 1, end if end >= 0 else len(text), *what

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(used)
        for b in batches:
            rows = [
                (doc_id, *found)
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for found in blocks(scanner, text or "")
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "block_start", "block_end", "license", "saved_bytes", "differences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, kind)
