"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Texts become words (lower-case runs of letters, digits and non-ASCII characters).  Words outside the
templates' vocabulary are one symbol.  Runs of GRAM words are hashed, and of every WINDOW neighbours the
least hash is kept (the rightmost of equals), so any shared run of GRAM + WINDOW - 1 words shares a
fingerprint.  An inverted index from fingerprint to template says which stretches of the text to align.

An alignment matches words of a template with words of the text in order.  Up to BAND words of the text
between two matched words cost nothing; a longer gap, of up to ``gap_for(template)`` words, is a jump to
another band and must pay for itself: the best alignment has the most matched words less JUMP a jump (of
equals the one that skips the fewest words, then the first).  So a clause or a page header put into a
license costs no coverage, while a lone word far away adds none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import plain_words

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.8
JUMP, GAP, LONG, LONGEST = 3, 64, 64, 8192
SPANS = "array<struct<license:string,coverage:double,matched_words:int,template_words:int,start:int,end:int>>"

#: Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-2.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


#: An alignment's worth is one integer: matched words less JUMP a jump, then skipped words, then jumps.
UNIT, SKIP = 1 << 40, 1 << 12


def gap_for(length: int) -> int:
    """Words that a template of ``length`` words may have put in at one place."""
    return GAP if length >= LONG else max(1, length // 4)


def worths(template: Sequence[int], words, band: int, gap: int):
    """For each word of the text, the worth of the best alignment that ends there (far below 0: none).

    One pass over the template's words; each looks at its own places in the text only, and at the ``gap``
    words before them.  Unknown words (0) match nothing.
    """
    import numpy as np

    words, steps = np.asarray(words, np.int64), np.arange(gap + 1, dtype=np.int64)
    pays = UNIT - steps * SKIP - (steps > band) * (JUMP * UNIT + 1)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    best = np.full(len(words) + gap + 1, -(1 << 61), np.int64)  # gap + 1 places before the text
    back = gap - steps
    for w in template:
        lo, hi = np.searchsorted(ranked, (w, w + 1)) if w else (0, 0)
        new = []
        for c in range(lo, hi, 8192):
            at = order[c : min(hi, c + 8192)]
            new.append((at + gap + 1, np.maximum((best[at[:, None] + back] + pays).max(axis=1), UNIT)))
        for at, worth in new:
            best[at] = np.maximum(best[at], worth)
    return best[gap + 1 :]


def unpack(worth: int) -> tuple[int, int]:
    """(matched, skipped) words of a worth."""
    score = -(-worth >> 40)
    skipped, jumps = divmod(score * UNIT - worth, SKIP)
    return score + JUMP * jumps, skipped


def align(template: Sequence[int], words: Sequence[int], start: int = 0, band: int = BAND, gap: int | None = None) -> tuple[int, int, int]:
    """(matched, first, end) of the best alignment of a template with the words from ``start`` on; (0, 0, 0): none."""
    ends = worths(template, words[start:], band, band if gap is None else gap)
    if not len(ends) or ends.max() < 0:
        return 0, 0, 0
    j = int(ends.argmax())
    matched, skipped = unpack(int(ends[j]))
    return matched, start + j + 1 - matched - skipped, start + j + 1


def alignments(template, words, lo: int, hi: int, least: float, band: int, gap: int) -> Iterator[tuple[int, int, int]]:
    """(matched, first, end) of every alignment of at least ``least`` words within words[lo:hi].

    The best stand (equals from left to right); then the same holds between them.
    """
    import numpy as np

    counts = np.bincount(template)
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        part = words[lo:hi]
        own = np.bincount(part, minlength=len(counts))[: len(counts)]
        if np.minimum(own, counts)[1:].sum() < least:  # too few words, whatever their order
            continue
        ends = worths(template, part, band, gap)
        score = -(-ends >> 40)
        ends = np.where(score + JUMP * ((score * UNIT - ends) & (SKIP - 1)) >= least, ends, -1)
        if ends.max() < 0:
            continue
        at = 0
        for j in np.flatnonzero(ends == ends.max()).tolist():
            matched, skipped = unpack(int(ends[j]))
            if (first := j + 1 - matched - skipped) >= at:
                yield matched, lo + first, lo + j + 1
                todo.append((lo + at, lo + first))
                at = j + 1
        todo.append((lo + at, hi))


class Scanner:
    """Templates, their vocabulary and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        import numpy as np

        self.coverage, self.number = coverage, {}
        if any(len(plain_words(t)) > LONGEST for t in templates.values()):
            raise ValueError(f"a template of over {LONGEST} words")
        self.names = sorted(templates)
        self.ids = [[self.number.setdefault(w, len(self.number) + 1) for w in plain_words(templates[n])] for n in self.names]
        self.index: dict[int, list[int]] = {}
        for t, ids in enumerate(self.ids):
            for h in set(self.winnow(np.array(ids, np.int64))[1].tolist()):
                self.index.setdefault(h, []).append(t)
        self.known = np.array(sorted(self.index), np.uint64)

    @staticmethod
    def hashes(ids):
        """Hash of every run of GRAM words (multiply-xor over the words' numbers)."""
        import numpy as np

        h = np.zeros(len(ids) - GRAM + 1, np.uint64)
        for g in range(GRAM):
            h = (h ^ ids[g : len(ids) - GRAM + 1 + g].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    @classmethod
    def winnow(cls, ids):
        """(places, hashes) of the kept fingerprints."""
        import numpy as np

        if len(ids) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = cls.hashes(ids)
        if len(h) <= WINDOW:
            at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
        else:
            views = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)  # reversed: argmin then takes the rightmost
            at = np.unique(len(h) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))
        return at, h[at]

    def scan(self, text: str | None) -> list[dict]:
        """Matches of COVERAGE or more, best first where they overlap, as spans of the original text's characters."""
        import numpy as np

        if not text:
            return []
        number = self.number
        ids = np.fromiter((number.get(w, 0) for w in plain_words(text)), np.int64)
        if not ids.any():
            return []
        at, h = self.winnow(ids)
        seeds = np.flatnonzero(np.isin(h, self.known))
        if not len(seeds):
            return []
        places: dict[int, list[int]] = {}
        for s in seeds.tolist():
            for t in self.index[int(h[s])]:
                places.setdefault(t, []).append(int(at[s]))
        found = []
        for t, seen in places.items():
            template = self.ids[t]
            gap = gap_for(len(template))
            # an alignment reaches as far from a fingerprint as its template and one jump
            reach, regions = len(template) + gap, []
            for a in seen:
                if regions and a - reach <= regions[-1][1]:
                    regions[-1][1] = a + GRAM + reach
                else:
                    regions.append([max(0, a - reach), a + GRAM + reach])
            for lo, hi in regions:
                found += [(m, t, a, b) for m, a, b in alignments(template, ids, lo, min(hi, len(ids)), self.coverage * len(template), min(BAND, gap), gap)]
        found.sort(key=lambda x: (-x[0], -x[0] / len(self.ids[x[1]]), x[2], self.names[x[1]]))
        if not found:
            return []
        out: list[tuple[int, int, int, int]] = []  # in order of place
        for m, t, a, b in found:
            k = bisect.bisect(out, (a,))
            if (not k or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
                out.insert(k, (a, b, m, t))
        # str.lower() can change a text's length, so places are found in the original, word by word
        chars = [x.span() for x in _words(text)]
        return [{"license": self.names[t], "coverage": round(m / len(self.ids[t]), 6), "matched_words": m, "template_words": len(self.ids[t]), "start": chars[a][0], "end": chars[b - 1][1]} for a, b, m, t in out]


def _words(text: str):
    return re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)


def spans(text: Column, templates: dict[str, str], coverage: float = COVERAGE) -> Column:
    scanner: list[Scanner] = []

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        if not scanner:
            scanner.append(Scanner(templates, coverage))
        return pd.Series([scanner[0].scan(t) for t in texts], dtype=object)

    return scan(text)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, template_words, start, end): every match in every whole text.

    Where matches overlap, the one with more matched words stands (ties: the higher coverage, the earlier,
    then by name).  Null and empty texts match nothing and an empty table gives no row; repeated rows each
    report; other columns, whatever their names, are ignored.  Long texts are read whole: only stretches
    around shared fingerprints are aligned, in memory that grows with such a stretch.  Templates are a
    parameter of bounded size, shipped with the function.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(spans(F.col(text_col), templates or TEMPLATES, coverage)).alias("s"))
    return found.select("doc_id", "s.*")
