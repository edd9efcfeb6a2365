"""Operator 2: license scans by MinHash over text windows, verified by shingle containment.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; shingles are
5 words.  Every template has a window size class (its own number of shingles, rounded up
to a power of two times 1, 1.25, 1.5 or 1.75); windows of that many shingles overlap by
three quarters.  A window's MinHash signature is cut into ``BANDS`` bands of ``ROWS``; a
template is retrieved if a band is equal.  A template held to ``CONTAINMENT`` in the worst
place between two windows has Jaccard 0.54 with the better of them, and then misses all 32
bands of 2 rows with probability (1 - 0.54^2)^32 = 1.6e-5.

A retrieved window is verified exactly.  An occurrence starts at a shingle of the template
and spans as many shingles as the template has; its containment is the share of the
template's different shingles in it.  Of overlapping occurrences of one template the one
of highest containment stays (then the leftmost), so notices in a row are one span each.
Of two templates whose spans share more than half of both, as the notices of one license
family do, the one of higher containment stays.

A window can only share a MinHash value with a template if it holds one of the template's
shingles, so windows without any are never signed; this loses no match.

Scale.  One narrow Arrow stage; templates are a dictionary of the caller, broadcast in
blocks of at most ``BLOCK`` templates that each text passes in turn.

Defined cases: null and empty texts have no licenses; a template of fewer than five words
is one shingle of all its words, one without words never matches; repeated rows are each
scanned; extra columns pass through if named in ``keep``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .session import arrow_batches, fresh
from .textbytes import ALNUM, Words, grams, mix, slices, text_bytes, whole

SHINGLE = 5
BANDS = 32
ROWS = 2
CONTAINMENT = 0.8
BLOCK = 10_000
_PERMUTE = np.random.RandomState(11).randint(1, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)

# License notices.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "MIT-short": "Licensed under the MIT License.",
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
        "OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
        "later version."
    ),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
        "is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}


def window_class(n: int) -> int:
    """The smallest window size of ``n`` shingles or more: 1, 2, 3, 4, then 5/4, 6/4, 7/4 and 8/4 of powers of two."""
    size = 1
    while size * 2 <= n:
        size *= 2
    return next(w for w in (size, -(-size * 5 // 4), -(-size * 6 // 4), -(-size * 7 // 4), size * 2) if w >= n)


def signature_bands(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band keys of the ranges [start, end) of shingle values, one row per range."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    n = ends - starts
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):  # a bounded number of values at a time
        done = total[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(total, done + (1 << 18), "right")))
        first = total[lo:hi] - n[lo:hi] - done
        part = values[np.arange(total[hi - 1] - done) - np.repeat(first - starts[lo:hi], n[lo:hi])]
        own = out[lo:hi]
        for b in range(BANDS):
            for r in range(ROWS):
                least = np.minimum.reduceat(mix(part * _PERMUTE[b * ROWS + r]), first)
                own[:, b] = mix(own[:, b] ^ least) + np.uint64(b)
        lo = hi
    return out


class Templates:
    def __init__(self, named: dict[str, str]):
        self.names = list(named)
        words = Words([t.encode() for t in named.values()], ALNUM, lower=True)
        h = words.hashes()
        self.sets, self.span, self.width = [], [], []
        for i in range(len(self.names)):
            own = h[words.first[i] : words.first[i + 1]]
            width = min(SHINGLE, len(own))
            self.sets.append(np.unique(grams(own, width)) if width else np.zeros(0, np.uint64))
            self.span.append(max(len(own) - SHINGLE + 1, 1))
            self.width.append(width)
        self.by_width: dict[int, dict[int, list[int]]] = {}
        for i, (n, w) in enumerate(zip(self.span, self.width, strict=True)):
            if w:
                self.by_width.setdefault(w, {}).setdefault(window_class(n), []).append(i)
        self.keys = {}
        for w, classes in self.by_width.items():
            for c, members in classes.items():
                values = np.concatenate([self.sets[i] for i in members])
                n = np.array([len(self.sets[i]) for i in members])
                self.keys[w, c] = signature_bands(values, np.cumsum(n) - n, np.cumsum(n))
        self.shingles = {w: np.unique(np.concatenate([self.sets[i] for c in cs.values() for i in c])) for w, cs in self.by_width.items()}

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """(template, first word, end word, containment) of every text, by first word."""
        words = Words(texts, ALNUM, lower=True)
        first, h, text = words.first, words.hashes(), words.text_of_word()
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for width, classes in self.by_width.items():
            g = grams(h, width)
            known = self.shingles[width]
            table = np.zeros(1 << 16, bool)
            table[known >> np.uint64(48)] = True
            hit = np.flatnonzero(table[g >> np.uint64(48)] & whole(text, width))
            hit = hit[np.isin(g[hit], known)]
            for size, members in classes.items() if len(hit) else ():
                begin = first[text[hit]]
                self._windows(g, hit, begin, first[text[hit] + 1] - width + 1, size, width, members, first, text, out)
        return [best_of_families(found) for found in out]

    def _windows(self, g, hit, base, last, size, width, members, first, text, out) -> None:
        """Retrieve templates by the bands of every window that holds a hit, and verify them around it."""
        step = max(1, size // 4)
        begin = []
        for back in range(-(-size // step) + 1):
            at = base + ((hit - base) // step - back) * step
            begin.append(np.stack([at, last])[:, (at >= base) & (at + size > hit)])
        begin = np.unique(np.concatenate(begin, 1), axis=1)
        start, end = begin[0], np.minimum(begin[0] + size, begin[1])
        bands = signature_bands(g, start, end)
        for k, i in enumerate(members):
            got = np.flatnonzero((bands == self.keys[width, size][k]).any(1))
            if len(got):
                own = np.isin(g[hit], self.sets[i])
                near = np.zeros(len(g) + 1, np.int64)  # occurrences may start a window before a retrieved one
                np.add.at(near, np.maximum(start[got] - size, first[text[start[got]]]), 1)
                np.add.at(near, end[got], -1)
                at = hit[own]
                for a, b, share in occurrences(at, g[at], last[own], self.span[i], len(self.sets[i]), width, np.cumsum(near)[at] > 0):
                    out[text[a]].append((self.names[i], int(a - first[text[a]]), int(b - first[text[a]]), share))


def occurrences(at, values, last, span: int, size: int, width: int, near) -> list[tuple[int, int, float]]:
    """(first word, end word, containment) of the chosen occurrences of one template.

    ``at`` and ``values``: sorted places of the template's shingles, ``last``: the end of
    each one's text, ``near``: whether an occurrence may start there.  Every place counts the
    different shingles in the ``span`` places from it: all, less those whose like comes before
    them in the window.
    """
    n = len(at)
    behind = np.searchsorted(at, np.minimum(at + span, last))
    order = np.lexsort((at, values, last))
    again = np.flatnonzero((values[order][1:] == values[order][:-1]) & (last[order][1:] == last[order][:-1]))
    earlier, later = order[again], order[again + 1]
    low = np.maximum(np.searchsorted(at, at[later] - span, "right"), np.searchsorted(last, last[later]))
    inside = low <= earlier
    change = np.bincount(low[inside], minlength=n + 1) - np.bincount(earlier[inside] + 1, minlength=n + 1)
    share = (behind - np.arange(n) - np.cumsum(change)[:n]) / size
    good = np.flatnonzero((share >= CONTAINMENT) & near)
    good = good[np.lexsort((at[good], -share[good]))]
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for k in good.tolist():
        a, b = int(at[k]), int(at[behind[k] - 1]) + width
        place = bisect_left(starts, a)
        if (place == 0 or ends[place - 1] <= a) and (place == len(starts) or starts[place] >= b):
            starts.insert(place, a)
            ends.insert(place, b)
            out.append((a, b, float(share[k])))
    return out


def best_of_families(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Without spans that share more than half of both with one of higher containment (then by place and name)."""
    blocks: dict[int, list[tuple[int, int]]] = {}
    out = []
    for name, a, b, share in sorted(found, key=lambda f: (-f[3], f[1], f[0])):
        # More than half of both in common: they share the word in the middle of either.
        near = [x for m in range(a >> 8, (b - 1 >> 8) + 1) for x in blocks.get(m, ())]
        if any(2 * (min(b, d) - max(a, c)) > max(b - a, d - c) for c, d in near):
            continue
        blocks.setdefault(a + b >> 9, []).append((a, b))
        out.append((name, a, b, share))
    return sorted(out, key=lambda f: (f[1], f[0]))


_FOUND = ArrayType(StructType([
    StructField("license", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("containment", DoubleType()),
]))
_FIELDS = ("license", "start", "end", "containment")
_FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def _scanner(templates, n_keep: int, names: list[str]) -> Callable:
    """(kept columns, matches, text): add the matches of one block of templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before = text_bytes(batch.column(n_keep + 1)), batch.column(n_keep).to_pylist()
            rows = [r for lo, hi in slices(texts) for r in templates.value.scan(texts[lo:hi])]
            rows = [best_of_families([tuple(m.values()) for m in b] + r) if b else r for b, r in zip(before, rows, strict=True)]
            found = pa.array([[dict(zip(_FIELDS, f, strict=True)) for f in r] for r in rows], _FOUND_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], found, batch.column(n_keep + 1)], names=names)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``matches`` (license, start and end word, containment) of every whole text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    matches, source = fresh(keep, "matches", "_text")
    schema = StructType([*docs.select(*keep).schema, StructField(matches, _FOUND), StructField(source, StringType())])
    rows = docs.select(*keep, F.array().cast(_FOUND).alias(matches), F.col(text).alias(source))
    named = list((TEMPLATES if templates is None else templates).items())
    for lo in range(0, max(len(named), 1), BLOCK):
        shared = spark.sparkContext.broadcast(Templates(dict(named[lo : lo + BLOCK])))
        rows = rows.mapInArrow(_scanner(shared, len(keep), schema.names), schema)
    return rows.drop(source)
