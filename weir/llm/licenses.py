"""License scans (operator 2): MinHash bands over overlapping windows, then exact containment.

Texts become shingles of five words (letters and digits, lower-cased). Every
template has a window length, the power of two up to half its shingles, and the
MinHash of each of its windows of that length is kept under its band. A
document is read in windows of the same lengths, half overlapping; a document
window in a quoted template has a template window beside it with Jaccard 2/3 or
more, so with `bands` bands of one row the chance that none collides is below
(1/3)**bands, 2e-4 for eight. A hit names a template and a place; there the
shingles are compared exactly, and a template counts if `containment` of its
shingles are found.

Templates are a bounded list, part of every task; texts are never shuffled. A
document without any shingle of any template, as most are, is left after one
lookup. Nothing is gathered, whatever is common.

Templates share wording (versions of a license, a line and the whole notice). Of
matches whose places overlap the one with most shingles found stays, of equal
ones the one of larger containment, then of the first name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import chunks, mix, table, word_hashes
from weir.llm.substring import _ROLL, rolling

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 8

#: Wording of public licenses and of their notices.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(kind: str, version: str) -> str:
    return (
        f"is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
        f"You should have received a copy of the GNU {kind} along with this program."
    )


TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0 license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 terms": (
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. "
        "3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT
    ),
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    ),
    "BSD-2-Clause": _BSD_START + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_WARRANTY,
    "GPL-2.0-or-later": _gnu("General Public License", "2"),
    "GPL-3.0-or-later": _gnu("General Public License", "3"),
    "LGPL-2.1-or-later": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-or-later": _gnu("Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
}

_BETWEEN = np.ones(256, dtype=bool)
for _c in (*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)):
    _BETWEEN[_c] = False
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(data: bytes, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's hash and document; shingles never span documents."""
    starts, _, words = word_hashes(np.frombuffer(data.lower(), np.uint8), _BETWEEN)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    inside = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :])
    return rolling(words, width, _ROLL)[inside], doc[inside]


class Index:
    """Templates by length of window and band."""

    def __init__(self, templates: dict[str, str], width: int = SHINGLE, bands: int = BANDS):
        self.width, self.bands, self.names = width, bands, sorted(templates)
        self.sets, held = [], {}
        for t, name in enumerate(self.names):
            s, _ = shingles(templates[name].encode() + b" ", np.array([0, len(templates[name].encode()) + 1]), width)
            if not len(s):
                raise ValueError(f"template {name} has fewer than {width} words")
            self.sets.append(np.unique(s))
            length = 1
            while 4 * length <= len(s):
                length *= 2
            for a in range(len(s) - length + 1):
                for b in range(bands):
                    held.setdefault((length, b), []).append((int(mix(s[a : a + length] + _SEEDS[b]).min()), t))
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.lengths = sorted({k[0] for k in held})
        self.keys = {}
        for k, pairs in held.items():
            pairs = sorted(set(pairs))
            self.keys[k] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))

    def matches(self, s: np.ndarray, containment: float) -> list[tuple[int, float, int]]:
        """(template, containment, first shingle) of the templates that a document's shingles hold."""
        at = np.minimum(np.searchsorted(self.every, s), len(self.every) - 1)
        if not (self.every[at] == s).any():
            return []
        hits = set()
        for length in self.lengths:
            if len(s) < length:
                continue
            step = max(1, length // 2)
            first = np.arange(0, len(s) - length + 1, step)
            if first[-1] != len(s) - length:
                first = np.append(first, len(s) - length)
            for b in range(self.bands):
                least = np.lib.stride_tricks.sliding_window_view(mix(s + _SEEDS[b]), length)[first].min(axis=1)
                keys, owners = self.keys[length, b]
                low, high = np.searchsorted(keys, least), np.searchsorted(keys, least, side="right")
                for i in np.flatnonzero(high > low):
                    hits.update((int(t), int(first[i])) for t in owners[low[i] : high[i]])
        best: dict = {}
        for t, a in sorted(hits):
            n = len(self.sets[t])
            low = max(0, a - 2 * n)
            own = np.flatnonzero(np.isin(s[low : a + 2 * n], self.sets[t]))
            found = len(np.unique(s[low : a + 2 * n][own]))
            if found >= containment * n and found > best.get(t, (0,))[0]:
                best[t] = (found, low + int(own[0]), low + int(own[-1]))
        kept = apart([(found, found / len(self.sets[t]), self.names[t], a, b, t) for t, (found, a, b) in best.items()])
        return sorted((t, share, a) for _, share, _, a, _, t in kept)


def apart(matches: list[tuple]) -> list[tuple]:
    """Of (shingles found, containment, name, first, last, ...) those that no better one overlaps."""
    kept: list[tuple] = []
    for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[2])):
        if all(m[3] > k[4] or m[4] < k[3] for k in kept):
            kept.append(m)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, width: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`, an array of (template, containment, start) by template name, for every row.

    `start` is the number of the first matching shingle. Null and empty texts,
    and those of fewer than `width` words, hold nothing. Extra columns are left
    alone; repeated rows are scanned each. A text of any length is read as a
    whole, within one task. An empty table gives an empty table.
    """
    names = TEMPLATES if templates is None else templates
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    found_type = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start", pa.int64())]))

    def run(batches):
        index = Index(names, width, bands)
        for batch in batches:
            out = []
            for _, data, offsets in chunks(batch.column(1)):
                s, doc = shingles(data, offsets, width)
                bound = np.searchsorted(doc, np.arange(len(offsets)))
                for a, b in zip(bound[:-1], bound[1:], strict=True):
                    out.append([{"template": index.names[t], "containment": share, "start": at} for t, share, at in (index.matches(s[a:b], containment) if b > a and len(index.every) else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, found_type)], names=["doc_id", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, found array<struct<template:string,containment:double,start:bigint>>")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("found").cast("bigint").alias("n_found"), F.col("found.template").alias("templates"), F.array_max("found.containment").alias("best"))


def brute(text: str | None, templates: dict[str, str] | None = None, width: int = SHINGLE, containment: float = CONTAINMENT) -> list[str]:
    """Templates whose shingles lie in the text anywhere, the best of each place: what a scan can find at most."""
    of = lambda t: [tuple(w[i : i + width]) for w in [re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())] for i in range(len(w) - width + 1)]
    own, matches = of(text or ""), []
    for name, t in (TEMPLATES if templates is None else templates).items():
        wanted = set(of(t))
        at = [i for i, x in enumerate(own) if x in wanted]
        if len(wanted & set(own)) >= containment * len(wanted):
            matches.append((len(wanted & set(own)), len(wanted & set(own)) / len(wanted), name, at[0], at[-1]))
    return sorted(m[2] for m in apart(matches))
