"""License scans by conditional compression.

Candidate blocks are runs of lines in which trigger words stand (with at most
`gap` other lines between them) and the words around them, as many as a notice may have. A block is compressed alone and with each
template as a raw-content zstandard dictionary; templates are ranked by the share
of the block's compressed size that the dictionary saves. All are
confirmed by their wording: the template's words are aligned with the block's
words around their common word pairs, and the words missing, extra or changed are
counted. A confirmed span is cut out and what is left and right of it is
searched again, so a block may hold several licenses.

Nulls and edge cases: null and empty texts have no block; a text is scanned
whole, whatever its length; of equal savings the template earlier in the list
wins; repeated rows give repeated findings; a null doc_id stays; extra columns are
ignored; an empty table gives no rows. Documents without findings have no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SAVING, MOST_DIFFERENCE, GAP = 0.2, 0.25, 8
TRIGGERS = r"(?i)licen[cs]|copyright|warrant|permission|redistribut|spdx|public\s+domain|unencumbered|mozilla"

# Public license notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: A word broken at its hyphen goes on in the next line.
WORD = re.compile(r"(?:[\w.+-]|(?<=\w-)\n[ \t]*(?=\w))*\w")
#: A notice may go on so many words beyond the line of its trigger word: a quarter more than the longest template has.
REACH = max(len(WORD.findall(t)) for _, t in TEMPLATES) * 5 // 4


def words(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word, start, end) of each word."""
    return [("".join(m[0].split()).lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def blocks(text: str, gap: int = GAP, reach: int = REACH) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines that hold trigger words, with reach words on both sides."""
    runs: list[list[int]] = []
    last = 0
    for m in re.finditer(TRIGGERS, text):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        if runs and text.count("\n", last, a) <= gap + 1:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
        last = runs[-1][1]
    if not runs:
        return []
    starts, ends = zip(*[m.span() for m in WORD.finditer(text)], strict=True)
    out: list[list[int]] = []
    for a, b in runs:
        i, j = max(0, bisect_left(starts, a) - reach), min(len(ends), bisect_right(ends, b) + reach) - 1
        a, b = min(a, starts[i] if i < len(starts) else a), max(b, ends[j])
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Scanner:
    """Templates ready to compress with and to compare with."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = templates
        self.words = [[w for w, _, _ in words(t)] for _, t in templates]
        self.pairs = [set(zip(w, w[1:], strict=False)) for w in self.words]
        options = {"level": 6, "write_checksum": False, "write_content_size": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, t in templates]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(saving, template) from the largest saving down."""
        raw = block.encode("utf-8", "replace")
        whole = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / whole, -i) for i, c in enumerate(self.given)), reverse=True)

    def saving(self, i: int, span: str) -> float:
        """The share that template i saves of a confirmed span alone, whatever stands around it."""
        raw = span.encode("utf-8", "replace")
        return 1 - len(self.given[i].compress(raw)) / len(self.alone.compress(raw))

    def differences(self, i: int, found: list[tuple[str, int, int]]) -> tuple[int, int, int] | None:
        """(first word, past the last word, words that differ) of the best place of template i among the words found."""
        want, pairs = self.words[i], self.pairs[i]
        hits = [j for j in range(len(found) - 1) if (found[j][0], found[j + 1][0]) in pairs]
        if not hits:
            return None
        # The stretch of about the template's length that holds the most common pairs.
        reach, best, left = len(want) + max(4, len(want) // 4), (0, 0), 0
        for right in range(len(hits)):
            while hits[right] - hits[left] >= reach:
                left += 1
            best = max(best, (right - left + 1, -hits[left]))
        start = max(0, -best[1] - max(2, len(want) // 8))
        part = [w for w, _, _ in found[start : start + reach + 2 * max(2, len(want) // 8)]]
        same = [m for m in SequenceMatcher(None, part, want, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        a, b = same[0].a, same[-1].a + same[-1].size
        kept = sum(m.size for m in same)
        return start + a, start + b, (len(want) - kept) + (b - a - kept)

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, template, saving, differing words, template's words) in order."""
        out, todo = [], blocks(text)
        while todo:
            a, b = todo.pop()
            block = text[a:b]
            if not re.search(TRIGGERS, block):
                continue
            found = words(block)
            sure = None
            for saving, minus in self.ranked(block):
                place = self.differences(-minus, found)
                if place is None or place[2] > MOST_DIFFERENCE * len(self.words[-minus]):
                    continue
                if sure is None or (place[2] / len(self.words[-minus]), -saving) < (sure[1][2] / len(self.words[-sure[0][1]]), -sure[0][0]):
                    sure = ((saving, minus), place)
            if sure is not None:
                (_, minus), (first, past, differ) = sure
                start, end = found[first][1], found[past - 1][2]
                saving = self.saving(-minus, block[start:end])
                if saving < LEAST_SAVING and differ:
                    sure = None
            if sure is None:
                # A short notice in a long block saves little of it: look at its lines, then sentences.
                finer = [m.span() for m in re.finditer(r"[^\n]+", block)]
                if len(finer) == 1:
                    finer = [m.span() for m in re.finditer(r"\S.*?(?:[.!?](?=\s+[A-Z\"])|$)", block)]
                if len(finer) > 1:
                    todo += [(a + x, a + y) for x, y in finer]
                continue
            out.append((a + start, a + end, self.templates[-minus][0], -minus, round(saving, 6), differ, len(self.words[-minus])))
            todo += [(a, a + start), (a + end, b)]
        return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, license, template, saving, n_differ, n_words: a row for each confirmed notice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(TRIGGERS))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "license": pa.string(), "template": pa.int32(), "saving": pa.float64(), "n_differ": pa.int32(), "n_words": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [(d, *x) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in scanner.scan(t)]
                columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(run, "doc_id long, start long, `end` long, license string, template int, saving double, n_differ int, n_words int")
