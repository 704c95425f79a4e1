"""License scans by conditional compression.

The words of a whole text (letters, digits and version dots, lower-cased) are searched, whatever its lines. A template of
up to `SHORT` words, where a number or a letter is all that tells licenses apart, allows no difference; longer ones allow
`SLACK` of their words: words of the template that are missing plus words inserted between matched ones. A template that
allows d is cut into d + 1 pieces, one of which any such wording holds unchanged; around each piece found, the words that
the template fits into are aligned with it.

Such a stretch of words is a candidate block. Each block is compressed with zstandard, once plainly and once with every template
as a raw dictionary; the bytes saved rank the templates, whatever the sign. From the top, a template is confirmed if the block's
exact wording differs from it in no more than it allows; the first one confirmed is the block's license. Blocks compete in turn:
the winner that saves most stands with the words it covers, a block that it overlaps is judged again without these words, and
so on until no block holds a confirmed template. So every notice is told, also several in one line.

An SPDX line may hold an expression (`MIT OR (Apache-2.0 AND ISC)`): each of its identifiers after the first is a block of its own.

A null or empty text has no license. Null ids and repeated rows are rows like any other. An empty table, or none with a
license, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, slices

SHORT = 16
SLACK = 0.1
REMEMBERED = 20_000
LEVEL = 3

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
SPDX = "SPDX-License-Identifier:"
EXPRESSION = re.compile(rf"{SPDX}[ \t]*\(*[\w.+-]+\)*((?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[\w.+-]+\)*)+)", re.I)
OPERAND = re.compile(r"(OR|AND|WITH)[ \t]+\(*([\w.+-]+)", re.I)

# License notices and texts by SPDX identifier, short statements first.
STATEMENTS = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License",
            "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0",
                   "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0",
                "GNU General Public License version 3", "GNU General Public License v3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0",
                "GNU General Public License version 2", "GNU General Public License v2.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.",
                 "GNU Lesser General Public License version 3", "SPDX-License-Identifier: LGPL-3.0-only",
                 "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
                 "GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0-only",
                 "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License 2.0",
                "Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License",
                     "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License",
                     "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Licensed under the ISC License.", "ISC License", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "SPDX-License-Identifier: Unlicense"],
}
# Opening grants of the longer texts, as they are published.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must retain the above "
                    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution. Neither the name of the "
                    "copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must retain the above "
                    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
               "option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
               "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def templates() -> list[tuple[str, str]]:
    return [(name, text) for name, texts in STATEMENTS.items() for text in texts] + list(TEXTS.items())


def words_of(text: str) -> list[str]:
    return [m.lower() for m in WORD.findall(text)]


def differences(template: list[str], block: list[str]) -> list[str]:
    """Template words that the block lacks as -word, words between matched ones as +word."""
    steps = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    first = next((k for k, s in enumerate(steps) if s[0] == "equal"), len(steps))
    last = max((k for k, s in enumerate(steps) if s[0] == "equal"), default=-1)
    out = []
    for k, (kind, a, b, c, d) in enumerate(steps):
        if kind != "equal":
            out += [f"-{w}" for w in template[a:b]]
            out += [f"+{w}" for w in block[c:d]] if first < k < last else []
    return out


class Judge:
    """What each template is looked up by, its compressors, and the verdicts on wordings seen before."""

    def __init__(self):
        self.named = [(name, words_of(text)) for name, text in templates()]
        self.level = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.primed = []
        for _, text in templates():
            words = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.primed.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=words))
        self.allowed = [0 if len(words) <= SHORT else int(SLACK * len(words)) for _, words in self.named]
        self.pieces: dict[str, list[tuple[int, int]]] = {}  # piece: templates, and the piece's place in each
        for k, (_, words) in enumerate(self.named):
            cuts = [len(words) * i // (self.allowed[k] + 1) for i in range(self.allowed[k] + 2)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(f" {' '.join(words[x:y])} ", []).append((k, x))
        self.seen: dict[tuple[int, str], tuple[int, int, list[str]] | None] = {}
        self.ranks: dict[bytes, list[tuple[int, int, float]]] = {}

    def aligned(self, k: int, words: list[str]) -> tuple[int, int, list[str]] | None:
        """(first word, word after, wording differences) of template `k` among the words, if confirmed."""
        asked = (k, " ".join(words))
        if asked not in self.seen:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            matcher = difflib.SequenceMatcher(None, self.named[k][1], words, autojunk=False)
            same = [m for m in matcher.get_matching_blocks() if m.size]
            differ = differences(self.named[k][1], words)
            confirmed = same and len(differ) <= self.allowed[k]
            self.seen[asked] = (same[0].b, same[-1].b + same[-1].size, differ) if confirmed else None
        return self.seen[asked]

    def ranked(self, block: bytes) -> list[tuple[int, int, float]]:
        """(bytes saved, template, share saved) of every template, best first."""
        if block not in self.ranks:
            if len(self.ranks) > REMEMBERED // len(self.primed):
                self.ranks.clear()
            alone = len(self.level.compress(block))
            sizes = [len(x.compress(block)) for x in self.primed]
            self.ranks[block] = sorted(((alone - n, k, 1 - n / alone) for k, n in enumerate(sizes)), key=lambda x: (-x[0], x[1]))
        return self.ranks[block]

    def winner(self, raw: str, words: list[str], may: set[int] | None = None):
        """(-bytes saved, number of differences, -words, template, share saved, first word, word after, differences) of the
        template that saves most of those confirmed, equal savings by the wording. Only templates that `may` can be confirmed."""
        best = None
        for saved, k, share in self.ranked(raw.lower().encode()):
            if best and -saved > best[0]:
                break
            one = self.aligned(k, words) if may is None or k in may else None
            if one:
                got = (-saved, len(one[2]), -len(self.named[k][1]), k, share, *one)
                best = got if best is None or got[:4] < best[:4] else best
        return best

    def blocks(self, words: list[str]) -> dict[tuple[int, int], set[int]]:
        """(first word, word after) of the candidate blocks, and the templates of which one holds a piece there."""
        line = f" {' '.join(words)} "
        hits = []
        for piece, users in self.pieces.items():
            at = line.find(piece)
            while at >= 0:
                hits.append((at, users))
                at = line.find(piece, at + 1)
        if not hits:
            return {}
        starts = [m.start() for m in re.finditer(" ", line)]
        found: dict[tuple[int, int], set[int]] = {}
        for at, users in hits:
            first = bisect.bisect_left(starts, at)
            for k, offset in users:
                slack = self.allowed[k]
                low, high = max(0, first - offset - slack), first - offset + len(self.named[k][1]) + slack
                found.setdefault((low, min(high, len(words))), set()).add(k)
        return found

    def found(self, text: str) -> list[tuple[str, int, int, int, int, float, list[str]]]:
        """(license, first line, line after, first character, character after, share of the compressed size saved, wording
        differences), by place."""
        words = words_of(text)
        blocks = self.blocks(words)
        if not blocks:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        queue = []

        def judge(low: int, high: int, may: set[int]) -> None:
            one = self.winner(text[spans[low][0]:spans[high - 1][1]], words[low:high], may) if low < high else None
            if one:
                heapq.heappush(queue, (one[:3], low + one[5], low + one[6], one[3], one[4], one[7], low, high, may))

        for (low, high), may in blocks.items():
            judge(low, high, may)
        taken, told = [], self.operands(text)
        while queue:
            _, a, b, k, share, differ, low, high, may = heapq.heappop(queue)
            i = bisect.bisect_left(taken, (a, b))
            if not (i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < b):
                taken.insert(i, (a, b))
                told.append((self.named[k][0], spans[a][0], spans[b - 1][1], share, differ))
            # the words of the block that nobody has taken are blocks anew
            i = bisect.bisect_left(taken, (low, low))
            i -= bool(i and taken[i - 1][1] > low)
            at = low
            near = itertools.islice(taken, i, i + high - low)
            for x, y in [*itertools.takewhile(lambda t, end=high: t[0] < end, near), (high, high)]:
                judge(at, x, may)
                at = y
        breaks = [m.start() for m in re.finditer("\n", text)]
        return sorted(((name, bisect.bisect_left(breaks, a), bisect.bisect_left(breaks, b - 1) + 1, a, b, share, differ)
                       for name, a, b, share, differ in told), key=lambda x: (x[3], x[4], x[0]))

    def operands(self, text: str) -> list[tuple[str, int, int, float, list[str]]]:
        """(license, first character, character after, share saved, differences) of the further identifiers of SPDX expressions."""
        out = []
        for m in EXPRESSION.finditer(text):
            for x in OPERAND.finditer(text, m.start(1), m.end(1)):
                block = f"{SPDX} {x[2].removesuffix('+')}"
                one = self.winner(block, words_of(block)) if x[1].upper() != "WITH" else None
                if one:
                    out.append((self.named[one[3]][0], x.start(2), x.end(2), one[4], one[7]))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: id, license, first_line, after_line, first_char, after_char, saved (share of the compressed size
    of its block that its template saves), n_differences, differences."""
    need(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    names = ["key", "license", "first_line", "after_line", "first_char", "after_char", "saved", "n_differences", "differences"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in slices(batches, "text"):
            rows, at = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for *found, differ in judge.found(text) if text else ():
                    rows.append((*found, len(differ), differ))
                    at.append(k)
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64()))]
                                             + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = keyed.mapInArrow(run, f"key {keyed.schema['key'].dataType.simpleString()}, license string, first_line int, "
                                "after_line int, first_char int, after_char int, saved double, n_differences int, differences array<string>")
    return out.withColumnRenamed("key", id_col)
