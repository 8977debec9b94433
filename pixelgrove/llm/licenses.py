"""License scans by conditional compression.

Candidate blocks are windows of words, of the size of a template, around each
place of the rarest ``must`` word (names and versions) of every template whose
must words all occur in a paragraph, however long, if the window has enough of
the template's words in whatever order. Each block is compressed with
every template as a raw zstandard dictionary, and the templates are ranked by
the size reduction. Each one that reduces the size is compared with the block
word by word: it is confirmed if nearly all of its words occur in order, few
other words stand between them, and every must word is among those that agree.
Of confirmed templates that overlap the one with the fewest differences counts,
then the one with the largest reduction. What lies beside it is judged again
until nothing is confirmed. The differences are part of the result.

One pass over all rows without a shuffle; the templates are a fixed table.

Cases: null or empty text has no findings; a null doc_id is carried as null;
repeated rows are scanned each; blocks that tie take the template named first;
an empty table gives no rows; other columns are ignored. A notice is not
followed over an empty line.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Least share of a template's words that agree, and most other words in between as a share of them.
AGREE, BETWEEN = 0.7, 0.3
# Public wordings of licenses and notices. Identifier, words that must agree, wording.
TEMPLATES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "mit", "This project is licensed under the terms of the MIT license."),
    ("MIT", "free charge sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "noninfringement merchantability dealings", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "conditions basis license", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "hope gnu general", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "lesser 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "redistribution source binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "bsd", "Licensed under the BSD License."),
    ("BSD", "contributors merchantability disclaimed exemplary", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("ISC", "fee granted purpose", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "author disclaims whatsoever", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("Zlib", "express warranty damages", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "commercial alter freely", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "eclipse 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC-BY-4.0", "by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "by-nc-nd 4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "attribution-noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "attribution-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "attribution-noncommercial-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "attribution-noncommercial-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "cc0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "reserved", "All rights reserved."),
)

WORD = re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    """Templates with their dictionaries, made once a task."""

    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates = [(name, frozenset(must.split()), words(text)) for name, must, text in templates]
        self.musts = sorted({tuple(sorted(must, key=len, reverse=True)) for _, must, _ in self.templates})
        plain = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False)
        raw = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, _, w in self.templates]
        self.alone = lambda b: len(plain.compress(b))
        self.given = [zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in raw]

    def reductions(self, block: list[str]) -> list[float]:
        """Share of its compressed size that a block loses, by template."""
        data = " ".join(block).encode()
        alone = self.alone(data)
        return [1 - len(c.compress(data)) / alone for c in self.given]

    def rank(self, block: list[str]) -> list[tuple[float, int]]:
        """(size reduction, template) from the largest; ties in the order of the templates."""
        return sorted(((x, -i) for i, x in enumerate(self.reductions(block))), reverse=True)

    def differences(self, template: int, block: list[str]) -> tuple[float, int, int, frozenset, int, int] | None:
        """(share of the template's words that agree, words missing, other words in between, words that agree, first and last of them in the block)."""
        ours = self.templates[template][2]
        same = [m for m in SequenceMatcher(None, ours, block, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        agreed = sum(m.size for m in same)
        between = sum(max(0, b.b - a.b - a.size) for a, b in zip(same, same[1:], strict=False))
        return agreed / len(ours), len(ours) - agreed, between, frozenset(w for m in same for w in ours[m.a : m.a + m.size]), same[0].b, same[-1].b + same[-1].size - 1

    def _possible(self, template: int, part: list[str]) -> bool:
        """Whether a block has the words to confirm a template, in whatever order; else it is no candidate for it."""
        _, must, ours = self.templates[template]
        here = set(part)
        return must <= here and sum(map(here.__contains__, ours)) >= AGREE * len(ours)

    def _confirm(self, template: int, block: list[str], start: int, end: int) -> tuple | None:
        """(differing words as a share, differing words, first and past last word) of the best run of agreeing words within these bounds."""
        name, must, ours = self.templates[template]
        part = block[start:end]
        same = [m for m in SequenceMatcher(None, ours, part, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(same)):  # words that agree by chance may stand before and behind the notice
            agreed = between = 0
            for j in range(i, len(same)):
                agreed += same[j].size
                between += same[j].b - same[j - 1].b - same[j - 1].size if j > i else 0
                if between > BETWEEN * len(ours):
                    break
                cost = len(ours) - agreed + between
                if agreed >= AGREE * len(ours) and (best is None or cost < best[0]) and must.issubset(w for m in same[i : j + 1] for w in ours[m.a : m.a + m.size]):
                    best = cost, start + same[i].b, start + same[j].b + same[j].size
        return best and (best[0] / len(ours), *best)

    def judge(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, license, differing words) of all notices in a block."""
        spots = list(WORD.finditer(text))
        block = [m[0].lower() for m in spots]
        places = defaultdict(list)
        for at, word in enumerate(block):
            places[word].append(at)
        todo = []
        for i, (_, must, ours) in enumerate(self.templates):
            if all(w in places for w in must):
                word = min(sorted(must), key=lambda w: len(places[w]))
                todo += [(i, at, ours.index(word)) for at in places[word]]
        taken, won, ranked = [-1, len(block)], [], {}  # bounds of what is still open: positions that belong to a notice
        while todo:
            found, rest = [], []
            for i, at, k in todo:
                n = bisect(taken, at)
                if taken[n - 1] == at:
                    continue
                low, high = taken[n - 1] + 1, taken[n]
                more = int(BETWEEN * len(self.templates[i][2]))
                length = len(self.templates[i][2]) + more
                rest.append((i, at, k, max(low, at - length), min(high, at + length + 1)))
                for a, b in ((at - length, at + length + 1), (at - k - more, at - k + length)):
                    a, b = max(low, a), min(high, b)
                    if not self._possible(i, block[a:b]):
                        continue
                    if (a, b) not in ranked:
                        ranked[a, b] = self.reductions(block[a:b])
                    if ranked[a, b][i] > 0 and (x := self._confirm(i, block, a, b)):
                        found.append((x[0], -ranked[a, b][i], i, *x[1:]))
            fresh = []
            for x in sorted(found):
                n = bisect(taken, x[4])
                if taken[n - 1] < x[4] and taken[n] >= x[5]:
                    taken[n:n] = range(x[4], x[5])
                    fresh += range(x[4], x[5])
                    won.append((spots[x[4]].start(), spots[x[5] - 1].end(), self.templates[x[2]][0], x[3]))
            # only places whose bounds have changed can give something new
            fresh.sort()
            todo = [(i, at, k) for i, at, k, low, high in rest if bisect(fresh, high - 1) > bisect(fresh, low - 1)]
        return sorted(won)

    def scan(self, text: str | None) -> list[tuple[int, int, str, int]]:
        """(start, end, license, differing words) in code points, in order, from the first to the last word that agrees."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a few letters change their length with their case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        # a paragraph without all must words of any template has no candidate blocks
        musts = [must for must in self.musts if all(w in low for w in must)]
        out, at = [], 0
        for paragraph in re.split(r"(\n[^\S\n]*\n)", text or "") if musts else ():
            here = low[at : at + len(paragraph)]
            if any(all(w in here for w in must) for must in musts):
                out += [(at + start, at + end, *rest) for start, end, *rest in self.judge(paragraph)]
            at += len(paragraph)
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, findings array<struct<start, end, license, differences>>."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("differences", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [[dict(zip(("start", "end", "license", "differences"), x, strict=True)) for x in scanner.scan(text.as_py())] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "findings"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, findings array<struct<start: long, end: long, license: string, differences: long>>")
