"""Licence scans by Dice coefficient over word bigrams.

A template is a notice, a header or a whole licence text of n words. Texts and templates are normalised (A-Z lower-cased, words
``[a-z0-9]+``, line breaks and marks alike), so a notice is found inside a line, over several, or wrapped anew. Compared are the windows of n words, cut
at the end of the text, that begin with a bigram of the template; the set of a window's bigrams is compared with the template's. Windows whose
size alone rules out the threshold are never compared: a coefficient of t needs between t / (2 - t) and (2 - t) / t times the
bigrams, and so many of the template's in the window, which running counts of the template's bigrams in the text tell.
Of windows that overlap the best stays: the highest coefficient, then the longer template, its name, and the first place.

Cases: null and empty texts, and texts with fewer than two words, match nothing; rows that repeat a doc_id each give their rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import LOWER, mix, parts, ranges, utf8, words

THRESHOLD = 0.8
#: Notices, headers and licence texts by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT license.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORD = re.compile(r"[a-z0-9]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of words as they are, all others blank.
_PLAIN = np.where(np.isin(LOWER, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)), LOWER, np.uint8(32))


def bigrams(found: list) -> set[tuple]:
    return set(zip(found, found[1:], strict=False))


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(3) + hashes[1:])


class Templates:
    """Templates with an index of their bigrams."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold, self.names, self.size, self.grams, pairs, owners = threshold, [], [], [], [], []
        for name, text in sorted(texts.items()):
            raw = np.frombuffer(text.encode(), np.uint8)
            plain = _PLAIN[raw]
            hashes, begin, end, _ = words(plain, np.array([0, len(plain)]))
            if len(hashes) < 2:
                continue
            known = [plain[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            self.names.append(name)
            self.size.append(len(known))
            self.grams.append(bigrams(known))
            own = np.unique(_pairs(hashes))
            pairs.append(own)
            owners.append(np.full(len(own), len(self.names) - 1))
        pairs, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, owners))
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.owners = pairs[order].astype(np.uint64), owners[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.pairs >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each template the places of words at which a window may begin, and where it ends."""
        if len(hashes) < 2:
            return
        h = _pairs(hashes)
        place = np.flatnonzero(self.filter[h >> np.uint64(44)])
        doc = np.searchsorted(at, place, "right") - 1
        inside = place + 1 < at[doc + 1]
        place, doc = place[inside], doc[inside]
        low, high = np.searchsorted(self.pairs, h[place]), np.searchsorted(self.pairs, h[place], "right")
        many = high - low
        owner, place, doc = self.owners[ranges(low, many)], np.repeat(place, many), np.repeat(doc, many)
        for k in np.unique(owner).tolist():
            own = owner == k
            p, stop = place[own], np.minimum(place[own] + self.size[k], at[doc[own] + 1])
            # as many of the template's bigrams lie in the window at the most
            count = np.searchsorted(p, stop - 1) - np.arange(len(p))
            enough = count >= len(self.grams[k]) * self.threshold / (2 - self.threshold) - 1e-9
            yield k, p[enough], stop[enough]

    def dice(self, k: int, grams: set) -> float:
        """The coefficient of a window with a template, or 0 where sizes alone rule the threshold out."""
        n, m, t = len(grams), len(self.grams[k]), self.threshold
        if not m * t / (2 - t) - 1e-9 <= n <= m * (2 - t) / t + 1e-9:
            return 0.0
        return 2 * len(grams & self.grams[k]) / (n + m)


def best_of(found: list[tuple]) -> Iterator[tuple]:
    """Of rows (first, end, -coefficient, -size, name, ...) in order, the best of each group that overlaps."""
    best, upto = None, -1
    for row in found:
        if best is not None and row[0] >= upto:
            yield best
            best = None
        upto = max(upto, row[1]) if best is not None else row[1]
        key = lambda x: (x[2], x[3], x[4], x[0])
        best = row if best is None or key(row) < key(best) else best
    if best is not None:
        yield best


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per matching window: doc_id, line (of its first word, from 1), template, dice, passage."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    kind = dict(documents.dtypes)["doc_id"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for lo, hi in parts(offsets):
                part, edges = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                plain = _PLAIN[part]
                hashes, begin, end, at = words(plain, edges)
                found: dict[int, list] = {}
                for k, first, stop in known.hits(hashes, at):
                    for x, y in zip(first.tolist(), stop.tolist(), strict=True):
                        dice = known.dice(k, bigrams([plain[b:e].tobytes() for b, e in zip(begin[x:y].tolist(), end[x:y].tolist(), strict=True)]))
                        if dice >= threshold:
                            found.setdefault(int(np.searchsorted(at, x, "right")) - 1, []).append((x, y, -dice, -known.size[k], known.names[k]))
                rows = []
                for doc in sorted(found):
                    for x, y, dice, _, name in best_of(sorted(found[doc])):
                        line = int((part[edges[doc] : begin[x]] == 10).sum()) + 1
                        rows.append((lo + doc, line, name, -dice, part[begin[x] : end[y - 1]].tobytes().decode("utf-8", "replace")))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(columns[0])), *(pa.array(x, t) for x, t in zip(columns[1:], kinds, strict=True))],
                        names=["doc_id", "line", "template", "dice", "passage"],
                    )

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, line long, template string, dice double, passage string")


def sql(documents: str = "documents", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan(), dice to six places and without the passage."""
    rows = ", ".join(f"('{name}', '{text}')" for name, text in (templates or TEMPLATES).items())
    found = "regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    pairs = "list_transform(generate_series({a}, {b}), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""WITH known AS (SELECT name, len(w) AS n, list_distinct({pairs.format(a=1, b='len(w) - 1')}) AS g FROM (SELECT name, {found.format(x='body')} AS w FROM (VALUES {rows}) AS v(name, body))),
own AS (SELECT name, n, unnest(g) AS pair FROM known),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
lines AS (SELECT r, doc_id, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS body FROM docs),
parts AS (SELECT r, doc_id, line, {found.format(x='body')} AS ws FROM lines),
d AS (SELECT r, any_value(doc_id) AS doc_id, flatten(list(ws ORDER BY line)) AS w, flatten(list(list_transform(ws, lambda x: line) ORDER BY line)) AS lns FROM parts GROUP BY r),
p AS (SELECT r, unnest(generate_series(1, len(w) - 1)) AS s, unnest({pairs.format(a=1, b='len(w) - 1')}) AS pair FROM d WHERE len(w) > 1),
c AS (SELECT r, s, name, n FROM p JOIN own USING (pair)),
x AS (SELECT r, doc_id, s, least(s + c.n, len(w) + 1) AS e, lns[s] AS line, c.name, c.n, k.g, list_distinct({pairs.format(a='s', b='least(s + c.n, len(w) + 1) - 2')}) AS gs FROM c JOIN d USING (r) JOIN known k ON k.name = c.name),
y AS (SELECT *, 2.0::DOUBLE * len(list_intersect(gs, g)) / (len(gs) + len(g)) AS dice FROM x WHERE len(gs) BETWEEN len(g) * {threshold} / (2 - {threshold}) - 1e-9 AND len(g) * (2 - {threshold}) / {threshold} + 1e-9),
z AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, e, dice DESC, n DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM y WHERE dice >= {threshold}),
i AS (SELECT *, count(*) FILTER (WHERE upto IS NULL OR s >= upto) OVER (PARTITION BY r ORDER BY s, e, dice DESC, n DESC, name ROWS UNBOUNDED PRECEDING) AS island FROM z)
SELECT doc_id, line::BIGINT AS line, name AS template, round(dice, 6) AS dice FROM i QUALIFY row_number() OVER (PARTITION BY r, island ORDER BY dice DESC, n DESC, name, s) = 1"""
