"""Licence scans: lines, whole texts and runs of words against licence templates by Dice over word bigrams.

Text is normalised to lower-case words of ASCII letters and digits. Units are all runs of
consecutive words, over line ends too, lines and the whole text among them, so a notice wrapped
over lines or inside a longer line is found. A template that shares fewer bigrams with the document
than the threshold needs is left out at once; most documents end there. A unit is compared only
if the sizes allow the threshold: Dice of sets of sizes m and n is at most 2 * min / (m + n).
Of the runs, only those need a look that begin and end with a bigram of the template and do not
hold their first again: others have a shorter run that is as good. That bounds the steps by the
template's bigrams times the words. The templates are part of the code (TEMPLATES, and whole
texts in license_texts.py) or a parameter; documents are scanned once without a shuffle.

Defined cases: null or empty text has no match; a unit of fewer than two words has no
bigrams and matches nothing; a template's best run inside that of one at least twice its size is part of it and left out; equal values go to the template first in order of name. n_lines counts lines alone. Repeated rows get a row each; other columns are ignored.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEXTS

WORD = re.compile(r"[a-z0-9]+")
_LOW = {i: i + 32 for i in range(65, 91)}

#: name: (licence, text). Short notices, and openings of the licences' own texts.
TEMPLATES: dict[str, tuple[str, str]] = {
    "all-rights-reserved": ("LicenseRef-Proprietary", "All rights reserved."),
    "apache-2.0-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "bsd-2-clause-notice": ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "bsd-3-clause-notice": ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "cc-by-4.0-notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-4.0-sentence": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-nc-4.0-sentence": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0-notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc0-1.0-notice": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "gpl-2.0-notice": ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    "gpl-3.0-notice": ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-3.0-header": ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "isc-grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl-3.0-notice": ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-grant": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    "mpl-2.0-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense-opening": ("Unlicense", "This is free and unencumbered software released into the public domain."),
}

SCHEMA = "doc_id long, license string, template string, dice double, n_lines long"


def bigrams(text: str) -> frozenset:
    words = WORD.findall(text.translate(_LOW))
    return frozenset(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, str]], least: float):
        self.least = least
        self.names = sorted(templates)
        self.license = [templates[n][0] for n in self.names]
        self.sets = [bigrams(templates[n][1]) for n in self.names]
        self.holding: dict[tuple, list[int]] = {}
        for i, s in enumerate(self.sets):
            for b in s:
                self.holding.setdefault(b, []).append(i)
        # the fewest shared bigrams that can reach the threshold: all of the unit's are shared
        self.need = [next((k for k in range(1, len(s) + 1) if 2 * k / (k + len(s)) >= least), len(s) + 1) for s in self.sets]

    def near(self, mine: set) -> dict[int, int]:
        """The templates that share enough of these bigrams, and how many."""
        shared: dict[int, int] = {}
        for b in self.holding.keys() & mine:
            for i in self.holding[b]:
                shared[i] = shared.get(i, 0) + 1
        return {i: both for i, both in sorted(shared.items()) if both >= self.need[i]}

    def matches(self, pairs: list[tuple]) -> bool:
        """Whether a unit as a whole reaches the threshold for some template."""
        mine = set(pairs)
        return any(2 * both / (len(mine) + len(self.sets[i])) >= self.least for i, both in self.near(mine).items())

    def run(self, i: int, pairs: list[tuple]) -> tuple[float, int, int, int] | None:
        """(Dice, template, start, end) of the best run of consecutive bigrams for template i, if it reaches the threshold."""
        mine, best, least, found = self.sets[i], 0.0, self.least, None
        n, after, held = len(mine), {}, []
        for p in range(len(pairs) - 1, -1, -1):
            if pairs[p] in mine:
                end = after.get(pairs[p], len(pairs))
                after[pairs[p]] = p
                held.append((p, end, len(after)))
        for p, end, rest in reversed(held):
            # bigrams of the template from here on bound all later runs
            if best == 1 or 2 * rest / (rest + n) < max(best, least):
                break
            seen, both, most = set(), 0, (2 - max(best, least)) / max(best, least) * n + 1e-6
            for q in range(p, end):
                b = pairs[q]
                if b in seen:
                    continue
                seen.add(b)
                if len(seen) > most:
                    break
                if b in mine:
                    both += 1
                    dice = 2 * both / (len(seen) + n)
                    if dice > best:
                        best, found = dice, (dice, i, p, q + 1)
        return found if best >= least else None

    def scan(self, text: str | None):
        lines = [WORD.findall(x) for x in (text or "").translate(_LOW).split("\n")]
        words = [w for line in lines for w in line]
        pairs = list(zip(words, words[1:]))
        near = self.near(set(pairs))
        if not near:
            return None, None, None, 0
        n = sum(self.matches(list(zip(line, line[1:]))) for line in lines if len(line) > 1)
        runs = [x for i in near if (x := self.run(i, pairs))]
        size = lambda x: len(self.sets[x[1]])
        runs = [x for x in runs if not any(y[2] <= x[2] and x[3] <= y[3] and 2 * size(x) <= size(y) for y in runs)]
        if not runs:
            return None, None, None, n
        dice, i, *_ = min(runs, key=lambda x: (-x[0], x[1]))
        return self.license[i], self.names[i], dice, n


def scan(docs: DataFrame, *, templates: dict[str, tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """A row for each row of docs(doc_id, text): the best licence, its template and likeness, and the number of lines that match one."""
    matcher = Matcher(TEMPLATES | TEXTS if templates is None else templates, least)

    def run(batches):
        for batch in batches:
            rows = [matcher.scan(x.as_py()) for x in batch.column(1)]
            if rows:
                names, kinds = zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(names, kinds, strict=True))], names=["doc_id", "license", "template", "dice", "n_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def sql(least: float = 0.8) -> str:
    """Lines and whole texts against TEMPLATES over `documents` for DuckDB, without pruning; runs of words and TEXTS are not in it."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(n)}, {q(a)}, {q(t)})" for n, (a, t) in sorted(TEMPLATES.items()))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pairs = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return f"""
WITH t AS (SELECT name, license, {pairs} AS b FROM (SELECT name, license, regexp_extract_all({low.format("text")}, '[a-z0-9]+') AS ws FROM (VALUES {values}) v(name, license, text))),
u AS (SELECT doc_id, n, text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, 1 AS n FROM documents)
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
s AS (SELECT row_number() OVER () AS k, doc_id, n, {pairs} AS b FROM (SELECT doc_id, n, regexp_extract_all({low.format("text")}, '[a-z0-9]+') AS ws FROM u) WHERE len(ws) > 1),
m AS (SELECT k, doc_id, n, name, license, 2 * len(list_intersect(s.b, t.b))::DOUBLE / (len(s.b) + len(t.b)) AS dice FROM s, t WHERE list_has_any(s.b, t.b)),
h AS (SELECT * FROM m WHERE dice >= {least}),
best AS (SELECT doc_id, arg_min({{'l': license, 't': name, 'd': dice}}, {{'d': -dice, 't': name}}) AS x, count(DISTINCT k) FILTER (WHERE n = 1) AS lines FROM h GROUP BY doc_id)
SELECT d.doc_id, x.l AS license, x.t AS template, x.d AS dice, coalesce(lines, 0)::BIGINT AS n_lines FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id"""
