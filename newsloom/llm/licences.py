"""Licence scan: normalised text units against licence templates by the Dice coefficient over word bigrams.

Units are lines, paragraphs (runs of lines with words) and the whole text, so that a notice is found alone on a line, as
a block, or as a file of its own.  Words are lower-cased runs of letters, digits and non-ASCII.  A unit of |A| distinct
bigrams can reach the threshold t only with templates of t/(2-t)|A| to (2-t)/t|A| bigrams; others are never compared.

Defined results: null, empty and one-word units match nothing; a document without a match gives a row with zero
matches; equal coefficients are settled by the name; repeated ids are scanned row by row; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows
from newsloom.llm.text_arrays import alnum_table, mix, slices, span_hashes, utf8, words

THRESHOLD = 0.75

#: Whole licence bodies, letter for letter as published, in ``licence_texts``.
BODIES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")


def _gnu(kind: str, licence: str, mark: str, version: str, mark_2: str, last: str) -> tuple[str, str]:
    """First paragraph and whole of a GNU header."""
    first = f"This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {licence} as published by the Free Software Foundation{mark_2} either version {version} of the License, or (at your option) any later version."
    warranty = f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more details."
    return first, f"{first} {warranty} You should have received a copy of the GNU {licence} along with this {kind}{last}"


_WRITE_TO = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_HEADERS = {
    "AGPL-3.0": _gnu("program", "Affero General Public License", ":", "3", ",", _SEE),
    "GPL-2.0": _gnu("program", "General Public License", ";", "2", ";", _WRITE_TO),
    "GPL-3.0": _gnu("program", "General Public License", ":", "3", ",", _SEE),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", ";", "2.1", ";", _WRITE_TO),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", ";", "3", ";", _SEE),
}
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"


def _body(name: str) -> str:
    return pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()


#: Notices by which texts usually name their licence.  A paragraph that several licences share is an "any" template.
_NOTICES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": _APACHE,
    "Apache-2.0 whole header": _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Reserved": "All rights reserved.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "any BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}

#: All templates, each on one line and with blanks for apostrophes, which cut words just as blanks do.
TEMPLATES: dict[str, str] = {
    name: " ".join(text.replace("'", " ").split())
    for name, text in (
        _NOTICES
        | {f"{k} header": first for k, (first, _) in _HEADERS.items()}
        | {f"{k} whole header": whole for k, (_, whole) in _HEADERS.items()}
        | {f"{k} text": _body(k) for k in BODIES}
    ).items()
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SCHEMA = "doc_id long, n_matches long, licences string, best_licence string, best_dice double, best_unit string, best_start long, best_end long"
_LEVELS = ("line", "paragraph", "text")


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    w = _WORD.findall(text.lower())
    return set(zip(w, w[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _A + h[1:] * _B) if len(h) > 1 else np.empty(0, np.uint64)


def _scanner(templates: Mapping[str, str], threshold: float):
    names = sorted(n for n, t in templates.items() if bigrams(t.encode()))
    sets = [bigrams(templates[n].encode()) for n in names]
    sizes = np.array([len(s) for s in sets])
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def vocabulary() -> np.ndarray:
        parts = [np.empty(0, np.uint64)]
        for n in names:
            raw = templates[n].encode()
            w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), alnum_table())
            parts.append(_pair_hashes(span_hashes(w)))
        return np.unique(np.concatenate(parts))

    known = vocabulary()

    def units(w, hashes) -> Iterator[tuple[int, int, int, int]]:
        """(level, document, start, end) of units that share enough bigrams with the templates together."""
        if len(hashes) < 2 or not len(known):
            return
        pairs = _pair_hashes(hashes)
        doc = np.searchsorted(w.first, np.arange(len(hashes)), "right") - 1
        line = np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
        same = doc[1:] == doc[:-1]
        step = line[1:] - line[:-1]
        hit = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
        for level, joined in enumerate((same & (step == 0), same & (step <= 1), same)):
            unit = np.concatenate(([0], np.cumsum(~joined)))
            touched = np.zeros(unit[-1] + 1, bool)
            touched[unit[:-1][joined & hit]] = True
            first = np.searchsorted(unit, np.arange(unit[-1] + 2))
            for u in np.flatnonzero(touched):
                a, b = first[u], first[u + 1]
                own = np.unique(pairs[a : b - 1])
                shared = np.count_nonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
                if len(own) * low <= shared and np.any((sizes >= len(own) * low) & (sizes <= len(own) * high)):
                    yield level, doc[a], int(w.starts[a]), int(w.ends[b - 1])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        found: list[list] = [[] for _ in range(len(offsets) - 1)]
        for r0, r1 in slices(offsets):
            w = words(data, offsets[r0 : r1 + 1], alnum_table())
            seen = set()
            for level, d, start, end in units(w, span_hashes(w)):
                if (d, start, end) in seen:  # a line that is a paragraph, a paragraph that is the text
                    continue
                seen.add((d, start, end))
                own = bigrams(w.data[start:end].tobytes())
                base = int(w.base[d])
                for k in np.flatnonzero((sizes >= len(own) * low) & (sizes <= len(own) * high)):
                    if (score := dice(own, sets[k])) >= threshold:
                        at = len(w.data[base:start].tobytes().decode("utf-8", "replace"))
                        found[r0 + d].append((-score, names[k], level, at, at + len(w.data[start:end].tobytes().decode("utf-8", "replace"))))
        rows = []
        for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True):
            best = min(own, default=None)
            rows.append(
                {"doc_id": doc_id, "n_matches": len(own), "licences": ",".join(sorted({x[1] for x in own}))}
                | ({"best_licence": best[1], "best_dice": -best[0], "best_unit": _LEVELS[best[2]], "best_start": best[3], "best_end": best[4]} if best else {})
            )
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))]))

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: number of (unit, template) matches, licences found, and the best match with its place."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(arrow_rows(_scanner(dict(templates), threshold)), _SCHEMA)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

ORACLE_SQL = rf"""
WITH t AS (SELECT name, regexp_extract_all({_LOW.format('body')}, '[^{_CLASS}]+') AS w FROM (VALUES {', '.join(f"('{n}', '{b}')" for n, b in TEMPLATES.items())}) v(name, body)),
tb AS (SELECT DISTINCT name, w[i] AS a, w[i + 1] AS b FROM (SELECT name, w, unnest(range(1, len(w))) AS i FROM t)),
tn AS (SELECT name, count(*) AS n FROM tb GROUP BY name),
l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
l1 AS (SELECT *, {_LOW.format('line')} AS low, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l0),
l2 AS (SELECT doc_id, k, regexp_extract_all(low, '[^{_CLASS}]+') AS w, pos + length(regexp_extract(low, '^[{_CLASS}]*')) AS s, pos + length(low) - length(regexp_extract(low, '[{_CLASS}]*$')) AS e FROM l1),
l3 AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 1 THEN 1 ELSE 0 END AS brk FROM l2 WHERE len(w) > 0),
l AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY k) AS para FROM l3),
words AS (SELECT doc_id, k, para, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM l),
pairs AS (SELECT doc_id, k, para, word AS a, lead(word) OVER o AS b, lead(k) OVER o AS k2, lead(para) OVER o AS p2 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k, j)),
ub AS (SELECT DISTINCT doc_id, 0 AS level, k AS unit, a, b FROM pairs WHERE k2 = k UNION ALL SELECT DISTINCT doc_id, 1, para, a, b FROM pairs WHERE p2 = para
  UNION ALL SELECT DISTINCT doc_id, 2, 0, a, b FROM pairs WHERE b IS NOT NULL),
us AS (SELECT doc_id, 0 AS level, k AS unit, s, e FROM l UNION ALL SELECT doc_id, 1, para, min(s), max(e) FROM l GROUP BY doc_id, para UNION ALL SELECT doc_id, 2, 0, min(s), max(e) FROM l GROUP BY doc_id),
un AS (SELECT doc_id, level, unit, count(*) AS n FROM ub GROUP BY ALL),
m AS (SELECT doc_id, level, unit, name, count(*) AS shared FROM ub JOIN tb USING (a, b) GROUP BY ALL),
d AS (SELECT m.*, s, e, CAST(2 * shared AS DOUBLE) / (un.n + tn.n) AS dice FROM m JOIN un USING (doc_id, level, unit) JOIN us USING (doc_id, level, unit) JOIN tn USING (name)),
f AS (SELECT doc_id, s, e, name, dice, min(level) AS level FROM d WHERE dice >= {THRESHOLD} GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM f GROUP BY doc_id),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name, level, s, e) = 1)
SELECT x.doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licences, '') AS licences, b.name AS best_licence, b.dice AS best_dice,
  CASE b.level WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'text' END AS best_unit, CAST(b.s AS BIGINT) AS best_start, CAST(b.e AS BIGINT) AS best_end
FROM documents x LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id)
"""
