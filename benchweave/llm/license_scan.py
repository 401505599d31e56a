"""Licence scans: sparse TF-IDF cosine of every line with licence templates, then inheritance from ancestor folders.

Units of every whole text are its lines, its sentences (across lines), and the windows of each template's number of words
at every word (templates of ``LEAST_WINDOW`` words or more and SPDX forms; other short ones only match whole lines and sentences), so notices
are found within longer lines and paragraphs, and headers and short licences over many lines. A unit's vector holds term counts
times inverse document frequency over all lines of the input. Only the templates' own words need counting (a bounded
vocabulary); every occurrence of another word counts as a term of its own with the largest weight. Cheap upper bounds of
the cosine leave a few units for the full product. The template of a text's best unit is its licence, ties in template
order; ``SHARED`` templates only count where no other is found. ``licence_lines`` counts the lines that such units touch,
``licence_share`` is the part of the words in them.

Licence files, told by name or by being mostly licence text (``is_licence_file``), speak for their folder; a folder whose
licence files name different licences hands on none, nor do the folders above it to what is below. A file without a
licence of its own takes that of the nearest folder above it: folders are joined to their ancestors by path, once per
distinct folder, and the rows to their folder, so a folder with a third of all files costs one row.

Null text has no lines, empty tables give none. A null path inherits nothing. Repeated rows are scanned alike. Columns named like an output are
replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.llm.words import Words, text_slices

THRESHOLD = 0.75
LEAST_WINDOW = 3
UNITS = 2048  # units whose products with all templates are held at once
MOSTLY = 0.8  # share of licence words that makes a file a licence file
OUTPUTS = ("own_licence", "score", "licence_lines", "licence_share")
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_FSF = "GNU {title} Version {version} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
# Openings that several licences share, and a reservation that stands beside any: they only count where nothing else is found.
SHARED = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("Proprietary", "All rights reserved."),
]
_NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}
_CC = {f"CC-{kind}-4.0": f"CC {kind} 4.0" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
_GNU_KINDS = [
    ("GPL-3.0", "program", "General Public License", "3", "3, 29 June 2007", "2007"),
    ("GPL-2.0", "program", "General Public License", "2", "2, June 1991", "1989, 1991"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3", "3, 29 June 2007", "2007"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1", "2.1, February 1999", "1991, 1999"),
    ("AGPL-3.0", "program", "Affero General Public License", "3", "3, 19 November 2007", "2007"),
]
# Short notices, SPDX forms, headers, openings of licence files, and whole short licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    *((key, _GNU.format(what=what, name=name, version=version)) for key, what, name, version, _, _ in _GNU_KINDS),
    *((key, f"{_GNU} {_WARRANTY}".format(what=what, name=name, version=version)) for key, what, name, version, _, _ in _GNU_KINDS),
    *((key, _FSF.format(title=name, version=dated, year=year)) for key, _, name, _, dated, year in _GNU_KINDS),
    *((key, f"Licensed under {name}") for key, name in _CC.items()),
    *((key, f"{how} under the {name}") for key, names in _NAMES.items() for name in names for how in ("licensed", "released")),
    *((key, f"{how} under the terms of the {name}") for key, names in _NAMES.items() for name in names[:1] for how in ("licensed", "distributed")),
    *((key, name) for key, names in _NAMES.items() for name in names),
    *((key, f"SPDX-License-Identifier: {form}") for key in [*_NAMES, *_CC] for form in ([f"{key}-only", f"{key}-or-later", key] if "GPL" in key else [key])),
    *SHARED,
]

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?()[]{}\"'*#/<>")] = True


def _units(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words without outer punctuation, in lower case, and the number of the line each one is on."""
    words = Words(texts, lower=True)
    row = words.rows()
    last = np.isin(words.data[words.ends - 1], np.frombuffer(b".!?", dtype=np.uint8))
    words.sentence = np.cumsum(np.concatenate([[False], last[:-1] | (np.diff(row) > 0)])) if len(row) else row
    for _ in range(3):
        words.ends = words.ends - (_PUNCTUATION[words.data[words.ends - 1]] & (words.ends - words.starts > 1))
        words.starts = words.starts + (_PUNCTUATION[words.data[words.starts]] & (words.ends - words.starts > 1))
    words.hashes = words._hashes()
    return words, np.cumsum(words.data == 10)[words.starts] + words.rows()


class Matcher:
    """Templates as unit vectors over their sorted word hashes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[int, int], units: int, threshold: float = THRESHOLD):
        words, _ = _units(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.vocabulary, term = np.unique(words.hashes, return_inverse=True)
        df = np.array([counts.get(int(h), 0) for h in self.vocabulary.view(np.int64)], dtype=float)
        self.idf = np.log((1 + units) / (1 + df)) + 1
        self.rare = np.log(1 + units) + 1
        vectors = np.zeros((len(templates), len(self.vocabulary)))
        np.add.at(vectors, (words.rows(), term), 1)
        vectors *= self.idf
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.lengths = words.counts
        self.sliding = [n >= LEAST_WINDOW or t.startswith("SPDX-") for n, (_, t) in zip(words.counts.tolist(), templates, strict=True)]
        self.weak = np.array([t in SHARED for t in templates])
        # A word's part of a template's product, and of the square of its unit's length; the last row is for other words.
        self.gain = np.vstack([(self.vectors * self.idf).T, np.zeros(len(templates))]).T.copy()
        # Without any of a template's heaviest words, the others cannot reach the threshold.
        heaviest = np.argsort(-self.vectors, axis=1, kind="stable")
        squared = np.take_along_axis(self.vectors, heaviest, axis=1) ** 2
        left = 1 - np.cumsum(squared, axis=1) + squared  # of a word and those lighter than it
        self.anchors = np.zeros((len(templates), len(self.vocabulary) + 1), dtype=bool)
        np.put_along_axis(self.anchors, heaviest, (left >= threshold**2 - 1e-9) & (squared > 0), axis=1)
        self.square = np.append(self.idf**2, self.rare**2)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def best(self, words: Words, line: np.ndarray, threshold: float) -> Found:
        """First and last word, template and cosine of the units (``line`` numbers them) that reach ``threshold``."""
        term = self.terms(words.hashes)
        units, unit = np.unique(line, return_inverse=True)
        known = term >= 0
        pair, times = np.unique(unit[known] * len(self.vocabulary) + term[known], return_counts=True)
        of, which = pair // len(self.vocabulary), pair % len(self.vocabulary)
        inside = np.bincount(of, weights=(times * self.idf[which]) ** 2, minlength=len(units))
        total = inside + np.bincount(unit[~known], minlength=len(units)) * self.rare**2
        at = np.flatnonzero(inside >= threshold**2 * total)
        parts = []
        for i in range(0, len(at), UNITS):  # so many units at a time have a row of products, however long the text is
            some = at[i : i + UNITS]
            a, b = np.searchsorted(of, [some[0], some[-1] + 1])
            keep = np.isin(of[a:b], some)
            rows, cols, n = of[a:b][keep], which[a:b][keep], times[a:b][keep]
            dense = np.zeros((len(some), len(self.vocabulary)))
            dense[np.searchsorted(some, rows), cols] = n * self.idf[cols]
            cosine = dense @ self.vectors.T / np.sqrt(total[some])[:, None]
            top = cosine.argmax(axis=1)
            score = cosine[np.arange(len(some)), top]
            good = score >= threshold
            parts.append((some[good], top[good], np.minimum(1.0, score[good])))
        hit, top, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else _NONE[1:]
        hit = hit.astype(np.int64)
        return np.searchsorted(line, units[hit]), np.searchsorted(line, units[hit], side="right") - 1, top.astype(np.int64), score

    def windows(self, words: Words, threshold: float) -> Found:
        """The same for windows of each template's number of words, at every word and across lines.

        Product and squared length are sums over the words as long as none repeats; repeats only lengthen a window, so
        these running sums bound the cosine from above, and the windows left are computed one by one. Only windows with
        one of the template's heaviest words are looked at.
        """
        term, out = self.terms(words.hashes), [_NONE]
        row = words.rows()
        squares = np.concatenate([[0], np.cumsum(self.square[term])])
        marked = np.flatnonzero(self.anchors.any(axis=0)[term])
        for t, n in enumerate(self.lengths.tolist()):
            at = marked[self.anchors[t][term[marked]]] if self.sliding[t] else marked[:0]
            if not len(at):
                continue
            if 2 * n * len(at) < len(term):
                starts = np.unique(np.maximum((at[:, None] - np.arange(n)).ravel(), np.repeat(words.offsets[:-1][row[at]], n)))
                near = np.unique(np.clip((at[:, None] + np.arange(1 - n, n)).ravel(), 0, len(term) - 1))
            else:
                starts = near = np.arange(len(term))
            stop = np.minimum(starts + n, words.offsets[1:][row[starts]])
            products = np.concatenate([[0], np.cumsum(self.gain[t][term[near]])])
            product = products[np.searchsorted(near, stop)] - products[np.searchsorted(near, starts)]
            hopeful = (product > 0) & (product >= threshold * np.sqrt(squares[stop] - squares[starts]) - 1e-6)
            starts, stop = starts[hopeful], stop[hopeful]
            scores, known_scores = np.zeros(len(starts)), {}
            for at_window, (i, end) in enumerate(zip(starts.tolist(), stop.tolist(), strict=True)):
                inside = term[i:end]
                same = inside.tobytes()  # equal windows, as in a notice repeated many times, are computed once
                if same in known_scores:
                    scores[at_window] = known_scores[same]
                    continue
                known, times = np.unique(inside[inside >= 0], return_counts=True)
                length = ((times * self.idf[known]) ** 2).sum() + (inside < 0).sum() * self.rare**2
                scores[at_window] = (times * self.gain[t][known]).sum() / np.sqrt(length)
                if len(known_scores) >= UNITS:
                    known_scores.clear()
                known_scores[same] = scores[at_window]
            good = scores >= threshold
            out.append((starts[good], stop[good] - 1, np.full(good.sum(), t), np.minimum(1.0, scores[good])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def found(self, words: Words, line: np.ndarray, threshold: float) -> Found:
        ways = (self.best(words, line, threshold), self.best(words, words.sentence, threshold), self.windows(words, threshold))
        return tuple(np.concatenate(c) for c in zip(*ways, strict=True))


def _count_terms(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, {}, 1)
        seen, units = np.zeros(len(matcher.vocabulary), dtype=np.int64), 0
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                words, line = _units(batch.column(0).slice(a, b - a))
                term = matcher.terms(words.hashes)
                pair = np.unique(line[term >= 0] * len(seen) + term[term >= 0])
                seen += np.bincount(pair % len(seen), minlength=len(seen))
                units += 1 + int((np.diff(line) > 0).sum()) if len(line) else 0
        yield pa.RecordBatch.from_arrays([pa.array([*matcher.vocabulary.view(np.int64).tolist(), None], pa.int64()), pa.array([*seen.tolist(), units], pa.int64())], ["term", "n"])

    return run


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``own_licence``, ``score`` (its cosine, 0 without), ``licence_lines``, and ``licence_share`` of its words.

    Without ``keep_text`` the texts are read but not handed on.
    """
    templates = templates or TEMPLATES
    base = docs.drop(*OUTPUTS)
    at = base.columns.index(text)
    totals = base.select(text).mapInArrow(_count_terms(templates), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in totals}
    units = counts.pop(None, 0)
    fields = [f for i, f in enumerate(base.schema.fields) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, counts, units, threshold)
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                words, line = _units(part.column(at))
                marked, row = np.zeros(len(line) + 1, dtype=np.int64), words.rows()
                w, last, t, s = matcher.found(words, line, threshold)
                of = row[w]
                np.add.at(marked, w, 1)
                np.add.at(marked, last + 1, -1)
                order = np.lexsort((t, -np.round(s, 9), matcher.weak[t], of))
                rows, one = np.unique(of[order], return_index=True)
                chosen = order[one]
                name, best = np.full(b - a, None, dtype=object), np.zeros(b - a)
                name[rows], best[rows] = [matcher.names[i] for i in t[chosen].tolist()], s[chosen]
                covered = np.cumsum(marked[:-1]) > 0
                _, one = np.unique(line[covered], return_index=True)
                lines = np.bincount(row[covered][one], minlength=b - a)
                share = np.bincount(row[covered], minlength=b - a) / np.maximum(1, words.counts)
                kept = part if keep_text else pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at], [f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(name, pa.string()), pa.array(best), pa.array(lines, pa.int64()), pa.array(share)], [*kept.schema.names, *OUTPUTS])

    kinds = [T.StringType(), T.DoubleType(), T.LongType(), T.DoubleType()]
    return base.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(OUTPUTS, kinds, strict=True))]))


def is_licence_file(path: str = "path", share: str = "licence_share") -> Column:
    """True for files named like licence files and for those whose words are mostly licence text."""
    named = F.coalesce(F.lower(F.col(path)).rlike(r"(^|/)(un)?(licen[cs]e|copying|copyright|notice)([._-][^/]*)?$"), F.lit(False))
    return named | (F.col(share) >= MOSTLY)


def inherit(files: DataFrame, path: str = "path", licence: str = "own_licence", speaks: Column | None = None) -> DataFrame:
    """``files`` with ``licence`` and ``licence_from``: its own path, the folder it is inherited from, or null.

    ``files`` is read three times (licences, folders, rows): stage it first where it is costly.
    """
    speaks = is_licence_file(path) if speaks is None else speaks
    folder = F.regexp_extract(F.col(path), r"(?s)^(.*)/[^/]*$", 1)
    placed = files.drop("licence", "licence_from").withColumn("__folder", F.when(F.col(path).isNotNull(), folder))
    said = placed.where(speaks & F.col(licence).isNotNull() & F.col("__folder").isNotNull())
    spoken = said.groupBy(F.col("__folder").alias("above")).agg(F.min(licence).alias("least"), F.max(licence).alias("most"))
    spoken = spoken.select("above", F.when(F.col("least") == F.col("most"), F.col("least")).alias("name"))
    parts = F.split("__folder", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    above = placed.where("__folder is not null").select("__folder").distinct().select("__folder", F.explode(levels).alias("level")).select("__folder", "level.depth", "level.above")
    nearest = above.join(spoken, "above").groupBy("__folder").agg(F.max(F.struct("depth", "above", "name")).alias("__near"))
    joined = placed.join(nearest, "__folder", "left")
    own = F.col(licence).isNotNull()
    return joined.withColumn("licence", F.coalesce(F.col(licence), F.col("__near.name"))).withColumn("licence_from", F.when(own, F.col(path)).when(F.col("__near.name").isNotNull(), F.col("__near.above"))).drop("__folder", "__near")
