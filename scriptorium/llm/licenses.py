"""License scans: passages compared to licence templates by the Dice coefficient over word bigrams.

Passages of a text are the whole text, its blocks between blank lines, its lines and its sentences. A passage is
normalised (A-Z lower-cased, everything but letters and digits a space) and becomes the set of its word bigrams. With sets
A and B the coefficient is 2 |A & B| / (|A| + |B|); it reaches t only if t / (2 - t) <= |A| / |B| <= (2 - t) / t, so only
templates within these size bounds are candidates. A passage too short for any has its bigrams never built, and one with more
words than the largest could allow is left to the windows.

A licence inside a longer text, over several lines or blocks, is found by windows over the words of the whole text. A window
begins at a bigram of the template and has t / (2 - t) to (2 - t) / t times its words; for templates of fewer than
``NOTICE`` words no fewer than the template, so that a window never leaves out the version that a notice names. Only templates
of which the text holds t / (2 - t) of all bigrams can be reached, and only texts with enough of a template's words have
their bigrams built. Of overlapping windows the best stays. A window that overlaps a passage found for the same licence, or
one at least as good for another, is not reported; passages of other licences that a better window overlaps are dropped.

Scale: one pass, no shuffle; the templates are a parameter and small.

Defined results: null and empty texts, and passages of one word, have no bigrams and match nothing; ties go to the longer
template, then to the first name; repeated rows give repeated rows; a passage that is one line, one block and a whole text is
reported once; very long texts are scanned whole, in time that grows with their length and the templates' hits; an empty
table gives no row; only the identifier and text are read, so no column name clashes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER_BYTES, id_text, texts

_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() or b in b"\n\x01" else 0x20 for b in LOWER_BYTES)

#: Templates of fewer words are notices.
NOTICE = 20

# The wording of common licences and of the notices that name them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}

SCHEMA = "doc_id long, matches array<struct<license:string,dice:double,line:long>>"
_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64())]))


def bigrams(passage: bytes) -> frozenset:
    words = passage.replace(b"\n", b" ").replace(b"\x01", b" ").split()
    return frozenset(zip(words, words[1:], strict=False))


def normalise(text: str) -> bytes:
    """Lower-cased words; line feeds stay, and 0x01 marks the end of a sentence."""
    return text.encode("utf-8", "surrogatepass").replace(b"\x01", b" ").replace(b". ", b"\x01").translate(_KEEP)


class Index:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, s) for name, texts_ in sorted(templates.items()) for t in texts_ if (s := bigrams(normalise(t)))]
        top = int(max((len(s) for _, s in self.sets), default=0) * (2 - threshold) / threshold) + 1
        #: Candidate templates by the size of the passage's set.
        self.by_size = [[(name, s) for name, s in self.sets if 2 * min(n, len(s)) / (n + len(s)) >= threshold] for n in range(top + 1)]
        self.least = next((n for n, c in enumerate(self.by_size) if c), top + 1)
        self.known = frozenset(g for _, s in self.sets for g in s)
        #: Per template: name, bigrams, how many of them a match needs, its words, how many of these may be missing, length bounds.
        self.sought = []
        for name, t in ((name, normalise(t)) for name, texts_ in sorted(templates.items()) for t in texts_):
            if s := bigrams(t):
                words = t.replace(b"\x01", b" ").split()
                need = next(n for n in range(len(s) + 1) if 2 * n / (n + len(s)) >= threshold)
                least = len(words) if len(words) < NOTICE else int(len(words) * threshold / (2 - threshold))
                # a missing word that is not the first takes a bigram of its own with it
                self.sought.append((name, s, need, frozenset(words), len(s) - need + 1, least, int(len(words) * (2 - threshold) / threshold)))

    def best(self, passage: bytes) -> tuple[float, int, str] | None:
        """(Dice, size, name) of the best template within the size bounds, if it reaches the threshold."""
        # a set is never larger than the number of blanks allows, and a smaller set is checked below
        if len(passage) < 2 * self.least:
            return None
        a = bigrams(passage)
        if len(a) >= len(self.by_size) or a.isdisjoint(self.known):
            return None
        found = [(2 * len(a & s) / (len(a) + len(s)), len(s), name) for name, s in self.by_size[len(a)]]
        found = [f for f in found if f[0] >= self.threshold]
        return min(found, key=lambda f: (-f[0], -f[1], f[2])) if found else None

    def windows(self, words: list[bytes]) -> list[tuple[float, int, str, int, int]]:
        """(Dice, size, name, first word, end) of the best windows, none overlapping another."""
        present = set(words)
        sought = [x for x in self.sought if len(x[3] - present) <= x[4]]
        if not sought:
            return []
        grams = list(zip(words, words[1:], strict=False))
        found = []
        for name, s, need, _, _, least, most in sought:
            hits = [i for i, g in enumerate(grams) if g in s]
            for k in range(len(hits) - need + 1):
                first = hits[k]
                # too far apart for one window
                if hits[k + need - 1] - first > most - 2:
                    continue
                seen, common, best = set(), 0, None
                for i in range(first, min(len(grams), first + most - 1)):
                    if grams[i] not in seen:
                        seen.add(grams[i])
                        common += grams[i] in s
                    if i + 2 - first >= least and common >= need:
                        dice = 2 * common / (len(seen) + len(s))
                        if dice >= self.threshold and (best is None or dice > best[0]):
                            best = (dice, len(s), name, first, i + 2)
                if best:
                    found.append(best)
        kept = []
        for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if all(f[4] <= x[3] or x[4] <= f[3] for x in kept):
                kept.append(f)
        return kept

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        lines = normalise(text).split(b"\n")
        at, block, start = 0, [], 0
        places: list[tuple[int, int, tuple[int, str], float]] = []

        def count(parts: list[bytes]) -> int:
            return sum(len(p.replace(b"\x01", b" ").split()) for p in parts)

        def look(passage: bytes, line: int, before: list[bytes] | tuple = ()) -> bool:
            if (b := self.best(passage)) is None:
                return False
            first = count(lines[:line]) + count(before)
            places.append((first, first + count([passage]), (line, b[2]), b[0]))
            return True

        for at, line in enumerate([*lines, b""]):
            if line.strip(b" \x01"):
                if not look(line, at) and b"\x01" in line:
                    sentences = line.split(b"\x01")
                    for i, sentence in enumerate(sentences):
                        look(sentence, at, sentences[:i])
                start = start if block else at
                block.append(line)
            else:
                if len(block) > 1:
                    look(b"\n".join(block), start)
                block = []
        if not all(x.strip(b" \x01") for x in lines):
            look(b"\n".join(lines), 0)
        for dice, _, name, first, end in self.windows(b" ".join(lines).replace(b"\x01", b" ").split()):
            over = [p for p in places if p[0] < end and first < p[1]]
            others = [p for p in over if p[2][1] != name]
            if any(p[3] >= dice for p in others):
                continue
            places = [p for p in places if p not in others]
            if len(over) == len(others):
                ends, line = 0, -1
                while ends <= first:
                    line += 1
                    ends += count([lines[line]])
                places.append((first, end, (line, name), dice))
        out: dict[tuple[int, str], float] = {}
        for *_, key, dice in places:
            out[key] = max(out.get(key, 0.0), dice)
        return [{"license": name, "dice": dice, "line": line} for (line, name), dice in sorted(out.items())]


def scan(docs: DataFrame, *, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its matches: licence, Dice coefficient, and the line where the passage begins."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(chosen, threshold)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.scan(t) for t in texts(batch)], _MATCHES)], names=["doc_id", "matches"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of matches, licences in order, and the best match."""
    best = F.array_max(F.transform("matches", lambda m: F.struct(m.dice.alias("dice"), m.license.alias("license"))))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), best.getField("license").alias("best_license"), best.getField("dice").alias("best_dice"))
