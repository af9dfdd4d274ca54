"""Licence scan: MinHash bands over overlapping word windows retrieve templates, exact containment decides.

Words are runs of letters and digits, lower-cased; shingles are five words (fewer words: the whole sequence).
For a template of L words, windows of W = 1.25 L plus a stride (a quarter of L) are read at every stride, so
any stretch of up to 1.25 L words lies whole in one of them. If such a stretch holds at least ``containment``
of the template's shingles, its window's Jaccard similarity with the template has a lower bound s; rows and
bands are set so that a window of similarity s misses the template with a probability of at most MISS. A
retrieved template is verified on the window's own shingles, words compared. Windows without any shingle of
any template have similarity 0 with all of them; they are told by one lookup and not signed, which loses
nothing.

A match is reported as (licence, start, end, containment), start and end in code points of the whole text;
overlapping matches of a licence are merged; of several licences that match one stretch, the one with the
highest containment is reported (then the longest template), and a notice within a match of a template that
holds the whole notice is not reported beside it. Windows that share too few shingles with all templates to
hold any are not signed. Null text counts as empty.

A licence can be interrupted (page furniture, comments, another notice in the middle) by any number of words.
Templates of PIECES * LEAST_PIECE words and more are therefore also indexed by overlapping pieces of a
quarter to an eighth of their length, with windows and bands of their own. A template retrieved by a piece is
verified on all of the document's shingles outside its whole matches: the shortest stretch that holds enough of
them, of whatever length, grown over neighbours that hold further ones.

A licence id before ``/`` in a template's name groups wordings of one notice. Templates are broadcast and may hold
MAX_TEMPLATE_WORDS words together (more is an error). Documents are independent: one map, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_PER_SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 128
MISS = 1e-6
MAX_TEMPLATE_WORDS = 200_000
SEED = 11
# A template has at least so many pieces, of a power of two of words each.
PIECES = 4
LEAST_PIECE = 8
# One interruption spoils one piece of four; (0.8 - 1/4) / (3/4) of the others' shingles are left.
PIECE_CONTAINMENT = 0.7

# Notices by which public licences are applied to a work.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_GNU = (
    "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation; either version {2} of the License, or (at your option) any later version. {0} is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
)
_TWO_CLAUSES = (
    NOTICES["BSD"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_THIRD_CLAUSE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_AFFERO_13 = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must
prominently offer all users interacting with it remotely through a computer network (if your version supports such
interaction) an opportunity to receive the Corresponding Source of your version by providing access to the
Corresponding Source from a network server at no charge, through some standard or customary means of facilitating
copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version
3 of the GNU General Public License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a
work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the
resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work
with which it is combined will remain governed by version 3 of the GNU General Public License.
"""
# Further notices, headers and short texts.
OTHERS = {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-header": _GNU.format("This program", "General Public License", "2"),
    "LGPL-2.0-header": _GNU.format("This library", "Library General Public License", "2"),
    "LGPL-2.1-header": _GNU.format("This library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _GNU.format("This program", "Lesser General Public License", "3"),
    "AGPL-3.0-header": _GNU.format("This program", "Affero General Public License", "3"),
    "GPL-3.0-long-header": _GNU.format("This program", "General Public License", "3"),
    "CC-BY-SA-4.0": _CC.format("Attribution-ShareAlike"),
    "CC-BY-NC-4.0-notice": _CC.format("Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _CC.format("Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _CC.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _CC.format("Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD-2-Clause": _TWO_CLAUSES + _AS_IS,
    "BSD-3-Clause": _TWO_CLAUSES + _THIRD_CLAUSE + _AS_IS,
    "MIT-full": (
        NOTICES["MIT-text"] + ", subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
}
# How notices of one line begin, and what they call the licences.
OPENINGS = ("licensed under", "released under", "distributed under", "available under")
SPOKEN = {
    "MIT": ("the MIT License", "an MIT license", "the terms of the MIT license"),
    "Apache-2.0": ("the Apache License 2.0", "the Apache License, Version 2.0", "the Apache 2.0 license"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-clause BSD license"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-clause BSD license"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"),
    "GPL-2.0": ("the GNU General Public License v2", "the GNU GPL v2", "the GNU GPL version 2"),
    "GPL-3.0": ("the GNU General Public License v3", "the GNU GPL v3", "the GNU GPL version 3"),
    "LGPL-3.0": ("the GNU Lesser General Public License v3", "the GNU LGPL v3"),
    "AGPL-3.0": ("the GNU Affero General Public License v3", "the GNU AGPL v3"),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
TEXTS = Path(__file__).parent / "licence_texts"
WORD = re.compile(r"[^\W_]+")
# ASCII bytes that end a word.
BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def band_settings(similarity: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows per band): as many rows as the miss probability at ``similarity`` allows."""
    for rows in range(hashes, 1, -1):
        bands = hashes // rows
        if (1 - similarity**rows) ** bands <= miss:
            return bands, rows
    return hashes, 1


def window_of(length: int) -> tuple[int, int]:
    """(words in a window, stride) for templates of ``length`` words."""
    stride = max(1, length // 4)
    return -(-5 * length // 4) + stride, stride


def piece_window_of(length: int) -> tuple[int, int]:
    """(words in a window, stride) for pieces of ``length`` words; stretches of 1.125 lengths lie in a window."""
    stride = max(1, length // 8)
    return -(-9 * length // 8) + stride, stride


def piece_length(length: int) -> int | None:
    """Words in a piece of a template of ``length`` words; None if it is too short for pieces."""
    words = length // PIECES
    return None if words < LEAST_PIECE else 1 << (words.bit_length() - 1)


def least_similarity(
    length: int, containment: float = CONTAINMENT, words: int = WORDS_PER_SHINGLE, window: int | None = None
) -> float:
    """Lower bound of the Jaccard similarity of a template and the window that holds a match of it."""
    own = max(1, length - words + 1)
    inside = max(1, (window or window_of(length)[0]) - words + 1)
    shared = max(1.0, np.ceil(containment * own - 1e-9))
    return float(shared / max(own, own + inside - shared))


def registered() -> dict[str, str]:
    """All templates: notices, headers, short texts, whole licences (``-text``) and wordings (``id/opening/name``)."""
    whole = {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    texts = NOTICES | OTHERS | whole | {"AGPL-3.0-text": _affero_terms(whole["GPL-3.0-text"])}
    taken = {tuple(words_of(t)) for t in texts.values()}
    for licence, names in SPOKEN.items():
        for i, opening in enumerate(OPENINGS):
            for j, name in enumerate(names):
                if tuple(words_of(f"{opening} {name}")) not in taken:
                    texts[f"{licence}/{i}/{j}"] = f"{opening} {name}"
    return texts


def _affero_terms(gpl: str) -> str:
    """The terms of AGPL-3.0: those of GPL-3.0 with another section 13."""
    terms = gpl[gpl.index("0. Definitions.") : gpl.index("END OF TERMS AND CONDITIONS")]
    a, b = terms.index("13. Use with the GNU Affero"), terms.index("14. Revised Versions")
    other = lambda t: t.replace("GNU General Public", "GNU Affero General Public")
    return other(terms[:a]) + _AFFERO_13 + other(terms[b:])


def words_of(text: str | None) -> list[str]:
    return [m[0].lower() for m in WORD.finditer(text or "")]


def _shingles(words: list, size: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w, SEED)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """One number per shingle; equal shingles have equal numbers."""
    n = max(1, len(hashed) - size + 1) if len(hashed) else 0
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(hashed))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n]
    return out ^ (out >> np.uint64(31))


@dataclass
class Group:
    """Templates, or pieces of templates, of one word count: band settings and index."""

    bands: int
    rows: int
    window: int
    stride: int
    least: int  # shingles that a window must share with some member
    index: dict[tuple, list[str]] = field(default_factory=dict)
    parts: list[np.ndarray] = field(default_factory=list)

    @cached_property
    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts))


class Templates:
    """The band index of the templates and of their pieces, by word count."""

    def __init__(self, texts: dict[str, str], containment: float = CONTAINMENT, size: int = WORDS_PER_SHINGLE):
        self.containment, self.size, self.known = containment, size, {}
        words = {name: words_of(t) for name, t in texts.items()}
        self.shingles = {name: set(_shingles(w, size)) for name, w in words.items() if w}
        self.length = {name: len(words[name]) for name in self.shingles}
        hashes = {name: self.numbers(words[name]) for name in self.shingles}
        self.vocabulary = np.unique(np.concatenate([*hashes.values(), np.zeros(0, dtype=np.uint64)]))
        draw = np.random.default_rng(SEED)
        self.factors = draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
        self.terms = draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.whole: dict[int, Group] = {}
        self.pieces: dict[int, Group] = {}
        for name, own in hashes.items():
            self._register(self.whole, name, own, self.length[name], window_of, containment)
            if piece := piece_length(self.length[name]):
                step, ends = piece - size + 1, self.length[name] - piece
                for start in {*range(0, ends + 1, step), ends}:
                    part = own[start : start + step]
                    self._register(self.pieces, name, part, piece, piece_window_of, min(containment, PIECE_CONTAINMENT))

    def _register(self, groups: dict[int, Group], name: str, own: np.ndarray, length: int, shape, share: float) -> None:
        window, stride = shape(length)
        least = int(np.ceil(share * len(np.unique(own)) - 1e-9))
        if (group := groups.get(length)) is None:
            settings = band_settings(least_similarity(length, share, self.size, window))
            group = groups[length] = Group(*settings, window, stride, least)
        group.least = min(least, group.least)
        group.parts.append(own)
        for key in self._keys(own, group):
            group.index.setdefault(key, []).append(name)

    def numbers(self, words: list[str]) -> np.ndarray:
        return _shingle_hashes(_word_hashes(words, self.known), self.size)

    def _keys(self, shingles: np.ndarray, group: Group) -> list[tuple]:
        mixed = np.unique(shingles)[None, :] * self.factors[:, None] + self.terms[:, None]
        signature = (mixed ^ (mixed >> np.uint64(29))).min(axis=1).tolist()
        return [(i, *signature[i * group.rows : (i + 1) * group.rows]) for i in range(group.bands)]

    def _retrieved(self, group: Group, numbers: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, set[str]]]:
        """(first word, names) of the windows that share a band with a member of the group."""
        if len(hits) < group.least:
            return
        hits = hits[np.isin(numbers[hits], group.vocabulary)]
        if len(hits) < group.least:
            return
        # windows [j * stride, j * stride + window) that hold the whole of a hit shingle
        first = np.maximum(0, -(-(hits + self.size - group.window) // group.stride))
        last = hits // group.stride
        reached = {j for a, b in zip(first.tolist(), last.tolist()) for j in range(a, b + 1)}
        for j in sorted(reached):
            lo = j * group.stride
            end = max(lo + 1, lo + group.window - self.size + 1)
            if np.subtract(*np.searchsorted(hits, (end, lo))) >= group.least:
                yield lo, {n for key in self._keys(numbers[lo:end], group) for n in group.index.get(key, ())}

    def found(self, words: list[str]) -> dict[str, list[tuple[int, int, float]]]:
        """Per template its matches (first word, end, containment), rivals included."""
        numbers = self.numbers(words)
        if not len(numbers) or not len(self.vocabulary):
            return {}
        at = np.minimum(np.searchsorted(self.vocabulary, numbers), len(self.vocabulary) - 1)
        hits = np.flatnonzero(self.vocabulary[at] == numbers)
        if not len(hits):
            return {}
        some: dict[str, list[tuple[int, int, float]]] = {}
        for group in self.whole.values():
            for lo, names in self._retrieved(group, numbers, hits):
                for name in names:
                    if match := self._verified(words[lo : lo + group.window], name):
                        some.setdefault(name, []).append((lo + match[0], lo + match[1], match[2]))
        matches = {name: _merged(spans) for name, spans in some.items()}
        asked: set[str] = set()
        for group in self.pieces.values():
            for _, names in self._retrieved(group, numbers, hits):
                asked |= names
        if asked:
            held = [(i, tuple(words[i : i + self.size])) for i in hits.tolist()]
            for name in sorted(asked):
                if more := self._interrupted(held, name, matches.get(name, [])):
                    matches[name] = sorted([*matches.get(name, []), *more])
        return matches

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        found = self.found(words_of(text))
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text or "")]
        return [(name, spans[a][0], spans[z - 1][1], share) for name, a, z, share in self._best(found)]

    def _interrupted(
        self, held: list[tuple[int, tuple]], name: str, known: list[tuple[int, int, float]]
    ) -> list[tuple[int, int, float]]:
        """Matches of any length outside the ``known`` ones, from the positions of all templates' shingles."""
        wanted, length = self.shingles[name], self.length[name]
        need = int(np.ceil(self.containment * len(wanted) - 1e-9))
        rows = [(i, s) for i, s in held if s in wanted and not any(a <= i < z for a, z, _ in known)]
        out: list[tuple[int, int, float]] = []
        inside: Counter = Counter()
        lo = at = 0
        while at < len(rows):
            inside[rows[at][1]] += 1
            at += 1
            if len(inside) < need:
                continue
            while len(inside) > need or inside[rows[lo][1]] > 1:  # the shortest that ends here
                shingle = rows[lo][1]
                inside[shingle] -= 1
                if not inside[shingle]:
                    del inside[shingle]
                lo += 1
            floor = out[-1][1] if out else -1
            while lo and floor <= rows[lo - 1][0] >= rows[lo][0] - length and rows[lo - 1][1] not in inside:
                lo -= 1
                inside[rows[lo][1]] += 1
            while at < len(rows) and rows[at][0] <= rows[at - 1][0] + length and rows[at][1] not in inside:
                inside[rows[at][1]] += 1
                at += 1
            out.append((rows[lo][0], rows[at - 1][0] + self.size, len(inside) / len(wanted)))
            inside.clear()
            lo = at
        return out

    def _best(self, found: dict[str, list[tuple[int, int, float]]]) -> list[tuple[str, int, int, float]]:
        """Of matches of one stretch (they share over half of the longer one) the one of highest containment."""
        some = [(name, *x) for name, spans in found.items() for x in spans]
        some.sort(key=lambda m: (-m[3], -len(self.shingles[m[0]]), m[0], m[1]))
        kept: list[tuple[str, int, int, float]] = []
        for m in some:
            rivals = (k for k in kept if k[0] != m[0])
            if not any(2 * (min(m[2], k[2]) - max(m[1], k[1])) > max(m[2] - m[1], k[2] - k[1]) for k in rivals):
                kept.append(m)
        return sorted(m for m in kept if not any(self._part_of(m, k) for k in kept))

    def _part_of(self, m: tuple[str, int, int, float], whole: tuple[str, int, int, float]) -> bool:
        """A notice that its place's longer match consists of too."""
        return whole[1] <= m[1] and m[2] <= whole[2] and self.shingles[m[0]] < self.shingles[whole[0]]

    def _verified(self, words: list[str], name: str) -> tuple[int, int, float] | None:
        wanted = self.shingles[name]
        held = [(i, s) for i, s in enumerate(_shingles(words, self.size)) if s in wanted]
        share = len({s for _, s in held}) / len(wanted)
        if share < self.containment:
            return None
        return held[0][0], min(len(words), held[-1][0] + self.size), share


def _merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    for a, z, share in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((a, z, share))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, matches (array of licence, start, end, containment) of every document."""
    texts = registered() if templates is None else templates
    if sum(len(words_of(t)) for t in texts.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words; scan with parts of them in turn")
    kind = pa.list_(
        pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts, containment)
        for b in batches:
            rows = [
                [{"licence": n, "start": s, "end": e, "containment": c} for n, s, e, c in index.matches(t)]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, matches array<struct<licence:string,start:bigint,end:bigint,containment:double>>"
    return narrow.mapInArrow(run, schema)
