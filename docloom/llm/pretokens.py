"""Splitting whole batches of texts into pre-tokens with array operations.

The pattern is ``public_tokenizers.PATTERN``: contractions, runs of letters, of numbers and of other
characters, each with one space before it if there is one, and white space. A character's class decides
where a run ends, so a few passes over an array of code points place every boundary; the pre-tokens come
out as one Arrow string array over the batch's own bytes, ready for dictionary encoding.

Characters that Unicode versions disagree on (unassigned here, or assigned in 15.1) send their document
through the pattern itself.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 19
LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)
# Unicode's White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)
# Ranges whose characters Unicode 15.1 assigned.
ASSIGNED_15_1 = ((0x2EBF0, 0x2EE5D), (0x2FFC, 0x2FFF), (0x31EF, 0x31EF))


@functools.cache
def class_table() -> np.ndarray:
    by_major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (
            UNSURE if (kind := unicodedata.category(chr(c))) == "Cn" else by_major.get(kind[0], OTHER)
            for c in range(0x110000)
        ),
        np.uint8,
        0x110000,
    )
    table[[ord(c) for c in WHITE_SPACE]] = SPACE
    for first, last in ASSIGNED_15_1:
        table[first : last + 1] = UNSURE
    return table


@functools.cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@dataclass
class Pieces:
    """Pre-tokens of some texts: distinct ones, each occurrence's index, and where each text's begin."""

    distinct: list[str]
    index: np.ndarray
    bounds: np.ndarray


def split(texts: list[str]) -> Pieces:
    joined = "".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    offsets = np.concatenate(([0], ends))
    n = len(joined)
    if not n:
        return Pieces([], np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64))
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kind = class_table()[cps]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first = first[:n]
    white, blank = kind == SPACE, cps == 32
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1] & ~first[1:]
    start = first | (change & (white | ~after_blank))
    # the last of several white-space characters before a word belongs to, or stands before, the word
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:]
    _contractions(cps, change & ~after_blank, first, start)
    if (kind == UNSURE).any():
        _by_pattern(joined, offsets, kind == UNSURE, start)
    starts = np.flatnonzero(start)
    width = 1 + (cps >= 0x80).astype(np.int32) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    byte_offsets = np.append(at[starts], at[-1]).astype(np.int32)
    flat = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(byte_offsets), pa.py_buffer(joined.encode("utf-8"))
    )
    coded = flat.dictionary_encode()
    return Pieces(
        coded.dictionary.to_pylist(),
        coded.indices.to_numpy().astype(np.int64),
        np.searchsorted(starts, offsets),
    )


def _contractions(cps: np.ndarray, opens: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Move the boundaries around 's 't 'm 'd 're 've 'll at the start of a run."""
    n = len(cps)
    quotes = np.flatnonzero(opens & (cps == 39))
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~first[quotes + 1]]
    one = quotes[np.isin(cps[quotes + 1], [ord(c) for c in "stmd"])]
    start[one + 1] = False
    start[(one + 2)[one + 2 < n]] = True
    two = quotes[quotes + 2 < n]
    two = two[~first[two + 2]]
    pair = cps[two + 1].astype(np.int64) * 0x110000 + cps[two + 2]
    two = two[np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]
    start[two + 1] = False
    start[(two + 3)[two + 3 < n]] = True


def _by_pattern(joined: str, offsets: np.ndarray, unsure: np.ndarray, start: np.ndarray) -> None:
    for doc in np.unique(np.searchsorted(offsets, np.flatnonzero(unsure), side="right") - 1):
        a, b = int(offsets[doc]), int(offsets[doc + 1])
        start[a:b] = False
        start[[m.start() for m in _pattern().finditer(joined, a, b)]] = True


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters (a longer text is a chunk of its own); null is empty."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class PieceCache:
    """Ids of pre-tokens seen before in this task; it starts afresh when ``limit`` are held."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 150_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, pieces: list[str]) -> list[list[int]]:
        if len(self.known) > self.limit:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.encode(new)))
        return [self.known[p] for p in pieces]


def flat_ids(found: Pieces, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, where each text's begin)."""
    lists = cache.ids(found.distinct)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    pool = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    each = sizes[found.index]
    after = np.concatenate(([0], np.cumsum(each)))
    places = np.repeat(begin[found.index] - after[:-1], each) + np.arange(after[-1])
    return pool[places], after[found.bounds]
