"""Terms of whole batches of texts, by byte classes.

A term is a maximal run of member characters: chosen ASCII characters and everything beyond ASCII. All bytes
of a character beyond ASCII are 0x80 and more, so a table over bytes finds the runs in the UTF-8 of a whole
batch at once; A-Z alone are lower-cased. Terms come out dictionary-encoded, ready for counting.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LETTERS = string.ascii_letters
LETTERS_DIGITS = string.ascii_letters + string.digits
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Terms:
    """Distinct terms of some texts, the index of each occurrence, and where each text's occurrences begin."""

    distinct: pa.StringArray
    code: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text of each occurrence."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_terms(texts: pa.Array, members: str) -> Terms:
    """Terms of an Arrow array of texts; null is empty."""
    whole = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    table[[ord(c) for c in members]] = True
    inside = table[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = at[at < len(raw)]
    start[edges] = inside[edges]
    starts = np.flatnonzero(start)
    before = np.cumsum(inside)
    ends = np.append(before[starts] - 1, before[-1] if len(raw) else 0).astype(np.int32)
    flat = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[raw[inside]]))
    )
    coded = flat.dictionary_encode()
    return Terms(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, at))


def chunked(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes of text; a longer text is a slice of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)
