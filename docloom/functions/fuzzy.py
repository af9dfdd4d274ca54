"""Partial ratio (J3, J10): the best normalised Indel similarity of the shorter string against any
window of the longer one, windows being cut off at both ends of the text.

Spark has no such function (``levenshtein`` counts a substitution as one edit), so this is an Arrow
UDF over text batches. Inside, all windows of one text advance together in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _best_window(short: np.ndarray, long: np.ndarray) -> float:
    m, n = len(short), len(long)
    words = -(-m // _WORD)
    # One bit mask per text position: the needle positions holding that character. m - 1 empty
    # positions on either side make the cut-off windows ordinary ones.
    top = int(short.max()) + 1
    table = np.zeros((words, top + 1), dtype=np.uint64)
    for i, char in enumerate(short):
        table[i // _WORD, char] |= np.uint64(1 << (i % _WORD))
    masks = np.zeros((words, n + 2 * (m - 1)), dtype=np.uint64)
    masks[:, m - 1 : m - 1 + n] = table[:, np.minimum(long, top)]
    windows = n + m - 1
    # Bit-parallel longest common subsequence; zero bits of the state count matched characters.
    state = np.full((words, windows), np.iinfo(np.uint64).max, dtype=np.uint64)
    for step in range(m):
        carry = None
        for w in range(words):
            s = state[w]
            u = s & masks[w, step : step + windows]
            total = s + u
            if carry is not None:
                total = total + carry
            if w + 1 < words:
                carry = ((total < s) | ((total == s) & (u != 0))).astype(np.uint64)
            state[w] = total | (s - u)
    last = m - (words - 1) * _WORD
    common = np.zeros(windows, dtype=np.int64)
    for w in range(words):
        used = _WORD if w + 1 < words else last
        keep = np.uint64(((1 << used) - 1) & ((1 << 64) - 1))
        common += np.bitwise_count(~state[w] & keep)
    start = np.arange(windows) - (m - 1)
    width = np.minimum(start + m, n) - np.maximum(start, 0)
    return float((2.0 * common / (m + width)).max())


def partial_ratio(a: str, b: str) -> float:
    """0..100."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    x, y = _codes(short), _codes(long)
    best = _best_window(x, y)
    if len(x) == len(y):
        best = max(best, _best_window(y, x))
    return 100.0 * best


def ratios_against(needles: list[str]):
    """Arrow UDF: text -> array of partial ratios (0..1), one per needle. Null text gives null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ratios(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else [partial_ratio(h, t) / 100.0 for h in needles] for t in texts],
            dtype=object,
        )

    return ratios


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def row_ratios(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """text, array of needles of the same row -> array of partial ratios (0..1)."""
    return pd.Series(
        [
            None if t is None or hs is None else [partial_ratio(h, t) / 100.0 if h else 0.0 for h in hs]
            for t, hs in zip(texts, needles)
        ],
        dtype=object,
    )


def _padded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each name, one name a column; lengths)."""
    codes = [_codes(n) for n in names]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    out = np.zeros((int(sizes.max(initial=0)), len(names)), dtype=np.uint32)
    for i, c in enumerate(codes):
        out[: len(c), i] = c
    return out, sizes


def _windows_of_many(hits: Callable[[int], np.ndarray], m: int, n: int, count: int) -> np.ndarray:
    """``_best_window`` for many pairs of m (at most a word) and n characters at once; ``hits(i)`` tells
    where the i-th character of each shorter text stands in the longer one, as an n x count array."""
    masks = np.zeros((n + 2 * (m - 1), count), dtype=np.uint64)
    inner = masks[m - 1 : m - 1 + n]
    for i in range(m):
        inner |= hits(i).astype(np.uint64) << np.uint64(i)
    windows = n + m - 1
    state = np.full((windows, count), np.iinfo(np.uint64).max, dtype=np.uint64)
    for step in range(m):
        u = state & masks[step : step + windows]
        state = (state + u) | (state - u)
    common = np.bitwise_count(~state & np.uint64((1 << m) - 1)).astype(np.int64)
    start = np.arange(windows) - (m - 1)
    width = np.minimum(start + m, n) - np.maximum(start, 0)
    return (2.0 * common / (m + width)[:, None]).max(axis=0)


def _ratios_of_many(text: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """``partial_ratio`` (0..100) of one text with many names of n characters, the shorter a word at most."""
    m, count = len(text), names.shape[1]
    best = np.zeros(count)
    if m <= n:
        best = _windows_of_many(lambda i: names == text[i], m, n, count)
    if n <= m:
        best = np.maximum(best, _windows_of_many(lambda i: names[i] == text[:, None], n, m, count))
    return 100.0 * best


_BUCKETS = 128
# Names rated at once: as many as fit a processor's cache with the windows of a usual name.
_MOST_AT_ONCE = 512


def _counts(names: list[str]) -> np.ndarray:
    """Characters of each name, counted in buckets of code points."""
    out = np.zeros((len(names), _BUCKETS), dtype=np.int32)
    for i, name in enumerate(names):
        out[i] = np.bincount(_codes(name) % _BUCKETS, minlength=_BUCKETS)
    return out


def best_of(asked: list[str], names: list[str], least: float) -> list[tuple[int | None, float, int]]:
    """For each asked text the first of the closest ``names`` with a ratio of at least ``least`` (0..100).

    Returns (index or None, ratio, names rated). No name that could win is passed over: a window of the longer
    text that has c characters in common with the shorter one (m characters) is at least c long, so its ratio
    is at most 2c / (m + c), which grows with c; and c is at most what both texts hold of each character, counted
    in buckets (a shared bucket only makes the bound larger). Names are rated in the order of their bounds until
    the bound is below the best ratio found: the first alone, then eight times as many each time, those of a length at once.
    """
    held = _counts(names)
    codes, sizes = _padded(names)
    out: list[tuple[int | None, float, int]] = []
    for text, own in zip(asked, _counts(asked)):
        if not text:
            out.append((None, 0.0, 0) if least > 0 or not names else (0, 0.0, 0))
            continue
        text_codes = _codes(text)
        common = np.zeros(len(names), dtype=np.int64)
        for bucket in np.flatnonzero(own):
            common += np.minimum(held[:, bucket], own[bucket])
        shorter = np.minimum(sizes, len(text))
        bound = 200.0 * common / (shorter + common) + 1e-9
        possible = np.flatnonzero(bound >= least)
        possible = possible[np.argsort(-bound[possible], kind="stable")]
        best, ratio, rated, at, step = None, least, 0, 0, 1
        while at < len(possible) and bound[possible[at]] >= ratio:
            some = possible[at : at + step]
            some = some[bound[some] >= ratio]
            values = np.empty(len(some))
            for n in np.unique(sizes[some]).tolist():
                of_size = sizes[some] == n
                if min(n, len(text)) <= _WORD and len(some) > 1:
                    values[of_size] = _ratios_of_many(text_codes, codes[:n, some[of_size]], n)
                else:
                    values[of_size] = [partial_ratio(text, names[i]) for i in some[of_size].tolist()]
            value = float(values.max())
            if value >= ratio:
                first = int(some[values == value].min())
                best = first if value > ratio or best is None else min(best, first)
                ratio = value
            rated += len(some)
            at += step
            step = min(8 * step, _MOST_AT_ONCE)
        out.append((best, ratio if best is not None else 0.0, rated))
    return out
