"""Vectorised words of Arrow text columns.

Texts are looked at as UTF-8 bytes.  Every separator of the word rules is ASCII, so cutting bytes is the same as cutting
code points.  All hashes are 64-bit; no word is ever cut, and each document is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True

#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Word rules: which (lowered, where the rule lowers) bytes belong to words.
RULES = {
    "spaced": (False, ~_SPACES),  # [^\x20\x09-\x0D]+, unchanged
    "spaced_lower": (True, ~_SPACES),  # the same after lowering A-Z
    "letters_lower": (True, _LETTERS[LOWER]),  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z
}

_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}
MOST_KEPT = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or held.size < n:
        grown = np.full(max(n, 1 << 16) * 3 // 2 if n <= MOST_KEPT else n, base, dtype=np.uint64)
        grown[0] = 1
        held = np.cumprod(grown, dtype=np.uint64)
        if n <= MOST_KEPT:  # a worker lives on after a very long text
            _powers[int(base)] = held
    return held[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all texts, as they are
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end
    hash: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets in them; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def cut(texts: pa.Array, rule: str, hashes: bool = True) -> Words:
    """The words of each text by a rule of ``RULES``."""
    lower, inside = RULES[rule]
    data, at = text_bytes(texts)
    word = np.zeros(data.size + 2, dtype=bool)
    np.take(inside, data, out=word[1:-1])
    begins, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]  # at a byte; before a byte
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < data.size)]
    joined = edges[word[edges] & word[edges + 1]]  # a word may not run on into the next text
    begins[joined] = ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, at)
    if not hashes or not start.size:
        return Words(data, start, end, first, np.zeros(start.size, dtype=np.uint64))
    codes = np.where(inside, _BYTE_CODES[LOWER] if lower else _BYTE_CODES, U64(0))
    value = codes[data]
    value *= powers(_BASE, data.size)
    back = powers(inverse(_BASE), data.size)
    return Words(data, start, end, first, mix(np.add.reduceat(value, start) * back[start]))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words from each word on (the last k-1 words have none)."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    p = powers(_STEP, k)
    out = h[:n].copy()
    for j in range(1, k):
        out += h[j : j + n] * p[j]
    return mix(out ^ U64(k))


class Spans:
    """Hashes of any run of words, after one pass."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(h.size + 1, dtype=np.uint64)
        np.cumsum(h * powers(_STEP, h.size), out=self.sums[1:])
        self.back = powers(inverse(_STEP), h.size + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = (end - start).astype(np.uint64)
        return mix(((self.sums[end] - self.sums[start]) * self.back[start]) ^ n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    if x.size < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, so that memory doesn't follow the number of rows; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
