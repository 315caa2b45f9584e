"""Distinct word shingles of texts as 64-bit hashes, for whole Arrow columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plantlens.llm.common import hashes_of, words_of

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets for each text, and the distinct shingles of each in ascending order.

    A text with fewer words than width has its whole sequence for a shingle; one without words has none.
    """
    rows, codes, words = words_of(texts)
    n = np.bincount(rows, minlength=len(texts))
    word = hashes_of(words)[codes] if len(words) else np.zeros(0, np.uint64)
    start = np.cumsum(n) - n
    size = np.minimum(width, n)
    many = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), many)
    first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[row]
    hashed = size[row].astype(np.uint64)
    for k in range(width):
        at = first + k
        inside = k < size[row]
        hashed = np.where(inside, mix(hashed * _MULTIPLIER + word[np.minimum(at, len(word) - 1)]) if len(word) else hashed, hashed)
    hashed = hashed >> np.uint64(1)  # as a positive long
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    row, hashed = row[new], hashed[new]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), hashed
