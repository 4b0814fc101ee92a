"""Character n-grams of many texts at once, hashed with NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from panelweave.llm.common import code_points


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536)


def is_letter(codes: np.ndarray) -> np.ndarray:
    found = _letters()[np.minimum(codes, 65535)]
    for c in np.unique(codes[codes > 65535]):
        found[codes == c] = chr(c).isalpha()
    return found


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with all but letters as spaces, padded by two
    spaces at either end of each text; row offsets; whether a row has letters."""
    codes, offsets = code_points(["  " + t.lower() + "  " for t in texts])
    letter = is_letter(codes)
    has = np.add.reduceat(letter, offsets[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    return np.where(letter, codes, 32).astype(np.uint64), offsets, has


def hashed(codes: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram that lies within one row; slots have `bits` bits."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h ^= codes[k : k + size]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = row[:size] == row[n - 1 :]
    return row[:size][inside], slot[inside]
