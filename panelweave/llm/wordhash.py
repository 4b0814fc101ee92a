"""Hashed words of whole Arrow columns, with NumPy on their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_STEP = 0xC2B2AE3D27D4EB4F  # odd, so its powers can be undone modulo 2**64


@lru_cache(1)
def _values() -> np.ndarray:
    """A random word for each byte: words are runs of ASCII letters and digits
    and of non-ASCII characters, upper-case letters count as lower case, and
    bytes that belong to no word are 0."""
    values = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    outside = np.ones(256, bool)
    outside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    values[outside] = 0
    return values


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step, and of its inverse."""
    powers, inverse = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


@lru_cache(1)
def token_values() -> np.ndarray:
    """The same for words that are runs of anything but ASCII white space."""
    values = np.random.default_rng(65).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of every word; no word crosses a row's end.

    A word's hash is the sum of its bytes' values times powers of a step, in 64
    bits, mixed. All words are summed at once with powers that run through the
    data; the inverse power of a word's first byte takes its place out again.
    """
    values = (_values() if values is None else values)[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] |= inside[edge]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    powers, inverse = _powers(1 << max(20, (len(data) - 1).bit_length()))
    values *= powers[: len(data)]
    total = np.add.reduceat(values, start) * inverse[start]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0x9FB21C651E98DF25)
    total ^= total >> np.uint64(32)
    return total, start, np.searchsorted(offsets, start, "right") - 1


def parts(data: np.ndarray, offsets: np.ndarray, most: int = 1_000_000):
    """Row ranges of about `most` bytes each."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b
