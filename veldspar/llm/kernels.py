"""Hashes of words and shingles over the bytes of whole texts, batch by batch in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np

#: Lower-cases A-Z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
#: Odd factors of the words of a shingle.
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def tidy(run: Callable) -> Callable:
    """Give freed memory back when a task ends, as its worker stays for tasks of later stages."""

    @wraps(run)
    def until_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return until_end


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(text: bytes, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order; words are parted by ASCII white space.

    A polynomial modulo 2**64 of a word's bytes comes from running sums over the text.
    ``chunk`` bounds memory: a text is cut there at white space, a longer word is not.
    """
    found, at, size = [], 0, len(text)
    data = np.frombuffer(text, np.uint8)
    while at < size:
        end = min(size, at + chunk)
        while end < size and _IS_WORD[data[end]]:
            step = data[end : end + chunk]
            gaps = np.flatnonzero(~_IS_WORD[step])
            end += int(gaps[0]) if len(gaps) else len(step)
        found.append(_hash_chunk(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _hash_chunk(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = max(1 << 18, 1 << int(len(data)).bit_length())
    power, inverse = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    raw = (sums[after] - sums[first]) * inverse[first]
    return mix(raw ^ ((after - first).astype(np.uint64) * _ODD[3]))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; of fewer words, the whole sequence is the one."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix(np.array([(words * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    rolled = words[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        rolled = rolled + words[k : n - width + 1 + k] * _ODD[k]
    rolled = mix(rolled)
    rolled.sort()
    keep = np.empty(len(rolled), bool)
    keep[0] = True
    np.not_equal(rolled[1:], rolled[:-1], out=keep[1:])
    return rolled[keep]


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared, len(a) + len(b) - shared
