"""Sets of word shingles as sorted arrays of 64-bit hashes, made inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs without space, tab, line feed, \\v, \\f or \\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    """``words_of`` with A to Z in lower case; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    # Looking a word up costs as much as hashing it, and a worker would keep the words.
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive elements, by place of the first."""
    count = len(hashes) - size + 1
    out = np.full(count, size, "u8")
    for shift in range(size):
        out = out * _FACTOR + hashes[shift : shift + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words make one shingle."""
    if not words:
        return np.zeros(0, "u8")
    return np.unique(run_hashes(word_hashes(words), min(size, len(words))))
