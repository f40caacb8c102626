"""Hashes of words and of windows of words."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = 0x9E3779B97F4A7C15
#: Words whose hashes a task remembers.
REMEMBERED = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each window of ``length`` words, built from those of half the length and again of half of that."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    whole = _polynomial(hashes, length)
    built = whole ^ (whole >> np.uint64(31))
    built *= np.uint64(0xBF58476D1CE4E5B9)
    return built ^ (built >> np.uint64(29))


def _polynomial(hashes: np.ndarray, length: int) -> np.ndarray:
    if length == 1:
        return hashes
    left = length // 2
    half = _polynomial(hashes, left)
    rest = half if length == 2 * left else _polynomial(hashes, length - left)
    number = len(hashes) - length + 1
    return half[:number] * np.uint64(pow(_FACTOR, length - left, 1 << 64)) + rest[left : left + number]


def selected(found: np.ndarray, zone: int) -> np.ndarray:
    """Places of the least hash of each ``zone`` neighbouring windows: which, only the words decide."""
    if len(found) < zone:
        return np.zeros(0, np.int64)
    return np.unique(least_in_zone(found, zone))


def least_in_zone(found: np.ndarray, zone: int) -> np.ndarray:
    """The place of the least hash in each run of ``zone`` windows, the first of equal ones."""
    runs = np.lib.stride_tricks.sliding_window_view(found, zone)
    return runs.argmin(1) + np.arange(len(runs))
