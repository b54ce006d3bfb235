"""Hashed word and character n-grams of whole texts: counts for training, means of weights for scoring."""

from __future__ import annotations

import numpy as np

from . import hashing as H

CHARS = (3, 4, 5)
WORDS = (1, 2)


def char_slots(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The slot of the n-gram that starts at each byte; len(raw) - n + 1 of them."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    b = raw.astype(np.uint32)
    h = np.full(m, 0x811C9DC5 + 97 * n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= b[k : k + m]
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def word_slots(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    return (H.window_hashes(h, n) >> np.uint64(64 - bits)).astype(np.int64)


def grams(raw: np.ndarray, offsets: np.ndarray, bits: int):
    """Yield (slots, starts, ends) for each kind of n-gram: slots[start:end] belong to document i."""
    for n in CHARS:
        yield char_slots(raw, n, bits), offsets[:-1], offsets[1:] - n + 1
    starts, ends = H.runs(~H.SPACE[raw], offsets)
    h = H.slice_hashes(raw, starts, ends)
    lo, hi = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
    for n in WORDS:
        yield word_slots(h, n, bits), lo, hi - n + 1


def mean_weights(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """For each document the sum of its n-grams' weights over their number; 0 for a text without n-grams."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for slots, starts, ends in grams(raw, offsets, bits):
        total += H.segment_sums(weights[slots].astype(np.float64), starts, ends)
        count += np.maximum(ends - starts, 0)
    return total / np.maximum(count, 1)


def bags(raw: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document (slots, shares): its distinct slots and what part of its n-grams each has."""
    parts = list(grams(raw, offsets, bits))
    out = []
    for i in range(len(offsets) - 1):
        slots = np.concatenate([s[a[i] : max(a[i], b[i])] for s, a, b in parts])
        slots, counts = np.unique(slots, return_counts=True)
        out.append((slots, (counts / max(1, counts.sum())).astype(np.float32)))
    return out
