"""Content-chosen sample positions: identical stretches choose identical places."""

from __future__ import annotations

import numpy as np

from gleaner.llm.grams import BYTE_BASE, BYTE_CODES, rolling


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    span, cur = 1, v
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    n = len(v) - w + 1
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def sample_positions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram fingerprints) such that each run of `length` bytes of one
    text holds a whole sampled gram, the same one wherever those bytes stand."""
    w = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(BYTE_CODES[data], gram, BYTE_BASE)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = sliding_min(v, w)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(best)]
    inside = ends >= np.arange(length, length + len(best))
    at = (best[inside] & low).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    at = np.unique(at)
    return at, h[at]
