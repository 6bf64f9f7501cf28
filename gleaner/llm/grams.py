"""Word spans and rolling 64-bit fingerprints of an Arrow text column, all in numpy.

Used inside Spark tasks only.  A *batch* is a run of whole documents; every
array below is aligned with the bytes or the words of that run.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Fixed odd bases of the two polynomial fingerprints (bytes, items).
BYTE_BASE = 0x9E3779B97F4A7C15
ITEM_BASE = 0xC2B2AE3D27D4EB4F


def _seeded(n: int, name: str) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same in every process."""
    raw = hashlib.shake_256(name.encode()).digest(8 * n)
    return np.frombuffer(raw, dtype="<u8").copy()


BYTE_CODES = _seeded(256, "byte codes") | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(maxsize=6)
def _powers_up_to(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    step = 1
    factor = np.uint64(base)
    with np.errstate(over="ignore"):
        while step < n:
            out[step : 2 * step] = out[: min(step, n - step)] * factor
            factor = factor * factor
            step *= 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 16)
    return _powers_up_to(base, size)[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, len+1 offsets); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype="<i8")[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def rolling(items: np.ndarray, n: int, base: int = ITEM_BASE) -> np.ndarray:
    """Fingerprints of every run of n consecutive items (len(items) - n + 1 of them)."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * powers(base, len(items)), out=total[1:])
        return mix((total[n:] - total[:-n]) * inverse_powers(base, len(items) - n + 1))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs without ASCII white space inside one text.

    Returns (start byte, end byte, first word of each text); the last array has
    one entry more than there are texts.
    """
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] if len(data) else False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(BYTE_BASE, len(data)), out=total[1:])
        h = (total[ends] - total[starts]) * inverse_powers(BYTE_BASE, max(1, len(data)))[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def doc_slices(offsets: np.ndarray, most: int = 1_000_000):
    """(first, last) document ranges of at most `most` bytes; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to
