"""Fingerprints sent through Spark's shuffle as packets.

A batch of documents (a few megabytes of text, one group of `__batch`) sends one
row per slice of the fingerprint space, holding all of its distinct fingerprints
there as one binary.  Equal fingerprints of all batches meet in one group of
`bucket`; a fingerprint that is frequent in a batch still travels once from it,
so no group grows with the copies of a text.  Answers travel back to the
batches as packets, too.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a batch: a share of all of it, within these bounds.
LEAST_BATCH, MOST_BATCH, BATCH_SHARE = 4_000_000, 64_000_000, 4096


@dataclass(frozen=True)
class Layout:
    batches: int
    buckets: int
    #: Bytes of a fingerprint that the first, filtering round sends.
    width: int


def layout(docs: DataFrame, unit_bytes: float, batch_bytes: int | None = None) -> Layout:
    """From the size of all texts.  unit_bytes: text per fingerprint of the rarer side;
    the width keeps chance matches under one in a hundred."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch_bytes = batch_bytes or min(MOST_BATCH, max(LEAST_BATCH, total // BATCH_SHARE))
    batches = max(1, -(-total // batch_bytes))
    units = max(2.0, total / unit_bytes)
    width = min(8, max(4, int(-(-(np.log2(units) + 7) // 8))))
    return Layout(batches, max(4, batches // 2), width)


def in_batches(docs: DataFrame, batches: int) -> DataFrame:
    """Documents with `__batch`, chosen by content, so that equal keys spread, too."""
    return docs.withColumn("__batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))


def occupied(buckets: np.ndarray) -> list[tuple[int, slice]]:
    """Each bucket that occurs in sorted bucket numbers, with its stretch: as many as there are fingerprints at most."""
    firsts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, np.int64)
    return [(int(buckets[a]), slice(int(a), int(b))) for a, b in zip(firsts, np.append(firsts[1:], len(buckets)), strict=True)] if len(buckets) else []


def cut(sorted_h: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets of sorted fingerprints, each a slice of the fingerprint space."""
    with np.errstate(over="ignore"):
        return occupied(((sorted_h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24))


def pack(h: np.ndarray, width: int) -> bytes:
    """The top `width` bytes of each fingerprint."""
    if width == 8:
        return h.astype("<u8").tobytes()
    return (h >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, "<u8")
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as their range needs."""
    low = int(ids.min()) if len(ids) else 0
    width = max(1, -(-(int(ids.max()) - low).bit_length() // 8)) if len(ids) else 1
    offset = (ids.astype(np.int64).view(np.uint64) - np.int64(low).view(np.uint64)).astype("<u8")
    return struct.pack("<qB", low, width) + offset.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    low, width = struct.unpack_from("<qB", raw)
    return (unpack(raw[9:], width) + np.int64(low).view(np.uint64)).view(np.int64)


def shortened(h: np.ndarray, width: int) -> np.ndarray:
    return h >> np.uint64(64 - 8 * width) if width < 8 else h


def contains(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there, where) for each value."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values, at


def by_batch(batch: np.ndarray, columns: list[np.ndarray], widths: list[int], schema: pa.Schema) -> pa.Table:
    """One row per batch with each column's values of that batch as a binary."""
    order = np.argsort(batch, kind="stable")
    batch = batch[order]
    firsts = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1]))) if len(batch) else np.zeros(0, np.int64)
    ends = np.append(firsts[1:], len(batch)) if len(batch) else firsts
    cols = [pa.array(batch[firsts], pa.int32())]
    for values, width in zip(columns, widths, strict=True):
        values = values[order]
        raw = values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        cols.append(pa.array([raw[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary()))
    return pa.Table.from_arrays(cols, schema=schema)


def joined(table: pa.Table, name: str) -> bytes:
    return b"".join(x.as_py() for x in table.column(name))
