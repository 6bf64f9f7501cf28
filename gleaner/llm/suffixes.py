"""Removing long byte strings that occur more than once, by sorting suffixes.

Only suffixes that can matter are sorted.  Sample positions chosen by content
(minimizers.py) put at least one sampled gram into every string of `length`
bytes, the same one wherever the string stands, so:
  1. grams of all batches meet; a string whose sampled gram occurs once occurs once
  2. the neighbourhoods of repeated grams meet (all bytes that a string holding
     the gram can cover).  A neighbourhood that occurs twice is covered whole;
     only grams with some other neighbourhood stay open, one place for each
     distinct neighbourhood
  3. the suffixes that start in open neighbourhoods are range-partitioned by
     their leading token with sampled splitters; each bucket sorts its suffixes
     by multikey quicksort: leading token first, then the fingerprint of the
     whole string; equal neighbours are repeats.  A leading token that several
     splitters share is split by the second key, so a common token is not one
     task's work, and equal strings can't lie on two sides of a boundary
  4. batches remove the bytes under repeated strings

Everything travels as packets (packets.py): a string that a batch holds often is
sent once.  Strings are told apart by their first eight bytes and a 64-bit
fingerprint, neighbourhoods by 64 bits: among n open strings, some two unlike ones
with one beginning are taken for equal with a chance below n**2 / 2**65.

Cases: a null text is empty and stays null; texts below `length` bytes lose
nothing; equal rows remove each other; an empty table gives no rows; doc_id is
only passed through, as are other columns whatever their names, and a clash with a
result column is resolved in favour of the result; texts are read whole, and one of
over 2 GB exceeds an Arrow string and fails; rows equal in doc_id and text share a
batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.columns import restored, shielded
from gleaner.llm.grams import BYTE_BASE, BYTE_CODES, doc_slices, inverse_powers, mix, powers, text_bytes
from gleaner.llm.minimizers import sample_positions
from gleaner.llm.packets import Layout, by_batch, contains, cut, in_batches, joined, layout, occupied, pack, shortened, unpack

RESULT = ("n_bytes", "n_removed", "n_spans", "kept")
#: A gram in more batches than this has its neighbourhoods dealt one by one.
HOT_BATCHES = 1000
#: Leading tokens that the splitters are taken from, at most.
SPLITTER_SAMPLE = 16_000
PACKETS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("flag", pa.binary())])
ANSWERS = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("flag", pa.binary())])
GRAM, NEIGHBOURHOOD, STRING = 1, 2, 3
REPEATED, OPEN = 1, 2


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


#: Parts that quicksort leaves to a plain sort.
SMALL_PART = 4096


def multikey_quicksort(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the next: a part is split into less, equal and more
    than a pivot of its key; the equal part goes on with the next key."""
    order = np.arange(len(keys[0]))
    parts = [(0, len(order), 0)]
    while parts:
        a, b, depth = parts.pop()
        if b - a < 2 or depth == len(keys):
            continue
        part = order[a:b]
        if b - a <= SMALL_PART:
            order[a:b] = part[np.lexsort([k[part] for k in keys[depth:]][::-1])]
            continue
        key = keys[depth][part]
        few = np.sort(key[:: max(1, len(key) // 31)])
        pivot = few[len(few) // 2]
        less, same = part[key < pivot], part[key == pivot]
        order[a:b] = np.concatenate([less, same, part[key > pivot]])
        middle, end = a + len(less), a + len(less) + len(same)
        parts += [(a, middle, depth), (middle, end, depth + 1), (end, b, depth)]
    return order


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place of each distinct key in it, how often it occurs)."""
    order = multikey_quicksort(*keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, order, order
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    firsts = np.flatnonzero(fresh)
    return order, firsts, np.diff(np.append(firsts, len(order)))


class Texts:
    """The bytes of a batch and the fingerprints of any stretch of one text."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = text_bytes(table.column("text"))
        self.batch = table.column("__batch")[0].as_py() if table.num_rows else 0

    def parts(self):
        for a, b in doc_slices(self.offsets):
            lo = self.offsets[a]
            yield lo, self.data[lo : self.offsets[b]], self.offsets[a : b + 1] - lo

    def samples(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, data, offsets in self.parts():
            a, b = sample_positions(data, offsets, length, gram)
            at.append(a + lo)
            h.append(b)
        return np.concatenate(at), np.concatenate(h)

    def stretches(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """Fingerprints of [start, end) in the order of start, equal exactly where bytes and salt are."""
        out = np.empty(len(start), np.uint64)
        salt = np.broadcast_to(np.asarray(salt, np.uint64), start.shape)
        for lo, data, _ in self.parts():
            here = slice(*np.searchsorted(start, [lo, lo + len(data)]))
            if here.start < here.stop:
                a, b = start[here] - lo, end[here] - lo
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(BYTE_CODES[data] * powers(BYTE_BASE, len(data)), out=sums[1:])
                    h = (sums[b] - sums[a]) * inverse_powers(BYTE_BASE, len(data))[a]
                    out[here] = mix(h + mix(salt[here] + (b - a).astype(np.uint64)))
        return out

    def limits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the texts that hold these places."""
        row = np.searchsorted(self.offsets, at, side="right") - 1
        return self.offsets[row], self.offsets[row + 1]

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as one number, in byte order."""
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.data[at + k].astype(np.uint64)
        return out


@dataclass(frozen=True)
class Splitters:
    """Even ranks of a bounded sample of leading tokens: distinct tokens, and how many of the splitters lie up to each."""

    tokens: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, buckets: int) -> Splitters:
        tokens, counts = np.unique(sample, return_counts=True)
        # The k-th of buckets - 1 splitters is the sample's entry at rank k * n // buckets.
        upto = np.minimum(-(-np.cumsum(counts) * buckets // max(1, len(sample))) - 1, buckets - 1)
        return cls(tokens, np.concatenate(([0], upto)).astype(np.int64))

    def ranges(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splitters below each token, and up to it."""
        return self.upto[np.searchsorted(self.tokens, lead, side="left")], self.upto[np.searchsorted(self.tokens, lead, side="right")]


def packets(batch: int, buckets: list[tuple[int, slice]], raw) -> pa.Table:
    rows = [(b, batch, *raw(s)) for b, s in buckets]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKETS)], schema=PACKETS)


def spread(table: pa.Table, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packets of a bucket side by side: batch, a, b, flag."""
    sizes = [len(x.as_py()) // width for x in table.column("a")]
    batch = np.repeat(np.array(table.column("batch").to_pylist(), np.int32), sizes)
    return batch, unpack(joined(table, "a"), width), np.frombuffer(joined(table, "b"), "<u8"), np.frombuffer(joined(table, "flag"), np.uint8)


def answer(kind: int, batch: np.ndarray, keys: np.ndarray, flags: np.ndarray, width: int = 8) -> pa.Table:
    schema = pa.schema([("batch", pa.int32()), ("a", pa.binary()), ("flag", pa.binary())])
    out = by_batch(batch, [keys, flags.astype(np.uint64)], [width, 1], schema)
    return pa.Table.from_arrays([out.column(0), pa.array([kind] * out.num_rows, pa.int32()), out.column(1), out.column(2)], schema=ANSWERS)


def answers_of(table: pa.Table, kind: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their flags."""
    mine = table.filter(pc.equal(table.column("kind"), kind)) if table.num_rows else table
    keys = unpack(joined(mine, "a"), width)
    flags = np.frombuffer(joined(mine, "flag"), np.uint8)
    order = np.argsort(keys, kind="stable")
    return keys[order], flags[order]


class Job:
    """The four rounds over a batch; sizes are fixed by the caller."""

    def __init__(self, lay: Layout, length: int, gram: int, splitters: Splitters):
        self.lay, self.length, self.gram, self.splitters = lay, length, gram, splitters

    def send_grams(self, table: pa.Table) -> pa.Table:
        texts = Texts(table)
        _, h = texts.samples(self.length, self.gram)
        h = np.unique(h)
        return packets(texts.batch, cut(h, self.lay.buckets), lambda s: (pack(h[s], self.lay.width), b"", b""))

    def match_grams(self, table: pa.Table) -> pa.Table:
        batch, h, _, _ = spread(table, self.lay.width)
        order, firsts, counts = distinct(h)
        n = np.repeat(counts, counts)
        take = n > 1
        return answer(GRAM, batch[order][take], h[order][take], n[take] > HOT_BATCHES, self.lay.width)

    def neighbourhoods(self, texts: Texts, back: pa.Table) -> tuple[np.ndarray, ...]:
        """Repeated samples: place, gram, begin and end of what their strings can cover, its fingerprint, hot."""
        at, h = texts.samples(self.length, self.gram)
        far, hot = answers_of(back, GRAM, self.lay.width)
        there, where = contains(far, shortened(h, self.lay.width))
        order, firsts, counts = distinct(h)
        here = np.zeros(len(h), bool)
        here[order] = np.repeat(counts > 1, counts)
        take = there | here
        is_hot = (hot[where] > 0) & there if len(hot) else np.zeros(len(h), bool)
        at, h, is_hot = at[take], h[take], is_hot[take]
        low, high = texts.limits(at)
        begin = np.maximum(at - (self.length - self.gram), low)
        end = np.minimum(at + self.length, high)
        return at, h, begin, end, texts.stretches(begin, end, (at - begin).astype(np.uint64)), is_hot

    def send_neighbourhoods(self, table: pa.Table, back: pa.Table) -> pa.Table:
        texts = Texts(table)
        _, h, _, _, c, hot = self.neighbourhoods(texts, back)
        order, firsts, counts = distinct(c)
        pick = order[firsts]
        key = np.where(hot[pick], c[pick], h[pick])
        flag = (counts > 1).astype(np.uint8) | (hot[pick].astype(np.uint8) << 1)
        by = np.argsort(key, kind="stable")
        hs, cs, fs = h[pick][by], c[pick][by], flag[by]
        return packets(texts.batch, cut(key[by], self.lay.buckets), lambda s: (hs[s].astype("<u8").tobytes(), cs[s].astype("<u8").tobytes(), fs[s].tobytes()))

    def match_neighbourhoods(self, table: pa.Table) -> pa.Table:
        batch, h, c, flag = spread(table)
        order, firsts, counts = distinct(h, c)
        batch, h, c, flag = batch[order], h[order], c[order], flag[order]
        several = (counts > 1) | ((flag[firsts] & 1) > 0)
        gram_h = h[firsts]
        groups = np.flatnonzero(np.concatenate(([True], gram_h[1:] != gram_h[:-1])))
        sizes = np.diff(np.append(groups, len(gram_h)))
        open_group = np.repeat(np.minimum.reduceat(several.astype(np.int8), groups) == 0, sizes) | ((flag[firsts] & 2) > 0)
        status = np.repeat(several.astype(np.uint8) * REPEATED, counts)
        status[firsts] |= open_group.astype(np.uint8) * OPEN
        take = status > 0
        return answer(NEIGHBOURHOOD, batch[take], c[take], status[take])

    def open_suffixes(self, texts: Texts, back: pa.Table) -> tuple[np.ndarray, ...]:
        """Suffix starts in open neighbourhoods with their two keys; begin and end of repeated neighbourhoods."""
        at, _, begin, end, c, _ = self.neighbourhoods(texts, back)
        keys, flags = answers_of(back, NEIGHBOURHOOD)
        there, where = contains(keys, c)
        status = np.where(there, flags[where], 0).astype(np.uint8) if len(flags) else np.zeros(len(c), np.uint8)
        repeated = ((status & REPEATED) > 0) & (end - begin >= self.length)
        opened = (status & OPEN) > 0
        order, firsts, _ = distinct(c)
        one = np.zeros(len(c), bool)
        one[order[firsts]] = True
        opened &= one
        first, last = begin[opened], np.minimum(at[opened], end[opened] - self.length)
        marks = np.zeros(len(texts.data) + 1, np.int32)
        good = last >= first
        np.add.at(marks, first[good], 1)
        np.add.at(marks, last[good] + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0) if len(texts.data) else np.zeros(0, np.int64)
        lead = texts.leads(starts)
        return starts, lead, texts.stretches(starts, starts + self.length), begin[repeated], end[repeated]

    def bucket_of(self, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
        low, high = self.splitters.ranges(lead)
        with np.errstate(over="ignore"):
            return low + (((tail >> np.uint64(40)) * (high - low + 1).astype(np.uint64)) >> np.uint64(24)).astype(np.int64)

    def send_suffixes(self, table: pa.Table, back: pa.Table) -> pa.Table:
        texts = Texts(table)
        _, lead, tail, _, _ = self.open_suffixes(texts, back)
        order, firsts, counts = distinct(lead, tail)
        pick = order[firsts]
        lead, tail, many = lead[pick], tail[pick], (counts > 1).astype(np.uint8)
        bucket = self.bucket_of(lead, tail)
        by = np.argsort(bucket, kind="stable")
        lead, tail, many = lead[by], tail[by], many[by]
        return packets(texts.batch, occupied(bucket[by]), lambda s: (lead[s].astype("<u8").tobytes(), tail[s].astype("<u8").tobytes(), many[s].tobytes()))

    def sort_suffixes(self, table: pa.Table) -> pa.Table:
        """Suffixes of a bucket in order; equal neighbours from different batches are repeats."""
        batch, lead, tail, _ = spread(table)
        order, firsts, counts = distinct(lead, tail)
        take = np.repeat(counts > 1, counts)
        return answer(STRING, batch[order][take], tail[order][take], np.ones(int(take.sum()), np.uint8))

    def remove(self, table: pa.Table, back: pa.Table, schema: pa.Schema) -> pa.Table:
        texts = Texts(table)
        starts, lead, tail, begin, end = self.open_suffixes(texts, back)
        far, _ = answers_of(back, STRING)
        repeated, _ = contains(far, tail)
        order, firsts, counts = distinct(lead, tail)
        here = np.zeros(len(starts), bool)
        here[order] = np.repeat(counts > 1, counts)
        hit = starts[repeated | here]
        n = len(texts.data)
        steps = np.zeros(n + 1, np.int32)
        for low, high in ((begin, end), (hit, hit + self.length)):
            np.add.at(steps, low, 1)
            np.add.at(steps, high, -1)
        gone = np.cumsum(steps)[:n] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = texts.offsets[:-1][texts.offsets[:-1] < n]
        opens[edge] = gone[edge]
        total = np.concatenate(([0], np.cumsum(gone)))
        spans = np.concatenate(([0], np.cumsum(opens)))
        a, b = texts.offsets[:-1], texts.offsets[1:]
        kept = [texts.data[x:y][~gone[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
        nulls = table.column("text").is_null().to_pylist()
        extra = {
            "n_bytes": pa.array(b - a, pa.int64()),
            "n_removed": pa.array(total[b] - total[a], pa.int64()),
            "n_spans": pa.array(spans[b] - spans[a], pa.int64()),
            "kept": pa.array([None if none else k for k, none in zip(kept, nulls, strict=True)], pa.binary()),
        }
        return pa.Table.from_arrays([(extra[f.name] if f.name in extra else table.column(f.name)).cast(f.type) for f in schema], schema=schema)


def sampled_splitters(docs: DataFrame, buckets: int, n_docs: int) -> Splitters:
    """Splitters for so many buckets, from a bounded sample of places: the task's closure does not grow with the input."""
    every = max(1, n_docs // (SPLITTER_SAMPLE // 8))
    rows = docs.select("text", F.xxhash64("text").alias("h")).where((F.octet_length("text") >= 200) & (F.pmod("h", F.lit(every)) == 0))
    place = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.length("text") - 7, F.lit(1))).cast("int")))
    places = rows.select("text", place.alias("at")).select(F.encode(F.substring("text", F.col("at") + 1, F.lit(8)), "UTF-8").alias("lead"))
    found = [int.from_bytes(bytes(r[0][:8]).ljust(8, b"\0"), "big") for r in places.limit(2 * SPLITTER_SAMPLE).collect()]
    return Splitters.of(np.array(found, dtype=np.uint64), buckets)


def remove_repeated_strings(docs: DataFrame, length: int = 200, gram: int = 160) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes that are left)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs, names = shielded(docs.drop(*RESULT), "doc_id", "text")
    lay = layout(docs, 20.0)
    splitters = sampled_splitters(docs, lay.buckets, docs.count())
    job = Job(lay, length, gram, splitters)
    rows = in_batches(docs, lay.batches)
    out = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in RESULT[:3]], T.StructField("kept", T.BinaryType())])
    arrow_out = to_arrow_schema(out)
    sent, back = ddl(PACKETS), ddl(ANSWERS)

    def round_of(send, answers: DataFrame, schema) -> DataFrame:
        return rows.groupBy("__batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: send(a, b), schema)

    def met(packets_sent: DataFrame, match) -> DataFrame:
        return packets_sent.groupBy("bucket").applyInArrow(lambda t: match(t), back)

    grams = met(rows.groupBy("__batch").applyInArrow(lambda t: job.send_grams(t), sent), job.match_grams)
    near = met(round_of(job.send_neighbourhoods, grams, sent), job.match_neighbourhoods)
    known = grams.unionByName(near)
    strings = met(round_of(job.send_suffixes, known, sent), job.sort_suffixes)
    return restored(round_of(lambda a, b: job.remove(a, b, arrow_out), known.unionByName(strings), out), names, *RESULT)
