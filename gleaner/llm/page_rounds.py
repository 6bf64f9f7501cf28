"""Repeats and boilerplate slots of a host whose pages are dealt to shards.

What counts is the host, not the shard: the same words are covered, and the same
slots go, however many shards a host has.  All rounds send packets by Spark's shuffle:
  1. shards of one host send their distinct runs as short fingerprints; those that
     another shard holds, too, go back.  A host of one shard sends none
  2. the runs left send their 64-bit fingerprint; a run that one page of a shard and
     another shard hold goes back to the shard: shards share no page, so it repeats
  3. each shard sorts its suffixes and marks the covered words; its distinct pairs of
     slot and text meet those of the other shards, so that each counts once in the host
  4. Spark sums up slots and hosts, and each shard learns which of its slots go

A pair of slot and text counts with the most of its words that are covered anywhere.
Runs and pairs are told apart by 64 bits: among n of a host, some two unlike ones are
taken for equal with a chance below n**2 / 2**65.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.grams import mix, rolling, text_bytes, word_codes, word_spans
from gleaner.llm.packets import contains, cut, occupied

DROPPED_MARK, MAIN, PLAIN = 0, 1, 2
#: Kinds of rows.
PAIRS, SLOT, COVERED, SUMS = 1, 2, 3, 4
SENT = pa.schema([("host", pa.string()), ("at", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
MET = pa.schema([("host", pa.string()), ("at", pa.int32()), ("kind", pa.int32()), ("slot", pa.int64()), *[(n, pa.int64()) for n in ("pages", "tokens", "hidden", "main")], ("a", pa.binary())])
SQL_TYPES = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
PAGE_CODEC = "zstd"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def made_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack_page(texts: list[str], marks: bytes, slots: bytes) -> tuple[bytes, int]:
    """The blocks of a page as compressed bytes, and their size before."""
    raw = struct.pack("<I", len(texts)) + marks + slots + "\n".join(texts).encode()
    return pa.compress(raw, PAGE_CODEC, asbytes=True), len(raw)


def pack_numbers(v: np.ndarray) -> bytes:
    """Whole numbers with their highest bytes first, then the next: in sorted or small ones those compress."""
    width = v.dtype.itemsize
    raw = np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T[::-1]).tobytes()
    return struct.pack("<BI", width, len(v)) + (pa.compress(raw, PAGE_CODEC, asbytes=True) if raw else b"")


def unpack_numbers(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", raw)
    if not n:
        return np.zeros(0, f"<u{width}")
    planes = np.frombuffer(pa.decompress(raw[5:], width * n, PAGE_CODEC, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes[::-1].T).view(f"<u{width}").ravel()


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending whole numbers: the first, then gaps in units of two or four bytes; a unit with all bits set is added to the next."""
    if not len(v):
        return b""
    gap = np.diff(v)
    width = 4 if int(v[-1] - v[0]) > len(gap) << 15 else 2
    top = (1 << 8 * width) - 1
    more = (gap // np.uint64(top)).astype(np.int64)
    out = np.full(len(gap) + int(more.sum()), top, f"<u{width}")
    out[np.cumsum(more + 1) - 1] = gap % np.uint64(top)
    return struct.pack("<Q", int(v[0])) + pack_numbers(out)


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    (first,) = struct.unpack_from("<Q", raw)
    units = unpack_numbers(raw[8:])
    ends = np.cumsum(units, dtype=np.uint64)[units != (1 << 8 * units.dtype.itemsize) - 1]
    return np.concatenate(([np.uint64(first)], ends + np.uint64(first)))


def of_shards(values: np.ndarray, shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The values of each shard, in their order."""
    order = np.argsort(shard, kind="stable")
    return [(s, values[order[span]]) for s, span in occupied(shard[order])]


def groups_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each distinct value."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return firsts, np.diff(np.append(firsts, len(sorted_values)))


def spread(t: pa.Table, name: str, read) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packets, and the shard of each."""
    parts = [read(x.as_py()) for x in t.column(name)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.repeat(np.asarray(t.column("shard")), [len(p) for p in parts])


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` tokens, rank of each): by prefix doubling.

    Equal ranks are common prefixes of at least `depth` tokens.
    """
    _, rank = np.unique(codes, return_inverse=True)
    n, step = len(rank), 1
    while n and step < depth:
        more = min(step, depth - step)
        second = np.zeros(n, np.int64)
        second[: max(0, n - more)] = rank[more:] + 1
        _, rank = np.unique(rank * np.int64(n + 1) + second, return_inverse=True)
        step += more
    return np.argsort(rank, kind="stable"), rank


class Stream:
    """Tokens of some pages of one host, laid end to end with a unique code after each page."""

    def __init__(self, pages: np.ndarray, blocks: list[list[str]]):
        texts = [t for own in blocks for t in own]
        self.page_of_block = np.repeat(pages, [len(own) for own in blocks]) if len(pages) else pages
        self.data, self.offsets = text_bytes(pa.array(texts, pa.string()))
        starts, ends, first = word_spans(self.data, self.offsets)
        self.counts = np.diff(first)
        codes = word_codes(self.data, starts, ends)
        row = np.repeat(np.arange(len(blocks)), [len(own) for own in blocks])
        row = np.repeat(row, self.counts)
        self.at = np.arange(len(codes)) + row  # one separator for each page before
        self.codes = np.arange(len(codes) + len(blocks), dtype=np.uint64)
        self.codes[self.at] = codes
        self.page = np.zeros(len(self.codes), np.int64)
        self.page[self.at] = np.asarray(pages, np.int64)[row]
        self.row = np.full(len(self.codes), -1, np.int64)
        self.row[self.at] = row

    def covered(self, n: int, far: np.ndarray) -> np.ndarray:
        """Words under a run of n tokens that a distinct page also holds, here or (far) in another shard."""
        order, rank = suffix_order(self.codes, n)
        if not len(order):
            return np.zeros(0, bool)
        ranks, page = rank[order], self.page[order]
        firsts, sizes = groups_of(ranks)
        several = np.minimum.reduceat(page, firsts) != np.maximum.reduceat(page, firsts)
        starts = order[np.repeat(several & (sizes > 1), sizes)]
        if len(far):
            at, h = self.leads(n)
            starts = np.concatenate([starts, at[np.isin(h, far)]])
        hit = np.zeros(len(self.codes) + n, np.int64)
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + n, -1)
        return np.cumsum(hit)[self.at] > 0

    def leads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with n tokens of one page ahead, and those tokens' fingerprint."""
        h = rolling(self.codes, n)
        row = self.row
        at = np.flatnonzero((row[: len(h)] >= 0) & (row[: len(h)] == row[n - 1 : n - 1 + len(h)]))
        return at, h[at]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs in the order of their fingerprints, and whether distinct pages here hold them."""
        at, h = self.leads(n)
        order = np.argsort(h, kind="stable")
        h, page = h[order], self.page[at[order]]
        firsts, _ = groups_of(h)
        if not len(firsts):
            return h, np.zeros(0, bool)
        return h[firsts], np.minimum.reduceat(page, firsts) != np.maximum.reduceat(page, firsts)

    def texts_of_slots(self, slots: np.ndarray) -> np.ndarray:
        """A fingerprint of each block's slot and text."""
        return mix(word_codes(self.data, self.offsets[:-1], self.offsets[1:]) ^ mix(slots.view(np.uint64)))


class Shard:
    """The blocks of a shard's pages, in the order of the pages' keys, so that every round sees them alike."""

    def __init__(self, t: pa.Table, page: str, packed: str, size: str):
        pages = np.asarray(t.column(page))
        self.order = np.argsort(pages, kind="stable")
        self.pages = pages[self.order]
        packets, sizes = t.column(packed).to_pylist(), t.column(size).to_pylist()
        self.blocks: list[list[str]] = []
        marks, slots = [], []
        for i in self.order.tolist():
            raw = pa.decompress(packets[i], sizes[i], PAGE_CODEC, asbytes=True)
            (n,) = struct.unpack_from("<I", raw)
            marks.append(raw[4 : 4 + n])
            slots.append(raw[4 + n : 4 + 9 * n])
            self.blocks.append(raw[4 + 9 * n :].decode().split("\n") if n else [])
        self.marks = np.frombuffer(b"".join(marks), np.uint8)
        self.slots = np.frombuffer(b"".join(slots), np.int64)

    def stream(self) -> Stream:
        return Stream(self.pages, self.blocks)

    def counts(self) -> np.ndarray:
        """Words of each block."""
        return np.diff(word_spans(*text_bytes(pa.array([x for own in self.blocks for x in own], pa.string())))[2])


class Rounds:
    """What shards and meeting points do in each round."""

    def __init__(self, run: int, shard_bytes: int, page: str, packed: str, size: str, shards: str):
        self.run, self.shard_bytes = run, shard_bytes
        self.page, self.packed, self.size, self.shards = page, packed, size, shards

    def read(self, t: pa.Table) -> Shard:
        return Shard(t, self.page, self.packed, self.size)

    def layout(self, t: pa.Table) -> tuple[int, int, int]:
        """Shards of the host, meeting points, bits of a short fingerprint: a chance match for some one in 64 runs."""
        shards = t.column(self.shards)[0].as_py()
        return shards, max(1, shards // 2), min(48, max(8, (shards * self.shard_bytes // 8).bit_length() + 6))

    def send_short(self, key: tuple, t: pa.Table) -> pa.Table:
        shards, points, bits = self.layout(t)
        if shards == 1:
            return SENT.empty_table()
        h, _ = self.read(t).stream().runs(self.run)
        short = h >> np.uint64(64 - bits)
        short = short[groups_of(short)[0]]
        point = (short * np.uint64(points)) >> np.uint64(bits)
        return made_of([(key[0].as_py(), p, key[1].as_py(), 0, pack_sorted(short[s]), None) for p, s in occupied(point)], SENT)

    def meet_short(self, key: tuple, t: pa.Table) -> pa.Table:
        v, shard = spread(t, "a", unpack_sorted)
        order = np.argsort(v, kind="stable")
        _, sizes = groups_of(v[order])
        take = order[np.repeat(sizes > 1, sizes)]
        return made_of([(key[0].as_py(), s, s, 0, pack_sorted(own), None) for s, own in of_shards(v[take], shard[take])], SENT)

    def send_exact(self, key: tuple, t: pa.Table, back: pa.Table) -> pa.Table:
        if not back.num_rows:
            return SENT.empty_table()
        _, points, bits = self.layout(t)
        h, several = self.read(t).stream().runs(self.run)
        there, _ = contains(np.sort(spread(back, "a", unpack_sorted)[0]), h >> np.uint64(64 - bits))
        h, several = h[there], several[there]
        return made_of([(key[0].as_py(), p, key[1].as_py(), 0, pack_numbers(h[s][~several[s]]), pack_numbers(h[s][several[s]])) for p, s in cut(h, points)], SENT)

    def meet_exact(self, key: tuple, t: pa.Table) -> pa.Table:
        """Runs that one page of a shard holds, and another shard."""
        (asked, of), (held, by) = spread(t, "a", unpack_numbers), spread(t, "b", unpack_numbers)
        v, shard = np.concatenate([asked, held]), np.concatenate([of, by])
        order = np.argsort(v, kind="stable")
        _, sizes = groups_of(v[order])
        take = order[np.repeat(sizes > 1, sizes) & (order < len(asked))]
        return made_of([(key[0].as_py(), s, s, 0, pack_numbers(np.sort(own)), None) for s, own in of_shards(v[take], shard[take])], SENT)

    def send_pairs(self, key: tuple, t: pa.Table, back: pa.Table) -> pa.Table:
        """Covered words, pages of each slot, and distinct pairs of slot and text with their words, covered words and words in articles."""
        _, points, _ = self.layout(t)
        own = self.read(t)
        stream = own.stream()
        covered = stream.covered(self.run, np.sort(spread(back, "a", unpack_numbers)[0]))
        edges = np.concatenate(([0], np.cumsum(stream.counts)))
        hidden = np.diff(np.concatenate(([0], np.cumsum(covered)))[edges])
        host, shard = key[0].as_py(), key[1].as_py()
        rows = [(host, shard, shard, COVERED, np.packbits(covered).tobytes(), None)]
        if len(own.slots):
            slots, pages = np.unique(np.unique(np.stack([own.slots, stream.page_of_block]), axis=1)[0], return_counts=True)
            rows.append((host, shard, shard, SLOT, slots.tobytes(), pages.tobytes()))
            pair = stream.texts_of_slots(own.slots)
            order = np.argsort(pair, kind="stable")
            firsts, _ = groups_of(pair[order])
            pick = order[firsts]
            facts = [stream.counts[pick], np.maximum.reduceat(hidden[order], firsts), np.maximum.reduceat((stream.counts * (own.marks == MAIN))[order], firsts)]
            for p, s in cut(pair[pick], points):
                mine = own.slots[pick[s]]
                by = np.argsort(mine, kind="stable")
                rows.append((host, p, shard, PAIRS, pair[pick[s]][by].tobytes(), mine[by].tobytes() + b"".join(f[s][by].astype("<u4").tobytes() for f in facts)))
        return made_of(rows, SENT)

    def meet_pairs(self, key: tuple, t: pa.Table) -> pa.Table:
        """Sums of each slot over distinct pairs; what goes back to shards passes through."""
        host, at = key[0].as_py(), key[1].as_py()
        rows, pair, slot, facts = [], [], [], []
        for kind, a, b in zip(t.column("kind").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            if kind == COVERED:
                rows.append((host, at, COVERED, None, None, None, None, None, a))
            elif kind == SLOT:
                rows += [(host, at, SLOT, s, n, None, None, None, None) for s, n in zip(np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist(), strict=True)]
            else:
                n = len(a) // 8
                pair.append(np.frombuffer(a, "<u8"))
                slot.append(np.frombuffer(b, "<i8", n))
                facts.append(np.frombuffer(b, "<u4", offset=8 * n).reshape(3, n).astype(np.int64))
        if pair:
            pairs, slots, numbers = np.concatenate(pair), np.concatenate(slot), np.concatenate(facts, axis=1)
            order = np.argsort(pairs, kind="stable")
            firsts, _ = groups_of(pairs[order])
            most = np.maximum.reduceat(numbers[:, order], firsts, axis=1)
            names, place = np.unique(slots[order[firsts]], return_inverse=True)
            sums = np.zeros((3, len(names)), np.int64)
            for k in range(3):
                np.add.at(sums[k], place, most[k])
            rows += [(host, at, SUMS, s, 0, *own, None) for s, own in zip(names.tolist(), sums.T.tolist(), strict=True)]
        return made_of(rows, MET)


def boilerplate_slots(met: DataFrame, slot: float, main_slot: float, slot_pages: int) -> DataFrame:
    """(host, slot) of the slots that go, judged by sums over each host."""
    sums = met.where(F.col("kind").isin(SUMS, SLOT)).groupBy("host", "slot").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("pages", "tokens", "hidden", "main")])
    own = F.col("main") * 2 > F.col("tokens")
    articles = sums.where(own).groupBy("host").agg(F.sum("tokens").alias("all_tokens"), F.sum("hidden").alias("all_hidden"))
    share = F.col("hidden") / F.greatest(F.col("tokens"), F.lit(1))
    rest = F.col("all_tokens") - F.col("tokens")
    others_unique = (rest > F.col("tokens")) & (F.col("all_hidden") - F.col("hidden") < F.lit(slot) * rest)
    goes = F.when(own, (share >= main_slot) & others_unique).otherwise(share >= slot)
    return sums.join(articles, "host", "left").where((F.col("pages") >= slot_pages) & goes).select("host", "slot")


def answers_of(parsed: DataFrame, host: str, shard: str, rounds: Rounds, judged: tuple[float, float, int]) -> DataFrame:
    """(host, at, kind, slot, a) for each shard: its covered words as bits, and its slots that go."""
    pages = parsed.groupBy(host, shard)
    sent = ddl(SENT)

    def met(packets: DataFrame, meet, schema: str = sent) -> DataFrame:
        return packets.groupBy("host", "at").applyInArrow(lambda k, t: meet(k, t), schema)

    def sent_by(send, back: DataFrame) -> DataFrame:
        return pages.cogroup(back.groupBy("host", "at")).applyInArrow(lambda k, t, b: send(k, t, b), sent)

    short = met(pages.applyInArrow(lambda k, t: rounds.send_short(k, t), sent), rounds.meet_short)
    exact = met(sent_by(rounds.send_exact, short), rounds.meet_exact)
    found = met(sent_by(rounds.send_pairs, exact), rounds.meet_pairs, ddl(MET))
    back = found.where(F.col("kind") == SLOT).join(boilerplate_slots(found, *judged), ["host", "slot"])
    return found.where(F.col("kind") == COVERED).unionByName(back).select("host", "at", "kind", "slot", "a")
