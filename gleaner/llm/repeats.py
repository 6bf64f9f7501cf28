"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window.
A window that also stands elsewhere holds one whole block of that other place,
so rolling probes at every word find it.  Probes that hit extend to the windows
around them; a window's words are compared by a 96-bit fingerprint between
batches and by 64 bits of it within one.  Words themselves are not compared: among
n windows of which at most m share a batch, some two unlike ones are taken for
equal with a chance below n**2 / 2**97 + n * m / 2**65.

Rounds (all by shuffles of packets, see packets.py):
  1. probes and anchors of all batches meet; hits go back to their batches
  2. windows around hits meet; each learns the smallest doc_id that holds it
  3. batches remove the words under windows held by a smaller doc_id

Cases: a null text has no words and stays null; a document with a null doc_id
is neither a source of removals nor cut; rows with one doc_id don't cut each
other; an empty table gives no rows; other columns pass through whatever their
names, and a clash with a result column is resolved in favour of the result.
Texts are read whole; one of over 2 GB exceeds an Arrow string and fails.  doc_id
is a whole number; rows equal in doc_id and text share a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.columns import restored, shielded
from gleaner.llm.grams import SPACE, doc_slices, mix, rolling, text_bytes, word_codes, word_spans
from gleaner.llm.packets import Layout, by_batch, contains, cut, in_batches, joined, layout, pack, pack_ids, shortened, unpack, unpack_ids

RESULT = ("n_words", "n_removed", "kept_text")
SECOND_BASE = 0xA0761D6478BD642F
PROBES = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("plain", pa.binary()), ("anchor", pa.binary())])
HITS = pa.schema([("batch", pa.int32()), ("h", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("h", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary())])
OWNERS = pa.schema([("batch", pa.int32()), ("h", pa.binary()), ("doc", pa.binary())])
SQL_TYPES = {"bucket": "int", "batch": "int"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES.get(f.name, 'binary')}" for f in schema)


class Words:
    """The words of a batch: fingerprints, and the document each stands in."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = text_bytes(table.column("text"))
        ids = table.column("doc_id").cast(pa.int64()).combine_chunks()
        self.null_id = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        starts, ends, first, codes = [], [], [0], []
        for a, b in doc_slices(self.offsets):
            lo = self.offsets[a]
            part = self.data[lo : self.offsets[b]]
            s, e, f = word_spans(part, self.offsets[a : b + 1] - lo)
            codes.append(word_codes(part, s, e))
            first.extend((f[1:] + sum(map(len, starts))).tolist())
            starts.append(s + lo)
            ends.append(e + lo)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.starts, self.ends, self.codes = cat(starts, np.int64), cat(ends, np.int64), cat(codes, np.uint64)
        self.first = np.array(first, np.int64)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def grams(self, n: int, base: int | None = None) -> np.ndarray:
        return rolling(self.codes, n) if base is None else rolling(self.codes, n, base)

    def whole(self, n: int) -> np.ndarray:
        """Which runs of n words lie in one document that has an id."""
        k = max(0, len(self.codes) - n + 1)
        row = self.row[:k]
        return (row == self.row[n - 1 : n - 1 + k]) & ~self.null_id[row]


def block_probes(words: Words, block: int) -> tuple[np.ndarray, ...]:
    """Distinct block fingerprints of the batch, sorted, with: is an anchor, is one and stands in
    several documents here; and every position's fingerprint."""
    h = words.grams(block)
    at = np.flatnonzero(words.whole(block))
    keys = h[at]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, bool)
    firsts = np.flatnonzero(fresh)
    unique = sorted_keys[firsts]
    row = words.row[at]
    ids = words.ids[row]
    anchored = (at - words.first[row]) % block == 0
    if not len(keys):
        none = np.zeros(0, bool)
        return unique, none, none, h, at
    is_anchor = np.maximum.reduceat(anchored[order].astype(np.int8), firsts) > 0
    several = np.minimum.reduceat(ids[order], firsts) != np.maximum.reduceat(ids[order], firsts)
    return unique, is_anchor, several & is_anchor, h, at


def send_probes(table: pa.Table, block: int, lay: Layout) -> pa.Table:
    unique, is_anchor, _, _, _ = block_probes(Words(table), block)
    batch = table.column("__batch")[0].as_py()
    rows = []
    for b, span in cut(unique, lay.buckets):
        a = is_anchor[span]
        rows.append((b, batch, pack(unique[span][~a], lay.width), pack(unique[span][a], lay.width)))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PROBES)], schema=PROBES)


def match_probes(table: pa.Table, lay: Layout) -> pa.Table:
    """Fingerprints that are an anchor somewhere and stand in several batches."""
    keys, batches, anchors = [], [], []
    for b, plain, anchor in zip(table.column("batch").to_pylist(), table.column("plain"), table.column("anchor"), strict=True):
        for raw, flag in ((plain, False), (anchor, True)):
            k = unpack(raw.as_py(), lay.width)
            keys.append(k)
            batches.append(np.full(len(k), b, np.int32))
            anchors.append(np.full(len(k), flag))
    key, batch, anchor = np.concatenate(keys), np.concatenate(batches), np.concatenate(anchors)
    order = np.argsort(key, kind="stable")
    key, batch, anchor = key[order], batch[order], anchor[order]
    firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(firsts, len(key)))
    good = (sizes > 1) & (np.maximum.reduceat(anchor.astype(np.int8), firsts) > 0)
    take = np.repeat(good, sizes)
    return by_batch(batch[take], [key[take]], [lay.width], HITS)


def candidate_windows(table: pa.Table, hits: pa.Table, block: int, window: int, lay: Layout) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, window starts, their two fingerprints) of windows that hold a hit."""
    words = Words(table)
    unique, _, several, h, at = block_probes(words, block)
    wanted = np.sort(unpack(joined(hits, "h"), lay.width)) if hits.num_rows else np.zeros(0, np.uint64)
    far, _ = contains(wanted, shortened(unique, lay.width))
    hot = unique[far | several]
    marks = np.zeros(len(h) + 1, np.int64)
    inside, _ = contains(hot, h[at])
    marks[1:][at[inside]] = 1
    np.cumsum(marks, out=marks)
    whole = np.flatnonzero(words.whole(window))
    reach = window - block + 1
    starts = whole[marks[whole + reach] > marks[whole]] if len(whole) else whole
    if not len(starts):
        return words, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return words, starts, words.grams(window)[starts], words.grams(window, SECOND_BASE)[starts]


def smallest_owner(words: Words, starts: np.ndarray, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window fingerprints of the batch in order, with the smallest doc_id here."""
    key = mix(h ^ (h2 >> np.uint64(32)))
    ids = words.ids[words.row[starts]]
    order = np.argsort(key, kind="stable")
    key = key[order]
    firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    owner = np.minimum.reduceat(ids[order], firsts) if len(key) else ids
    return key[firsts], (h2[order][firsts] >> np.uint64(32)).astype(np.uint64), owner


def send_windows(table: pa.Table, hits: pa.Table, block: int, window: int, lay: Layout) -> pa.Table:
    words, starts, h, h2 = candidate_windows(table, hits, block, window, lay)
    key, second, owner = smallest_owner(words, starts, h, h2)
    batch = table.column("__batch")[0].as_py() if table.num_rows else 0
    rows = [(b, batch, key[s].astype("<u8").tobytes(), second[s].astype("<u4").tobytes(), pack_ids(owner[s])) for b, s in cut(key, lay.buckets)]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(WINDOWS)], schema=WINDOWS)


def match_windows(table: pa.Table) -> pa.Table:
    """For each batch, its windows that a smaller doc_id of another batch holds, with that doc_id."""
    sizes = [len(x.as_py()) // 8 for x in table.column("h")]
    key = np.frombuffer(joined(table, "h"), "<u8")
    second = np.frombuffer(joined(table, "h2"), "<u4")
    doc = np.concatenate([unpack_ids(x.as_py()) for x in table.column("doc")])
    batch = np.repeat(np.array(table.column("batch").to_pylist(), np.int32), sizes)
    order = np.lexsort((doc, second, key))
    key, second, doc, batch = key[order], second[order], doc[order], batch[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])))
    firsts = np.flatnonzero(fresh)
    least = doc[np.repeat(firsts, np.diff(np.append(firsts, len(key))))]
    take = doc > least
    return by_batch(batch[take], [key[take], least[take]], [8, 8], OWNERS)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a run of `length` from one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps)[:n] > 0


def joined_words(words: Words, removed: np.ndarray) -> list[str]:
    """Each document's kept words, joined by one space."""
    kept = ~removed
    data = np.where(SPACE[words.data], np.uint8(0x20), words.data)
    steps = np.zeros(len(data) + 1, np.int8)
    steps[words.starts[kept]] += 1
    ends = words.ends[kept]
    # With the white space after it, unless the word is a text's last.
    steps[ends + (ends < words.offsets[1:][words.row[kept]])] -= 1
    mask = np.cumsum(steps[:-1], dtype=np.int8) > 0
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        out.append(data[a:b][mask[a:b]].tobytes().strip(b" ").decode("utf-8"))
    return out


def cut_repeats(table: pa.Table, owners: pa.Table, hits: pa.Table, block: int, window: int, lay: Layout, schema: pa.Schema) -> pa.Table:
    words, starts, h, h2 = candidate_windows(table, hits, block, window, lay)
    removed = np.zeros(len(words.codes), bool)
    if len(starts):
        key, _, owner = smallest_owner(words, starts, h, h2)
        if owners.num_rows:
            far = np.frombuffer(joined(owners, "h"), "<u8")
            far_doc = np.frombuffer(joined(owners, "doc"), "<i8")
            order = np.lexsort((far_doc, far))
            far, far_doc = far[order], far_doc[order]
            there, where = contains(far, key)
            owner = np.where(there, np.minimum(owner, far_doc[where] if len(far) else owner), owner)
        mine = mix(h ^ (h2 >> np.uint64(32)))
        at = np.searchsorted(key, mine)
        cuts = starts[owner[at] < words.ids[words.row[starts]]]
        removed = covered(len(words.codes), cuts, window)
    n_words = np.diff(words.first)
    n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), np.minimum(words.first[:-1], len(removed))) if len(n_words) else n_words
    n_removed = np.where(n_words > 0, n_removed, 0)
    kept = joined_words(words, removed)
    nulls = np.asarray(table.column("text").combine_chunks().is_null())
    texts = [None if gone else t for t, gone in zip(kept, nulls, strict=True)]
    extra = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string())}
    cols = [extra[f.name] if f.name in extra else table.column(f.name) for f in schema]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with n_words, n_removed and kept_text: each word under a window of
    `window` words that also starts in a document with a smaller doc_id is cut."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs, names = shielded(docs.drop(*RESULT), "doc_id", "text")
    block = (window + 1) // 2
    lay = layout(docs, 6.0 * block)
    batched = in_batches(docs, lay.batches)
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    arrow_out = to_arrow_schema(out)
    probes = batched.groupBy("__batch").applyInArrow(lambda t: send_probes(t, block, lay), ddl(PROBES))
    hits = probes.groupBy("bucket").applyInArrow(lambda t: match_probes(t, lay), ddl(HITS))
    windows = (
        batched.groupBy("__batch").cogroup(hits.groupBy("batch")).applyInArrow(lambda a, b: send_windows(a, b, block, window, lay), ddl(WINDOWS))
    )
    owners = windows.groupBy("bucket").applyInArrow(match_windows, ddl(OWNERS))
    answers = hits.selectExpr("batch", "h", "cast(null as binary) as doc").unionByName(owners)

    def last(a: pa.Table, b: pa.Table) -> pa.Table:
        is_hit = b.column("doc").is_null()
        return cut_repeats(a, b.filter(_not(is_hit)), b.filter(is_hit), block, window, lay, arrow_out)

    return restored(batched.groupBy("__batch").cogroup(answers.groupBy("batch")).applyInArrow(last, out), names, *RESULT)


def _not(mask: pa.ChunkedArray) -> pa.ChunkedArray:
    import pyarrow.compute as pc

    return pc.invert(mask)
