"""Token counts by byte-pair merging, without making the tokens.

Cases: a null or empty text has no bytes and no tokens; a text of one endless
word is merged like any other, in n log n; rows and columns beside doc_id and
text don't matter; a vocabulary whose rules for splitting or normalizing texts
are not those known here is refused.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import bounded_batches

#: Pieces a worker remembers before it starts afresh.
CACHE_PIECES = 800_000
#: White space as the vocabulary's own pattern has it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What a vocabulary file must ask for, for the counts below to be the library's.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZERS = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairMerger(dict):
    """piece -> number of tokens; a missing piece is merged and remembered."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        asked = [(spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers"), model.get("type"), model.get("byte_fallback"), model.get("ignore_merges")]
        if asked != [NORMALIZERS, PRE_TOKENIZERS, "BPE", False, False]:
            raise ValueError(f"{path} splits or normalizes texts in a way that is not known here")
        self.end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        vocab = model["vocab"]
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PIECE).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = self.merged(piece.encode("utf-8"))
        return n

    def merged(self, raw: bytes) -> int:
        """Initial symbols minus merges.

        The heap yields the lowest rank, leftmost first; the linked list of
        symbols tells whether a popped pair still stands.
        """
        n = len(raw)
        if n == 1:
            return 1
        pairs = self.pairs
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if hit := pairs.get((symbol[i], symbol[i + 1])):
                heap.append((hit[0], i, symbol[i], symbol[i + 1], hit[1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, made = heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if hit := pairs.get((made, symbol[k])):
                    heappush(heap, (hit[0], i, made, symbol[k], hit[1]))
            h = left[i]
            if h >= 0 and (hit := pairs.get((symbol[h], made))):
                heappush(heap, (hit[0], h, symbol[h], made, hit[1]))
        return n - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        parts = [text]
        if self.split_special:
            parts = self.split_special.split(text)
            total = len(parts) - 1
        for part in parts:
            # One letter at a time: no final sigma.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            total += sum(map(self.__getitem__, self.find(plain)))
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """One per worker process."""
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.  No shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary)
        for b in batches:
            counts = [own.count(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
