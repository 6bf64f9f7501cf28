"""Dictionary terms in texts: one pass over each text with an automaton of all terms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of terms of an automaton that every task holds; beyond, terms are dealt to parts by their first letters.
BROADCAST_BYTES = 16_000_000
#: Bytes of texts that meet a part of the terms at once.
TEXT_BYTES = 32_000_000
#: Letters of an ASCII term, which must not go on at its ends; least length of a term; most of a query that is rewritten.
TOKEN_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_.+/-"
LEAST_LENGTH, MOST_QUERY = 2, 1000


def normal(text: str | None) -> list[str]:
    """The words of a text after compatibility composition and case folding."""
    return unicodedata.normalize("NFKC", text or "").casefold().split()


def key_of(term: str | None) -> str:
    return "".join(normal(term))


@dataclass(frozen=True)
class Dictionary:
    """Terms by their keys, as an automaton."""

    automaton: ahocorasick.Automaton

    @staticmethod
    def of(terms: list[str]) -> Dictionary:
        by_key: dict[str, set[str]] = {}
        for term in terms:
            by_key.setdefault(key_of(term), set()).add(term)
        automaton = ahocorasick.Automaton()
        for key, same in by_key.items():
            if len(key) >= LEAST_LENGTH:
                automaton.add_word(key, (len(key), all(c in TOKEN_LETTERS for c in key), sorted(same)))
        automaton.make_automaton()
        return Dictionary(automaton)

    def found_in(self, text: str | None) -> set[str]:
        """Terms in a text, whose white space does not count but as the end of a token."""
        if not len(self.automaton) or not text:
            return set()
        words = normal(text)
        close, ends, at = "".join(words), {0}, 0
        for w in words:
            at += len(w)
            ends.add(at)
        out: set[str] = set()
        for last, (size, is_token, terms) in self.automaton.iter(close):
            start, end = last - size + 1, last + 1
            if not is_token or ((start in ends or close[start - 1] not in TOKEN_LETTERS) and (end in ends or close[end] not in TOKEN_LETTERS)):
                out.update(terms)
        return out


def _matches(id_type: pa.DataType, ids: list, texts: list, dictionary: Dictionary) -> pa.RecordBatch:
    rows = [(i, t) for i, text in zip(ids, texts, strict=True) for t in sorted(dictionary.found_in(text))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.string())], ["text_id", "term"])


def term_matches(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, term): the terms that a text (text_id, text) holds, each once, whatever the width, case and white space.

    Terms of letters, digits and ``_.+/-`` alone stand as whole tokens, others
    anywhere; terms under two letters are never found; null texts hold none.
    Terms within BROADCAST_BYTES are sent to every task.  Beyond, they are dealt
    to parts by their first two letters, and texts in slices of a bounded size to
    the parts whose letters they have.
    """
    known = terms.select("term").where("term is not null").distinct()
    size = known.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    kind = texts.schema["text_id"].dataType
    schema, arrow = f"text_id {kind.simpleString()}, term string", to_arrow_type(kind)
    rows = texts.select("text_id", "text")
    if size <= BROADCAST_BYTES:
        listed = rows.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()])  # within BROADCAST_BYTES
        held: dict[str, Dictionary] = {}

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionary = held.setdefault("it", Dictionary.of(listed.value)) if not held else held["it"]
            for b in batches:
                yield _matches(arrow, b.column("text_id").to_pylist(), b.column("text").to_pylist(), dictionary)

        return rows.mapInArrow(search, schema).distinct()

    parts = -(-size // BROADCAST_BYTES)
    slices = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TEXT_BYTES))
    part_of = lambda lead: int.from_bytes(lead.encode(), "big") % parts

    def lead_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text in b.column(b.num_columns - 1).to_pylist():
                close = key_of(text)
                made.append(sorted({part_of(close[i : i + 2]) for i in range(len(close) - 1)}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int64()))], [*b.schema.names, "parts"])

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array([part_of(key_of(t)[:2]) for t in b.column("term").to_pylist()], pa.int64())], ["term", "part"])

    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    left = known.mapInArrow(first_part, "term string, part bigint").withColumn("slice", every)
    right = rows.mapInArrow(lead_parts, f"text_id {kind.simpleString()}, text string, parts array<bigint>")
    right = right.select("text_id", "text", F.explode("parts").alias("part"), F.pmod(F.xxhash64("text_id", "text"), F.lit(slices)).cast("int").alias("slice"))

    def meet(own: pa.Table, found: pa.Table) -> pa.Table:
        dictionary = Dictionary.of(own.column("term").to_pylist())
        return pa.Table.from_batches([_matches(arrow, found.column("text_id").to_pylist(), found.column("text").to_pylist(), dictionary)])

    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(meet, schema).distinct()


def replaced_once(text: str | None, term: str, replacement: str) -> str | None:
    """A text with the first literal occurrence of a term replaced; None where nothing changes."""
    plain = " ".join((text or "").split())
    if not plain or len(plain) > MOST_QUERY or key_of(term) == key_of(replacement):
        return None
    made, n = re.subn(re.escape(" ".join(term.split())), lambda _: " ".join(replacement.split()), plain, count=1, flags=re.IGNORECASE)
    return " ".join(made.split())[:MOST_QUERY] if n else None


def query_variants(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, term, replacement, variant): each matched term (term, replacement) of a text replaced once by its replacement."""
    matched = term_matches(terms, texts).join(terms.select("term", "replacement").distinct(), "term").join(texts.select("text_id", "text"), "text_id")
    schema = matched.select("text_id", "term", "replacement").schema.add("variant", "string")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [replaced_once(*r) for r in zip(*[b.column(c).to_pylist() for c in ("text", "term", "replacement")], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("text_id", "term", "replacement")], pa.array(found, pa.string())], schema.names)

    return matched.mapInArrow(made, schema).where("variant is not null")
