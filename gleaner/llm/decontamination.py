"""Benchmark decontamination on a distributed positional inverted index.

  1. every word of every training text becomes a posting (term, doc, pos), term
     and doc as 64-bit fingerprints.  The index is written in segments, one for
     each part of the input, with columns coded by dictionary and run length; a
     common term's list is thus spread over all segments
  2. the terms of each test window are ordered from the rarest by their counts
     in the index.  The rarest term's list and the second's, moved by the
     difference of their offsets, are intersected; what is left is intersected
     with the lists of all other terms at once
  3. an occurrence is a document and a place at which every term of the window
     has a posting at its own offset (exact phrase), or each has one within some
     words of the rarest (proximity)
  4. the words of exact phrases are compared with the text of the few documents
     that hold any, so that equal fingerprints of unlike words or texts count
     for nothing

Only DataFrame functions are used.

Cases: null texts have no words and stay in the result with zero counts; an
empty benchmark hits nothing; repeated rows are judged alike; a null item_id
still marks words as hit but is no item; very long texts and words are taken
whole; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.columns import ALNUM_WORD, lower_ascii, word_count
from gleaner.session import discard, stored

#: A table of at most this many bytes may be broadcast, at so many a row.
BROADCAST_BYTES = 8_000_000
ROW_BYTES = 120
#: Beyond it, postings meet the table in so many parts of each term.
SALTS = 32


@dataclass(frozen=True)
class Windows:
    """Test windows (window_id, words), and the items that each stands in (window_id, item_id)."""

    phrases: DataFrame
    owners: DataFrame
    stored_at: DataFrame


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ALNUM_WORD), F.lit(0))


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def term_of(word: Column) -> Column:
    return F.xxhash64(lower_ascii(word))


def bounded(df: DataFrame) -> bool:
    """Whether df, of a few numbers and digests a row, may be broadcast."""
    return df.count() * ROW_BYTES <= BROADCAST_BYTES


def with_term(postings: DataFrame, table: DataFrame) -> DataFrame:
    """postings joined with a table by term: broadcast behind a check of its size, else a salted shuffle."""
    if bounded(table):
        return postings.join(F.broadcast(table), "term")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod("pos", F.lit(SALTS))).join(salted, ["term", "salt"]).drop("salt")


def test_windows(items: DataFrame, n: int) -> Windows:
    """Every n consecutive words of an item; a shorter item is one window."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(tokens(F.col("text")), lower_ascii).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), n).alias("words"))
    each = stored(each.withColumn("window_id", F.sha2(F.array_join("words", " "), 256)), "windows")
    return Windows(each.select("window_id", "words").dropDuplicates(["window_id"]), each.select("window_id", "item_id").distinct(), each)


def build_postings(docs: DataFrame) -> DataFrame:
    """The index: one row for every word of every text, in one segment for each part of the input, in the shared folder."""
    words = docs.select(doc_key().alias("doc"), F.posexplode(tokens(F.col("text"))).alias("pos", "raw"))
    return stored(words.select(term_of(F.col("raw")).alias("term"), "doc", "pos"), "postings")


def from_the_rarest(postings: DataFrame, windows: Windows) -> DataFrame:
    """(window_id, rare): each window's (df, term, offset) from the rarest term.

    Windows with a term that no document holds can't occur and go.
    """
    terms = stored(windows.phrases.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct(), "terms")
    counts = with_term(postings.select("term", "pos"), terms).groupBy("term").agg(F.count("*").alias("df"))
    placed = windows.phrases.select("window_id", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word")).withColumn("term", term_of(F.col("word"))).join(counts, "term")
    ranked = placed.groupBy("window_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "term", "offset"))).alias("rare"))
    ranked = stored(ranked.where(F.size("rare") == F.col("n")).drop("n"), "ranked")
    discard(terms)
    return ranked


def term_at(k: int) -> tuple[Column, Column]:
    return F.col("rare")[k]["term"], F.col("rare")[k]["offset"]


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc, start, len, window_id) of every exact occurrence of a window, stored."""
    (term, offset), (term2, offset2) = term_at(0), term_at(1)
    lone = stored(ranked.where(F.size("rare") == 1).select(term.alias("term"), "window_id"), "lone")
    alone = with_term(postings, lone).select("doc", F.col("pos").alias("start"), F.lit(1).alias("len"), "window_id")

    pairs = stored(ranked.where(F.size("rare") > 1).select("window_id", term.alias("term"), offset.alias("offset"), term2.alias("term2"), (offset2 - offset).alias("shift")), "pairs")
    heads = stored(pairs.select("term", "term2", "shift").distinct(), "heads")
    seconds = stored(heads.select(F.col("term2").alias("term")).distinct(), "seconds")
    moved = with_term(postings, heads).select("doc", F.col("pos").alias("first"), (F.col("pos") + F.col("shift")).alias("pos"), F.col("term").alias("term1"), "shift", F.col("term2").alias("term"))
    met = moved.where("pos >= 0").join(with_term(postings, seconds), ["doc", "pos", "term"])
    met = met.select("doc", "first", F.col("term1").alias("term"), F.col("term").alias("term2"), "shift")
    both = met.join(pairs, ["term", "term2", "shift"]).select("doc", (F.col("first") - F.col("offset")).alias("start"), "window_id").where("start >= 0")
    both = stored(both.distinct(), "both")  # repeated rows post the same

    rest = both.join(ranked, "window_id").select("doc", "start", "window_id", F.explode(F.slice("rare", 3, 1 << 30)).alias("x"))
    rest = rest.select("doc", (F.col("start") + F.col("x.offset")).alias("pos"), F.col("x.term").alias("term"), "start", "window_id")
    near = stored(both.select("doc").distinct(), "hit_docs")
    there = postings.join(F.broadcast(near) if bounded(near) else near, "doc", "left_semi")
    others = rest.join(there, ["doc", "pos", "term"]).groupBy("doc", "start", "window_id").agg(F.count_distinct("pos").alias("found"))
    sizes = ranked.select("window_id", F.size("rare").alias("len"))
    whole = both.join(sizes, "window_id").join(others, ["doc", "start", "window_id"], "left").where(F.coalesce("found", F.lit(0)) + 2 == F.col("len"))
    out = stored(alone.unionByName(whole.select("doc", "start", "len", "window_id")), "matches")
    discard(lone, pairs, heads, seconds, both, near)
    return out


def proximity_matches(postings: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(doc, pos, window_id): all of a window's words within `slop` words of its rarest one, in any order.

    Places are compared in cells of slop + 1 words, so that the joins are equi-joins.
    """
    cell = F.floor(F.col("pos") / (slop + 1))
    term, _ = term_at(0)
    firsts = stored(ranked.select(term.alias("term"), "window_id"), "firsts")
    seeds = with_term(postings, firsts).select("doc", F.col("pos").alias("at"), "window_id")
    wanted = ranked.select("window_id", F.explode(F.array_distinct(F.transform("rare", lambda x: x["term"]))).alias("term"))
    cells = seeds.join(wanted, "window_id").withColumn("pos", F.col("at")).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).drop("pos")
    terms = stored(wanted.select("term").distinct(), "near_terms")
    there = with_term(postings, terms).withColumn("cell", cell)
    met = cells.join(there, ["doc", "cell", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    found = met.groupBy("doc", "at", "window_id").agg(F.count_distinct("term").alias("found"))
    need = wanted.groupBy("window_id").agg(F.count("*").alias("need"))
    return found.join(need, "window_id").where("found = need").select("doc", F.col("at").alias("pos"), "window_id")


def spelled_out(found: DataFrame, docs: DataFrame, windows: Windows) -> DataFrame:
    """(doc_id, doc, hits) of the documents in whose text some of the phrases stand word by word: array of (start, window_id)."""
    placed = found.join(windows.phrases, "window_id").groupBy("doc").agg(F.collect_list(F.struct("start", "window_id", "words")).alias("hits"))
    keys = stored(found.select("doc").distinct(), "hit_keys")
    near = docs.select("doc_id", doc_key().alias("doc"), "text").join(F.broadcast(keys) if bounded(keys) else keys, "doc", "left_semi")
    # Each text is cut into words once: what a generator makes is not computed again for each hit.
    words = near.join(placed, "doc").select("doc_id", "doc", "hits", F.explode(F.array(F.transform(tokens(F.col("text")), lower_ascii))).alias("w"))
    real = F.filter("hits", lambda h: F.slice("w", h["start"] + 1, F.size(h["words"])) == h["words"])
    kept = words.select("doc_id", "doc", F.transform(real, lambda h: F.struct(h["start"].alias("start"), h["window_id"].alias("window_id"), F.size(h["words"]).alias("len"))).alias("hits"))
    return kept.where(F.size("hits") > 0)


def hit_words(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, doc, n_hit, hit_items) of the documents with any occurrence, stored."""
    windows = test_windows(items, n)
    postings = build_postings(docs)
    ranked = from_the_rarest(postings, windows)
    found = phrase_matches(postings, ranked)
    discard(postings)
    real = stored(spelled_out(found.select("doc", "start", "window_id"), docs, windows).dropDuplicates(["doc_id", "doc"]), "real")
    each = real.select("doc_id", "doc", F.explode("hits").alias("h"))
    places = each.select("doc_id", "doc", F.explode(F.sequence("h.start", F.col("h.start") + F.col("h.len") - 1)).alias("pos")).distinct()
    words = places.groupBy("doc_id", "doc").agg(F.count("*").alias("n_hit"))
    owned = each.select("doc_id", "doc", "h.window_id").distinct().join(windows.owners.where("item_id is not null"), "window_id").select("doc_id", "doc", "item_id").distinct()
    names = owned.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list("item_id")).alias("hit_items"))
    hits = words.alias("a").join(names.alias("b"), same_document("a", "b"), "left").select("a.*", "b.hit_items")
    out = stored(hits, "hits")
    discard(ranked, found, real, windows.stored_at)
    return out


def same_document(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc") == F.col(f"{b}.doc")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = hit_words(docs, items, n)
    rows = docs.select("doc_id", doc_key().alias("doc"), word_count(F.col("text"), ALNUM_WORD).alias("n_words"))
    names = F.coalesce("hit_items", F.array().cast("array<string>"))
    return rows.alias("r").join(hits.alias("h"), same_document("r", "h"), "left").select(
        F.col("r.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The documents in which no test window occurs, with all their columns."""
    hits = hit_words(docs, items, n)
    bad = hits.select(F.col("doc_id").alias("id"), F.col("doc").alias("key"))
    return docs.join(bad, (doc_key() == bad["key"]) & docs["doc_id"].eqNullSafe(bad["id"]), "left_anti")
