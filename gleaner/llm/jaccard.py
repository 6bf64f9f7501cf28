"""Near-duplicate classes by an exact n-gram Jaccard join.

A document is the set of its distinct word n-grams, as 64-bit fingerprints;
equal sets are one node.  A pair at or above the threshold shares a gram among
the first (rarest) grams of both, its prefixes.  Rarity is a table of counts of
all documents with a fixed number of cells; it only orders the grams, so the
result does not depend on it.

  1. grams are counted; each node keeps its prefix
  2. prefix grams that two nodes share make candidate pairs, unless lengths or
     positions rule the pair out.  A gram that many nodes share first tries
     each node with one hub; only nodes outside the class that most of them
     fall in then meet the others, so that a large group of copies is not
     expanded into its pairs
  3. the suffix filter bounds the difference of two sets from below by counts of
     their grams in 256 residue cells of the hashes (not by pivots chosen for the
     pair); what is left is intersected once a pair
  4. linked nodes form components

Cases: a text with fewer words than n is one gram of all its words; a null or
wordless text has no grams and stays alone; rows that are equal in text are one
node; a null doc_id takes part but never names a component unless it is alone
there (then null); an empty table gives no rows; texts of any length are read
whole; columns beside doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.columns import heavy_keys, restored, shielded, spread_join
from gleaner.llm.grams import doc_slices, mix, rolling, text_bytes, word_codes, word_spans
from gleaner.llm.language import LOWER
from gleaner.operators.components import components
from gleaner.session import bounded_batches, discard, stored

CELL_BITS = 20
SLICES = 64
#: Cells of the suffix filter: enough to tell sets of some thousand grams apart.
HISTOGRAM = 256
#: A gram that more nodes share than this starts with a hub.
CROWD = 48
#: Tables of counts that are added up in one task.
FAN_IN = 512


@dataclass(frozen=True)
class Similarity:
    """Pairs with |intersection| * den >= num * |union| are linked."""

    n: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, size: np.ndarray) -> np.ndarray:
        least = -(-size * self.num // self.den)
        return np.where(size > 0, size - least + 1, 0)

    def overlap(self, a: Column, b: Column) -> Column:
        """Least intersection of linked sets of these sizes."""
        return F.ceil(F.lit(self.num) * (a + b) / F.lit(self.num + self.den))


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(documents, offsets, fingerprints) of runs of documents; sorted and distinct in each."""
    data, offsets = text_bytes(texts)
    for a, b in doc_slices(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        codes = word_codes(part, starts, ends)
        row = np.repeat(np.arange(b - a), np.diff(first))
        h = rolling(codes, n)
        fits = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
        h, owner = h[fits], row[: len(h)][fits]
        words = np.diff(first)
        for r in np.flatnonzero((words > 0) & (words < n)):
            short = rolling(codes[first[r] : first[r + 1]], int(words[r])) ^ np.uint64(words[r])
            h, owner = np.append(h, mix(short)), np.append(owner, r)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
        yield b - a, np.searchsorted(owner, np.arange(b - a + 1)), h


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents each cell's grams stand, over all documents: a table of 2**CELL_BITS cells."""
    width = (1 << CELL_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for _, _, h in gram_sets(b.column("text"), n):
                cells += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        raw = [np.minimum(cells[k * width : (k + 1) * width], 2**31 - 1).astype("<i4").tobytes() for k in range(SLICES)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(raw, pa.binary())], ["part", "task", "cells"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in t.column("cells"):
            total += np.frombuffer(x.as_py(), "<i4")
        first = [pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("part", "task")]
        return pa.table({"part": first[0], "task": first[1], "cells": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    schema = "part int, task int, cells binary"
    tables = docs.select("text").mapInArrow(count, schema)
    for fan_in in (FAN_IN, FAN_IN * FAN_IN):  # a tree, so that no task adds up what all others counted
        tables = tables.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy("part", "task").applyInArrow(add, schema)
    parts = tables.collect()
    out = np.zeros(1 << CELL_BITS, np.int64)
    for p in parts:
        out[p["part"] * width : (p["part"] + 1) * width] += np.frombuffer(p["cells"], "<i4")
    return out


def node_name(h: np.ndarray) -> bytes:
    """128 bits that don't depend on order."""
    with np.errstate(over="ignore"):
        return mix(h).sum(dtype=np.uint64).tobytes() + mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()


def describe(docs: DataFrame, sim: Similarity, sets: bool = False) -> DataFrame:
    """docs' other columns with node and, as asked, size, prefix and histogram, or the whole set."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    shared = None if sets else docs.sparkSession.sparkContext.broadcast(gram_counts(docs, sim.n))  # 8 MB, whatever the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, prefixes, cells, wholes = [], [], [], [], []
            for n_docs, offsets, h in gram_sets(b.column("text"), sim.n):
                if not sets:
                    rank = shared.value[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                for r in range(n_docs):
                    own = h[offsets[r] : offsets[r + 1]]
                    names.append(node_name(own))
                    if sets:
                        wholes.append(own.view(np.int64))
                        continue
                    sizes.append(len(own))
                    order = np.lexsort((own, rank[offsets[r] : offsets[r + 1]]))
                    prefixes.append(own[order[: int(sim.prefix(np.int64(len(own))))]].view(np.int64))
                    cells.append(np.minimum(np.bincount((own & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM), 32_767).astype(np.int16))
            cols = [b.column(c) for c in rest] + [pa.array(names, pa.binary())]
            if sets:
                cols += [pa.array(wholes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [*rest, "node", "grams"])
            else:
                cols += [pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays(cols, [*rest, "node", "size", "prefix", "cells"])

    extra = "node binary, grams array<bigint>" if sets else "node binary, size bigint, prefix array<bigint>, cells array<smallint>"
    return docs.mapInArrow(rows, ", ".join([*fields, extra]))


def fitting(pairs: DataFrame, sim: Similarity) -> DataFrame:
    """Length and positional filters on (size, pos, size2, pos2)."""
    a, b = F.col("size"), F.col("size2")
    need = sim.overlap(a, b)
    length = (F.least(a, b) * sim.den >= F.greatest(a, b) * sim.num)
    return pairs.where(length & (F.least(a - F.col("pos"), b - F.col("pos2")) >= need))


def one_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).where("a <> b").distinct()


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}_{c}" if c != "node" else name) for c in df.columns])


def near_pairs(pairs: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b) once each, of the pairs that the suffix filter leaves."""
    light = nodes.select("node", "size", "cells")
    near = one_way(pairs).join(_side(light, "a"), "a").join(_side(light, "b"), "b")
    apart = F.aggregate(F.zip_with("a_cells", "b_cells", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    room = F.col("a_size") + F.col("b_size") - 2 * sim.overlap(F.col("a_size"), F.col("b_size"))
    return near.where(apart <= room).select("a", "b")


def verified(near: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b) of the pairs whose sets are that similar."""
    whole = near.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    union = F.size("a_grams") + F.size("b_grams") - both
    return whole.where(both * sim.den >= union * sim.num).select("a", "b")


def similar_classes(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """(doc_id, __th, n_shingles, component_id, class) of every row of docs; __th is xxhash64 of its text,
    class tells components apart also where no member has a doc_id (null: no grams)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__th"))
    members = stored(describe(rows, sim).withColumnRenamed("node", "name"), "members")
    distinct = members.where("size > 0").groupBy("name").agg(
        F.min(F.struct("doc_id", "__th")).alias("key"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells")
    )
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Position and size in one number: what is shuffled is three longs a gram.
    spot = F.shiftleft("size", 32) + F.col("pos")
    grams = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "gram")).select("gram", "node", spot.alias("spot"))
    crowds = stored(grams.groupBy("gram").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    common = heavy_keys(crowds, "gram", "crowd", crowds.agg(F.sum("crowd")).first()[0] or 0)
    entries = spread_join(grams, crowds, "gram", common).select("gram", "node", F.shiftright("spot", 32).alias("size"), F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), "crowd")
    entries = stored(entries, "entries")

    few = entries.where(F.col("crowd") <= CROWD).drop("crowd")
    other = few.select("gram", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "pos")])
    within = stored(near_pairs(fitting(few.join(other, "gram").where("node < node2"), sim), nodes, sim), "within")
    crowded = entries.where(F.col("crowd") > CROWD).drop("crowd")
    hubs = crowded.groupBy("gram").agg(F.min(F.struct("pos", "size", "node")).alias("hub"))
    stars = spread_join(crowded, hubs, "gram", common).select("node", "size", "pos", F.col("hub.node").alias("node2"), F.col("hub.size").alias("size2"), F.col("hub.pos").alias("pos2"))

    asked = within.select(F.col("a").alias("node")).unionByName(within.select(F.col("b").alias("node"))).unionByName(crowded.select("node")).distinct()
    asked = stored(asked.join(nodes.select("node", "key"), "node").select("node", "key.*"), "asked")
    texts = rows.alias("r").join(asked.alias("u"), F.col("r.__th").eqNullSafe(F.col("u.__th")) & F.col("r.doc_id").eqNullSafe(F.col("u.doc_id"))).select(F.col("u.node").alias("of"), "r.text")
    sets = stored(describe(texts, sim, sets=True).select(F.col("of").alias("node"), "grams"), "sets")
    first_links = stored(verified(near_pairs(fitting(stars, sim), nodes, sim), sets, sim), "stars")
    label = components(first_links)

    named = crowded.join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    shares = named.groupBy("gram", "class").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count("*").alias("classes"))
    split = stored(spread_join(named, shares.where("classes > 1"), "gram", common), "split")
    right = split.select("gram", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "class")])
    outside = split.where(F.col("class") != F.col("main")).drop("main", "classes")
    across = fitting(outside.join(right, "gram").where("class <> class2"), sim)
    links = first_links.unionByName(verified(within, sets, sim)).unionByName(verified(near_pairs(across, nodes, sim), sets, sim))
    found = stored(components(links), "found")
    discard(entries, within, asked, sets, first_links, split)

    # Classes are named on nodes first: copies of a text, and large classes, meet nothing but a broadcast.
    of_class = nodes.select("node", "name", "least_id", "copies").join(found, "node", "left").select("name", "least_id", "copies", F.coalesce("component", "node").alias("class"))
    of_class = stored(of_class, "of_class")
    least = of_class.groupBy("class").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    large = heavy_keys(least, "class", "n", of_class.count())
    names = stored(spread_join(of_class, least.drop("n"), "class", large).select("name", "copies", "class", "component_id"), "names")
    own = members.select("doc_id", "__th", "size", "name")
    copied = heavy_keys(names, "name", "copies", own.count())
    named = spread_join(own.where("size > 0"), names.drop("copies"), "name", copied).select("doc_id", "__th", F.col("size").alias("n_shingles"), "component_id", "class")
    return named.unionByName(own.where("size = 0").select("doc_id", "__th", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class")))


def one_of_each_class(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The rows of docs that stay: of each class the one with the least doc_id (null last), and all without grams."""
    classes = stored(similar_classes(docs.select("doc_id", "text"), sim), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__th")
    best = classes.where("class is not null").groupBy("class").agg(F.min(order).alias("best")).select("best.doc_id", "best.__th")
    copies = classes.groupBy("doc_id", "__th").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.__th").eqNullSafe(F.col(f"{b}.__th"))
    once = best.alias("b").join(copies.where("n > 0").alias("c"), same("b", "c")).select("b.doc_id", "b.__th", "copies")
    stay = once.unionByName(copies.where("n = 0").select("doc_id", "__th", F.lit(1).cast("long").alias("copies")))
    rows, names = shielded(docs, "doc_id", "text")
    rows = rows.withColumn("__th", F.xxhash64("text"))
    kept = rows.alias("r").join(stay.alias("s"), same("r", "s")).select("r.*", F.col("s.copies").alias("__copies"))
    several = kept.where("__copies > 1").dropDuplicates(["doc_id", "__th"])
    return restored(kept.where("__copies = 1").unionByName(several), names)
