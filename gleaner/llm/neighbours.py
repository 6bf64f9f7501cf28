"""Approximate nearest neighbours on randomly rotated one-bit codes.

The index puts each vector in the cell of its nearest coarse centroid (fitted on
a bounded sample) and keeps the signs of its rotated offset from there (packed
bits), the offset's length, and the inner product of offset and code.  Short
vectors are padded before the rotation, so that a code has at least `bits` bits.

A query first drops cells: with d its distance to a cell's centroid and r the
cell's radius, no member lies nearer than d - r, and the k nearest lie no
farther than the least d + r under which the cells hold k members.  In the cells
that stay, the bits and scalars estimate its inner product with every code; the
best estimates are measured on the original components, in double precision, and
so is every vector whose least distance under the error bound lies below the
k-th of these.

Queries and vectors meet in parts of bounded size: cells are cut into shards,
and only cells with many queries meet them in several blocks.

Cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, as query or candidate; equal rows count once; vectors
of another dimension are never compared; with fewer candidates than k, all are
returned; ties go to the smaller id; an empty table gives no rows; columns
beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import discard, stored

FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class SearchPlan:
    k: int = 10
    #: Half-width of the error bound in standard deviations of the estimate.
    sigmas: float = 3.0
    #: Least length of a code.
    bits: int = 256
    #: Vectors of a shard, and queries that it meets at once.
    group: int = 8_192
    query_block: int = 4_096
    #: Centroids are fitted on so many vectors of each dimension; cells, at most.
    sample: int = 20_000
    cells: int = 1_024
    rounds: int = 5
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """Coded vectors (vec_id, embedding, dim, cell, code, length, align), stored, and the centroids of each dimension."""

    rows: DataFrame
    centroids: dict[int, np.ndarray]
    plan: SearchPlan


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding, dim) of the vectors that take part."""
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kept = "array<float>" if kind == "float" else "array<double>"
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kept).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size(v)).distinct()


@lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x max(dim, bits): rows of a random rotation; once in each worker."""
    size = max(dim, bits)
    q, r = np.linalg.qr(np.random.default_rng(seed + size).standard_normal((size, size)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T, 0.0)


def fit_centroids(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Some rounds of k-means; empty cells keep their centroid."""
    centroids = x[:cells].copy() if cells > 1 else x.mean(axis=0, keepdims=True)
    for _ in range(rounds if cells > 1 else 0):
        own = square_distances(x, centroids).argmin(axis=1)
        n = np.bincount(own, minlength=cells)
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=cells) for j in range(x.shape[1])], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def build_index(vectors: DataFrame, plan: SearchPlan = SearchPlan()) -> Index:
    """Every usable vector with its cell and code; centroids from a bounded sample of each dimension, by digest."""
    rows = stored(usable(vectors), "vectors")
    centroids: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():
        dim, n = r["dim"], r["n"]
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < F.lit(min(1.0, plan.sample / n) * 1_000_003)
        found = rows.where((F.col("dim") == dim) & share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(plan.sample).select("embedding").collect()
        x = np.array([f[0] for f in found], np.float64).reshape(-1, dim)
        centroids[dim] = fit_centroids(x, min(plan.cells, len(x), -(-n // plan.group)), plan.rounds) if len(x) else np.zeros((1, dim))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most plan.cells vectors of each dimension

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            cells, codes, lengths, aligns = np.zeros(len(dims), np.int32), np.empty(len(dims), object), np.zeros(len(dims)), np.ones(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = as_matrix(b.column("embedding").take(pa.array(own)), dim)
                middle = shared.value[int(dim)]
                cells[own] = square_distances(x, middle).argmin(axis=1)
                off = x - middle[cells[own]]
                turned = off @ rotation(int(dim), plan.bits, plan.seed)
                lengths[own] = np.linalg.norm(off, axis=1)
                some = lengths[own] > 0
                aligns[own[some]] = np.abs(turned[some]).sum(axis=1) / np.sqrt(turned.shape[1]) / lengths[own][some]
                codes[own] = [c.tobytes() for c in np.packbits(turned > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(codes.tolist(), pa.binary()), pa.array(lengths), pa.array(aligns)], [*b.schema.names, "cell", "code", "length", "align"])

    kind = rows.schema["embedding"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"vec_id bigint, embedding {kind}, dim int, cell int, code binary, length double, align double")
    index = stored(coded, "index")
    discard(rows)
    return Index(index, centroids, plan)


def search_part(vectors: pa.Table, queries: pa.Table, centroids: dict[int, np.ndarray], plan: SearchPlan) -> pa.Table:
    """The k best of each query among the vectors of one shard."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if vectors.num_rows and queries.num_rows:
        dim, cell = vectors.column("dim")[0].as_py(), vectors.column("cell")[0].as_py()
        ids, x = np.asarray(vectors.column("vec_id")), as_matrix(vectors.column("embedding"), dim)
        turn = rotation(dim, plan.bits, plan.seed)
        size = turn.shape[1]
        packed = np.frombuffer(b"".join(c.as_py() for c in vectors.column("code")), np.uint8).reshape(len(ids), -1)
        signs = (np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
        length, align = np.asarray(vectors.column("length")), np.asarray(vectors.column("align"))
        spread = plan.sigmas * np.sqrt(np.maximum(0.0, 1 - align**2)) / align / np.sqrt(max(1, size - 1)) + 1e-5
        q_ids, q = np.asarray(queries.column("vec_id")), as_matrix(queries.column("embedding"), dim)
        off = q - centroids[dim][cell]
        q_length = np.linalg.norm(off, axis=1)
        units = (off @ turn) / np.where(q_length > 0, q_length, 1.0)[:, None]
        first = min(4 * plan.k, len(ids))
        for a in range(0, len(q), 64):
            inner = (signs @ units[a : a + 64].T.astype(np.float32)).astype(np.float64) / align[:, None]
            for j in range(inner.shape[1]):
                i = a + j
                scale = 2 * length * q_length[i]
                middle = np.where(ids == q_ids[i], np.inf, length**2 + q_length[i] ** 2 - scale * inner[:, j])
                near = np.argpartition(middle, first - 1)[:first]
                reach = np.sort(((x[near[np.isfinite(middle[near])]] - q[i]) ** 2).sum(axis=1))
                cut = reach[plan.k - 1] if len(reach) >= plan.k else np.inf
                near = np.flatnonzero((middle - scale * spread <= cut * (1 + 1e-9)) & np.isfinite(middle))
                score = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[near], score))[: plan.k]
                found.append((np.full(len(order), q_ids[i]), ids[near][order], score[order]))
    cat = lambda k, kind: np.concatenate([f[k] for f in found]).astype(kind) if found else np.zeros(0, kind)
    return pa.table({"query_id": pa.array(cat(0, np.int64)), "vec_id": pa.array(cat(1, np.int64)), "score": pa.array(cat(2, np.float64))})


def reachable_cells(queries: DataFrame, index: Index, sizes: dict[tuple[int, int], tuple[int, float]]) -> DataFrame:
    """(vec_id, embedding, dim, cell): each query with the cells that may hold one of its k nearest."""
    plan = index.plan
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, sizes))
    kind = queries.schema["embedding"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, known = shared.value
        for b in batches:
            dims = np.asarray(b.column("dim"))
            rows, cells = [], []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                held = np.array([c for c in range(len(centroids[int(dim)])) if (int(dim), c) in known])
                counts = np.array([known[int(dim), c][0] for c in held])
                radius = np.array([known[int(dim), c][1] for c in held])
                d = np.sqrt(square_distances(as_matrix(b.column("embedding").take(pa.array(own)), dim), centroids[int(dim)][held]))
                order = np.argsort(d + radius, axis=1)
                # The query itself may be a member, so that k + 1 are asked for.
                enough = (np.cumsum(counts[order], axis=1) >= plan.k + 1).argmax(axis=1)
                far = np.take_along_axis(d + radius, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
                far = np.where(counts.sum() > plan.k, far, np.inf)
                r, c = np.nonzero(d - radius <= far[:, None] * (1 + 1e-9) + 1e-9)
                rows.append(own[r])
                cells.append(held[c])
            at = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            cell = pa.array(np.concatenate(cells).astype(np.int32)) if rows else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(at) for n in ("vec_id", "embedding", "dim")], cell], ["vec_id", "embedding", "dim", "cell"])

    return queries.select("vec_id", "embedding", "dim").mapInArrow(choose, f"vec_id bigint, embedding {kind}, dim int, cell int")


def nearest(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; queries are rows of the index."""
    plan = index.plan
    members = {(r["dim"], r["cell"]): (r["n"], r["far"]) for r in index.rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("length").alias("far")).collect()}
    asked = stored(reachable_cells(queries, index, members), "asked")
    per_cell = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / plan.query_block).cast("int").alias("blocks"))
    per_cell = index.rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / plan.group).cast("int").alias("shards")).join(per_cell, ["dim", "cell"])
    per_cell = F.broadcast(stored(per_cell, "cells"))  # at most plan.cells rows of each dimension
    part = ["dim", "cell", "shard", "block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_hash = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = index.rows.join(per_cell, ["dim", "cell"]).withColumn("shard", of_hash("shards")).withColumn("block", every("blocks")).drop("shards", "blocks")
    right = asked.join(per_cell, ["dim", "cell"]).withColumn("block", of_hash("blocks")).withColumn("shard", every("shards")).drop("shards", "blocks")
    centroids = queries.sparkSession.sparkContext.broadcast(index.centroids)
    found = left.groupBy(*part).cogroup(right.groupBy(*part)).applyInArrow(lambda a, b: search_part(a, b, centroids.value, plan), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k).select("query_id", "rank", "vec_id", "score")
