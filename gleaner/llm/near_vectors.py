"""Near-duplicate vectors under equal labels, by randomly rotated binary codes.

Every distinct vector gets a code: the signs of its unit vector under two
independent random rotations, and for each the correction factor <x, code(x)>.
Decoded and divided by their factors, the first code of x and the second of y
have <x, y> as the mean of their inner product (the rotations are independent,
hence no bias), with an error bound that the factors give.

1. Groups of code bits, as many as the bound on missed links asks for, put
   vectors into buckets.  Only codes and factors are shuffled.  In a bucket, the
   estimates plus their bounds decide which vectors may have a link at all.
2. Vectors of these alone are fetched and measured in double precision, bucket
   by bucket.  A pair that shares several buckets counts in the first one.  A
   bucket returns, for each vector, its number of links and the least vector it
   is connected to there: no pairs.

A pair at the very threshold shares no bucket with a chance of `miss`, and less
the nearer it is; nothing under the threshold is ever linked.  Buckets with more
than `block` vectors are compared shard by shard.

Cases: equal vectors of a label are collapsed before anything is compared and
count as linked; vectors that are null, empty, zero or hold a null or non-finite
component, and those without a label, have no links and are classes of their
own; vectors of different dimensions are never linked; rows without a vec_id
take no part (component_id null, not kept); rows that repeat a vec_id count each
in n_links, and are one vector in component_id; an empty table gives no rows;
columns beside vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import groups, in_parts
from gleaner.llm.columns import heavy_keys, spread_join
from gleaner.llm.neighbours import as_matrix, rotation
from gleaner.operators.components import components
from gleaner.session import discard, stored

BUCKET = ["label", "dim", "band", "key"]


@dataclass(frozen=True)
class LinkPlan:
    cosine: float = 0.98
    #: Half-width of the confidence bound in standard deviations of the estimate.
    sigmas: float = 5.0
    #: Chance that a pair at the threshold shares no bucket.
    miss: float = 1e-6
    #: Vectors of the largest label in a bucket, if they are spread evenly.
    crowd: int = 64
    #: Least bits of each of the two codes.
    bits: int = 128
    #: Vectors of a shard of a crowded bucket, and rows of a part.
    block: int = 1_024
    part_rows: int = 8_192
    seed: int = 29


@dataclass(frozen=True)
class Bands:
    """Groups of `width` code bits, `count` of them; `least` bits for each of the two codes."""

    width: int
    count: int
    least: int

    def half(self, dim: int) -> int:
        return -(-max(dim, self.least) // 8) * 8

    def keys(self, bits: np.ndarray, seed: int) -> np.ndarray:
        """(vectors, bands): the value of each band, from bits dealt to the bands at random."""
        dealt = np.random.default_rng(seed).permutation(bits.shape[1])[: self.width * self.count]
        return bits[:, dealt].reshape(len(bits), self.count, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))


def bands_for(vectors: int, plan: LinkPlan) -> Bands:
    """Enough bits that a bucket of the largest label stays small, enough bands that links are found."""
    width = max(4, math.ceil(math.log2(max(2, vectors) / plan.crowd)))
    same = (1 - math.acos(plan.cosine) / math.pi) ** width
    count = max(1, math.ceil(math.log(plan.miss) / math.log1p(-same)))
    return Bands(width, count, max(plan.bits, -(-width * count // 2)))


@lru_cache(maxsize=8)
def rotations(dim: int, half: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return rotation(dim, half, seed), rotation(dim, half, seed + 1_000_003)


def encode(x: np.ndarray, half: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits of both codes, the two correction factors) of unit vectors."""
    turned = [x @ r for r in rotations(x.shape[1], half, seed)]
    bits = np.concatenate([t > 0 for t in turned], axis=1)
    return np.packbits(bits, axis=1), np.stack([np.abs(t).sum(axis=1) / np.sqrt(half) for t in turned], axis=1)


def decode(bits: np.ndarray, factors: np.ndarray, dim: int, half: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both codes back in the vectors' own space, over their factors."""
    signs = bits.astype(np.float32) * 2 - 1
    return tuple(signs[:, k * half : (k + 1) * half] @ r.T.astype(np.float32) / (np.sqrt(half) * factors[:, k : k + 1]).astype(np.float32) for k, r in enumerate(rotations(dim, half, seed)))


def may_link(x: tuple[np.ndarray, np.ndarray], factors: np.ndarray, half: int, plan: LinkPlan) -> np.ndarray:
    """For every two vectors of a bucket: the estimate plus its bound reaches the threshold."""
    cross = x[0] @ x[1].T
    rest = 1 / np.minimum(factors, 1.0) ** 2 - 1
    spread = (rest[:, :1] + rest[:, 1] + rest[:, :1] * rest[:, 1]) / (half - 1)
    bound = plan.sigmas * 0.5 * np.sqrt(spread + spread.T) + 1e-5
    return (cross + cross.T) / 2 + bound >= plan.cosine


def bits_of(table: pa.Table | pa.RecordBatch, half: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(c.as_py() for c in table.column("code")), np.uint8).reshape(table.num_rows, -1)
    return np.unpackbits(packed, axis=1, count=2 * half)


def _factors(table: pa.Table) -> np.ndarray:
    return np.stack([np.asarray(table.column("factor1")), np.asarray(table.column("factor2"))], axis=1)


def _of_one_dimension(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    dims = np.asarray(table.column("dim"))
    for dim in np.unique(dims):
        yield int(dim), table.take(pa.array(np.flatnonzero(dims == dim)))


def _apart(table: pa.Table, run: np.ndarray) -> np.ndarray:
    """Pairs of a block that are its to judge: of different rows, and of different shards where two shards meet."""
    shard = np.asarray(table.column("shard"))[run]
    if table.column("low")[int(run[0])].as_py() == table.column("high")[int(run[0])].as_py():
        return ~np.eye(len(run), dtype=bool)
    return shard[:, None] != shard[None]


def likely(table: pa.Table, bands: Bands, plan: LinkPlan) -> pa.Table:
    """The rows of a part that may have a link in their bucket."""
    kept = [table.select([*BUCKET, "digest"]).slice(0, 0)]
    for dim, own in _of_one_dimension(table):
        half = bands.half(dim)
        factors = _factors(own)
        x = decode(bits_of(own, half), factors, dim, half, plan.seed)
        some = np.zeros(own.num_rows, bool)
        for run in groups(own, BUCKET):
            pairs = may_link((x[0][run], x[1][run]), factors[run], half, plan) & _apart(own, run)
            some[run[pairs.any(axis=1)]] = True
        kept.append(own.select([*BUCKET, "digest"]).filter(pa.array(some)))
    return pa.concat_tables(kept)


def least_reached(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least node that links lead to."""
    out, open_ = nodes.copy(), linked.any(axis=1)
    for start in np.argsort(nodes, kind="stable"):
        front = np.array([start])
        if open_[start]:
            open_[start] = False
            while len(front):
                out[front] = nodes[start]
                front = np.flatnonzero(linked[front].any(axis=0) & open_)
                open_[front] = False
    return out


def linked_in(table: pa.Table, bands: Bands, plan: LinkPlan) -> pa.Table:
    """(digest, node, root, n) for the vectors of a part that are linked: counts of the pairs whose first bucket this is."""
    found: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
    for dim, own in _of_one_dimension(table):
        x = as_matrix(own.column("embedding"), dim)
        x = x / np.sqrt((x**2).sum(axis=1))[:, None]
        keys = bands.keys(bits_of(own, bands.half(dim)), plan.seed)
        nodes, copies, band = (np.asarray(own.column(c)) for c in ("node", "copies", "band"))
        for run in groups(own, BUCKET):
            linked = (x[run] @ x[run].T >= plan.cosine) & _apart(own, run)
            for earlier in range(band[run[0]]):
                linked &= keys[run, earlier][:, None] != keys[run, earlier][None]
            some = linked.any(axis=1)
            if some.any():
                root = least_reached(linked, nodes[run])
                found.append((own.column("digest").take(pa.array(run[some])).to_pylist(), nodes[run[some]], root[some], linked[some] @ copies[run]))
    cat = lambda k: pa.array(np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64))
    return pa.table({"digest": pa.array([d for f in found for d in f[0]], pa.binary()), "node": cat(1), "root": cat(2), "n": cat(3)})


def coded(vectors: DataFrame, bands: Bands, plan: LinkPlan) -> DataFrame:
    """(vec_id, label, embedding, dim, digest, code, factor1, factor2); digest is of label and vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            labels = b.column("label").to_pylist()
            digests, codes, factors = np.empty(len(dims), object), np.empty(len(dims), object), np.ones((len(dims), 2))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = as_matrix(b.column("embedding").take(pa.array(own)), int(dim)) + 0.0  # -0.0 becomes 0.0
                digests[own] = [hashlib.blake2b(row.tobytes() + labels[i].encode(), digest_size=16).digest() for i, row in zip(own, x, strict=True)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                packed, factors[own] = encode(x / np.linalg.norm(x, axis=1, keepdims=True), bands.half(int(dim)), plan.seed)
                codes[own] = [c.tobytes() for c in packed]
            made = [pa.array(digests.tolist(), pa.binary()), pa.array(codes.tolist(), pa.binary()), pa.array(factors[:, 0]), pa.array(factors[:, 1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "digest", "code", "factor1", "factor2"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(add, f"vec_id bigint, label string, embedding {kind}, dim int, digest binary, code binary, factor1 double, factor2 double")


def in_buckets(classes: DataFrame, bands: Bands, plan: LinkPlan) -> DataFrame:
    """One row for each vector and band: its codes without the vector."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, own in _of_one_dimension(pa.Table.from_batches([b])):
                keys = bands.keys(bits_of(own, bands.half(dim)), plan.seed)
                for band in range(bands.count):
                    yield from own.append_column("band", pa.array(np.full(len(keys), band, np.int32))).append_column("key", pa.array(keys[:, band])).combine_chunks().to_batches()

    return classes.select("digest", "label", "dim", "code", "factor1", "factor2").mapInArrow(deal, "digest binary, label string, dim int, code binary, factor1 double, factor2 double, band int, key bigint")


def near_vector_classes(vectors: DataFrame, plan: LinkPlan = LinkPlan()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.cast("array<float>" if kind == "float" else "array<double>").alias("embedding"))
    rows = rows.withColumn("dim", F.when(F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.size(v)))
    taking_part = rows.where("dim is not null")
    largest = taking_part.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bands = bands_for(largest, plan)
    known = stored(coded(taking_part, bands, plan), "coded")
    first = [F.first(c).alias(c) for c in ("label", "dim", "code", "factor1", "factor2", "embedding")]
    classes = stored(known.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), *first), "classes")

    buckets = stored(in_buckets(classes, bands, plan), "buckets")
    parts = in_parts(buckets, BUCKET, "digest", plan.block, plan.part_rows)
    open_ = stored(parts.groupBy("part").applyInArrow(lambda t: likely(t, bands, plan), "label string, dim int, band int, key bigint, digest binary").distinct(), "open")
    discard(buckets)
    measured = stored(open_.join(classes.select("digest", "node", "copies", "code", "embedding"), "digest"), "measured")
    parts = in_parts(measured, BUCKET, "digest", plan.block, plan.part_rows)
    links = stored(parts.groupBy("part").applyInArrow(lambda t: linked_in(t, bands, plan), "digest binary, node bigint, root bigint, n bigint"), "linked")
    discard(open_, measured)

    component = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("digest", "node", "copies").join(links.groupBy("digest").agg(F.sum("n").alias("n")), "digest", "left").join(component, "node", "left")
    named = stored(named.select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"), "copies"), "named")
    heavy = heavy_keys(named, "digest", "copies", known.count())
    linked = spread_join(known.select("vec_id", "digest"), named.drop("copies"), "digest", heavy).select("vec_id", "n_links", "component_id")
    alone = rows.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
