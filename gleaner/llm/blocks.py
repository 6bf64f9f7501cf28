"""Comparing the members of groups in parts of a bounded size.

A group with more than `most` members is cut into shards by a digest, and every
two shards meet in a block of their own, so that no task holds a whole group.
Small groups travel together, many to a part: one call of Python for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import stored

#: Columns that in_parts() adds; low and high are the two shards that meet in the block.
ADDED = ("shard", "low", "high", "part")


def in_parts(rows: DataFrame, keys: list[str], member: str, most: int, part_rows: int) -> DataFrame:
    """rows (a stored table) with shard, low, high and part: a group is every row with the same keys, low and high.

    The table of crowded groups has a row for each `most` rows at best; whether it
    is broadcast is left to Spark, which knows its size from the files.
    """
    crowded = stored(rows.groupBy(*keys).agg(F.count("*").alias("__size")).where(F.col("__size") > most), "crowded")
    if crowded.isEmpty():
        blocks = rows.withColumn("shard", F.lit(0)).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    else:
        blocks = rows.join(crowded, keys, "left").withColumn("__shards", F.ceil(F.coalesce(F.col("__size"), F.lit(1)) / most).cast("int"))
        blocks = blocks.withColumn("shard", F.pmod(F.xxhash64(member), F.col("__shards")).cast("int"))
        blocks = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__shards") - 1)))
        blocks = blocks.withColumn("low", F.least("shard", "__other")).withColumn("high", F.greatest("shard", "__other")).drop("__size", "__shards", "__other")
    parts = max(1, -(-rows.count() // part_rows))
    return blocks.withColumn("part", F.pmod(F.xxhash64(*keys, "low", "high"), F.lit(parts)).cast("int"))


def groups(table: pa.Table, keys: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of each group with more than one row."""
    codes = [np.asarray(c.combine_chunks().dictionary_encode().indices) if not pa.types.is_integer(c.type) else np.asarray(c) for c in (table.column(k) for k in [*keys, "low", "high"])]
    if not table.num_rows:
        return
    order = np.lexsort(codes[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for c in codes:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    for run in np.split(order, np.flatnonzero(fresh)[1:]):
        if len(run) > 1:
            yield run
