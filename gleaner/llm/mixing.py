"""Mixing sources to target weights by capped water-filling.

Cases: a null text has size 0 and a null source is a source of its own, ordered
last; an empty table gives no rows; rows that are equal in every ordering column
are interchangeable; very long texts are counted whole; columns beside text,
source and doc_id pass through whatever their names, and a clash with a result
column is resolved in favour of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.columns import restored, shielded, word_count

RESULT = ("size", "source_size", "target", "taken")


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the whole mix as a multiple of the words there are.
    budget: float = 1.5
    #: Most repetitions of a source.
    max_epochs: float = 2.0
    seed: str = "mix-1"


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water-filling: level = what is left over the weights that are left.  Sources
    whose cap lies under level * weight are clamped, in order of cap / weight;
    the level is the first at which no further source exceeds its cap.  Both sums
    run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(plan.weights)
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    ranked = sizes.withColumn("weight", F.get(weights, ((F.row_number().over(order) - 1) % n).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(plan.max_epochs)).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        ((F.sum("source_size").over(everything) * F.lit(plan.budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
    )
    levels = levels.withColumn("final", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of each).

    A source whose target is r times its size gives floor(r) whole repetitions of
    every document; the fractional repetition goes to documents in the order of a
    seeded digest until the source's target is met, the last one in part.  The
    running sum over a source is cut into 4096 digest slices, so that no task
    holds a whole source.
    """
    rows, names = shielded(docs.drop(*RESULT), "doc_id", "source", "text")
    rows = rows.withColumn("size", word_count(F.col("text")))
    digest = F.md5(F.concat_ws("|", F.lit(plan.seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("-"))).cast("binary"))
    rows = rows.withColumn("__digest", digest).withColumn("__slice", F.substring("__digest", 1, 3))
    slices = rows.groupBy("source", "__slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    ahead = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    plan_rows = slices.select("source", "__slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("__ahead"))
    goal = F.round("target").cast("long")
    targets = source_targets(sizes, plan).withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("__quota", goal - F.col("__whole") * F.col("source_size"))
    plan_rows = plan_rows.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target", "__whole", "__quota")
    joined = rows.alias("r").join(plan_rows.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.__slice") == F.col("p.__slice")))
    joined = joined.select("r.*", "p.source_size", "p.target", "p.__whole", "p.__quota", "p.__ahead")
    inside = Window.partitionBy("source", "__slice").orderBy("__digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__quota") - start))
    return restored(joined.withColumn("taken", (F.col("__whole") * F.col("size") + extra).cast("long")), names, *RESULT)
