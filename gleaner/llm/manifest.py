"""A Merkle manifest of a dataset, its leaves placed by the ranks of bitmaps.

A document's leaf is a digest of its fields.  Where it stands in its group (its
language) follows from bitmaps of the doc_ids: words of 64 bits, of which only
those with a document exist, are merged per group, and a directory on three
levels (words in blocks of 1,024, blocks in stretches of 4,096, stretches) holds
how many documents lie before each.  A document's rank is the directory's count
plus the bits below its own: no sort of the documents.  Each level then gathers
up to `fan` nodes into one slot array per parent; a level has an eighth of the
rows of the level below.  Proofs go down the same way: every run hands each of
its nodes the siblings to its left and right and what it got from above itself.

Cases: null fields are told from empty ones in the leaf; documents without a
doc_id stand first in their group; documents that share a doc_id (or have none)
are ordered by leaf, so that equal rows are interchangeable; a null language is a
group of its own, before all others; one language's or one document's subroot
may be the root; an empty table gives no rows; texts of any length are hashed
whole; columns beside the five of a leaf are not read.  The subroots are numbered
in one task: one row for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.columns import lower_ascii
from gleaner.session import discard, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where rows without a doc_id stand: before the word of any other.
NO_ID = -(1 << 62)
WORD_BITS, BLOCK_BITS, STRETCH_BITS = 6, 10, 12


@dataclass(frozen=True)
class TreePlan:
    #: Nodes of a run: a power of two.
    fan_bits: int = 3


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Each field as `-` or its number of bytes, a colon and itself."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return sha(F.concat(*[part(c.cast("string")) for c in fields]))


def with_ranks(rows: DataFrame) -> DataFrame:
    """rows (g, doc_id, leaf, ...; a stored table) with pos, the rank in its group, and n, the group's rows."""
    id_ = F.col("doc_id").cast("long")
    keyed = rows.withColumn("__word", F.coalesce(F.shiftright(id_, WORD_BITS), F.lit(NO_ID))).withColumn("__bit", F.coalesce(id_.bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int"))
    one = F.expr("shiftleft(1L, __bit)")
    words = keyed.groupBy("g", "__word").agg(F.bit_or(one).alias("__bits"), F.count("*").alias("__rows"))
    words = words.withColumn("__block", F.shiftright("__word", BLOCK_BITS)).withColumn("__stretch", F.shiftright("__block", STRETCH_BITS))
    words = stored(words, "words")

    before = lambda order, *keys: F.coalesce(F.sum("__rows").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = words.groupBy("g", "__stretch", "__block").agg(F.sum("__rows").alias("__rows"))
    stretches = blocks.groupBy("g", "__stretch").agg(F.sum("__rows").alias("__rows"))
    total = F.sum("__rows").over(Window.partitionBy("g"))
    stretches = stretches.select("g", "__stretch", before("__stretch", "g").alias("__far"), total.alias("n"))
    blocks = blocks.select("g", "__stretch", "__block", before("__block", "g", "__stretch").alias("__near")).join(stretches, ["g", "__stretch"])
    directory = words.withColumn("__own", before("__word", "g", "__block")).join(blocks.drop("__stretch"), ["g", "__block"])
    directory = stored(directory.select("g", "__word", "__bits", "__rows", (F.col("__far") + F.col("__near") + F.col("__own")).alias("__before"), "n"), "directory")

    at = keyed.join(directory.hint("shuffle_hash"), ["g", "__word"])
    below = F.bit_count(F.expr("__bits & ~shiftleft(-1L, __bit)"))
    single = F.col("__rows") == F.bit_count("__bits")
    internal = ["__word", "__bit", "__bits", "__rows", "__before"]
    ranked = at.where(single).withColumn("pos", F.col("__before") + below).drop(*internal)
    if not directory.where(~single).isEmpty():
        # Words with a repeated doc_id: ranks by doc_id, then by slices of the leaf.
        shared = at.where(~single).withColumn("__slice", F.substring("leaf", 1, 3))
        spot = ["g", "__word", "__bit", "__slice"]
        counts = shared.groupBy(*spot).agg(F.count("*").alias("__rows"))
        ahead = F.sum("__rows").over(Window.partitionBy("g", "__word").orderBy("__bit", "__slice").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(*spot, F.coalesce(ahead, F.lit(0)).alias("__ahead"))
        number = F.row_number().over(Window.partitionBy(*spot).orderBy("leaf")) - 1
        placed = shared.join(counts, spot).withColumn("pos", F.col("__before") + F.col("__ahead") + number)
        ranked = ranked.unionByName(placed.drop(*internal, "__slice", "__ahead"))
    ranked = stored(ranked.withColumn("pos", F.col("pos").cast("long")), "ranked")
    discard(words, directory)
    return ranked


def levels(nodes: DataFrame, plan: TreePlan) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level from below: g, pos, n, height, kids, h; the last node of each group: g, height, h).

    nodes: g, pos, n, h; pos and n in a run are the parent's.
    """
    runs: list[DataFrame] = []
    ends = nodes.where("n = 1").select("g", F.lit(0).alias("height"), "h")
    most = nodes.agg(F.max("n")).first()[0] or 0
    up = lambda c: F.shiftright(c, plan.fan_bits)
    while most > 1:
        slot = F.struct(F.col("pos").bitwiseAND(F.lit((1 << plan.fan_bits) - 1)).alias("slot"), "h")
        run = nodes.where("n > 1").groupBy("g", up("pos").alias("pos")).agg(F.first(up(F.col("n") - 1) + 1).alias("n"), F.array_sort(F.collect_list(slot)).alias("kids"))
        run = stored(run.withColumn("h", sha(F.array_join("kids.h", ""))).withColumn("height", F.lit(len(runs) + 1)), "level")
        runs.append(run)
        ends = ends.unionByName(run.where("n = 1").select("g", "height", "h"))
        nodes = run.select("g", "pos", "n", "h")
        most = (most - 1 >> plan.fan_bits) + 1
    return runs, ends


PATH = "array<struct<l:string,r:string>>"


def paths(runs: list[DataFrame], ends: DataFrame, plan: TreePlan) -> DataFrame:
    """(g, pos, subroot, path) of every node of the lowest level: its siblings left and right, level by level upwards.

    ends: g, height, h, and path, the siblings from the group's last node on.
    """
    at = lambda height: ends.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("pos"), F.col("h").alias("subroot"), "path")
    above = at(len(runs))
    for k in range(len(runs) - 1, -1, -1):
        hashes = F.col("kids.h")
        side = lambda x, i: F.struct(x["slot"].alias("slot"), F.array_join(F.slice(hashes, F.lit(1), i), "").alias("l"), F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "").alias("r"))
        each = runs[k].select("g", "pos", F.transform("kids", side).alias("kids")).join(above, ["g", "pos"])
        each = each.select("g", "pos", "subroot", "path", F.explode("kids").alias("kid"))
        own = F.array(F.struct("kid.l", "kid.r"))
        below = each.select("g", (F.shiftleft("pos", plan.fan_bits) + F.col("kid.slot")).alias("pos"), "subroot", F.concat(own, "path").alias("path"))
        above = below.unionByName(at(k))
    return above


def build_manifest(docs: DataFrame, tampered: Column, plan: TreePlan = TreePlan()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    tampered: the text as it is found when proofs are verified (over the columns
    of docs); its leaf is folded with the proof's siblings and held against the root.
    """
    fields = [F.col(c) for c in FIELDS]
    g = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    found = F.when(tampered.eqNullSafe(F.col("text")), F.col("leaf")).otherwise(leaf_of([*fields[:-1], tampered]))
    rows = docs.select(*FIELDS).withColumn("leaf", leaf_of(fields)).select("doc_id", g.alias("g"), "leaf", found.alias("found"))
    leaves = with_ranks(stored(rows, "leaves"))
    runs, ends = levels(leaves.select("g", "pos", "n", F.col("leaf").alias("h")), plan)
    ends = stored(ends, "subroots")
    order = F.row_number().over(Window.orderBy(F.col("g").cast("binary"))) - 1
    numbered = stored(ends.select(F.lit("").alias("g"), order.cast("long").alias("pos"), F.count("*").over(Window.partitionBy()).alias("n"), "h", F.col("g").alias("of")), "numbered")
    top, last = levels(numbered.select("g", "pos", "n", "h"), plan)
    whole = last.first()
    root = F.lit(whole["h"] if whole else None).cast("string")
    to_root = paths(top, last.withColumn("path", F.array().cast(PATH)), plan)
    to_root = to_root.join(numbered.select("pos", "of"), "pos").select(F.col("of").alias("g"), "path")
    proofs = paths(runs, stored(ends.join(to_root, "g"), "to_root"), plan)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    folded = F.aggregate("path", F.col("found"), lambda h, s: sha(F.concat(s["l"], h, s["r"])))
    out = leaves.join(proofs, ["g", "pos"]).select("doc_id", "leaf", "subroot", root.alias("root"), sha(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased_third(docs_text: str = "text", doc_id: str = "doc_id") -> Column:
    """The contract's tampering: where 3 divides the crc32 of the doc_id, A-Z in lower case."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return F.when(F.coalesce(hit, F.lit(False)), lower_ascii(F.col(docs_text))).otherwise(F.col(docs_text))
