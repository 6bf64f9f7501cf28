"""Access rules, catalogue counts, set operations and document upkeep as joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 60_000
#: Pairs that a task makes of two tables, and such tasks at most.
TASK_PAIRS, MOST_PARTS = 20_000_000, 20_000


def visible_documents(docs: DataFrame, user: int, is_superadmin: bool = False) -> DataFrame:
    """Drafts are seen by their creator only; a superadmin sees all."""
    return docs if is_superadmin else docs.where((F.col("status") != "draft") | (F.col("created_by") == user))


def _parts(docs: DataFrame, n: int) -> int:
    """Tasks over docs that are to be paired with n rows each, so that a task makes some TASK_PAIRS; at least one for each core."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-docs.count() * n // TASK_PAIRS)))


def document_actions(docs: DataFrame, users: DataFrame) -> DataFrame:
    """What each user may do with each document of theirs, and superadmins with all (user, doc pairs are given)."""
    who = users.select(F.col("user_id").alias("uid"), "is_superadmin")
    owned = docs.join(who.where("not coalesce(is_superadmin, false)"), F.col("created_by") == F.col("uid"))
    chiefs, columns = who.where("is_superadmin"), ["doc_id", "created_by", "status"]
    n = chiefs.count()
    chiefs = F.broadcast(chiefs) if n <= BROADCAST_ROWS else chiefs
    # Superadmins see all documents: the result itself.  Few documents are a small table that would stay in one task.
    pairs = owned.select(*columns, "uid", "is_superadmin").unionByName(docs.select(*columns).repartition(_parts(docs, n)).crossJoin(chiefs))
    owner = F.coalesce(F.col("created_by") == F.col("uid"), F.lit(False))
    open_doc = owner | (F.col("status") != "draft")
    return pairs.select("uid", "doc_id", (F.col("is_superadmin") | open_doc).alias("can_read"), (F.col("is_superadmin") | open_doc).alias("can_update"), (F.col("is_superadmin") | owner).alias("can_delete"))


def catalog_status_filter(docs: DataFrame, mode: str) -> DataFrame:
    """any, inactive, not_ready, or a status; drafts never."""
    status, active = F.col("status"), F.col("is_active")
    rule = {"any": active, "inactive": ~active, "not_ready": active & (status != "ready")}.get(mode, active & (status == mode))
    return docs.where(rule & (status != "draft"))


def catalog_term_filter(docs: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Each term's characters occur in this order in one of the columns, whatever the case."""
    for term in terms:
        letters = [c for c in term[:96] if c.isalnum()]
        if not letters:
            continue
        pattern = "(?is)" + ".*".join(f"\\Q{c}\\E" for c in letters)
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c), F.lit("")).rlike(pattern)
        docs = docs.where(hit)
    return docs


def documents_with_first_chunk(docs: DataFrame, chunks: DataFrame, limit: int = 2000) -> DataFrame:
    first = chunks.where("chunk_index = 0").select("doc_id", "kb_id", F.col("id").alias("first_chunk"))
    return docs.where((F.col("status") == "ready") & F.col("is_active")).join(first, ["doc_id", "kb_id"], "left").orderBy("doc_id").limit(limit)


def accessible_kb(users: DataFrame, roles: DataFrame, role_kb: DataFrame, kb: DataFrame) -> DataFrame:
    """(user_id, kb_id): all for superadmins and roles of scope all, the role's own for `selected`."""
    joined = users.join(roles, "role_id", "left")
    wide = joined.where(F.col("is_superadmin") | (F.col("scope_mode") == "all")).select("user_id")
    bases = kb.select("kb_id")
    everything = wide.crossJoin(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases)  # all pairs are the result
    own = joined.where(~F.col("is_superadmin") & (F.col("scope_mode") == "selected")).join(role_kb, "role_id").join(kb.select("kb_id"), "kb_id", "left_semi").select("user_id", "kb_id")
    return everything.unionByName(own).distinct()


def missing_ids(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(existing, key, "left_anti")


def revalidate_sources(snapshots: DataFrame, chunks: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """Cited chunks (conv, pos, id) that are still visible, in first-seen order, scores reset."""
    ready = docs.where((F.col("status") == "ready") & F.col("is_active")).select("doc_id", "kb_id")
    live = chunks.join(ready, ["doc_id", "kb_id"], "left_semi").select("id")
    kept = snapshots.join(live, "id", "left_semi").groupBy("conv", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("conv").orderBy("pos", "id")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("score", F.lit(0.0))


def kb_document_counts(kb: DataFrame, docs: DataFrame, user: int) -> DataFrame:
    counted = visible_documents(docs, user).groupBy("kb_id").agg(F.count("*").alias("n"))
    return kb.join(counted, "kb_id", "left").select("kb_id", "name", F.coalesce("n", F.lit(0)).alias("documents"))


def catalog_group(docs: DataFrame, by: str) -> DataFrame:
    """by: kb_id, file_type or status (inactive wins over a status)."""
    label = F.when(~F.col("is_active"), "inactive").otherwise(F.col("status")) if by == "status" else F.col(by).cast("string")
    return docs.where("status <> 'draft'").groupBy(label.alias("label")).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "label")))


def distinct_tags(docs: DataFrame) -> DataFrame:
    return docs.select("kb_id", F.explode("tags").alias("tag")).where("tag <> ''").distinct()


def scoped_chunk_stats(docs: DataFrame, most: int = 1200, most_of_one: int = 600) -> DataFrame:
    n = F.greatest(F.coalesce("chunk_count", F.lit(0)), F.lit(0))
    out = docs.groupBy("kb_id").agg(F.sum(n).alias("total"), F.max(n).alias("largest"))
    return out.withColumn("exact_only", (F.col("total") > most) | (F.col("largest") > most_of_one))


def small_documents(docs: DataFrame, chunks: DataFrame, most_chunks: int = 30, most_chars: int = 16_000) -> DataFrame:
    own = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("content")).alias("chars"))
    return docs.where((F.col("status") == "ready") & F.col("is_active")).select("doc_id").join(own, "doc_id").where((F.col("n_chunks") <= most_chunks) & (F.col("chars") <= most_chars))


def replace_document_chunks(current: DataFrame, incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """Incoming chunks (with revision) replace all chunks of their document, unless its revision has moved on."""
    valid = incoming.join(docs.select("doc_id", F.col("processing_revision").alias("revision")), ["doc_id", "revision"], "left_semi").drop("revision")
    return current.join(valid.select("doc_id").distinct(), "doc_id", "left_anti").select(valid.columns).unionByName(valid)


def with_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with chunk_count as the chunks have it after a replacement; 0 without any."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("__size"))
    return docs.drop("chunk_count").join(sizes, "doc_id", "left").withColumn("chunk_count", F.coalesce("__size", F.lit(0)).cast("long")).drop("__size")


def latest_page(df: DataFrame, page: int, size: int) -> DataFrame:
    return df.orderBy(F.col("started_at").desc(), F.col("trace_id").desc()).offset((page - 1) * size).limit(size)


# --- structure of documents


def adjacent_chunks(seeds: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Neighbours by chunk_index in the seed's document, the seed itself not."""
    steps = F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])
    near = seeds.select(F.col("id").alias("seed"), "doc_id", F.col("chunk_index").alias("at"), F.explode(steps).alias("step"))
    near = near.select("seed", "doc_id", (F.col("at") + F.col("step")).alias("chunk_index"), F.abs("step").alias("distance"))
    return near.join(chunks.select("id", "doc_id", "chunk_index"), ["doc_id", "chunk_index"])


def same_section_neighbors(seeds: DataFrame, chunks: DataFrame, n: int = 2) -> DataFrame:
    """The n nearest before and n after in the seed's section, then the n nearest of these."""
    s = seeds.select(F.col("id").alias("seed"), "doc_id", "section_key", F.col("chunk_index").alias("at"))
    pairs = s.join(chunks.select("id", "doc_id", "section_key", "chunk_index"), ["doc_id", "section_key"]).where("id <> seed")
    pairs = pairs.withColumn("side", F.signum(F.col("chunk_index") - F.col("at"))).withColumn("distance", F.abs(F.col("chunk_index") - F.col("at")))
    side = Window.partitionBy("seed", "side").orderBy("distance", "chunk_index", "id")
    pairs = pairs.withColumn("r", F.row_number().over(side)).where(F.col("r") <= n)
    both = Window.partitionBy("seed").orderBy("distance", "chunk_index", "id")
    return pairs.withColumn("r", F.row_number().over(both)).where(F.col("r") <= n).select("seed", "id", "doc_id", "chunk_index", "distance")


def table_siblings(seeds: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Parts of the seed's table next to its own part."""
    steps = F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])
    near = seeds.where("table_id is not null").select(F.col("id").alias("seed"), "table_id", F.col("table_part_index").alias("at"), F.explode(steps).alias("step"))
    near = near.select("seed", "table_id", (F.col("at") + F.col("step")).alias("table_part_index"), F.abs("step").alias("distance"))
    return near.join(chunks.select("id", "doc_id", "chunk_index", "table_id", "table_part_index"), ["table_id", "table_part_index"]).where("id <> seed").select("seed", "id", "doc_id", "chunk_index", "distance")


def structural_neighbors(seeds: DataFrame, chunks: DataFrame, total: int = 12) -> DataFrame:
    """Table siblings, section and adjacent neighbours as one list: each chunk once, with its best origin and all of them."""
    kinds = (("table_sibling", table_siblings(seeds, chunks)), ("same_section", same_section_neighbors(seeds, chunks)), ("adjacent", adjacent_chunks(seeds, chunks)))
    rows = None
    for i, (name, df) in enumerate(kinds):
        part = df.select("seed", "id", "doc_id", "chunk_index", "distance", F.lit(i).alias("priority"), F.lit(name).alias("origin"))
        rows = part if rows is None else rows.unionByName(part)
    near = Window.partitionBy("doc_id").orderBy("priority", "seed", "distance", "chunk_index", "id")
    few = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= min(24, 3 * total))
    merged = few.groupBy("doc_id", "id", "chunk_index").agg(F.min("priority").alias("best"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "origin", "seed", "distance"))), ",").alias("origins"))
    order = Window.partitionBy("doc_id").orderBy("best", "chunk_index", "id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total)


def complete_documents(chunks: DataFrame) -> DataFrame:
    """All of 0 .. N-1 are there, where N is the one declared number of parts."""
    return chunks.groupBy("doc_id").agg(
        (F.coalesce((F.count_distinct("declared") == 1) & (F.count("*") == F.max("declared")) & (F.count_distinct("chunk_index") == F.max("declared")) & (F.min("chunk_index") == 0) & (F.max("chunk_index") == F.max("declared") - 1), F.lit(False))).alias("complete")
    )


def render_document(chunks: DataFrame, most_chars: int = 2000) -> DataFrame:
    """Chunks in order as one text, a section's heading once; cut at a length, and whether it was."""
    first = F.row_number().over(Window.partitionBy("doc_id", "section_key").orderBy("chunk_index", "id")) == 1
    parts = chunks.withColumn("part", F.when(first, F.concat(F.lit("# "), "section_key", F.lit("\n\n"), "content")).otherwise(F.col("content")))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "part"))), lambda x: x["part"]), "\n\n").alias("t"))
    return whole.select("doc_id", F.substring("t", 1, most_chars).alias("text"), (F.char_length("t") > most_chars).alias("truncated"))
