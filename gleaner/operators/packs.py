"""Composed retrieval: records, scoped search, evidence packs, expansion, bridges and scope groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import catalog as C
from gleaner.operators import retrieval as R
from gleaner.operators import scan
from gleaner.operators.components import components
from gleaner.operators.telemetry import greedy_budget
from gleaner.session import stored

#: What a question is wrapped in, and words too general to search for.
FILLER_PREFIXES = ["请帮我", "麻烦帮我", "我想知道", "我想了解", "我想问", "请问", "如何解决", "怎么解决", "解决", "如何", "怎么", "怎样", "我是", "我用的是", "当前是"]
FILLER_SUFFIXES = ["应该怎么配置", "要怎么配置", "怎么配置", "如何配置", "要配置什么", "配置什么", "怎么办", "是什么", "可以吗", "吗"]
GENERIC_TERMS = ["请问", "帮我", "麻烦", "如何", "怎么", "怎样", "什么", "配置", "问题", "解决", "现在", "当前", "要配置什么", "配置什么", "怎么配置", "如何配置", "应该怎么配置"]

#: Chunks of a scope, and of one of its documents, up to which the vector and trigram channels read it.
SCOPE_CHUNKS, SCOPE_DOCUMENT_CHUNKS = 1200, 600


def query_terms(query: Column, most: int = 16) -> Column:
    """Search terms of a question: whole, unwrapped, its words and tokens; distinct whatever the case, in order."""
    plain = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    base = F.concat(F.array(F.substring(plain, 1, 96)), F.split(plain, " "), F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.:+/\-]*|[\x{3400}-\x{9fff}]{2,}"), F.lit(0)))

    def bare(t: Column) -> Column:
        t = F.regexp_replace(t, r"^[ \t\r\n，。！？；：,.!?;:()（）\[\]【】\"']+|[ \t\r\n，。！？；：,.!?;:()（）\[\]【】\"']+$", "")
        for _ in range(4):  # a question has few wrappers
            t = F.trim(F.regexp_replace(t, rf"^(?:{'|'.join(FILLER_PREFIXES)})(?=..)", ""))
            t = F.trim(F.regexp_replace(t, rf"(?<=..)(?:{'|'.join(FILLER_SUFFIXES)})$", ""))
        return t

    terms = F.concat(F.slice(base, 1, 1), F.transform(base, bare), base)
    terms = F.transform(terms, lambda t: F.substring(F.trim(t), 1, 96))
    terms = F.filter(terms, lambda t: (F.char_length(t) >= 2) & ~F.lower(t).isin(GENERIC_TERMS))
    first = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("t"), (F.array_position(F.transform(terms, F.lower), F.lower(t)) == i + 1).alias("first"))), lambda x: x["first"])
    return F.slice(F.transform(first, lambda x: x["t"]), 1, most)


def one_of_each(rows: DataFrame, texts: list[str], key: str, k: int) -> DataFrame:
    """(key, texts, own, place): of rows with equal texts the k first by key, in their place, under the first one's key (own).

    Rows with equal texts score alike, so that ties fall to the first keys: one
    row of them is compared, and no more than k can be among the k best.
    """
    same = Window.partitionBy(*texts).orderBy(key)
    few = rows.select(key, *texts).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k)
    return few.withColumn("own", F.first(key).over(same))


def search_records(queries: DataFrame, records: DataFrame, k: int = 20, least: float = 0.18, own: DataFrame | None = None) -> DataFrame:
    """Records (id, doc_id, subject, search_text) like the query, or holding all of its words; only each query's own (query_id, id) where these are given.

    Equal queries and equal texts are compared once.  The k best of a query are
    among the k best texts, and of each text among its k first records.
    """
    if own is not None:
        return _search_own(queries, records, k, least, own)
    asked = stored(queries.select("query_id", "query").withColumn("q", F.min("query_id").over(Window.partitionBy("query"))), "asked")
    held = stored(one_of_each(records, ["search_text", "subject"], "id", k), "texts")
    once, texts = asked.where("query_id = q").select("query_id", "query").distinct(), held.where("place = 1")
    rows = scan.record_candidates(once, texts, k, least)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    first = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = first(rows.withColumnRenamed("query_id", "q")).select("q", F.col("id").alias("own"), "score", "all_words")
    best = first(best.join(held.select("id", "own"), "own").drop("own"))
    return asked.select("query_id", "q").join(best, "q").select("query_id", "id", "score", "all_words", "rank")


def _search_own(queries: DataFrame, records: DataFrame, k: int, least: float, own: DataFrame) -> DataFrame:
    """search_records() among each query's own records: these pairs alone are made, and equal ones compared once."""
    pairs = own.select("query_id", "id").distinct().join(queries.select("query_id", "query"), "query_id").join(records.select("id", "search_text", "subject"), "id")
    names = ["query", "search_text", "subject"]
    shared = lambda c: F.coalesce(F.size(F.array_intersect("g", R.trigrams(F.col(c)))), F.lit(0))
    once = pairs.select(*names).distinct().withColumn("g", R.trigrams(F.col("query"))).where(F.size("g") > 0).withColumn("m", shared("search_text")).where("m > 0")
    score = F.round(F.greatest(F.col("m"), shared("subject")) / F.size("g"), 6)
    asked = F.array_distinct(R.words(F.col("query")))
    scored = once.select(*names, score.alias("score"), (F.size(F.array_except(asked, R.words(F.col("search_text")))) == 0).alias("all_words")).where((F.col("score") >= least) | F.col("all_words"))
    scored = scored.select(*[F.col(c).alias(f"__{c}") for c in names], "score", "all_words")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return pairs.join(scored, same).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "all_words", "rank")


def search_within_documents(queries: DataFrame, chunks: DataFrame, scope: DataFrame, per_document: int = 4, total: int = 12) -> DataFrame:
    """Hybrid search in each query's own documents (query_id, doc_id); large scopes keep the keyword channel only."""
    pool = min(48, max(16, 4 * total))
    own = scope.select("query_id", "doc_id").distinct()
    sizes = own.join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").groupBy("query_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    exact = own.join(sizes.where((F.col("n") <= SCOPE_CHUNKS) & (F.col("most") <= SCOPE_DOCUMENT_CHUNKS)), "query_id", "left_semi")
    terms = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    inside = {
        "vector": R.vector_candidates(queries, chunks, pool, exact),
        "keyword": R.keyword_candidates(queries, chunks, pool, scope=own),
        "trigram": R.trigram_candidates(terms, chunks, pool, scope=exact),
    }
    fused = R.fuse({n: R.channel_rank(c) for n, c in inside.items()})
    few = fused.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "best_rank", "chunk_index", "id"))).where(F.col("r") <= per_document)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "best_rank", "doc_id", "chunk_index", "id")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).drop("r")


def evidence_pack(
    queries: DataFrame, chunks: DataFrame, records: DataFrame, k: int = 10, selected: int = 6,
    search_chunks: Callable[[DataFrame, DataFrame, int], DataFrame] = R.hybrid_search, search_facts: Callable[[DataFrame, DataFrame, int], DataFrame] = search_records,
    admit: Callable[[DataFrame], DataFrame] = R.admit_documents, verify: Callable[[DataFrame], DataFrame] | None = None,
    doc_ids: DataFrame | None = None, record_ids: DataFrame | None = None,
) -> DataFrame:
    """One row a query: what was found, admitted and selected, the outcome and its reason.

    Records and chunks are fused, allow-lists (doc_id; id of records, which
    leaves no chunk) restrict the fused list, and admission judges what is left:
    chunks by their document, records by their score.  The searches, the
    admission rule and a verifier (rows in, rows out) are the caller's to replace.
    """
    found = stored(search_chunks(queries, chunks, k), "found")
    facts = search_facts(queries, records, k).join(records.select("id", "doc_id"), "id").select("query_id", F.concat(F.lit("r"), "id").alias("item"), F.col("id").cast("string").alias("id"), "doc_id", "rank", "score")
    items = facts.select("query_id", F.lit("1 records").alias("source"), F.col("rank").alias("pos"), "item")
    items = items.unionByName(found.select("query_id", F.lit("2 chunks").alias("source"), F.col("fusion_rank").alias("pos"), F.concat(F.lit("c"), "id").alias("item")))
    fused = stored(R.fuse_sources(items, 2 * k), "fused")
    chunk_rows = found.withColumn("item", F.concat(F.lit("c"), "id")).join(fused.select("query_id", "item"), ["query_id", "item"], "left_semi")
    fact_rows = facts.join(fused.select("query_id", "item"), ["query_id", "item"], "left_semi")
    chunk_rows, fact_rows = R.restrict_to_ids(chunk_rows, doc_ids), R.restrict_to_ids(fact_rows, doc_ids)
    if record_ids is not None:
        chunk_rows, fact_rows = chunk_rows.limit(0), fact_rows.join(record_ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    judged = R.admit_candidates(chunk_rows.drop("id").withColumnRenamed("item", "id"), admit(R.document_relevance(chunk_rows)), fact_rows.select("query_id", F.col("item").alias("id"), "doc_id", F.col("score").alias("structured_score")))
    rows = judged.select("query_id", F.col("id").alias("item"), "source_kind", (F.col("admission_status") == "admitted").alias("ok"), "admission_reason").join(fused, ["query_id", "item"])
    rows = rows if verify is None else verify(rows)
    ranked = rows.withColumn("n", F.when(F.col("ok"), F.sum(F.col("ok").cast("int")).over(Window.partitionBy("query_id").orderBy("fusion_rank"))))
    own = ranked.groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.sum(F.col("ok").cast("long")).alias("admitted"), F.bool_or(F.col("ok") & (F.col("source_kind") == "record")).alias("by_record"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= selected, F.struct("n", "item")))), lambda x: x["item"]), ",").alias("selected"),
    )
    out = queries.select("query_id").join(own, "query_id", "left")
    outcome = F.when(F.col("candidates").isNull(), "no_hit").when(F.col("admitted") == 0, "insufficient_evidence").otherwise("answered")
    reason = F.when(F.col("candidates").isNull(), "no_candidates").when(F.col("admitted") == 0, "no_candidate_met_admission_gate").when(F.col("by_record"), "structured_or_document_evidence_admitted").otherwise("document_evidence_admitted")
    return out.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("selected", F.lit("")).alias("selected"), outcome.alias("outcome"), reason.alias("reason"))


def search_records_for_chunks(queries: DataFrame, chosen: DataFrame, records: DataFrame, k: int = 20) -> DataFrame:
    """The best records of each query's chosen chunks (query_id, chunk_id), without a threshold."""
    own = records.select("id", "chunk_id").join(chosen.select("query_id", "chunk_id").distinct(), "chunk_id")
    hits = search_records(queries, records, k, 0.0, own)
    return hits.join(records.select("id", "chunk_id"), "id").select("query_id", "chunk_id", "id", "score", F.col("rank").alias("place"))


def second_stage_records(queries: DataFrame, chosen: DataFrame, records: DataFrame, k: int = 8, most_chunks: int = 2, most: int = 12) -> DataFrame:
    """Records of each query's first chosen chunks (query_id, chunk_id, pos), fused with these chunks."""
    first = Window.partitionBy("query_id").orderBy("pos", "chunk_id")
    few = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most_chunks)
    facts = search_records_for_chunks(queries, few, records, min(most, max(8, k)))
    items = facts.select("query_id", F.lit("1 records").alias("source"), F.col("place").alias("pos"), F.concat(F.lit("r"), "id").alias("item"))
    items = items.unionByName(few.select("query_id", F.lit("2 chunks").alias("source"), F.col("n").alias("pos"), F.concat(F.lit("c"), "chunk_id").alias("item")))
    return R.fuse_sources(items, most).select("query_id", "item", "score", F.col("fusion_rank").alias("place"))


def _per_query(df: DataFrame, *columns: str) -> DataFrame:
    """Keys made the query's own, so that rows of different queries never meet."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.concat_ws("/", F.col("query_id"), F.col(c))))
    return df


def expand_evidence(queries: DataFrame, seeds: DataFrame, chunks: DataFrame, docs: DataFrame, most: int = 12, joint: int = 30, most_chars: int = 16_000) -> DataFrame:
    """What is added to each query's seeds (query_id, id, pos): whole small documents of the seeds, hits within
    their documents, and structural neighbours, each chunk once, as many as fit.

    Up to four seeds of three documents count; whole documents come first and have
    no limit of their own, the rest is `most` rows; with the seeds, `joint` in all.
    """
    rows = seeds.select("query_id", "id", "pos").join(chunks.drop("embedding"), "id")
    first = Window.partitionBy("query_id").orderBy("doc_at", "pos", "id")
    rows = rows.withColumn("doc_at", F.min("pos").over(Window.partitionBy("query_id", "doc_id"))).withColumn("doc_n", F.dense_rank().over(Window.partitionBy("query_id").orderBy("doc_at", "doc_id")))
    own = stored(rows.where("doc_n <= 3").withColumn("n", F.row_number().over(first)).where("n <= 4"), "seeds")
    scope = own.select("query_id", "doc_id").distinct()

    small = scope.join(C.small_documents(docs, chunks).select("doc_id"), "doc_id", "left_semi")
    whole = small.join(chunks.select("doc_id", "id", "chunk_index"), "doc_id").select("query_id", "id", F.lit(0).alias("stage"), F.struct(F.col("doc_id").cast("string").alias("a"), F.col("chunk_index").cast("long").alias("b")).alias("at"))
    hits = search_within_documents(queries, chunks, scope).select("query_id", "id", F.lit(1).alias("stage"), F.struct(F.lit("").alias("a"), F.col("place").cast("long").alias("b")).alias("at"))
    around = scope.join(chunks.drop("embedding", "content"), "doc_id").withColumn("chunk", F.col("id"))
    near = C.structural_neighbors(_per_query(own, "id", "doc_id", "table_id"), _per_query(around, "id", "doc_id", "table_id"), most)
    near = near.join(_per_query(around, "id").select("id", "query_id", "chunk"), "id").select("query_id", F.col("chunk").alias("id"), F.lit(2).alias("stage"), F.struct(F.col("doc_id").cast("string").alias("a"), F.col("place").cast("long").alias("b")).alias("at"))

    found = whole.unionByName(hits).unionByName(near).join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = found.groupBy("query_id", "id").agg(F.min(F.struct("stage", "at")).alias("f")).select("query_id", "id", F.col("f.stage").alias("stage"), F.col("f.at").alias("at"))
    sized = once.join(chunks.select("id", "doc_id", F.char_length("content").cast("long").alias("chars")), "id").withColumn("limited", F.col("stage") > 0)
    kept = greedy_budget(sized, "query_id", ["stage", "at", "id"], "chars", most_chars, joint - 4, "limited", most)
    return kept.select("query_id", "id", "doc_id", "stage", "chars", "place")


def bridge_two_hop(queries: DataFrame, records: DataFrame, most: int = 500) -> DataFrame:
    """Questions rewritten with the value of the longest record subject that they name."""
    subjects = records.groupBy(F.lower(F.trim("subject")).alias("s")).agg(F.min("value").alias("value")).where(F.char_length("s") >= 2)
    split = F.split("query", " ")
    starts = queries.select("query_id", "query", F.explode(F.sequence(F.lit(1), F.size(split))).alias("i"))
    spans = starts.select("query_id", "query", F.explode(F.transform(F.sequence(F.lit(1), F.size(split) - F.col("i") + 1), lambda n: F.lower(F.array_join(F.slice(split, F.col("i"), n), " ")))).alias("s"))
    hits = spans.distinct().join(subjects, "s")
    best = hits.groupBy("query_id", "query").agg(F.max_by(F.struct("s", "value"), F.struct(F.char_length("s"), F.col("s"))).alias("b"))
    at = F.instr(F.lower("query"), F.col("b.s"))
    text = F.concat(F.expr("substring(query, 1, instr(lower(query), b.s) - 1)"), F.col("b.value"), F.expr("substring(query, instr(lower(query), b.s) + char_length(b.s))"))
    return best.select("query_id", F.col("b.s").alias("subject"), F.substring(F.when(at > 0, text).otherwise(F.concat_ws(" ", "b.value", "query")), 1, most).alias("query"))


def bridge_retrieve(queries: DataFrame, records: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The second hop: what `search` finds for the rewritten questions, with the subject that led there."""
    bridged = stored(bridge_two_hop(queries, records), "bridged")
    return search(bridged.select("query_id", "query")).join(bridged.select("query_id", "subject"), "query_id")


def _clusters(docs: DataFrame, values: str, within: list[str], name: str) -> DataFrame:
    """docs with `name`: the least document that is linked to theirs by shared values, inside of each outer cluster; null without values."""
    inside = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within]) if within else F.lit("")
    links = docs.select(F.col("doc_id"), inside.alias("inside"), F.explode(values).alias("value")).where("value is not null")
    hubs = links.groupBy("inside", "value").agg(F.min("doc_id").alias("hub"))
    found = components(links.join(hubs, ["inside", "value"]).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    alone = links.select("doc_id").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias(name))
    return docs.join(stored(alone, name), "doc_id", "left")


def scope_groups(docs: DataFrame) -> DataFrame:
    """Scopes of documents (doc_id, products, versions, projects): clusters that share a product, within them a
    version, within these a project, chains included; each is named by its least document.

    A document without values on a level is a companion of all clusters there: its
    name is null, so that it is not copied into each of them.  dimension says what
    tells the scopes apart.
    """
    rows = docs.select("doc_id", "products", "versions", "projects")
    for values, name, outer in (("products", "product_group", []), ("versions", "version_group", ["product_group"]), ("projects", "project_group", ["product_group", "version_group"])):
        rows = _clusters(rows, values, outer, name)
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in ("product_group", "version_group", "project_group")])
    dimension = F.when(F.col("product_group") > 1, "product_version").when(F.col("version_group") > 1, "version").when(F.col("project_group") > 1, "project")
    return rows.select("doc_id", "product_group", "version_group", "project_group").crossJoin(F.broadcast(counts.select(dimension.alias("dimension"))))  # one row


def _attached(rows: DataFrame, values: str, name: str, outer: list[str]) -> DataFrame:
    """rows with `name`, the least doc_id of a cluster of shared values inside of their outer cluster: one row for
    each cluster that a document is in, and for each there is where it has no values (null where there is none)."""
    inside = F.to_json(F.struct(*outer))
    placed = rows.withColumn("inside", inside).withColumn("node", F.concat_ws("|", inside, F.col("doc_id").cast("string")))
    placed = stored(placed, "placed")
    links = placed.select("inside", "node", "doc_id", F.explode(values).alias("value"))
    hubs = links.groupBy("inside", "value").agg(F.min("node").alias("hub"))
    found = components(links.join(hubs, ["inside", "value"]).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    own = links.select("inside", "node", "doc_id").distinct().join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    own = own.select("inside", "doc_id", "node", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias(name))
    own = stored(own.join(least, "component").select("inside", "node", name), "clusters")
    scoped = placed.join(own.drop("inside"), "node")
    shared = placed.where(F.size(values) == 0).join(own.select("inside", name).distinct(), "inside", "left")
    shared = shared.withColumn("shared", F.col("shared") | F.col(name).isNotNull())
    return scoped.unionByName(shared).drop("inside", "node")


def scope_members(docs: DataFrame) -> DataFrame:
    """The scopes that a question's documents (question, doc_id, products, versions, projects) fall into, as a table
    of members: question, product_group, version_group, project_group, doc_id, shared, dimension.

    Documents that share a product form a cluster, chains included; inside of it those that share a version, inside
    of that those that share a project.  A document without values on a level is a companion: it is a member of
    every cluster there (shared), so that no choice between scopes loses it.  dimension says what tells a
    question's scopes apart: the products of its groups, their versions, or else their projects.

    Members grow with a question's clusters times its companions; a question's documents are what its search
    admitted.  Cases: rows of one document are merged; null values, and rows without doc_id, count for nothing; a
    group's name is null where no document of the outer cluster has values; a null question is one of its own.
    """
    levels = ("products", "versions", "projects")
    merged = [F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))).alias(c) for c in levels]
    rows = docs.where("doc_id is not null").groupBy("question", "doc_id").agg(*merged).withColumn("shared", F.lit(False))
    outer = ["question"]
    for values, name in zip(levels, ("product_group", "version_group", "project_group"), strict=True):
        rows = _attached(rows, values, name, outer)
        outer = [*outer, name]
    rows = stored(rows, "members")
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in levels]
    groups = rows.groupBy(*outer).agg(*unions)
    counts = groups.groupBy(F.to_json(F.struct("question")).alias("asked")).agg(
        F.count_distinct("products").alias("p"), F.count_distinct(F.when(F.size("versions") > 0, F.col("versions"))).alias("v"), F.count("*").alias("n"), F.min(F.size("projects")).alias("least")
    )
    dimension = F.when(F.col("p") > 1, "product_version").when(F.col("v") > 1, "version").when((F.col("n") > 1) & (F.col("least") > 0), "project")
    named = rows.withColumn("asked", F.to_json(F.struct("question"))).join(counts.select("asked", dimension.alias("dimension")), "asked")
    return named.select(*outer, "doc_id", "shared", "dimension")


def match_config(queries: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments that a question asks for: by identifier 100, by meaning 50 and more, else by shared pairs of letters."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z_][a-z0-9_.\-]+"), F.lit(0)))
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    q = queries.select("query_id", F.regexp_replace(F.lower("query"), r"\s+", "").alias("q"), tokens(F.col("query")).alias("names"))
    a = assignments.withColumn("m", F.regexp_replace(F.lower(F.coalesce("meaning", F.lit(""))), r"\s+", ""))
    both = a.crossJoin(F.broadcast(q) if queries.count() <= R.BROADCAST_QUERIES else q)
    named = F.array_contains("names", F.col("path")) | F.array_contains("names", F.element_at(F.split("path", r"\."), -1))
    shared = F.size(F.array_intersect(pairs(F.col("m")), pairs(F.col("q"))))
    share = shared / F.size(pairs(F.col("m")))
    score = F.when(named, 100.0).when(F.col("m") == "", 0.0).when(F.col("q").contains(F.col("m")) | F.col("m").contains(F.col("q")), 50.0 + F.char_length("m")).when((shared >= 2) & (share >= 0.4), shared + share).otherwise(0.0)
    scored = both.withColumn("score", F.round(score, 6)).where("score > 0")
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("top", top).where(F.when(F.col("top") >= 50, F.col("score") >= F.col("top")).otherwise(F.col("score") >= F.greatest(F.lit(2.0), F.col("top") - 1))).select("query_id", "path", "value", "score")


def entity_facts(queries: DataFrame, records: DataFrame, most: int = 60) -> DataFrame:
    """Records whose subject or value the question names; equal questions, and records of equal subject and value, are compared once."""
    asked = stored(queries.select("query_id", "query").withColumn("q", F.min("query_id").over(Window.partitionBy("query"))), "asked")
    held = stored(one_of_each(records, ["subject", "value"], "id", most), "facts")
    once = asked.where("query_id = q").select("q", "query").distinct()
    words = once.select("q", F.explode(F.array_distinct(R.words(F.col("query")))).alias("word"))
    keys = held.where("place = 1").select("id", "subject", "value", F.explode(F.array_distinct(F.concat(R.words(F.col("subject")), R.words(F.col("value"))))).alias("word"))
    near = keys.join(words, "word").select("q", "id", "subject", "value").distinct().join(once.select("q", F.lower("query").alias("text")), "q")
    named = near.withColumn("by", F.when(F.col("text").contains(F.lower("subject")), "subject").when(F.col("text").contains(F.lower("value")), "value")).where("by is not null")
    w = Window.partitionBy("q").orderBy("by", "subject", "id")
    first = lambda rows: rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    best = first(named.select("q", "id", "by", "subject")).select("q", F.col("id").alias("own"), "by", "subject")
    best = first(best.join(held.select("id", "own"), "own").drop("own"))
    return asked.select("query_id", "q").join(best, "q").select("query_id", "id", "by", "place")
