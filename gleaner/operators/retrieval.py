"""Hybrid ranked retrieval of whole tables of queries: vector, keyword and trigram channels, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries up to this many are broadcast; beyond, they are taken in blocks or shuffled.
BROADCAST_QUERIES = 20_000
#: Candidates that a task holds for all queries of a block.
TASK_CANDIDATES = 1_000_000
#: The words or trigrams of up to this many queries are broadcast (some 200 rows each); beyond, both sides are shuffled.
BROADCAST_TERMS = 2_000
RRF_OFFSET = 60
CHUNKS_PER_DOCUMENT = 6
#: Fixed value: stands for a rank that a channel does not give.
NO_RANK = 2147483647


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def pool_size(k: int) -> int:
    """Candidates of each channel for a wanted k."""
    return min(max(8 * k, 40), 240)


def visible_chunks(chunks: DataFrame, docs: DataFrame, kb_ids: list[int] | None = None) -> DataFrame:
    """Chunks of ready, active documents, in the allowed knowledge bases (None: all)."""
    allowed = docs.where((F.col("status") == "ready") & F.col("is_active")).select("doc_id", "kb_id")
    if kb_ids is not None:
        allowed = allowed.where(F.col("kb_id").isin(kb_ids))
    return chunks.join(allowed, ["doc_id", "kb_id"], "left_semi")


def embeddable_chunks(chunks: DataFrame, docs: DataFrame, kb_ids: list[int] | None = None) -> DataFrame:
    return visible_chunks(chunks, docs, kb_ids).where(F.col("embedding").isNotNull())


def chunk_document_join(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id", "kb_id", "filename", "status"), ["doc_id", "kb_id"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def few_terms(terms: DataFrame, n_queries: int) -> DataFrame:
    return F.broadcast(terms) if n_queries <= BROADCAST_TERMS else terms


def best_first(*score: str) -> list[Column]:
    """The total order of all ranked results."""
    return [F.col(s).desc() for s in score] + [F.col("doc_id"), F.col("chunk_index"), F.col("id")]


def top_k(df: DataFrame, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*best_first(score))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(pairs: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Pairs of a query and a chunk in the query's own documents (query_id, doc_id); no scope: all."""
    return pairs if scope is None else pairs.join(scope, ["query_id", "doc_id"], "left_semi")


def unit(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def vector_candidates(queries: DataFrame, chunks: DataFrame, pool: int, scope: DataFrame | None = None, oversample: int = 4) -> DataFrame:
    """(query_id, id, doc_id, chunk_index, score): the pool nearest chunks by cosine, in a scope of distinct rows if there is one.

    Without a scope, queries come in blocks of a bounded size to the vectors:
    one-byte components choose `oversample` times the pool in each batch, full
    precision orders them, and each task passes its best pool on.
    """
    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    held = chunks.where(F.col("embedding").isNotNull()).select("id", "doc_id", "chunk_index", "embedding")
    if scope is not None:
        left = asked.withColumn("qn", unit(F.col("query_vec")))
        both = held.withColumn("cn", unit(F.col("embedding"))).join(scope.select("query_id", "doc_id"), "doc_id").join(left, "query_id")
        scored = both.select("query_id", "id", "doc_id", "chunk_index", F.round(dot(F.col("query_vec"), F.col("embedding")) / (F.col("qn") * F.col("cn")), 6).alias("score"))
        return top_k(scored, pool).drop("rank")
    n, most = asked.count(), max(64, TASK_CANDIDATES // (oversample * pool))
    blocks = max(1, -(-n // most))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        near = _nearest_in_tasks(part, held, pool, oversample)
        found = near if found is None else found.unionByName(near)
    return top_k(found, pool).drop("rank")


def _nearest_in_tasks(asked: DataFrame, held: DataFrame, pool: int, oversample: int) -> DataFrame:
    kinds = {n: asked.schema["query_id"].dataType if n == "query_id" else held.schema[n].dataType for n in ("query_id", "id", "doc_id", "chunk_index")}
    by_size: dict[int, list] = {}
    for r in asked.collect():  # one block of a bounded size
        by_size.setdefault(len(r[1]), []).append(r)
    shared = held.sparkSession.sparkContext.broadcast([([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)) for n, rows in by_size.items() if n])
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", score double"
    arrow = {n: to_arrow_type(t) for n, t in kinds.items()}

    def bytes_of(x: np.ndarray) -> np.ndarray:
        return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.float32)

    def better(best: list | None, b: pa.RecordBatch, q: np.ndarray) -> list | None:
        """The pool of each query after one more batch; vectors of another dimension are not compared."""
        b = b.take(pa.array(np.flatnonzero(np.asarray(b.column("embedding").value_lengths()) == q.shape[1])))
        if not b.num_rows:
            return best
        codes, q_norm = bytes_of(q), np.linalg.norm(q, axis=1)
        codes = codes / np.maximum(np.linalg.norm(codes, axis=1, keepdims=True), 1e-30)
        x = np.asarray(b.column("embedding").flatten(), dtype=np.float64).reshape(-1, q.shape[1])
        low = bytes_of(x)
        near = codes @ (low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-30)).T
        m = min(len(x), oversample * pool)
        at = np.argpartition(-near, m - 1, axis=1)[:, :m].ravel()
        who = np.repeat(np.arange(len(q)), m)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(np.einsum("ij,ij->i", q[who], x[at]) / (q_norm[who] * np.linalg.norm(x, axis=1)[at]), 6)
        meta = [np.asarray(b.column(n))[at] for n in ("doc_id", "chunk_index", "id")]
        rows = [who, score, *meta] if best is None else [np.concatenate(p) for p in zip(best, [who, score, *meta], strict=True)]
        rows = [r[~np.isnan(rows[1])] for r in rows]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        first = np.searchsorted(rows[0][order], rows[0][order], side="left")
        order = order[np.arange(len(order)) - first < pool]
        return [r[order] for r in rows]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list | None] = [None] * len(shared.value)
        for b in batches:
            best = [better(held, b, q) for held, (_, q) in zip(best, shared.value, strict=True)]
        for found, (ids, _) in zip(best, shared.value, strict=True):
            if found is not None:
                who, score, doc, place, own = found
                yield pa.RecordBatch.from_arrays([pa.array([ids[w] for w in who], arrow["query_id"]), pa.array(own, arrow["id"]), pa.array(doc, arrow["doc_id"]), pa.array(place, arrow["chunk_index"]), pa.array(score)], [*kinds, "score"])

    return held.mapInArrow(search, schema)


def words(text: Column) -> Column:
    """Lower-case words: letters and digits, others separate."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def inverted_index(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(token, id, doc_id, chunk_index, len, tf) of all words, or of the tokens in `only`."""
    w = chunks.select("id", "doc_id", "chunk_index", words(F.col("content")).alias("w"))
    each = w.select("id", "doc_id", "chunk_index", F.size("w").alias("len"), F.explode("w").alias("token"))
    each = each if only is None else each.join(only, "token", "left_semi")
    return each.groupBy("token", "id", "doc_id", "chunk_index", "len").agg(F.count("*").alias("tf"))


def keyword_candidates(queries: DataFrame, chunks: DataFrame, pool: int, bm25: Bm25 = Bm25(), scope: DataFrame | None = None) -> DataFrame:
    """Chunks that hold all words of the query, by BM25.  Words that no query has go before any shuffle."""
    n_queries = queries.count()
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("token"))
    tokens = asked.select("token").distinct()
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    index = inverted_index(chunks, few_terms(tokens, n_queries))
    stats = chunks.select(F.size(words(F.col("content"))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    scored = within(index.join(few_terms(asked.join(df, "token"), n_queries), "token"), scope).crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (bm25.k1 + 1) / (F.col("tf") + bm25.k1 * (1 - bm25.b + bm25.b * F.col("len") / F.col("avg_len")))
    both = scored.groupBy("query_id", "id", "doc_id", "chunk_index").agg(F.count("*").alias("matched"), F.round(F.sum(part), 6).alias("score"))
    full = both.join(needed, "query_id").where("matched = needed").select("query_id", "id", "doc_id", "chunk_index", "score")
    return top_k(full, pool).drop("rank")


def trigrams(text: Column) -> Column:
    """Distinct 3-character grams of the lower-case words, each padded by two blanks before and one after."""
    return word_trigrams(F.array_distinct(words(text)))


def word_trigrams(distinct_words: Column) -> Column:
    padded = F.transform(distinct_words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def term_weight(term: Column) -> Column:
    return 0.5 + 0.5 * F.least(F.char_length(term), F.lit(12)) / 12


def searched_text(chunks: DataFrame) -> Column:
    """What trigrams are looked up in: the name of the file, where chunks have it, and the content."""
    return F.concat_ws("\n", "filename", "content") if "filename" in chunks.columns else F.col("content")


def trigram_candidates(terms: DataFrame, chunks: DataFrame, pool: int, least: float = 0.12, scope: DataFrame | None = None) -> DataFrame:
    """Best weighted trigram containment of any term (query_id, term) in the chunk's filename and text."""
    grams = terms.select("query_id", "term", trigrams(F.col("term")).alias("g")).where(F.size("g") > 0)
    asked = grams.select("query_id", "term", F.size("g").alias("n"), F.explode("g").alias("gram"))
    held = chunks.select("id", "doc_id", "chunk_index", F.explode(trigrams(searched_text(chunks))).alias("gram"))
    shared = within(held.join(few_terms(asked, terms.count()), "gram"), scope).groupBy("query_id", "term", "n", "id", "doc_id", "chunk_index").agg(F.count("*").alias("m"))
    scored = shared.withColumn("s", F.col("m") / F.col("n") * term_weight(F.col("term")))
    best = scored.groupBy("query_id", "id", "doc_id", "chunk_index").agg(F.round(F.max("s"), 6).alias("score")).where(F.col("score") >= least)
    return top_k(best, pool).drop("rank")


def per_document_rank(cands: DataFrame, n: int = CHUNKS_PER_DOCUMENT, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.col(score).desc(), "chunk_index", "id")
    return cands.withColumn("document_rank", F.row_number().over(w)).where(F.col("document_rank") <= n)


def channel_rank(cands: DataFrame) -> DataFrame:
    """Rank over the whole channel, after the per-document limit."""
    w = Window.partitionBy("query_id").orderBy(*best_first("score"))
    return cands.withColumn("rank", F.row_number().over(w))


def fuse(channels: dict[str, DataFrame]) -> DataFrame:
    """One row for each (query, chunk) of any channel: its scores and ranks, reciprocal-rank sum and best rank."""
    tagged = None
    for name, df in channels.items():
        part = df.select("query_id", "id", "doc_id", "chunk_index", F.lit(name).alias("channel"), "score", "rank")
        tagged = part if tagged is None else tagged.unionByName(part)
    pick = lambda name, col: F.max(F.when(F.col("channel") == name, F.col(col)))
    aggs = [pick(name, col).alias(f"{name}_{col}") for name in channels for col in ("score", "rank")]
    wide = tagged.groupBy("query_id", "id", "doc_id", "chunk_index").agg(*aggs)
    total = sum((F.coalesce(1.0 / (RRF_OFFSET + F.col(f"{name}_rank")), F.lit(0.0)) for name in channels), F.lit(0.0))
    ranks = [F.coalesce(F.col(f"{name}_rank"), F.lit(NO_RANK)) for name in channels]
    return wide.withColumn("score", F.round(total, 9)).withColumn("best_rank", F.least(*ranks) if len(ranks) > 1 else ranks[0])


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 10, vectors: bool = True, index=None) -> DataFrame:
    """The k best chunks of each query over all channels, at most six of a document in each channel and in all.

    index: a stored TextIndex of the same chunks, which spares reading their texts.
    """
    pool = pool_size(k)
    found = {"vector": vector_candidates(queries, chunks, pool)} if vectors else {}
    terms = queries.select("query_id", F.col("query").alias("term"))
    found["keyword"] = keyword_candidates(queries, chunks, pool) if index is None else index.keyword_candidates(queries, pool)
    found["trigram"] = trigram_candidates(terms, chunks, pool) if index is None else index.trigram_candidates(terms, pool)
    fused = fuse({name: channel_rank(per_document_rank(c)) for name, c in found.items()})
    one = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "best_rank", "chunk_index", "id")
    few = fused.withColumn("fused_document_rank", F.row_number().over(one)).where(F.col("fused_document_rank") <= CHUNKS_PER_DOCUMENT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "best_rank", "doc_id", "chunk_index", "id")
    return few.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= k)


def best_of_documents(cands: DataFrame, k: int) -> DataFrame:
    """The best chunk of each document, then the k best of these."""
    return top_k(per_document_rank(cands, 1).drop("document_rank"), k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return best_of_documents(vector_candidates(queries, chunks, pool_size(k)), k)


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return best_of_documents(keyword_candidates(queries, chunks, pool_size(k)), k)


def merge_query_variants(cands: DataFrame, per_document: int, total: int) -> DataFrame:
    """Results of several phrasings of a query (variant) as one: best score and rank, variants that found it."""
    merged = cands.groupBy("query_id", "id", "doc_id", "chunk_index").agg(
        F.max("score").alias("score"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("variant")).alias("variants")
    )
    merged = merged.withColumn("n_variants", F.size("variants"))
    order = [F.col("score").desc(), F.col("n_variants").desc(), F.col("doc_id"), F.col("chunk_index"), F.col("id")]
    kept = merged.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).where(F.col("r") <= per_document)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= total).drop("r")


def fuse_sources(sources: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of named sources (query_id, source, pos, item); ties by first appearance, sources in the order of their names."""
    summed = sources.groupBy("query_id", "item").agg(
        F.round(F.sum(1.0 / (RRF_OFFSET + F.col("pos"))), 9).alias("score"),
        F.min(F.struct("source", "pos")).alias("first_seen"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source", "pos"))), ",").alias("ranks"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_seen", "item")
    return summed.withColumn("fusion_rank", F.row_number().over(w)).where(F.col("fusion_rank") <= limit).drop("first_seen")


def ordered_union(stages: DataFrame) -> DataFrame:
    """(query_id, stage, pos, item): the first occurrence of each item wins, order is kept."""
    first = Window.partitionBy("query_id", "item").orderBy("stage", "pos")
    kept = stages.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "pos", "item")))


def channel_counts(fused: DataFrame, channels: list[str]) -> DataFrame:
    return fused.groupBy("query_id").agg(*[F.sum(F.col(f"{c}_rank").isNotNull().cast("long")).alias(f"n_{c}") for c in channels], F.count("*").alias("n"))


def origin_counts(rows: DataFrame, by: str, origins: str) -> DataFrame:
    """(by, origin, n): rows of each origin (an array); origins without a row have none."""
    return rows.select(by, F.explode(F.array_distinct(origins)).alias("origin")).groupBy(by, "origin").agg(F.count("*").alias("n"))


def document_relevance(fused: DataFrame, keyword_least: float = 1e-4, trigram_least: float = 0.12) -> DataFrame:
    lexical = (F.coalesce("keyword_score", F.lit(0.0)) >= keyword_least) | (F.coalesce("trigram_score", F.lit(0.0)) >= trigram_least)
    return fused.groupBy("query_id", "doc_id").agg(F.bool_or(lexical).alias("lexical"), F.max("vector_score").alias("best_vector"))


EPSILON = 1e-12


def version_representatives(relevance: DataFrame, versions: DataFrame, least: float = 0.78) -> DataFrame:
    """(query_id, doc_id) of the best document by vector of each version (query_id, doc_id, version); ties to the smaller doc_id.

    versions: those that documents state of the product a query asks for, of
    queries that name no version themselves.
    """
    near = relevance.where(F.col("best_vector") >= least).join(versions.select("query_id", "doc_id", F.lower("version").alias("version")).distinct(), ["query_id", "doc_id"])
    best = near.groupBy("query_id", "version").agg(F.max_by("doc_id", F.struct("best_vector", (-F.col("doc_id")).alias("o"))).alias("doc_id"))
    return best.select("query_id", "doc_id").distinct()


def admit_documents(relevance: DataFrame, least: float = 0.78, margin: float = 0.035, versions: DataFrame | None = None, forced: DataFrame | None = None) -> DataFrame:
    """Admitted with a lexical hit, a vector score that is high and close to the query's best, as the best document of a
    version of the wanted product (see version_representatives), or by a list of its own (query_id, doc_id)."""
    top = F.max("best_vector").over(Window.partitionBy("query_id"))
    near = (F.col("best_vector") + EPSILON >= least) & (F.col("best_vector") >= top - margin - EPSILON)
    rows = relevance
    for name, keys in (("__version", None if versions is None else version_representatives(relevance, versions, least)), ("__forced", None if forced is None else forced.select("query_id", "doc_id").distinct())):
        rows = rows.withColumn(name, F.lit(None).cast("boolean")) if keys is None else rows.join(keys.withColumn(name, F.lit(True)), ["query_id", "doc_id"], "left")
    reason = F.when(F.col("lexical"), "lexical_hit").when(near, "vector_near_best").when(F.col("__version"), "version_representative").when(F.col("__forced"), "forced").otherwise("weak")
    return rows.withColumn("reason", reason).withColumn("admitted", F.col("reason") != "weak").drop("__version", "__forced")


def admit_candidates(fused: DataFrame, admitted: DataFrame, records: DataFrame | None = None, least: float = 0.18) -> DataFrame:
    """Every candidate with its status and reason; of rejected ones only the ids are told.

    Chunks follow their document; records (query_id, id, doc_id, structured_score)
    need a score of their own, and an admitted one brings its document in.
    """
    chunks = fused.select("query_id", "id", "doc_id", F.lit("chunk").alias("source_kind"))
    docs = admitted.select("query_id", "doc_id", "admitted", "reason")
    judged = None
    if records is not None:
        good = F.coalesce(F.col("structured_score") >= least, F.lit(False))
        judged = records.select("query_id", "id", "doc_id", F.lit("record").alias("source_kind"), good.alias("ok"), F.when(good, "structured_record_score").otherwise("structured_record_below_threshold").alias("why"))
        anchors = judged.where("ok").select("query_id", "doc_id", F.lit(True).alias("anchored")).distinct()
        docs = docs.join(anchors, ["query_id", "doc_id"], "full")
    else:
        docs = docs.withColumn("anchored", F.lit(None).cast("boolean"))
    own, brought = F.coalesce("admitted", F.lit(False)), F.coalesce("anchored", F.lit(False))
    why = F.when(own, F.col("reason")).when(brought, "structured_record_document_anchor").otherwise("document_relevance_gate")
    rows = chunks.join(docs, ["query_id", "doc_id"], "left").select("query_id", "id", "doc_id", "source_kind", (own | brought).alias("ok"), why.alias("why"))
    rows = rows if judged is None else rows.unionByName(judged)
    return rows.select("query_id", "id", "doc_id", "source_kind", F.when(F.col("ok"), "admitted").otherwise("rejected").alias("admission_status"), F.col("why").alias("admission_reason"))


def restrict_to_ids(cands: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    """No table: no restriction; an empty one: nothing."""
    return cands if doc_ids is None else cands.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def normalize_scores(fused: DataFrame, channels: list[str]) -> DataFrame:
    active = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{c}_rank").isNotNull(), F.lit(c)) for c in channels])), ",")
    return fused.withColumn("retrieval_score", F.col("score")).withColumn("active_channels", active)
