"""Registered queries of the retrieval operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import catalog as C
from gleaner.operators import retrieval as R
from gleaner.plans.views import Views, duckdb_views
from gleaner.session import stored

WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

BASE = duckdb_views("queries", "docs") + rf""",
vis AS (SELECT c.*, d.filename FROM chunks c JOIN docs d USING (doc_id, kb_id) WHERE d.status = 'ready' AND d.is_active),
vec_all AS (
  SELECT query_id, id, doc_id, chunk_index, round(list_cosine_similarity(CAST(query_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM queries, vis WHERE embedding IS NOT NULL AND query_vec IS NOT NULL),
vec AS (SELECT * FROM vec_all QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, id) <= 80),
w AS (SELECT id, doc_id, chunk_index, {WORDS.format('content')} AS w FROM vis),
idx AS (SELECT token, id, doc_id, chunk_index, len, count(*) AS tf FROM (SELECT id, doc_id, chunk_index, len(w) AS len, unnest(w) AS token FROM w) GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS token FROM queries),
df AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
kw_all AS (
  SELECT query_id, id, doc_id, chunk_index, count(*) AS matched,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM idx JOIN asked USING (token) JOIN df USING (token), st GROUP BY ALL),
kw AS (
  SELECT k.query_id, id, doc_id, chunk_index, score FROM kw_all k JOIN (SELECT query_id, count(*) AS needed FROM asked GROUP BY query_id) n ON k.query_id = n.query_id AND matched = needed
  QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY score DESC, doc_id, chunk_index, id) <= 80),
g_c AS (SELECT DISTINCT id, doc_id, chunk_index, substr(p, CAST(i AS INT), 3) AS gram FROM (SELECT id, doc_id, chunk_index, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT id, doc_id, chunk_index, '  ' || unnest({WORDS.format("filename || chr(10) || content")}) || ' ' AS p FROM vis))),
g_q AS (SELECT DISTINCT query_id, query AS term, substr(p, CAST(i AS INT), 3) AS gram FROM (SELECT query_id, query, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT query_id, query, '  ' || unnest({WORDS.format('query')}) || ' ' AS p FROM queries))),
g_n AS (SELECT query_id, count(*) AS n FROM g_q GROUP BY query_id),
tri_all AS (
  SELECT g.query_id, c.id, c.doc_id, c.chunk_index, round(count(*) / any_value(n) * (0.5 + 0.5 * least(length(any_value(term)), 12) / 12), 6) AS score
  FROM g_c c JOIN g_q g USING (gram) JOIN g_n USING (query_id) GROUP BY g.query_id, c.id, c.doc_id, c.chunk_index),
tri AS (SELECT * FROM tri_all WHERE score >= 0.12 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, id) <= 80),
tagged AS (
  SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, doc_id, chunk_index, id) AS rank
  FROM (SELECT 'vector' AS channel, * FROM vec UNION ALL SELECT 'keyword', * FROM kw UNION ALL SELECT 'trigram', * FROM tri)
  QUALIFY true),
limited AS (
  SELECT * EXCLUDE (dr, rank), row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, doc_id, chunk_index, id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY channel, query_id, doc_id ORDER BY score DESC, chunk_index, id) AS dr FROM tagged) WHERE dr <= 6),
wide AS (
  SELECT query_id, id, doc_id, chunk_index,
         max(score) FILTER (channel = 'vector') AS vector_score, max(rank) FILTER (channel = 'vector') AS vector_rank,
         max(score) FILTER (channel = 'keyword') AS keyword_score, max(rank) FILTER (channel = 'keyword') AS keyword_rank,
         max(score) FILTER (channel = 'trigram') AS trigram_score, max(rank) FILTER (channel = 'trigram') AS trigram_rank
  FROM limited GROUP BY ALL),
fused AS (
  SELECT *, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60 + trigram_rank), 0), 9) AS score,
         least(coalesce(vector_rank, 2147483647), coalesce(keyword_rank, 2147483647), coalesce(trigram_rank, 2147483647)) AS best_rank
  FROM wide),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, best_rank, chunk_index, id) AS fused_document_rank FROM fused QUALIFY fused_document_rank <= 6),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id, chunk_index, id) AS fusion_rank FROM few QUALIFY fusion_rank <= 10),
rel AS (
  SELECT query_id, doc_id, bool_or(coalesce(keyword_score, 0) >= 1e-4 OR coalesce(trigram_score, 0) >= 0.12) AS lexical, max(vector_score) AS best_vector FROM fused GROUP BY query_id, doc_id),
adm AS (
  SELECT *, CASE WHEN lexical THEN 'lexical_hit' WHEN best_vector >= 0.78 AND best_vector >= max(best_vector) OVER (PARTITION BY query_id) - 0.035 - 1e-12 THEN 'vector_near_best' ELSE 'weak' END AS reason FROM rel)
"""
CHANNELS = ["vector", "keyword", "trigram"]
HYBRID_COLUMNS = ["query_id", "id", "doc_id", "chunk_index", "score", "best_rank", "fused_document_rank", "fusion_rank", *[f"{c}_{x}" for c in CHANNELS for x in ("score", "rank")]]
CAND = "SELECT query_id, id, doc_id, chunk_index, score FROM "


def _visible(v: Views):
    return R.visible_chunks(v.chunks, v.docs)


def _terms(v: Views):
    return v.queries.select("query_id", F.col("query").alias("term"))


def _limited(v: Views) -> dict:
    q, c = v.queries, _visible(v)
    found = {
        "vector": R.vector_candidates(q, c, 80),
        "keyword": v.text_index.keyword_candidates(q, 80),
        "trigram": v.text_index.trigram_candidates(_terms(v), 80),
    }
    return {n: R.channel_rank(R.per_document_rank(d)) for n, d in found.items()}


def _fused(v: Views):
    return R.fuse(_limited(v))


def _by_version(v: Views):
    """Candidates without lexical evidence; documents state one of three versions to every second query, and some are forced."""
    weak = _fused(v).where("keyword_score is null and coalesce(trigram_score, 0) < 0.5")
    rel = stored(R.document_relevance(weak.withColumn("trigram_score", F.lit(0.0))), "relevance")
    versions = rel.where("query_id % 2 = 0").select("query_id", "doc_id", F.concat(F.lit("V"), F.col("doc_id") % 3).alias("version"))
    return R.admit_documents(rel, 0.1, 0.01, versions, rel.where("doc_id % 11 = 0")).drop("lexical")


def _sources(v: Views):
    lim = _limited(v)
    parts = [lim[c].select("query_id", F.lit(c).alias("source"), F.col("rank").alias("pos"), F.col("id").alias("item")) for c in ("keyword", "trigram")]
    return parts[0].unionByName(parts[1])


def _variants(v: Views):
    lim = _limited(v)
    parts = [lim[c].select("query_id", "id", "doc_id", "chunk_index", "score", "rank", F.lit(i).alias("variant")) for i, c in enumerate(("keyword", "trigram"))]
    return parts[0].unionByName(parts[1])


SOURCES_SQL = "(SELECT query_id, channel AS source, rank AS pos, id AS item FROM limited WHERE channel <> 'vector')"
Q = {
    "B1_visible_chunks": (lambda v: _visible(v).select("id", "doc_id", "kb_id", "chunk_index"), duckdb_views("docs") + " SELECT c.id, c.doc_id, c.kb_id, c.chunk_index FROM chunks c JOIN docs d USING (doc_id, kb_id) WHERE d.status = 'ready' AND d.is_active"),
    "B2_embeddable_chunks": (
        lambda v: R.embeddable_chunks(v.chunks, v.docs, [0, 2]).select("id", "doc_id", "kb_id"),
        duckdb_views("docs") + " SELECT c.id, c.doc_id, c.kb_id FROM chunks c JOIN docs d USING (doc_id, kb_id) WHERE d.status = 'ready' AND d.is_active AND c.embedding IS NOT NULL AND c.kb_id IN (0, 2)",
    ),
    "C1_chunk_document_join": (lambda v: R.chunk_document_join(v.chunks, v.docs).select("id", "doc_id", "filename", "status"), duckdb_views("docs") + " SELECT c.id, c.doc_id, d.filename, d.status FROM chunks c JOIN docs d USING (doc_id, kb_id)"),
    "C2_vector_candidates": (lambda v: R.vector_candidates(v.queries, _visible(v), 80), BASE + CAND + "vec"),
    "C3_keyword_candidates": (lambda v: v.text_index.keyword_candidates(v.queries, 80), BASE + CAND + "kw"),
    "C4_trigram_candidates": (lambda v: v.text_index.trigram_candidates(_terms(v), 80), BASE + CAND + "tri"),
    "C3_keyword_without_index": (lambda v: R.keyword_candidates(v.queries, _visible(v), 80), BASE + CAND + "kw"),
    "C4_trigram_without_index": (lambda v: R.trigram_candidates(_terms(v), v.searched, 80), BASE + CAND + "tri"),
    "C5_fuse_join": (lambda v: _fused(v).select([c for c in HYBRID_COLUMNS if not c.startswith("fus")]), BASE + "SELECT " + ", ".join(c for c in HYBRID_COLUMNS if not c.startswith("fus")) + " FROM fused"),
    "F1_vector_search": (
        lambda v: R.vector_search(v.queries, _visible(v), 10).select("query_id", "id", "doc_id", "score", "rank"),
        BASE + "SELECT query_id, id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, id) AS rank FROM (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index, id) = 1) QUALIFY rank <= 10",
    ),
    "F2_keyword_search": (
        lambda v: R.keyword_search(v.queries, _visible(v), 10).select("query_id", "id", "doc_id", "score", "rank"),
        BASE + "SELECT query_id, id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, id) AS rank FROM (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index, id) = 1) QUALIFY rank <= 10",
    ),
    "F3_hybrid_search": (lambda v: R.hybrid_search(v.queries, _visible(v), 10, index=v.text_index).select(HYBRID_COLUMNS), BASE + "SELECT " + ", ".join(HYBRID_COLUMNS) + " FROM hybrid"),
    "F5_merge_query_variants": (
        lambda v: R.merge_query_variants(_variants(v), 3, 12).select("query_id", "id", "score", "best_rank", "n_variants", "rank"),
        BASE + """, m AS (SELECT query_id, id, doc_id, chunk_index, max(score) AS score, min(rank) AS best_rank, count(DISTINCT channel) AS n_variants FROM limited WHERE channel <> 'vector' GROUP BY ALL),
        k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n_variants DESC, doc_id, chunk_index, id) <= 3)
        SELECT query_id, id, score, best_rank, n_variants, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_variants DESC, doc_id, chunk_index, id) AS rank FROM k QUALIFY rank <= 12""",
    ),
    "F6_fuse_sources": (
        lambda v: R.fuse_sources(_sources(v), 20),
        BASE + f""", s AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, min((source, pos)) AS seen, array_to_string(list_sort(list(concat_ws(':', source, pos))), ',') AS ranks FROM {SOURCES_SQL} GROUP BY query_id, item)
        SELECT query_id, item, score, ranks, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, item) AS fusion_rank FROM s QUALIFY fusion_rank <= 20""",
    ),
    "H1_union_ids": (lambda v: _sources(v).select("query_id", "item").distinct(), BASE + f"SELECT DISTINCT query_id, item FROM {SOURCES_SQL}"),
    "H5_ordered_union": (
        lambda v: R.ordered_union(_sources(v).withColumnRenamed("source", "stage")).select("query_id", "item", "stage", "place"),
        BASE + f"SELECT query_id, item, source AS stage, row_number() OVER (PARTITION BY query_id ORDER BY source, pos, item) AS place FROM (SELECT * FROM {SOURCES_SQL} QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY source, pos) = 1)",
    ),
    "W1_per_document_rank": (
        lambda v: R.per_document_rank(v.text_index.trigram_candidates(_terms(v), 80), 2),
        BASE + "SELECT query_id, id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index, id) AS document_rank FROM tri QUALIFY document_rank <= 2",
    ),
    "W2_channel_rank": (lambda v: _limited(v)["trigram"].select("query_id", "id", "rank"), BASE + "SELECT query_id, id, rank FROM limited WHERE channel = 'trigram'"),
    "B12_normalize_scores": (
        lambda v: R.normalize_scores(_fused(v), CHANNELS).select("query_id", "id", "retrieval_score", "active_channels"),
        BASE + "SELECT query_id, id, score AS retrieval_score, concat_ws(',', CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END, CASE WHEN trigram_rank IS NOT NULL THEN 'trigram' END) AS active_channels FROM fused",
    ),
    "B9_restrict_to_ids": (lambda v: R.restrict_to_ids(_fused(v), v.docs.where("created_by is null")).select("query_id", "id", "doc_id"), BASE + "SELECT query_id, id, doc_id FROM fused WHERE doc_id IN (SELECT doc_id FROM docs WHERE created_by IS NULL)"),
    "D18_document_relevance": (lambda v: R.document_relevance(_fused(v)), BASE + "SELECT query_id, doc_id, lexical, best_vector FROM rel"),
    "D19_admit_documents": (lambda v: R.admit_documents(R.document_relevance(_fused(v))), BASE + "SELECT query_id, doc_id, lexical, best_vector, reason, reason <> 'weak' AS admitted FROM adm"),
    "D19_version_representatives": (
        _by_version,
        BASE + """, r2 AS (SELECT query_id, doc_id, max(vector_score) AS best_vector FROM fused WHERE keyword_score IS NULL AND coalesce(trigram_score, 0) < 0.5 GROUP BY ALL),
        ver AS (SELECT query_id, doc_id, 'v' || (doc_id % 3) AS version FROM r2 WHERE query_id % 2 = 0),
        rep AS (SELECT DISTINCT query_id, doc_id FROM (SELECT * FROM r2 JOIN ver USING (query_id, doc_id) WHERE best_vector >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, version ORDER BY best_vector DESC, doc_id) = 1)),
        k AS (SELECT r2.*, CASE WHEN best_vector + 1e-12 >= 0.1 AND best_vector >= max(best_vector) OVER (PARTITION BY query_id) - 0.01 - 1e-12 THEN 'vector_near_best' WHEN rep.doc_id IS NOT NULL THEN 'version_representative' WHEN doc_id % 11 = 0 THEN 'forced' ELSE 'weak' END AS reason FROM r2 LEFT JOIN rep USING (query_id, doc_id))
        SELECT query_id, doc_id, best_vector, reason, reason <> 'weak' AS admitted FROM k""",
    ),
    "D20_admit_candidates": (
        lambda v: R.admit_candidates((f := stored(_fused(v), "fused")), R.admit_documents(R.document_relevance(f.where("doc_id % 2 = 0"))), f.where("trigram_score is not null").select("query_id", "id", "doc_id", F.col("trigram_score").alias("structured_score"))),
        BASE + """, even AS (SELECT * FROM adm WHERE doc_id % 2 = 0), rec AS (SELECT query_id, id, doc_id, trigram_score >= 0.18 AS ok FROM fused WHERE trigram_score IS NOT NULL), anchor AS (SELECT DISTINCT query_id, doc_id FROM rec WHERE ok)
        SELECT f.query_id, f.id, f.doc_id, 'chunk' AS source_kind, CASE WHEN coalesce(e.reason <> 'weak', false) OR a.doc_id IS NOT NULL THEN 'admitted' ELSE 'rejected' END AS admission_status,
               CASE WHEN coalesce(e.reason <> 'weak', false) THEN e.reason WHEN a.doc_id IS NOT NULL THEN 'structured_record_document_anchor' ELSE 'document_relevance_gate' END AS admission_reason
        FROM fused f LEFT JOIN even e ON f.query_id = e.query_id AND f.doc_id = e.doc_id LEFT JOIN anchor a ON f.query_id = a.query_id AND f.doc_id = a.doc_id
        UNION ALL SELECT query_id, id, doc_id, 'record', CASE WHEN ok THEN 'admitted' ELSE 'rejected' END, CASE WHEN ok THEN 'structured_record_score' ELSE 'structured_record_below_threshold' END FROM rec""",
    ),
    "D21_channel_counts": (
        lambda v: R.channel_counts(_fused(v), CHANNELS),
        BASE + "SELECT query_id, count(vector_rank) AS n_vector, count(keyword_rank) AS n_keyword, count(trigram_rank) AS n_trigram, count(*) AS n FROM fused GROUP BY query_id",
    ),
    "D21_origin_counts": (
        lambda v: R.origin_counts(C.structural_neighbors(v.chunks.where("chunk_index = 1"), v.chunks).select("doc_id", F.transform(F.split("origins", ","), lambda x: F.split_part(x, F.lit(":"), F.lit(1))).alias("origins")), "doc_id", "origins"),
        duckdb_views("chunks") + """, s AS (SELECT * FROM chunks WHERE chunk_index = 1), t AS (SELECT DISTINCT c.doc_id, c.id, 'table_sibling' AS origin FROM s JOIN chunks c ON c.table_id = s.table_id AND abs(c.table_part_index - s.table_part_index) = 1),
        n AS (SELECT c.doc_id, c.id, 'same_section' AS origin FROM s JOIN chunks c ON c.doc_id = s.doc_id AND c.section_key = s.section_key AND c.id <> s.id), a AS (SELECT c.doc_id, c.id, 'adjacent' AS origin FROM s JOIN chunks c ON c.doc_id = s.doc_id AND abs(c.chunk_index - s.chunk_index) = 1)
        SELECT doc_id, origin, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM n UNION ALL SELECT * FROM a) GROUP BY ALL""",
    ),
    "G1_top_k": (lambda v: R.top_k(_fused(v), 5).select("query_id", "id", "score", "rank"), BASE + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, id) AS rank FROM fused QUALIFY rank <= 5"),
    "W3_fused_document_rank": (lambda v: R.hybrid_search(v.queries, v.searched, 1000, index=v.text_index).select("query_id", "id", "fused_document_rank"), BASE.replace("<= 80", "<= 240") + "SELECT query_id, id, fused_document_rank FROM few"),
    "W4_fusion_rank": (
        lambda v: R.fuse_sources(_sources(v), 1000).select("query_id", "item", "fusion_rank"),
        BASE + f", s AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, min((source, pos)) AS seen FROM {SOURCES_SQL} GROUP BY query_id, item) SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, item) AS fusion_rank FROM s QUALIFY fusion_rank <= 1000",
    ),
}
