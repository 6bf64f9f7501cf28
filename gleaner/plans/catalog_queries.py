"""Registered queries of access, catalogue and structure operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import catalog as C
from gleaner.plans.views import Views, duckdb_views

D = duckdb_views("docs")
DK = duckdb_views("docs", "kb")
READY = "status = 'ready' AND is_active"
SEEDS = "seeds AS (SELECT * FROM chunks)"
ADJ = "adj AS (SELECT s.id AS seed, c.id, c.doc_id, c.chunk_index, abs(c.chunk_index - s.chunk_index) AS distance FROM seeds s JOIN chunks c ON c.doc_id = s.doc_id AND abs(c.chunk_index - s.chunk_index) = 1)"
SEC = """sec AS (SELECT seed, id, doc_id, chunk_index, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY distance, chunk_index, id) AS r FROM (
    SELECT s.id AS seed, c.id, c.doc_id, c.chunk_index, sign(c.chunk_index - s.chunk_index) AS side, abs(c.chunk_index - s.chunk_index) AS distance
    FROM seeds s JOIN chunks c ON c.doc_id = s.doc_id AND c.section_key = s.section_key AND c.id <> s.id)) WHERE r <= 2
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, chunk_index, id) <= 2)"""
TAB = "tab AS (SELECT s.id AS seed, c.id, c.doc_id, c.chunk_index, abs(c.table_part_index - s.table_part_index) AS distance FROM seeds s JOIN chunks c ON c.table_id = s.table_id AND abs(c.table_part_index - s.table_part_index) = 1)"


def _seeds(v: Views):
    return v.chunks


Q = {
    "B3_visible_documents": (lambda v: C.visible_documents(v.docs, 3).select("doc_id", "status", "created_by"), D + " SELECT doc_id, status, created_by FROM docs WHERE status <> 'draft' OR created_by = 3"),
    "B4_document_actions": (
        lambda v: C.document_actions(v.docs, v.users),
        duckdb_views("docs", "users") + """ SELECT user_id AS uid, doc_id, is_superadmin OR coalesce(created_by = user_id, false) OR status <> 'draft' AS can_read, is_superadmin OR coalesce(created_by = user_id, false) OR status <> 'draft' AS can_update,
        is_superadmin OR coalesce(created_by = user_id, false) AS can_delete FROM docs JOIN users ON created_by = user_id OR is_superadmin""",
    ),
    "B5_catalog_status_filter": (
        lambda v: C.catalog_status_filter(v.docs, "any").select("doc_id", F.lit("any").alias("mode")).unionByName(C.catalog_status_filter(v.docs, "inactive").select("doc_id", F.lit("inactive").alias("mode"))).unionByName(C.catalog_status_filter(v.docs, "not_ready").select("doc_id", F.lit("not_ready").alias("mode"))).unionByName(C.catalog_status_filter(v.docs, "failed").select("doc_id", F.lit("failed").alias("mode"))),
        D + " SELECT doc_id, 'any' AS mode FROM docs WHERE is_active AND status <> 'draft' UNION ALL SELECT doc_id, 'inactive' FROM docs WHERE NOT is_active AND status <> 'draft' UNION ALL SELECT doc_id, 'not_ready' FROM docs WHERE is_active AND status NOT IN ('ready', 'draft') UNION ALL SELECT doc_id, 'failed' FROM docs WHERE is_active AND status = 'failed'",
    ),
    "B6_catalog_term_filter": (lambda v: C.catalog_term_filter(v.docs.join(v.kb, "kb_id"), ["D-1", "k2"], ["filename", "name"]).select("doc_id", "filename"), DK + " SELECT doc_id, filename FROM docs JOIN kb USING (kb_id) WHERE (regexp_matches(filename, '(?is)d.*1') OR regexp_matches(name, '(?is)d.*1')) AND (regexp_matches(filename, '(?is)k.*2') OR regexp_matches(name, '(?is)k.*2'))"),
    "C6_adjacent_chunks": (lambda v: C.adjacent_chunks(_seeds(v), v.chunks), duckdb_views("chunks") + f", {SEEDS}, {ADJ} SELECT * FROM adj"),
    "C7_same_section_neighbors": (lambda v: C.same_section_neighbors(_seeds(v), v.chunks), duckdb_views("chunks") + f", {SEEDS}, {SEC} SELECT * FROM sec"),
    "C8_table_siblings": (lambda v: C.table_siblings(_seeds(v), v.chunks), duckdb_views("chunks") + f", {SEEDS}, {TAB} SELECT * FROM tab"),
    "C9_structural_neighbors": (
        lambda v: C.structural_neighbors(_seeds(v), v.chunks),
        duckdb_views("chunks") + f""", {SEEDS}, {ADJ}, {SEC}, {TAB},
        rows AS (SELECT *, 0 AS priority, 'table_sibling' AS origin FROM tab UNION ALL SELECT *, 1, 'same_section' FROM sec UNION ALL SELECT *, 2, 'adjacent' FROM adj),
        few AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, seed, distance, chunk_index, id) <= 24),
        m AS (SELECT doc_id, id, chunk_index, min(priority) AS best, array_to_string(list_sort(list(DISTINCT concat_ws(':', origin, seed, distance))), ',') AS origins FROM few GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY best, chunk_index, id) AS place FROM m QUALIFY place <= 12""",
    ),
    "C11_documents_with_first_chunk": (lambda v: C.documents_with_first_chunk(v.docs, v.chunks).select("doc_id", "filename", "first_chunk"), D + f" SELECT d.doc_id, filename, c.id AS first_chunk FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.kb_id = d.kb_id AND c.chunk_index = 0 WHERE {READY} ORDER BY d.doc_id LIMIT 2000"),
    "C12_accessible_kb": (
        lambda v: C.accessible_kb(v.users, v.roles, v.role_kb, v.kb),
        duckdb_views("users", "roles", "role_kb", "kb") + """ SELECT DISTINCT user_id, kb_id FROM (SELECT user_id, kb_id FROM users LEFT JOIN roles USING (role_id), kb WHERE is_superadmin OR scope_mode = 'all'
        UNION ALL SELECT user_id, k.kb_id FROM users JOIN roles USING (role_id) JOIN role_kb k USING (role_id) JOIN kb USING (kb_id) WHERE NOT is_superadmin AND scope_mode = 'selected')""",
    ),
    "C13_missing_ids": (lambda v: C.missing_ids(v.events.select(F.col("event_id").alias("doc_id")), v.docs.select("doc_id"), "doc_id"), D + " SELECT DISTINCT event_id AS doc_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM docs)"),
    "C14_revalidate_sources": (
        lambda v: C.revalidate_sources(v.chunks.select(F.explode(F.array(F.floor(F.col("id") / 16), F.floor(F.col("id") / 16) + 1, F.floor(F.col("id") / 40))).alias("conv"), ((F.col("id") * 7) % 31).alias("pos"), "id"), v.chunks, v.docs),
        D + f""", s AS (SELECT unnest([id // 16, id // 16 + 1, id // 40]) AS conv, (id * 7) % 31 AS pos, id FROM chunks), live AS (SELECT c.id FROM chunks c JOIN docs USING (doc_id, kb_id) WHERE {READY}),
        k AS (SELECT conv, id, min(pos) AS pos FROM s WHERE id IN (SELECT id FROM live) GROUP BY conv, id)
        SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos, id) AS place, 0.0::DOUBLE AS score FROM k QUALIFY place <= 5""",
    ),
    "D13_kb_document_counts": (lambda v: C.kb_document_counts(v.kb, v.docs, 3), DK + " SELECT k.kb_id, k.name, count(doc_id) AS documents FROM kb k LEFT JOIN docs d ON d.kb_id = k.kb_id AND (status <> 'draft' OR created_by = 3) GROUP BY ALL"),
    "D14_catalog_group": (lambda v: C.catalog_group(v.docs, "status"), D + " SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT CASE WHEN NOT is_active THEN 'inactive' ELSE status END AS label, count(*) AS n FROM docs WHERE status <> 'draft' GROUP BY 1)"),
    "D15_distinct_tags": (lambda v: C.distinct_tags(v.docs.withColumn("tags", F.array(F.concat(F.lit("t"), F.col("doc_id") % 4), F.lit(""), F.col("file_type")))), D + " SELECT DISTINCT kb_id, tag FROM (SELECT kb_id, unnest(['t' || (doc_id % 4), '', file_type]) AS tag FROM docs) WHERE tag <> ''"),
    "D16_scoped_chunk_stats": (lambda v: C.scoped_chunk_stats(v.docs, 90, 60), D + " SELECT kb_id, CAST(sum(greatest(coalesce(chunk_count, 0), 0)) AS BIGINT) AS total, max(greatest(coalesce(chunk_count, 0), 0)) AS largest, sum(chunk_count) > 90 OR max(chunk_count) > 60 AS exact_only FROM docs GROUP BY kb_id"),
    "D17_small_documents": (lambda v: C.small_documents(v.docs, v.chunks), D + f" SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks JOIN docs USING (doc_id) WHERE {READY} GROUP BY doc_id HAVING count(*) <= 30 AND sum(length(content)) <= 16000"),
    "D26_complete_documents": (lambda v: C.complete_documents(v.chunks.withColumn("declared", F.col("table_part_count"))), duckdb_views("chunks") + " SELECT doc_id, coalesce(count(DISTINCT table_part_count) = 1 AND count(*) = max(table_part_count) AND count(DISTINCT chunk_index) = max(table_part_count) AND min(chunk_index) = 0 AND max(chunk_index) = max(table_part_count) - 1, false) AS complete FROM chunks GROUP BY doc_id"),
    "D27_complete_tables": (lambda v: C.complete_documents(v.chunks.where("table_id is not null").select(F.col("table_id").alias("doc_id"), F.col("table_part_index").alias("chunk_index"), F.lit(2).alias("declared"))).withColumnRenamed("doc_id", "table_id"), duckdb_views("chunks") + " SELECT table_id, count(*) = 2 AND count(DISTINCT table_part_index) = 2 AND min(table_part_index) = 0 AND max(table_part_index) = 1 AS complete FROM chunks WHERE table_id IS NOT NULL GROUP BY table_id"),
    "E9_render_document": (
        lambda v: C.render_document(v.chunks),
        duckdb_views("chunks") + """, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, section_key ORDER BY chunk_index, id) = 1 THEN '# ' || section_key || chr(10) || chr(10) || content ELSE content END AS part FROM chunks),
        t AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY chunk_index, id) AS t FROM p GROUP BY doc_id) SELECT doc_id, t[1:2000] AS text, length(t) > 2000 AS truncated FROM t""",
    ),
    "H3_intersect": (lambda v: v.docs.where("status = 'ready'").select("kb_id").intersect(v.role_kb.select("kb_id")), duckdb_views("docs", "role_kb") + " SELECT kb_id FROM docs WHERE status = 'ready' INTERSECT SELECT kb_id FROM role_kb"),
    "H4_except": (lambda v: v.roles.select(F.col("role_id").cast("long").alias("k")).exceptAll(v.role_kb.select(F.col("kb_id").alias("k")).distinct()), duckdb_views("roles", "role_kb") + " SELECT CAST(role_id AS BIGINT) AS k FROM roles EXCEPT SELECT kb_id FROM role_kb"),
    "A4_replace_document_chunks": (
        lambda v: C.replace_document_chunks(v.chunks.select("id", "doc_id", "chunk_index"), v.chunks.where("section_key = 'sec-0'").select((F.col("id") + 100000).alias("id"), "doc_id", "chunk_index", (F.lit(1) + F.col("doc_id") % 2).alias("revision")), v.docs),
        D + """, inc AS (SELECT c.id + 100000 AS id, c.doc_id, c.chunk_index FROM chunks c JOIN docs d USING (doc_id) WHERE c.section_key = 'sec-0' AND d.processing_revision = 1 + c.doc_id % 2)
        SELECT id, doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM inc) UNION ALL SELECT * FROM inc""",
    ),
    "A4_chunk_counts": (
        lambda v: C.with_chunk_counts(v.docs, C.replace_document_chunks(v.chunks.select("id", "doc_id", "chunk_index"), v.chunks.where("section_key = 'sec-0' and chunk_index < 1").select((F.col("id") + 100000).alias("id"), "doc_id", "chunk_index", (F.lit(1) + F.col("doc_id") % 2).alias("revision")), v.docs)).select("doc_id", "chunk_count"),
        D + """, inc AS (SELECT c.doc_id, count(*) AS n FROM chunks c JOIN docs d USING (doc_id) WHERE c.section_key = 'sec-0' AND c.chunk_index < 1 AND d.processing_revision = 1 + c.doc_id % 2 GROUP BY 1)
        SELECT doc_id, coalesce(n, chunk_count) AS chunk_count FROM docs LEFT JOIN inc USING (doc_id)""",
    ),
    "H2_union_all_matches": (
        lambda v: C.table_siblings(_seeds(v), v.chunks).withColumn("origin", F.lit("table_sibling")).unionByName(C.adjacent_chunks(_seeds(v), v.chunks).withColumn("origin", F.lit("adjacent"))).select("seed", "id", "origin"),
        duckdb_views("chunks") + f", {SEEDS}, {ADJ}, {TAB} SELECT seed, id, 'table_sibling' AS origin FROM tab UNION ALL SELECT seed, id, 'adjacent' FROM adj",
    ),
}
