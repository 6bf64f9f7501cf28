"""Registered queries of the evidence and scope operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import evidence as V
from gleaner.operators import terms as M
from gleaner.plans.views import Views, duckdb_views

CH = duckdb_views("chunks")


def _scoped(v: Views):
    i = F.col("id")
    versions = F.when(i % 4 == 0, F.array(F.lit("6"), F.lit("6.1"))).when(i % 4 == 1, F.array(F.lit("6.1"))).when(i % 4 == 2, F.array(F.lit("7"))).otherwise(F.array().cast("array<string>"))
    return v.chunks.select(
        F.floor(i / 40).alias("query_id"), "id", "doc_id", "chunk_index", "section_key", F.when(i % 5 != 0, F.concat(F.lit("p"), i % 3)).alias("product"), versions.alias("versions"),
        F.when(i % 6 == 2, F.array(F.lit("6.1"))).otherwise(F.array().cast("array<string>")).alias("compatible"), F.when(i % 7 == 3, F.array(F.lit("6.1"))).otherwise(F.array().cast("array<string>")).alias("unsupported"),
    )


SC = CH + """, sc AS (SELECT CAST(floor(id / 40) AS BIGINT) AS query_id, id, doc_id, chunk_index, section_key, CASE WHEN id % 5 <> 0 THEN 'p' || (id % 3) END AS product,
  CASE id % 4 WHEN 0 THEN ['6', '6.1'] WHEN 1 THEN ['6.1'] WHEN 2 THEN ['7'] ELSE CAST([] AS VARCHAR[]) END AS versions,
  CASE WHEN id % 6 = 2 THEN ['6.1'] ELSE CAST([] AS VARCHAR[]) END AS compatible, CASE WHEN id % 7 = 3 THEN ['6.1'] ELSE CAST([] AS VARCHAR[]) END AS unsupported FROM chunks)"""


def _scopes(v: Views):
    q = v.chunks.select(F.floor(F.col("id") / 40).alias("query_id")).distinct()
    rows = [q.select("query_id", F.lit(s).alias("scope_id"), F.lit(p).cast("string").alias("target_product"), F.lit(x).cast("string").alias("target_version")) for s, p, x in ((1, "p1", "6.1"), (2, "p2", None))]
    return rows[0].unionByName(rows[1])


def _rows(v: Views):
    i = F.col("id")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (i % n).cast("int"))
    return v.chunks.select(
        F.floor(i / 40).alias("query_id"), "id", "doc_id", "chunk_index", "content", pick(["direct", "related", "irrelevant"], 3).alias("role"), pick(["exact", "compatible", "neutral", "unknown", "mismatch"], 5).alias("constraint_status"),
        (i % 7 / 10).alias("support"), (i % 4 / 10).alias("topic"), (i % 9 / 10).alias("score"), (i * 31 % 503).alias("pos"), (i % 6 == 0).alias("is_seed"), pick(["table", "specific", "overview", "other"], 4).alias("kind"),
    )


RW = CH + """, rw AS (SELECT CAST(floor(id / 40) AS BIGINT) AS query_id, id, doc_id, chunk_index, content, ['direct', 'related', 'irrelevant'][1 + id % 3] AS role, ['exact', 'compatible', 'neutral', 'unknown', 'mismatch'][1 + id % 5] AS constraint_status,
  id % 7 / 10 AS support, id % 4 / 10 AS topic, id % 9 / 10 AS score, id * 31 % 503 AS pos, id % 6 = 0 AS is_seed, ['table', 'specific', 'overview', 'other'][1 + id % 4] AS kind FROM chunks)"""
ROLE = "CASE role WHEN 'direct' THEN 3 WHEN 'related' THEN 2 ELSE 1 END"


def _facts(v: Views):
    i = F.col("event_id")
    return v.events.select((i % 30).alias("doc_id"), F.concat(F.lit("s"), i % 4).alias("scope"), F.concat(F.lit("k"), F.col("user_id") % 40).alias("subject"), F.concat(F.lit(" V"), F.floor(i / 7) % 3).alias("value"))


FACTS = "WITH facts AS (SELECT event_id % 30 AS doc_id, 's' || (event_id % 4) AS scope, 'k' || (user_id % 40) AS subject, ' V' || (CAST(floor(event_id / 7) AS BIGINT) % 3) AS value FROM events)"


def _members(v: Views):
    i = F.col("event_id")
    return v.events.select((i % 50).alias("query_id"), (F.floor(i / 50) % 6).alias("set_id"), (F.col("user_id") % 4).alias("requirement_id"), (i % 3 != 0).alias("eligible"), (i % 11 / 10).alias("support"))


MEM = """WITH mem AS (SELECT event_id % 50 AS query_id, CAST(floor(event_id / 50) AS BIGINT) % 6 AS set_id, user_id % 4 AS requirement_id, event_id % 3 <> 0 AS eligible, event_id % 11 / 10 AS support FROM events),
need AS (SELECT query_id, unnest(CASE WHEN query_id % 2 = 0 THEN [0, 1] ELSE [0, 1, 2, 3] END) AS requirement_id FROM (SELECT DISTINCT query_id FROM mem)),
cov AS (SELECT query_id, set_id, size, covered, needed - covered AS missing, support, CASE WHEN needed = covered AND support >= 0.7 THEN 'complete' WHEN covered > 0 AND support >= 0.3 THEN 'partial' ELSE 'insufficient' END AS status FROM (
  SELECT m.query_id, m.set_id, count(*) AS size, coalesce(max(support) FILTER (eligible), 0.0) AS support, count(DISTINCT n.requirement_id) FILTER (eligible) AS covered, any_value(k.needed) AS needed
  FROM mem m JOIN (SELECT query_id, count(*) AS needed FROM need GROUP BY 1) k ON k.query_id = m.query_id LEFT JOIN need n ON n.query_id = m.query_id AND n.requirement_id = m.requirement_id GROUP BY m.query_id, m.set_id))"""


def _coverage(v: Views):
    members = _members(v)
    need = members.select("query_id").distinct().select("query_id", F.explode(F.when(F.col("query_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(*[F.lit(x) for x in range(4)]))).alias("requirement_id"))
    return V.evidence_set_coverage(members, need)


def _bindings(v: Views):
    i = F.col("event_id")
    return v.events.select((i % 5).alias("kb_id"), F.concat(F.lit("t"), F.col("user_id") % 50).alias("spelling"), (i % 13).alias("concept"), F.when(i % 4 != 0, F.concat(F.lit("v"), i % 3)).alias("scope"))


TERMS = ["the", "tion", "über", "ing", "of", "ção"]
def _term_rule(term: str, text: str) -> str:
    """White space between the letters of a term counts for nothing; a token of ASCII letters has ends."""
    spread, edge = r"\s*".join(term.replace(" ", "")), "[^a-z0-9_.+/-]"
    return f"regexp_matches(lower({text}), '" + (f"(^|{edge}){spread}($|{edge})" if term.isascii() else spread) + "')"


def _term_sql(term: str) -> str:
    return f"SELECT doc_id AS text_id, '{term}' AS term FROM documents WHERE {_term_rule(term, 'text')}"


Q = {
    "B10_restrict_to_scope_slices": (
        lambda v: V.restrict_to_scope_slices(v.chunks, v.docs.where("status = 'ready'").select(F.col("doc_id").alias("c_doc"), F.when(~F.col("is_active"), "sec-1").alias("c_section"))).select("id", "doc_id", "section_key"),
        duckdb_views("docs") + " SELECT id, c.doc_id, section_key FROM chunks c JOIN docs d ON c.doc_id = d.doc_id WHERE status = 'ready' AND (is_active OR section_key = 'sec-1')",
    ),
    "C15_scope_match_join": (
        lambda v: V.scope_match_join(_scoped(v), _scopes(v)),
        SC + """, scopes AS (SELECT * FROM (SELECT DISTINCT CAST(floor(id / 40) AS BIGINT) AS query_id FROM chunks), (VALUES (1, 'p1', '6.1'), (2, 'p2', NULL)) t(scope_id, tp, tv)),
        p AS (SELECT sc.query_id, id, scope_id, CASE WHEN tp IS NOT NULL AND product IS NOT NULL AND product <> tp THEN 'mismatch' WHEN product IS NULL THEN 'unknown' WHEN tv IS NULL THEN 'exact' WHEN list_contains(unsupported, tv) THEN 'mismatch'
          WHEN len(versions) = 1 AND list_contains(versions, tv) THEN 'exact' WHEN list_contains(versions, tv) OR list_contains(compatible, tv) THEN 'compatible' WHEN len(versions) > 0 THEN 'mismatch' ELSE 'unknown' END AS constraint_status FROM sc JOIN scopes USING (query_id)),
        f AS (SELECT *, CASE constraint_status WHEN 'exact' THEN 3 WHEN 'compatible' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS fit FROM p)
        SELECT query_id, id, CASE WHEN fit > 0 THEN scope_id END AS scope_id, constraint_status, fit > 0 AS accepted FROM f QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY fit DESC, scope_id) = 1""",
    ),
    "C17_term_matches": (lambda v: M.term_matches(v.spark.createDataFrame([(t,) for t in TERMS], "term string"), v.documents.select(F.col("doc_id").alias("text_id"), "text")), " UNION ALL ".join(_term_sql(t) for t in TERMS)),
    "C17_query_variants": (
        lambda v: M.query_variants(v.spark.createDataFrame([(t, f"<{t}>") for t in TERMS], "term string, replacement string"), v.queries.select(F.col("query_id").alias("text_id"), F.col("query").alias("text"))),
        duckdb_views("queries") + " " + " UNION ALL ".join(f"SELECT query_id AS text_id, '{t}' AS term, '<{t}>' AS replacement, trim(regexp_replace(regexp_replace(query, '\\s+', ' ', 'g'), '{t}', '<{t}>', 'i')) AS variant FROM queries WHERE {_term_rule(t, 'query')}" for t in TERMS),
    ),
    "C18_ambiguous_terms": (
        lambda v: V.ambiguous_terms(_bindings(v)),
        "WITH b AS (SELECT event_id % 5 AS kb_id, 't' || (user_id % 50) AS spelling, event_id % 13 AS concept, CASE WHEN event_id % 4 <> 0 THEN 'v' || (event_id % 3) END AS scope FROM events) SELECT DISTINCT a.kb_id, a.spelling, a.concept, b.concept AS other FROM b a JOIN b ON a.kb_id = b.kb_id AND a.spelling = b.spelling AND a.concept < b.concept AND coalesce(a.scope = b.scope, true)",
    ),
    "D22_document_identity": (
        lambda v: V.document_identity(_scoped(v), ["doc_id"]),
        SC + ", o AS (SELECT doc_id, product, list_filter(versions, lambda x: len(list_filter(versions, lambda y: starts_with(y, x || '.'))) = 0) AS own FROM sc) SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT product) FILTER (product IS NOT NULL)), ','), '') AS products, array_to_string(list_sort(list_distinct(flatten(list(own)))), ',') AS versions FROM o GROUP BY doc_id",
    ),
    "D23_inherit_identity": (
        lambda v: V.inherit_identity(_scoped(v)),
        SC + """, s AS (SELECT *, list(DISTINCT product) FILTER (product IS NOT NULL) OVER (PARTITION BY doc_id, section_key) AS s, list(DISTINCT product) FILTER (product IS NOT NULL) OVER (PARTITION BY doc_id) AS d FROM sc)
        SELECT id, doc_id, section_key, coalesce(product, CASE WHEN coalesce(len(s), 0) = 1 THEN s[1] WHEN coalesce(len(s), 0) = 0 AND coalesce(len(d), 0) = 1 THEN d[1] END) AS product, product IS NULL AND (coalesce(len(s), 0) > 1 OR (coalesce(len(s), 0) = 0 AND coalesce(len(d), 0) > 1)) AS ambiguous FROM s""",
    ),
    "D25_version_choices": (
        lambda v: V.version_choices(v.docs.select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 3).alias("product"), F.concat(F.lit("v"), F.lit("1."), F.col("doc_id") % 12).alias("version"))),
        duckdb_views("docs") + ", r AS (SELECT 'p' || (doc_id % 3) AS product, 'v1.' || (doc_id % 12) AS version, doc_id % 12 AS m, count(DISTINCT doc_id) AS documents FROM docs GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY product) AS n, sum(documents) OVER (PARTITION BY product) AS total FROM r) SELECT product, version, documents, row_number() OVER (PARTITION BY product ORDER BY m) AS place, n > 8 AS too_many FROM n WHERE n >= 2 AND total >= 2",
    ),
    "D28_fact_conflicts": (lambda v: V.fact_conflicts(_facts(v)), FACTS + " SELECT doc_id, scope, subject, count(DISTINCT lower(trim(value))) AS n_values, count(DISTINCT lower(trim(value))) > 1 AS conflict FROM facts GROUP BY ALL"),
    "D29_fact_scope_ambiguity": (lambda v: V.fact_scope_ambiguity(_facts(v).withColumn("value", F.substring("scope", 2, 1).cast("int") % 2)), FACTS + ", s AS (SELECT subject, scope, list(DISTINCT CAST(scope[2:2] AS INT) % 2) AS v FROM facts GROUP BY ALL) SELECT a.subject, a.scope, b.scope AS other FROM s a JOIN s b ON a.subject = b.subject AND a.scope < b.scope WHERE NOT list_has_any(a.v, b.v)"),
    "D30_claim_conflicts": (
        lambda v: V.claim_conflicts(_facts(v).select(F.col("doc_id").alias("requirement_id"), F.col("scope").alias("kind"), F.col("subject").alias("claim_key"), F.col("value").alias("result"))),
        FACTS + " SELECT doc_id AS requirement_id, scope AS kind, subject AS claim_key, count(DISTINCT lower(value)) AS n FROM facts GROUP BY ALL HAVING n >= 2",
    ),
    "D31_evidence_set_coverage": (lambda v: _coverage(v), MEM + " SELECT * FROM cov"),
    "D32_best_evidence_set": (lambda v: V.best_evidence_set(_coverage(v)), MEM + " SELECT * FROM cov QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE status WHEN 'complete' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END DESC, covered DESC, support DESC, size, set_id) = 1"),
    "D34_topic_documents": (lambda v: V.topic_documents(_rows(v)).drop("n_terms"), RW + " SELECT query_id, doc_id, min(pos) AS first_pos, max(score) AS best FROM rw GROUP BY ALL"),
    "D36_group_visibility": (
        lambda v: V.group_visibility(v.chunks.select(F.concat_ws("/", "doc_id", "section_key").alias("unit"), "id"), v.chunks.where("block_type = 'text'").select("id")),
        CH + " SELECT concat_ws('/', doc_id, section_key) AS unit, count(*) FILTER (block_type <> 'text') = 0 AS closed, coalesce(array_to_string(list_sort(list(id) FILTER (block_type <> 'text')), ','), '') AS missing FROM chunks GROUP BY 1",
    ),
    "D37_scope_anchor_coverage": (
        lambda v: V.anchor_coverage(v.docs.select((F.col("doc_id") % 40).alias("choice"), "doc_id"), v.chunks.where("block_type = 'table'").select("id", "doc_id")),
        duckdb_views("docs") + " SELECT d.doc_id % 40 AS choice, count(c.id) > 0 AS covered, coalesce(array_to_string(list_sort(list(DISTINCT c.id) FILTER (c.id IS NOT NULL)), ','), '') AS hits FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.block_type = 'table' GROUP BY 1",
    ),
    "G3_rerank_order": (lambda v: V.rerank_order(_rows(v)).select("query_id", "id", "place"), RW + f" SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {ROLE} DESC, CASE constraint_status WHEN 'exact' THEN 5 WHEN 'compatible' THEN 4 WHEN 'neutral' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END DESC, support DESC, topic DESC, score DESC, doc_id, chunk_index, id) AS place FROM rw"),
    "G4_context_order": (lambda v: V.context_order(_rows(v)).select("query_id", "id", "place"), RW + ", f AS (SELECT *, min(pos) OVER (PARTITION BY query_id, doc_id) AS first_at FROM rw) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first_at, chunk_index, id) AS place FROM f"),
    "G7_context_priority": (lambda v: V.context_priority(_rows(v)).select("query_id", "id", "place"), RW + f" SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY is_seed DESC, CASE kind WHEN 'table' THEN 4 WHEN 'specific' THEN 3 ELSE 2 END DESC, {ROLE} DESC, score DESC, pos) AS place FROM rw"),
    "E18_scope_status": (
        lambda v: _scoped(v).select("id", V.X.scope_status(F.lit("p1"), F.lit("6.1"), F.col("product"), F.col("versions"), F.col("compatible"), F.col("unsupported")).alias("status")),
        SC + " SELECT id, CASE WHEN product <> 'p1' THEN 'mismatch' WHEN product IS NULL THEN 'unknown' WHEN list_contains(unsupported, '6.1') THEN 'mismatch' WHEN len(versions) = 1 AND list_contains(versions, '6.1') THEN 'exact' WHEN list_contains(versions, '6.1') OR list_contains(compatible, '6.1') THEN 'compatible' WHEN len(versions) > 0 THEN 'mismatch' ELSE 'unknown' END AS status FROM sc",
    ),
}
