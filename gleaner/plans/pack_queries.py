"""Registered queries of composed retrieval and payload rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import payload as P
from gleaner.operators import documents as D
from gleaner.operators import packs as K
from gleaner.operators import evidence as V
from gleaner.operators import retrieval as R
from gleaner.plans.text_queries import RECORDS_SQL
from gleaner.plans.views import Views, duckdb_views
from gleaner.sources.files import read_documents, rebuild_knowledge_records
from gleaner.sources.table_functions import register_table_functions


def _records(v: Views):
    r = D.extract_records(v.md_chunks, "doc_name")
    return r.withColumn("id", F.concat_ws("#", "doc_name", F.lpad(F.col("line_no").cast("string"), 6, "0"))).withColumnRenamed("doc_name", "doc_id")


def _record_queries(v: Views):
    return _records(v).groupBy("doc_id").agg(F.min_by("subject", "line_no").alias("query")).select(F.col("doc_id").alias("query_id"), "query")


def _payloads(v: Views):
    text = F.expr("concat('{\"event\":\"', event_type, '\",\"apiKey\":\"k', event_id, '\",\"tokens\":', event_id % 9, ',\"deep\":[{\"password\":\"p\",\"content\":\"', case when event_id % 2 = 0 then 'text' else ' ' end, '\"}],\"long\":\"', repeat('x', cast(event_id % 200 as int)), '\",\"hit_count\":3}')")
    return v.events.select("event_id", text.alias("payload"))


def _configs(v: Views):
    """Lines under parents and a property; by turns a block that was run together, pairs in prose, and text of another kind."""
    run_on = "concat('```yaml cache: size: ', event_id % 60, ' # how big ttl: ', user_id % 9, 's url: http://h/', event_id % 4, '```')"
    prose = "concat('here retry.count=', event_id % 12, ' mode=true\\nof a=', event_id, ' no value')"
    text = F.expr(f"concat('server:\\n  port: ', event_id % 100, ' # listen port ', user_id % 5, '\\n  tls:\\n    enabled: ', event_id % 2 = 0, '\\nmax.size=', user_id, '\\n', CASE event_id % 3 WHEN 0 THEN {run_on} WHEN 1 THEN {prose} ELSE 'plain: words' END, '\\n')")
    return v.events.select("event_id", text.alias("text"))


def _settings(v: Views):
    return v.nation.select("n_nationkey", F.expr("concat('server:\\n  port: ', n_nationkey % 7, ' # listen port ', n_nationkey % 10, '\\n')").alias("text"))


def _pack_records(v: Views):
    """A record of every document: its first and last words."""
    w = F.split(F.trim("text"), r"\s+")
    return v.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("doc_id"), F.array_join(F.slice(w, 1, 2), " ").alias("subject"), F.array_join(F.slice(w, 1, 8), " ").alias("search_text"))


def _pack(v: Views):
    return K.evidence_pack(v.queries, v.searched, _pack_records(v), search_chunks=lambda q, c, k: R.hybrid_search(q, c, k, index=v.text_index))


def _md(v: Views):
    """One table a chunk, its document numbered by its brand: Brand#1-10 and Brand#11-0 are chunks of one document."""
    doc = F.replace(F.substring("doc_name", 7, 20), F.lit("-"), F.lit("")).cast("long")
    return v.md_chunks.select(F.col("doc_name").alias("id"), doc.alias("doc_id"), (doc % 3).alias("kb_id"), "content")


def _expanded(v: Views):
    chunks = v.searched
    seeds = R.hybrid_search(v.queries, chunks, 8, index=v.text_index).select("query_id", "id", F.col("fusion_rank").alias("pos"))
    return K.expand_evidence(v.queries, seeds, chunks, v.docs)


def _verdicts(v: Views):
    """Every chunk judged by a verifier that knows its length and label only."""

    def judge(f):
        n = f["content"].str.len()
        return f.assign(topic_relevance=n % 13 / 10, answer_support=n % 7 / 10, role=["direct" if k == "table" else "odd" for k in f["block_type"]])

    return V.with_verdicts(v.chunks.select("id", "content", "block_type"), judge).select("id", F.round("topic_relevance", 6).alias("topic_relevance"), F.round("answer_support", 6).alias("answer_support"), "role")


def _read_back(v: Views):
    """All texts, written to the shared folder as text files and read as documents."""
    import uuid

    from gleaner.session import shared_folder

    folder = f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"
    v.documents.where("text is not null").select("text").write.text(folder)
    found = read_documents(v.spark, folder, "*.txt")
    return found.groupBy("file_type").agg(F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


def _from_sql(v: Views):
    register_table_functions(v.spark)
    _configs(v).createOrReplaceTempView("config_texts")
    return v.spark.sql("SELECT event_id, a.path, a.value, a.meaning FROM config_texts, LATERAL config_assignments(text) a")


def _scope(v: Views):
    return v.queries.select("query_id").join(v.docs.select("doc_id", (F.col("doc_id") % 7).alias("g")), F.col("query_id") % 7 == F.col("g")).select("query_id", "doc_id")


#: Keys and values of payloads: the first five keys hold content, the first four values say something.
NAMES = ["content", "Bridge_Facts", "constraint-reason", "QUERY", "intentRawResponse", "model", "token", "contents"]
VALUES = ['"x"', "0", "false", '["a"]', '" "', "null", "[]", "{}"]


def _quoted(texts: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in texts)


#: Scopes of documents: some have none on a level.
SCOPED = {
    "products": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE array(concat('p', doc_id % 31), concat('q', floor(doc_id / 50))) END",
    "versions": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(concat('v', doc_id % 4)) END",
    "projects": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE array(concat('j', doc_id % 2)) END",
}


SCOPED_SQL = ", ".join(f"{x.replace('array(', 'list_value(').replace('floor(doc_id / 50)', 'CAST(floor(doc_id / 50) AS BIGINT)')} AS {n}" for n, x in SCOPED.items())


def _clustered(table: str, values: str, within: list[str], name: str) -> str:
    """Recursive reach over shared values inside of the outer clusters."""
    group = {"products": "product_group", "versions": "version_group", "projects": "project_group"}[values]
    inside = " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in within) or "''"
    return f"""{name}x AS (SELECT doc_id, {inside} AS inside, unnest({values}) AS value FROM {table}),
        {name}r AS (WITH RECURSIVE reach(i, a, b) AS (SELECT DISTINCT inside, doc_id, doc_id FROM {name}x UNION SELECT reach.i, reach.a, y.doc_id FROM reach JOIN {name}x x ON x.inside = reach.i AND x.doc_id = reach.b JOIN {name}x y ON y.value = x.value AND y.inside = x.inside) SELECT i, a, min(b) AS m FROM reach GROUP BY i, a),
        {name} AS (SELECT t.*, m AS {group} FROM {table} t LEFT JOIN {name}r ON a = doc_id AND i = {inside})"""


def _companions(table: str, group: str, keys: list[str]) -> str:
    """Documents without values as members of every cluster of their outer group."""
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    return f"""{table}_all AS (SELECT t.* EXCLUDE ({group}), coalesce(t.{group}, c.{group}) AS {group} FROM {table} t
        LEFT JOIN (SELECT DISTINCT {", ".join(keys)}, {group} FROM {table} WHERE {group} IS NOT NULL) c ON t.{group} IS NULL AND {same})"""


CONTAINED = "substr(p, CAST(i AS INT), 3)"
WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _grams(table: str, key: str, text: str) -> str:
    return f"(SELECT DISTINCT {key}, {CONTAINED} AS gram FROM (SELECT {key}, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT {key}, '  ' || unnest({WORDS.format(text)}) || ' ' AS p FROM {table})))"


SCORES_SQL = RECORDS_SQL + f""", q AS (SELECT doc_name AS query_id, arg_min(subject, line_no) AS query FROM rec GROUP BY 1),
qg AS {_grams('q', 'query_id', 'query')}, qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1),
ts AS (SELECT query_id, doc_name, line_no, round(count(*) / any_value(n), 6) AS s FROM {_grams('rec', 'doc_name, line_no', 'search_text')} JOIN qg USING (gram) JOIN qn USING (query_id) GROUP BY 1, 2, 3),
ss AS (SELECT query_id, doc_name, line_no, round(count(*) / any_value(n), 6) AS s FROM {_grams('rec', 'doc_name, line_no', 'subject')} JOIN qg USING (gram) JOIN qn USING (query_id) GROUP BY 1, 2, 3),
sc AS (SELECT ts.query_id, ts.doc_name, ts.line_no, greatest(ts.s, coalesce(ss.s, 0)) AS score FROM ts LEFT JOIN ss USING (query_id, doc_name, line_no)),
w AS (SELECT query_id, unnest(list_distinct({WORDS.format('query')})) AS token FROM q), wn AS (SELECT query_id, count(*) AS needed FROM w GROUP BY 1),
aw AS (SELECT query_id, doc_name, line_no, count(*) AS got FROM (SELECT doc_name, line_no, unnest(list_distinct({WORDS.format('search_text')})) AS token FROM rec) JOIN w USING (token) GROUP BY 1, 2, 3)"""
SEARCH_SQL = SCORES_SQL + """ SELECT sc.query_id, sc.doc_name, sc.line_no, sc.score, coalesce(got = needed, false) AS all_words FROM sc JOIN wn USING (query_id) LEFT JOIN aw USING (query_id, doc_name, line_no) WHERE score >= 0.18 OR coalesce(got = needed, false) QUALIFY row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, sc.doc_name || '#' || lpad(CAST(sc.line_no AS VARCHAR), 6, '0')) <= 50"""


def _search(v: Views):
    records = _records(v)
    hits = K.search_records(_record_queries(v), records, 50)
    return hits.join(records.select("id", F.col("doc_id").alias("doc_name"), "line_no"), "id").select("query_id", "doc_name", "line_no", "score", "all_words")


Q = {
    "E12_search_records": (_search, SEARCH_SQL),
    "E13_query_terms": (lambda v: v.queries.select("query_id", F.array_join(K.query_terms(F.concat(F.lit("请问 "), "query", F.lit(" 怎么配置吗"))), "|").alias("terms")), None),
    "E15_extract_config_assignments": (
        lambda v: P.extract_config_assignments(_configs(v), "event_id", "text"),
        """WITH p AS (SELECT * FROM events) SELECT event_id, 'server.port' AS path, CAST(event_id % 100 AS VARCHAR) AS value, 'listen port ' || (user_id % 5) AS meaning FROM p UNION ALL SELECT event_id, 'server.tls.enabled', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, NULL FROM p UNION ALL SELECT event_id, 'max.size', CAST(user_id AS VARCHAR), NULL FROM p
        UNION ALL SELECT event_id, 'size', CAST(event_id % 60 AS VARCHAR), 'how big' FROM p WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'ttl', '"' || (user_id % 9) || 's"', NULL FROM p WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'url', '"http://h/' || (event_id % 4) || '"', NULL FROM p WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 'retry.count', CAST(event_id % 12 AS VARCHAR), NULL FROM p WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'plain', '"words"', NULL FROM p WHERE event_id % 3 = 2""",
    ),
    "E16_match_config": (
        lambda v: K.match_config(v.part.select(F.col("p_partkey").alias("query_id"), F.expr("concat(element_at(array('what is server.port here ', 'listenport ', 'nothing '), cast(1 + p_partkey % 3 as int)), p_size % 10)").alias("query")), P.extract_config_assignments(_settings(v), "n_nationkey", "text").drop("n_nationkey")),
        """WITH q AS (SELECT p_partkey AS query_id, p_partkey % 3 AS k, p_size % 10 AS d FROM part), s AS (SELECT n_nationkey % 7 AS port, n_nationkey % 10 AS d FROM nation)
        SELECT query_id, 'server.port' AS path, CAST(port AS VARCHAR) AS value, 100.0::DOUBLE AS score FROM q, s WHERE k = 0 UNION ALL
        SELECT query_id, 'server.port', CAST(port AS VARCHAR), 61.0::DOUBLE FROM q JOIN s ON q.d = s.d WHERE k = 1""",
    ),
    "E22_entity_facts": (
        lambda v: K.entity_facts(_record_queries(v), _records(v)),
        SCORES_SQL + f""" SELECT query_id, id, kind AS "by", row_number() OVER (PARTITION BY query_id ORDER BY kind, subject, id) AS place FROM (
        SELECT DISTINCT q.query_id, concat_ws('#', doc_name, lpad(CAST(line_no AS VARCHAR), 6, '0')) AS id, subject, CASE WHEN contains(lower(query), lower(subject)) THEN 'subject' WHEN contains(lower(query), lower(value)) THEN 'value' END AS kind
        FROM rec, q WHERE list_has_any(list_concat({WORDS.format('subject')}, {WORDS.format('value')}), {WORDS.format('query')})) WHERE kind IS NOT NULL QUALIFY place <= 60""",
    ),
    "E24_redact_json_keys": (
        lambda v: P.redact_json_keys(_payloads(v), "payload"),
        """SELECT event_id, '{"event":"' || event_type || '","apiKey":"[REDACTED]","tokens":' || (event_id % 9) || ',"deep":[{"password":"[REDACTED]","content":"' || CASE WHEN event_id % 2 = 0 THEN 'text' ELSE ' ' END || '"}],"long":"' || repeat('x', event_id % 200) || '","hit_count":3}' AS payload FROM events""",
    ),
    "E25_contains_business_content": (
        lambda v: P.contains_business_content(v.events.select("event_id", F.expr(f"concat('{{\"a\":[{{\"', element_at(array({_quoted(NAMES)}), cast(1 + event_id % {len(NAMES)} as int)), '\":', element_at(array({_quoted(VALUES)}), cast(1 + floor(event_id / {len(NAMES)}) % {len(VALUES)} as int)), '}}]}}')").alias("payload")), "payload").select("event_id", "has_content"),
        f"SELECT event_id, event_id % {len(NAMES)} < 5 AND CAST(floor(event_id / {len(NAMES)}) AS BIGINT) % {len(VALUES)} < 4 AS has_content FROM events",
    ),
    "E28_cap_payload": (lambda v: P.cap_payload(_payloads(v), "payload", 200), None),
    "F4_search_within_documents": (lambda v: K.search_within_documents(v.queries, v.searched, _scope(v)).select("query_id", "id", "doc_id", "score", "place"), None),
    "F7_evidence_pack": (_pack, None),
    "E12_search_records_for_chunks": (
        lambda v: K.search_records_for_chunks(_record_queries(v), _record_queries(v).select("query_id", F.col("query_id").alias("chunk_id")), _records(v).withColumn("chunk_id", F.col("doc_id"))),
        SCORES_SQL + " SELECT query_id, doc_name AS chunk_id, concat_ws('#', doc_name, lpad(CAST(line_no AS VARCHAR), 6, '0')) AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM sc WHERE doc_name = query_id QUALIFY place <= 20",
    ),
    "F8_second_stage_records": (
        lambda v: K.second_stage_records(_record_queries(v), _record_queries(v).select("query_id", F.col("query_id").alias("chunk_id"), F.lit(1).alias("pos")), _records(v).withColumn("chunk_id", F.col("doc_id"))),
        SCORES_SQL + """, f AS (SELECT query_id, 'r' || concat_ws('#', doc_name, lpad(CAST(line_no AS VARCHAR), 6, '0')) AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, line_no) AS pos, 1 AS source FROM sc WHERE doc_name = query_id QUALIFY pos <= 8),
        u AS (SELECT * FROM f UNION ALL SELECT query_id, 'c' || query_id, 1, 2 FROM q)
        SELECT query_id, item, round(1.0::DOUBLE / (60 + pos), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos, source) AS place FROM u QUALIFY place <= 12""",
    ),
    "F9_expand_evidence": (_expanded, None),
    "K2_verifier_scores": (
        _verdicts,
        duckdb_views("chunks") + " SELECT id, round(least(1.0, length(content) % 13 / 10), 6) AS topic_relevance, round(length(content) % 7 / 10, 6) AS answer_support, CASE WHEN block_type = 'table' THEN 'direct' ELSE 'irrelevant' END AS role FROM chunks",
    ),
    "A1_read_documents": (_read_back, f"SELECT 'txt' AS file_type, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL"),
    "C16_bridge_two_hop": (
        lambda v: K.bridge_two_hop(_record_queries(v).withColumn("query", F.concat(F.lit("what is "), "query", F.lit(" for"))), _records(v)),
        SCORES_SQL + """, a AS (SELECT query_id, 'what is ' || query || ' for' AS query FROM q), s AS (SELECT lower(trim(subject)) AS s, min(value) AS value FROM rec GROUP BY 1 HAVING length(s) >= 2),
        ws AS (SELECT query_id, query, string_split(query, ' ') AS w FROM a), sp AS (SELECT DISTINCT query_id, query, lower(array_to_string(list_slice(w, i, i + n - 1), ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ws), (SELECT unnest(range(1, 40)) AS n) WHERE i + n - 1 <= len(w)),
        best AS (SELECT sp.*, value FROM sp JOIN s USING (s) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(sp.s) DESC, sp.s DESC) = 1)
        SELECT query_id, s AS subject, query[1:instr(lower(query), s) - 1] || value || query[instr(lower(query), s) + length(s):] AS query FROM best""",
    ),
    "C16_bridge_retrieve": (
        lambda v: K.bridge_retrieve(_record_queries(v).withColumn("query", F.concat(F.lit("what is "), "query", F.lit(" for"))), (r := _records(v)), lambda asked: K.search_records(asked, r, 5)).select("query_id", "subject", "id", "rank"),
        None,
    ),
    "D24_scope_groups": (
        lambda v: K.scope_groups(v.docs.select("doc_id", *[F.expr(x).alias(n) for n, x in SCOPED.items()])),
        duckdb_views("docs") + f""", d AS (SELECT doc_id, {SCOPED_SQL} FROM docs),
        {_clustered("d", "products", [], "p")}, {_clustered("p", "versions", ["product_group"], "v")}, {_clustered("v", "projects", ["product_group", "version_group"], "j")}
        SELECT doc_id, product_group, version_group, project_group, (SELECT CASE WHEN count(DISTINCT product_group) > 1 THEN 'product_version' WHEN count(DISTINCT version_group) > 1 THEN 'version' WHEN count(DISTINCT project_group) > 1 THEN 'project' END FROM j) AS dimension FROM j""",
    ),
    "D24_scope_members": (
        lambda v: K.scope_members(v.docs.select(F.floor(F.col("doc_id") / 40).alias("question"), "doc_id", *[F.expr(x).alias(n) for n, x in SCOPED.items()])),
        duckdb_views("docs") + f""", d AS (SELECT doc_id // 40 AS question, doc_id, {SCOPED_SQL} FROM docs),
        {_clustered("d", "products", ["question"], "p")}, {_companions("p", "product_group", ["question"])},
        {_clustered("p_all", "versions", ["question", "product_group"], "v")}, {_companions("v", "version_group", ["question", "product_group"])},
        {_clustered("v_all", "projects", ["question", "product_group", "version_group"], "j")}, {_companions("j", "project_group", ["question", "product_group", "version_group"])},
        each AS (SELECT j_all.*, CASE WHEN product_group IS NOT NULL AND products IS NULL OR version_group IS NOT NULL AND versions IS NULL OR project_group IS NOT NULL AND projects IS NULL THEN true ELSE false END AS shared FROM j_all),
        grp AS (SELECT question, product_group, version_group, project_group, list_sort(list_distinct(flatten(list(coalesce(products, []))))) AS ps, list_sort(list_distinct(flatten(list(coalesce(versions, []))))) AS vs, list_distinct(flatten(list(coalesce(projects, [])))) AS js FROM each GROUP BY ALL),
        dim AS (SELECT question, CASE WHEN count(DISTINCT ps) > 1 THEN 'product_version' WHEN count(DISTINCT vs) FILTER (len(vs) > 0) > 1 THEN 'version' WHEN count(*) > 1 AND min(len(js)) > 0 THEN 'project' END AS dimension FROM grp GROUP BY question)
        SELECT question, product_group, version_group, project_group, doc_id, shared, dimension FROM each JOIN dim USING (question)""",
    ),
    "A5_rebuild_knowledge_records": (
        lambda v: rebuild_knowledge_records(None, _md(v), _md(v).select("doc_id", "kb_id", F.lit("ready").alias("status"), (F.floor(F.col("doc_id") / 10) % 2 == 1).alias("is_active"))).select("kb_id", "doc_id", "subject", "predicate", "value"),
        RECORDS_SQL + " SELECT CAST(replace(doc_name[7:], '-', '') AS BIGINT) % 3 AS kb_id, CAST(replace(doc_name[7:], '-', '') AS BIGINT) AS doc_id, subject, predicate, value FROM rec WHERE CAST(replace(doc_name[7:], '-', '') AS BIGINT) // 10 % 2 = 1",
    ),
    "A8_embed_table": (
        lambda v: D.embed_table(v.documents.select("doc_id", "text"), "text", lambda texts: [[len(t), t.count("e")] for t in texts]).select("doc_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")),
        "SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS y FROM documents",
    ),
    "K1_replaceable_stages": (
        lambda v: K.evidence_pack(v.queries, v.searched, _pack_records(v), search_chunks=lambda q, c, k: R.hybrid_search(q, c, k, vectors=False, index=v.text_index).withColumn("vector_score", F.lit(None).cast("double"))),
        None,
    ),
}
Q["K4_table_functions"] = (_from_sql, Q["E15_extract_config_assignments"][1])
