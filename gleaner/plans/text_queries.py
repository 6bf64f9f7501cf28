"""Registered queries of text functions and document operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import documents as D
from gleaner.plans.views import Views, duckdb_views

MD, KV = duckdb_views("md_chunks"), duckdb_views("kv_rows")
NL = "chr(10)"


def _doc(v: Views, *columns):
    return v.documents.select("doc_id", *columns)


def _headed(v: Views):
    """Documents whose paragraphs get headings of changing level, and a table."""
    i = F.col("doc_id")
    parts = F.transform(F.split("text", "\n"), lambda p, k: F.concat(F.repeat(F.lit("#"), (1 + (k + i.cast("int")) % 3).cast("int")), F.lit(" h"), k, F.lit("\n"), p, F.lit("\n| a | b |\n| --- | --- |\n| x | "), k, F.lit(" |")))
    return v.documents.select("doc_id", F.concat(F.lit("d-"), i).alias("title"), F.array_join(parts, "\n").alias("text"))


VERSIONED = "concat('ver ', event_id % 9, '.0', user_id % 7, ' and ', event_id % 3, '.', user_id % 5, '.2 or 8')"
SECRET = "concat('Bearer abc.', event_id, ' x password=', user_id, '; see https://u:p@h', event_id % 5, '.org/a/', user_id, '?q=1#z end')"
MIXED = "concat(event_type, '-x ', '知识库检索', ' a', user_id % 9, ' ', '版本')"
NAMED = "concat(p_brand, ' ', p_type, element_at(array(' Platform', '-系统', ' 工程', ' x'), cast(1 + p_partkey % 4 as int)))"
NAMED_SQL = "p_brand || ' ' || p_type || [' Platform', '-系统', ' 工程', ' x'][1 + p_partkey % 4]"
NOISE = X.LOOKUP_NOISE.replace("'", "''")
RECORDS_SQL = MD + """, l AS (SELECT doc_name, unnest(string_split(content, chr(10))) AS line, unnest(range(0, len(string_split(content, chr(10))))) AS n FROM md_chunks),
  c AS (SELECT doc_name, n, list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda x: trim(x)) AS cells FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY n) AS r FROM c WHERE len(cells) >= 2 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{3,}:?$'))) > 0),
  rec AS (SELECT doc_name, n AS line_no, cells[1] AS subject, 'type' AS predicate, cells[2] AS value, array_to_string(cells, ' ') AS search_text FROM k WHERE r > 1 AND cells[1] <> '' AND cells[2] <> '' QUALIFY row_number() OVER (PARTITION BY doc_name, cells[1], cells[2] ORDER BY n) = 1)"""
CLAIMS = """element_at(array(
  concat('本组件支持 Box ', event_id % 9, '.', user_id % 5, '。但不再支持 Box v', event_id % 4, '.9，Box 7 兼容'),
  concat('盒子平台', event_id % 9, '.', user_id % 5, '尚未适配，适用于盒子平台 ', event_id % 4, '.9'),
  concat('box 0', event_id % 9, '.', user_id % 5, '：兼容；组件支持 8.6')), cast(1 + event_id % 3 as int))"""
#: Sentences about lists: what leads them in, and what follows.
LEADS = ["仅支持", "共 3 项：", "所有条目如下", "分为", "it consists of ", "依次为", "the following: ", "主要是", "有"]
TAILS = ["", "，例如丙", "，详见附录"]
HEADS = ["| a | b |\\n| c | d |\\n", "# 第一章 总则\\n", "不得超过\\n", "", "<TABLE><tr>", "目的：", "限 3 天 ", "目的地 "]
KINDS = ["table", "overview", "specific", "other", "table", "overview", "specific", "other"]


def quoted(texts: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in texts)


LEVELS = ", ".join(f"last_value(CASE WHEN level > 0 AND level <= {k} THEN struct_pack(l := level, t := title) END IGNORE NULLS) OVER w AS s{k}" for k in range(1, 7))
TITLES = ", ".join(f"CASE WHEN s{k}.l = {k} THEN s{k}.t END" for k in range(1, 7))
SECTIONS_SQL = f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, {NL})) AS p, unnest(range(0, len(string_split(text, {NL})))) AS k FROM documents),
l AS (SELECT doc_id, 5 * k + unnest(range(0, 5)) AS n, unnest([repeat('#', CAST(1 + (k + doc_id) % 3 AS BIGINT)) || ' h' || k, p, '| a | b |', '| --- | --- |', '| x | ' || k || ' |']) AS line FROM p),
v AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM l),
h AS (SELECT *, {LEVELS}, CASE WHEN level > 0 THEN 'heading' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^\\|.*\\|$') THEN 'table' ELSE 'text' END AS kind FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT *, concat_ws(' › ', {TITLES}) AS path, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AND kind <> 'heading' THEN 0 ELSE 1 END AS change FROM h),
b AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM c)
SELECT doc_id, block, path, kind, min(n) AS first_line, string_agg(line, {NL} ORDER BY n) AS content FROM b WHERE kind IN ('table', 'text') GROUP BY doc_id, block, path, kind"""
Q = {
    "A2_rows_to_kv_text": (
        lambda v: D.rows_to_kv_text(v.kv_rows, ["name", "type", "size"], "sheet", "row_id"),
        KV + f" SELECT sheet, '[' || sheet || ']' || {NL} || string_agg('name: ' || name || '，type: ' || type || '，size: ' || size, {NL} ORDER BY row_id) AS text FROM kv_rows GROUP BY sheet HAVING count(*) >= 2",
    ),
    "A3_rows_to_markdown_table": (
        lambda v: D.rows_to_markdown_table(v.kv_rows, ["name", "type"], "sheet", "row_id"),
        KV + f" SELECT sheet, '| name | type |' || {NL} || '| --- | --- |' || {NL} || string_agg('| ' || name || ' | ' || type || ' |', {NL} ORDER BY row_id) AS content FROM kv_rows GROUP BY sheet",
    ),
    "E2_parse_sections": (lambda v: D.parse_sections(_headed(v), "doc_id"), SECTIONS_SQL),
    "E3_drop_placeholder_sections": (
        lambda v: v.events.select("event_id", F.expr("concat('> ', element_at(array('无', 'N/A', 'yes', '-'), cast(1 + event_id % 4 as int)), '\n\n', element_at(array('暂无', 'no', '-'), cast(1 + event_id % 3 as int)))").alias("t")).where(~X.is_placeholder(F.col("t"))),
        f"SELECT * FROM (SELECT event_id, '> ' || ['无', 'N/A', 'yes', '-'][1 + event_id % 4] || {NL} || {NL} || ['暂无', 'no', '-'][1 + event_id % 3] AS t FROM events) WHERE event_id % 4 = 2 OR event_id % 3 = 1",
    ),
    "E6_chunk_documents": (lambda v: D.chunk_documents(_headed(v), "doc_id", "title"), None),
    "E7_stable_structure_id": (
        lambda v: _doc(v, X.stable_structure_id("sec", F.col("source"), F.col("text")).alias("sid")),
        "SELECT doc_id, 'sec:' || sha256(lower(trim(source)) || chr(31) || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))[1:24] AS sid FROM documents",
    ),
    "E8_strip_section_context": (
        lambda v: v.documents.select("doc_id", X.strip_section_context(F.concat(F.expr("element_at(array('【a › h】\n', '  【b】 \n\n', 'x 【c】\n', '【d'), cast(1 + doc_id % 4 as int))"), F.lit("q"), "text")).alias("t")),
        f"SELECT doc_id, ['', '', 'x 【c】' || {NL}, '【d'][1 + doc_id % 4] || 'q' || text AS t FROM documents",
    ),
    "E10_row_cells": (
        lambda v: v.md_chunks.select("doc_name", F.explode(F.split("content", "\n")).alias("line")).select("doc_name", F.array_join(X.row_cells(F.col("line")), "/").alias("cells")).where("cells is not null"),
        RECORDS_SQL + " SELECT doc_name, array_to_string(cells, '/') AS cells FROM k",
    ),
    "E11_extract_records": (lambda v: D.extract_records(v.md_chunks, "doc_name"), RECORDS_SQL + " SELECT * FROM rec"),
    "E14_matching_line": (
        lambda v: _doc(v, X.matching_line(F.col("text"), F.lit("Tion "), 200).alias("line")),
        f"SELECT doc_id, coalesce(list_filter(string_split(text, {NL}), lambda x: contains(lower(x), 'tion '))[1], text)[1:200] AS line FROM documents",
    ),
    "E17_extract_versions": (
        lambda v: v.events.select("event_id", F.array_join(X.extract_versions(F.expr(VERSIONED)), ",").alias("versions")),
        "SELECT event_id, array_to_string(list_distinct_ordered, ',') AS versions FROM (SELECT event_id, CASE WHEN a = b THEN [a, '8'] ELSE [a, b, '8'] END AS list_distinct_ordered FROM (SELECT event_id, (event_id % 9) || '.' || (user_id % 7) AS a, (event_id % 3) || '.' || (user_id % 5) || '.2' AS b FROM events))",
    ),
    "E14_exact_source_match": (
        lambda v: v.documents.select("doc_id", X.exact_source_match(F.concat(F.substring("text", 11, 30), F.expr("element_at(array(' - ', '！', ' zq', '\u3010'), cast(1 + doc_id % 4 as int))")), F.col("text")).alias("found")),
        rf"WITH n AS (SELECT doc_id, regexp_replace(lower(text), '{NOISE}', '', 'g') AS t, regexp_replace(lower(text[11:40] || [' - ', '！', ' zq', '【'][1 + doc_id % 4]), '{NOISE}', '', 'g') AS q FROM documents) SELECT doc_id, q <> '' AND contains(t, q) AS found FROM n",
    ),
    "E17_canonical_names": (
        lambda v: v.part.select("p_partkey", X.canonical_product(F.expr(NAMED)).alias("product"), X.canonical_project(F.expr(NAMED)).alias("project"), X.canonical_version(F.expr("concat(element_at(array('v', 'V ', '版本', ''), cast(1 + p_partkey % 4 as int)), '0', p_size, element_at(array('.007', '', '-RC', '.0'), cast(1 + p_partkey % 4 as int)))")).alias("version")),
        f"""WITH n AS (SELECT p_partkey, p_size, p_partkey % 4 AS k, regexp_replace(lower({NAMED_SQL}), '[^a-z0-9㐀-鿿]+', '', 'g') AS t FROM part)
        SELECT p_partkey, CASE WHEN k = 0 THEN t[1:length(t) - 8] WHEN k = 1 THEN t[1:length(t) - 2] ELSE t END AS product, CASE WHEN k = 2 THEN t[1:length(t) - 2] ELSE t END AS project,
        CASE k WHEN 0 THEN p_size || '.7' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '0' || p_size || '-rc' ELSE p_size || '.0' END AS version FROM n""",
    ),
    "E20_canonical_evidence_status": (
        lambda v: v.events.select("event_id", X.canonical_evidence_status(F.expr("element_at(array(' Hit', 'version_mismatch', 'other', 'error'), cast(1 + event_id % 4 as int))")).alias("status")),
        "SELECT event_id, ['hit', 'scope_mismatch', NULL, 'error'][1 + event_id % 4] AS status FROM events",
    ),
    "E21_topic_terms": (
        lambda v: v.events.select("event_id", F.array_join(X.topic_terms(F.expr(MIXED)), ",").alias("terms")),
        "SELECT event_id, array_to_string(list_sort([event_type || '-x', 'a' || (user_id % 9), '知识', '识库', '库检', '检索', '知识库', '识库检', '库检索', '版本']), ',') AS terms FROM events",
    ),
    "E23_redact_text": (
        lambda v: v.events.select("event_id", X.redact_text(F.expr(SECRET)).alias("t")),
        "SELECT event_id, 'Bearer [REDACTED] x password=[REDACTED]; see https://h' || (event_id % 5) || '.org/a/' || user_id || ' end' AS t FROM events",
    ),
    "E26_content_fingerprint": (lambda v: _doc(v, X.content_fingerprint(F.col("text")).alias("f")).select("doc_id", "f.length", "f.sha256"), "SELECT doc_id, length(text) AS length, sha256(text) AS sha256 FROM documents"),
    "E27_preview": (lambda v: _doc(v, X.preview(F.col("text"), 100).alias("p")), "SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 100 THEN t[1:100] || '…' ELSE t END AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)"),
    "E29_throttle_keys": (
        lambda v: v.logins.select("id", X.throttle_keys(F.upper("username"), F.when(F.col("id") % 7 != 0, F.col("ip")))["pair"].alias("pair_key")),
        duckdb_views("logins") + " SELECT id, sha256('pair' || chr(0) || CASE WHEN id % 7 <> 0 THEN ip ELSE 'unknown' END || chr(0) || username) AS pair_key FROM logins",
    ),
    "E30_file_type_from_name": (
        lambda v: v.docs.select("doc_id", X.file_type_from_name(F.col("file_type"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a."), F.lit("PDF"))).otherwise(F.col("filename"))).alias("kind")),
        duckdb_views("docs") + " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE file_type END AS kind FROM docs",
    ),
    "E31_evidence_role": (
        lambda v: v.events.select(
            "event_id", X.evidence_role(F.expr("element_at(array('direct', 'related', 'irrelevant'), cast(1 + event_id % 3 as int))"), F.expr("event_id % 5 / 8"), F.expr("event_id % 7 / 10"), F.expr("element_at(array('exact', 'unknown', 'mismatch'), cast(1 + floor(event_id / 3) % 3 as int))"), F.expr("event_id % 2 = 0"), F.expr("element_at(array('answer', 'bridge', 'irrelevant', 'answer'), cast(1 + event_id % 4 as int))")).alias("role"),
        ),
        """WITH e AS (SELECT event_id, ['direct', 'related', 'irrelevant'][1 + event_id % 3] AS role, event_id % 5 / 8 AS topic, event_id % 7 / 10 AS support, ['exact', 'unknown', 'mismatch'][1 + CAST(floor(event_id / 3) AS BIGINT) % 3] AS status, event_id % 2 = 0 AS scoped, ['answer', 'bridge', 'irrelevant', 'answer'][1 + event_id % 4] AS c FROM events),
        f AS (SELECT *, CASE WHEN topic >= 0.3 THEN 'related' ELSE 'irrelevant' END AS lesser FROM e),
        g AS (SELECT *, CASE WHEN status = 'mismatch' THEN lesser WHEN status = 'unknown' AND scoped AND role = 'direct' THEN 'related' WHEN role = 'direct' AND (topic < 0.3 OR support < 0.3) THEN lesser ELSE role END AS first FROM f)
        SELECT event_id, CASE WHEN c = 'irrelevant' THEN 'irrelevant' WHEN c = 'bridge' AND first = 'direct' THEN lesser ELSE first END AS role FROM g""",
    ),
    "E32_request_kind": (
        lambda v: v.trace_events.select("event_id", X.request_kind(F.col("event"), F.when(F.col("event_id") % 2 == 0, "search_test")).alias("kind")),
        duckdb_views("trace_events") + " SELECT event_id, CASE WHEN event LIKE 'chat.%' THEN 'chat' WHEN event_id % 2 = 0 THEN 'search_test' ELSE 'unknown' END AS kind FROM trace_events",
    ),
    "E34_identity_fingerprint": (
        lambda v: v.docs.select("doc_id", X.identity_fingerprint(F.array("filename", "status"), F.array("file_type")).alias("fp")),
        duckdb_views("docs") + " SELECT doc_id, sha256(array_to_string(list_sort([filename, status]), chr(31)) || chr(31) || chr(31) || file_type) AS fp FROM docs",
    ),
    "E35_normalize_tags": (
        lambda v: v.events.select("event_id", F.array_join(X.normalize_tags(F.expr("""case when event_id % 5 = 0 then 'not json' else concat('[" a', event_id % 3, ' ","b","","b"]') end""")), ",").alias("tags")),
        "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'a' || (event_id % 3) || ',b' END AS tags FROM events",
    ),
    "G5_candidate_limit": (
        lambda v: v.events.select("event_id", X.candidate_limit(F.col("event_id") % 25).alias("n"), X.candidate_limit(F.col("event_id") % 25, simple=True).alias("simple")),
        "SELECT event_id, least(30, greatest(12, 3 * least(20, event_id % 25))) AS n, least(20, greatest(8, 2 * least(20, event_id % 25))) AS simple FROM events",
    ),
    "G6_version_order": (
        lambda v: v.events.select("event_id", F.concat(F.col("user_id") % 12, F.lit("."), F.col("event_id") % 30).alias("version")).withColumn("place", F.rank().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(F.col("event_id") % 8).orderBy(X.version_key(F.col("version"))))),
        "SELECT event_id, (user_id % 12) || '.' || (event_id % 30) AS version, rank() OVER (PARTITION BY event_id % 8 ORDER BY user_id % 12, event_id % 30) AS place FROM events",
    ),
    "E1_normalize_markdown": (
        lambda v: _doc(v, X.normalize_markdown(F.concat(F.lit("a<br/>b\r\n"), F.regexp_replace("text", "\n", "\n\n\n\n\n"))).alias("t")),
        f"SELECT doc_id, 'a' || {NL} || 'b' || {NL} || replace(text, {NL}, repeat({NL}, 3)) AS t FROM documents",
    ),
    "E19_compatibility_statements": (
        lambda v: v.events.select("event_id", X.compatibility_statements(F.expr(CLAIMS), ["Box", "盒子平台"]).alias("c")).select("event_id", F.array_join("c.compatible", ",").alias("compatible"), F.array_join("c.unsupported", ",").alias("unsupported"), F.array_join("c.products", ",").alias("products")),
        """WITH e AS (SELECT event_id, (event_id % 9) || '.' || (user_id % 5) AS a, (event_id % 4) || '.9' AS b, event_id % 3 AS k FROM events)
        SELECT event_id, CASE k WHEN 0 THEN a || ',7' WHEN 1 THEN b ELSE a END AS compatible, CASE k WHEN 0 THEN b WHEN 1 THEN a ELSE '' END AS unsupported, CASE k WHEN 0 THEN 'box' WHEN 1 THEN '盒子平台' ELSE 'box' END AS products FROM e""",
    ),
    "E33_collection_closure_flags": (
        lambda v: v.events.select("event_id", X.collection_flags(F.expr(f"concat(element_at(array({quoted(LEADS)}), cast(1 + event_id % {len(LEADS)} as int)), '甲、乙', element_at(array({quoted(TAILS)}), cast(1 + floor(event_id / {len(LEADS)}) % {len(TAILS)} as int)))")).alias("f")).select("event_id", "f.*"),
        f"""WITH e AS (SELECT event_id, event_id % {len(LEADS)} AS i, CAST(floor(event_id / {len(LEADS)}) AS BIGINT) % {len(TAILS)} AS k FROM events), f AS (SELECT event_id, i <= 4 AS closes, i IN (2, 5, 6) AS introduces, i = 7 OR k = 1 AS opens, k = 2 AS elsewhere FROM e)
        SELECT *, (closes OR introduces) AND NOT opens AND NOT elsewhere AS closed FROM f""",
    ),
    "E36_section_kind": (
        lambda v: v.documents.select("doc_id", X.section_kind(F.concat(F.expr(f"element_at(array({quoted(HEADS)}), cast(1 + doc_id % {len(HEADS)} as int))"), F.lit("plain words")), F.when(F.col("doc_id") % 5 == 0, " Other ")).alias("kind")),
        f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE {KINDS}[1 + doc_id % {len(HEADS)}] END AS kind FROM documents",
    ),
    "E4_split_text": (lambda v: D.split_texts(v.documents, "doc_id", "text"), None),
    "E5_split_table_rows": (lambda v: D.split_tables(v.md_chunks, "doc_name", "content"), None),
}
