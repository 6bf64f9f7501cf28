"""The logical input tables of the retrieval and telemetry operators, built from the physical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.retrieval import visible_chunks
from gleaner.operators.text_index import TextIndex, build_text_index, shared_text_index
from gleaner.tables import table

#: name -> (physical tables and views it reads, Spark SQL, DuckDB SQL where it differs)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "chunks": (
        ("embeddings", "documents"),
        """SELECT d.doc_id AS id, CAST(floor(d.doc_id / 4) AS BIGINT) AS doc_id, CAST(d.doc_id % 4 AS INT) AS chunk_index,
           CAST(floor(d.doc_id / 4) AS BIGINT) % 5 AS kb_id, d.text AS content, e.embedding AS embedding,
           concat('sec-', CAST(floor((d.doc_id % 4) / 2) AS INT)) AS section_key,
           CASE WHEN e.label % 2 = 0 THEN 'table' ELSE 'text' END AS block_type,
           CASE WHEN e.label % 2 = 0 THEN concat('t-', CAST(floor(d.doc_id / 4) AS BIGINT)) END AS table_id,
           CASE WHEN e.label % 2 = 0 THEN CAST(d.doc_id % 4 AS INT) END AS table_part_index,
           CASE WHEN e.label % 2 = 0 THEN 4 END AS table_part_count
           FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id""",
        None,
    ),
    "docs": (
        ("chunks",),
        """SELECT doc_id, kb_id, concat('doc-', doc_id, '.md') AS filename, 'md' AS file_type,
           CASE doc_id % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'ready' END AS status,
           doc_id % 7 <> 0 AS is_active, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 13 END AS created_by,
           1 + doc_id % 3 AS processing_revision, count(*) AS chunk_count
           FROM {chunks} GROUP BY doc_id, kb_id""",
        None,
    ),
    "kb": (("chunks",), "SELECT DISTINCT kb_id, concat('kb-', kb_id) AS name FROM {chunks}", None),
    "runs": (
        ("events",),
        """SELECT event_id AS trace_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
           CASE WHEN event_type = 'view' THEN 'search_test' ELSE 'chat' END AS request_kind,
           CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
           CASE event_id % 7 WHEN 0 THEN 'hit' WHEN 1 THEN 'partial' WHEN 2 THEN 'needs_clarification' WHEN 3 THEN 'no_hit'
                WHEN 4 THEN 'insufficient_evidence' WHEN 5 THEN 'unverified' END AS evidence_status,
           CAST(floor(value * 10) AS BIGINT) AS duration_ms, CASE WHEN event_id % 7 = 6 THEN NULL ELSE event_id % 5 END AS hit_count,
           1 + event_id % 3 AS selected_kb_count, ts AS started_at FROM {events}""",
        None,
    ),
    "trace_events": (
        ("events",),
        """SELECT event_id, user_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS trace_id,
           CAST(row_number() OVER (PARTITION BY user_id, extract(day FROM ts) ORDER BY ts, event_id) AS BIGINT) AS seq,
           CASE event_type WHEN 'signup' THEN 'chat.request' WHEN 'view' THEN 'intent.model_result' WHEN 'click' THEN 'generation.completed'
                WHEN 'purchase' THEN 'chat.response' ELSE 'chat.error' END AS event,
           user_id, props AS payload, ts AS created_at FROM {events}""",
        None,
    ),
    # Trace events with the payloads of a run: fields of every type that a summary must tell apart.
    "records": (
        ("trace_events",),
        """SELECT t.event_id, t.trace_id, t.seq, t.event, CASE WHEN t.event_id % 11 = 0 THEN NULL ELSE t.user_id END AS user_id, t.created_at,
           concat('{{"n":', t.event_id, CASE WHEN t.event_id % 3 = 0 THEN concat(',"conversation_id":"c', t.trace_id % 97, '"') WHEN t.event_id % 3 = 1 THEN ',"conversation_id":""' ELSE '' END,
             CASE t.event_id % 5 WHEN 0 THEN concat(',"question":" what  about item ', t.event_id, '?"') WHEN 1 THEN concat(',"query":"item ', t.event_id, '","answer":""')
               WHEN 2 THEN concat(',"question":" ","answer":"', repeat('so it is. ', CAST(t.event_id % 60 AS INT)), '"') WHEN 3 THEN concat(',"meta":[{{"Candidate_Content":"', CASE WHEN t.event_id % 2 = 0 THEN 'x' ELSE ' ' END, '"}}]') ELSE '' END,
             CASE t.event_id % 4 WHEN 0 THEN ',"selected_kb_ids":[1,2,"x"]' WHEN 1 THEN concat(',"selected_kb_count":', t.event_id % 6) WHEN 2 THEN ',"selected_kb_count":"7"' ELSE '' END,
             CASE t.event_id % 7 WHEN 0 THEN ',"evidence_status":"no_hit","hit_count":5' WHEN 1 THEN concat(',"evidence_status":"hit","hit_count":', t.event_id % 9) WHEN 2 THEN ',"hit_count":"3","direct_evidence_count":4'
               WHEN 3 THEN ',"hit_count":-1' WHEN 4 THEN ',"evidence_status":"skipped"' WHEN 5 THEN ',"hit_count":true,"direct_evidence_count":2' ELSE ',"evidence_status":""' END,
             CASE t.event_id % 6 WHEN 0 THEN concat(',"total_ms":', t.event_id % 1000, '.5') WHEN 1 THEN concat(',"total_ms":', t.event_id % 1000) WHEN 2 THEN ',"total_ms":"12"' WHEN 3 THEN ',"total_ms":-4' ELSE '' END,
             CASE t.event_id % 8 WHEN 0 THEN concat(',"prompt_tokens":', t.event_id % 500) WHEN 1 THEN concat(',"prompt_tokens":', t.event_id % 500, ',"completion_tokens":', t.event_id % 70) WHEN 2 THEN concat(',"prompt_tokens":10,"completion_tokens":5,"total_tokens":', t.event_id % 90)
               WHEN 3 THEN ',"prompt_tokens":"44","note":"prompt_tokens: 3"' WHEN 4 THEN ',"usage":{{"prompt_tokens":9}}' WHEN 5 THEN ',"total_tokens":12,"completion_tokens":null' ELSE '' END, '}}') AS payload
           FROM {trace_events} t""",
        None,
    ),
    "logins": (
        ("events",),
        """SELECT event_id AS id, concat('u', user_id) AS username, concat('10.0.', CAST(floor(user_id / 8) AS BIGINT)) AS ip, user_id,
           event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN concat('r', event_id % 2) END AS fail_reason, ts AS attempt_at FROM {events}""",
        None,
    ),
    "messages": (("conversations",), "SELECT conv_id, turn, role, text AS content FROM {conversations}", None),
    "roles": (("nation",), "SELECT n_nationkey AS role_id, CASE n_regionkey WHEN 0 THEN 'all' WHEN 1 THEN 'none' ELSE 'selected' END AS scope_mode FROM {nation}", None),
    "role_kb": (("nation",), "SELECT n_nationkey AS role_id, CAST(n_nationkey % 5 AS BIGINT) AS kb_id FROM {nation} WHERE n_regionkey > 1", None),
    "users": (("customer",), "SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS role_id, c_custkey % 50 = 0 AS is_superadmin FROM {customer}", None),
    "kv_rows": (("part",), "SELECT p_brand AS sheet, p_partkey AS row_id, p_name AS name, p_type AS type, CAST(p_size AS STRING) AS size FROM {part}", None),
    "queries": (
        ("benchmark", "embeddings"),
        r"""SELECT b.item_id AS query_id, e.embedding AS query_vec, array_join(slice(split(lower(b.text), '[ \\n]+'), 1, 3), ' ') AS query FROM {benchmark} b LEFT JOIN {embeddings} e ON e.vec_id = b.item_id""",
        r"""SELECT b.item_id AS query_id, e.embedding AS query_vec, array_to_string(list_slice(string_split_regex(lower(b.text), '[ \n]+'), 1, 3), ' ') AS query FROM {benchmark} b LEFT JOIN {embeddings} e ON e.vec_id = b.item_id""",
    ),
    # Tables of some 40 rows: a brand's parts, a thousand keys at a time.
    "md_chunks": (
        ("part",),
        r"""SELECT concat(p_brand, '-', CAST(floor(p_partkey / 1000) AS BIGINT)) AS doc_name, concat('| name | type |\n| --- | --- |\n', listagg(concat('| ', p_name, ' | ', p_type, ' |'), '\n') WITHIN GROUP (ORDER BY p_partkey)) AS content FROM {part} GROUP BY p_brand, floor(p_partkey / 1000)""",
        """SELECT concat(p_brand, '-', CAST(floor(p_partkey / 1000) AS BIGINT)) AS doc_name, concat('| name | type |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', p_name, ' | ', p_type, ' |'), chr(10) ORDER BY p_partkey)) AS content FROM {part} GROUP BY p_brand, floor(p_partkey / 1000)""",
    ),
}


class Views:
    """The views over the tables of one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    @property
    def searched(self) -> DataFrame:
        """Visible chunks with the names of their files."""
        visible = visible_chunks(self.chunks, self.docs)
        return visible.join(self.docs.select("doc_id", "kb_id", "filename"), ["doc_id", "kb_id"])

    @property
    def text_index(self) -> TextIndex:
        """The index of the searched chunks, shared by all queries over the same files."""
        return shared_text_index(self.spark, [f"{self.folder}/{t}.parquet" for t in ("documents", "embeddings")], lambda: build_text_index(self.searched))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                needs, sql, _ = VIEWS[name]
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
            else:
                self._made[name] = table(self.spark, self.folder, name)
        return self._made[name]


def duckdb_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` of these views and what they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    parts = []
    for n in order:
        needs, spark_sql, duck_sql = VIEWS[n]
        parts.append(f"{n} AS ({(duck_sql or spark_sql).format(**{x: x for x in needs})})")
    return "WITH " + ",\n".join(parts)
