"""Registered queries of the telemetry operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.payload import CONTENT_KEYS
from gleaner.operators import runs as U
from gleaner.operators import telemetry as T
from gleaner.plans.views import Views, duckdb_views

RUNS, TE, RE, LOG, MSG = duckdb_views("runs"), duckdb_views("trace_events"), duckdb_views("records"), duckdb_views("logins"), duckdb_views("messages")
TERM = {k: "(" + ", ".join(f"'{e}'" for e in v) + ")" for k, v in U.TERMINAL.items()}
ALL_TERM = "(" + ", ".join(f"'{e}'" for e in U.ALL_TERMINAL) + ")"


def _number(path: str, kinds: str = "('UBIGINT', 'BIGINT', 'DOUBLE')") -> str:
    return f"CASE WHEN json_type(j, '$.{path}') IN {kinds} THEN CAST(j->>'$.{path}' AS DOUBLE) END"


def _count(path: str) -> str:
    return f"CASE WHEN json_type(j, '$.{path}') IN ('UBIGINT', 'BIGINT') AND CAST(j->>'$.{path}' AS BIGINT) >= 0 THEN CAST(j->>'$.{path}' AS BIGINT) END"


def _said(*names: str) -> str:
    one = lambda n: f"nullif(trim(regexp_replace(CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' THEN j->>'$.{n}' END, '\\s+', ' ', 'g')), '')"
    return "coalesce(" + ", ".join(f"CASE WHEN length({one(n)}) > 500 THEN substr({one(n)}, 1, 500) || '…' ELSE {one(n)} END" for n in names) + ")"


#: The rule of a run, told by a fold over the list of its outcomes.
FOLD = f"""q AS (SELECT *, payload::JSON AS j FROM records),
p AS (SELECT *, CASE WHEN event LIKE 'chat.%' THEN 'chat' WHEN event LIKE 'search_test.%' THEN 'search_test' END AS kind,
  CASE WHEN event IN {TERM['success']} THEN 'success' WHEN event IN {TERM['error']} THEN 'error' WHEN event IN {TERM['interrupted']} THEN 'interrupted' END AS state,
  nullif(j->>'$.conversation_id', '') AS conversation, {_said('question', 'query')} AS asked, {_said('answer', 'partial_answer')} AS said, nullif(j->>'$.evidence_status', '') AS evidence,
  CASE WHEN json_type(j, '$.selected_kb_ids') = 'ARRAY' THEN CAST(json_array_length(j, '$.selected_kb_ids') AS BIGINT) WHEN json_type(j, '$.selected_kb_count') IN ('UBIGINT', 'BIGINT') THEN CAST(j->>'$.selected_kb_count' AS BIGINT) END AS kbs,
  CASE WHEN j->>'$.evidence_status' IN ('no_hit', 'skipped') THEN 0 ELSE coalesce({_count('hit_count')}, {_count('direct_evidence_count')}) END AS hits,
  CASE WHEN {_number('total_ms')} >= 0 THEN CAST(round_even({_number('total_ms')}, 0) AS BIGINT) END AS stage_ms,
  min(created_at) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS first_at FROM q),
tree AS (SELECT q.event_id, bool_or(regexp_replace(lower(t.key), '[^a-z0-9]', '', 'g') IN {tuple(CONTENT_KEYS)} AND CASE t.type WHEN 'VARCHAR' THEN trim(t.atom->>'$') <> '' WHEN 'NULL' THEN false ELSE CAST(t.value AS VARCHAR) NOT IN ('[]', '{{}}') END) AS content FROM q, json_tree(q.j) t GROUP BY q.event_id),
w AS (SELECT p.*, asked IS NOT NULL OR said IS NOT NULL OR coalesce(content, false) AS has_content,
  CASE WHEN state IS NOT NULL THEN greatest(CAST(round_even((epoch_us(created_at) - epoch_us(first_at)) / 1000.0, 0) AS BIGINT), 0) ELSE stage_ms END AS ms FROM p LEFT JOIN tree USING (event_id)),
folded AS (SELECT trace_id, arg_max(event, seq) AS current_stage, arg_max(kind, seq) FILTER (kind IS NOT NULL) AS request_kind, arg_max(user_id, seq) FILTER (user_id IS NOT NULL) AS user_id,
  arg_max(conversation, seq) FILTER (conversation IS NOT NULL) AS conversation_id, arg_max(asked, seq) FILTER (asked IS NOT NULL) AS input_preview, arg_max(said, seq) FILTER (said IS NOT NULL) AS output_preview, bool_or(has_content) AS content_included,
  arg_max(kbs, seq) FILTER (kbs IS NOT NULL) AS selected_kb_count, arg_max(evidence, seq) FILTER (evidence IS NOT NULL) AS evidence_status, arg_max(hits, seq) FILTER (hits IS NOT NULL) AS hit_count, arg_max(ms, seq) FILTER (ms IS NOT NULL) AS duration_ms,
  min(created_at) AS started_at, arg_max(created_at, seq) AS updated_at, arg_max(created_at, seq) FILTER (state IS NOT NULL) AS completed_at,
  list_reduce(list_prepend('running', coalesce(list(state ORDER BY seq) FILTER (state IS NOT NULL), [])), lambda a, b: CASE WHEN a = 'error' AND b = 'success' THEN a ELSE b END) AS status, count(*) AS events FROM w GROUP BY trace_id)"""
_TOKENS = {c: f"CAST(round({_number(n)}) AS BIGINT)" for c, n in (("p", "prompt_tokens"), ("c", "completion_tokens"), ("t", "total_tokens"))}
USAGE = RE + f""", u AS (SELECT CAST(created_at AS DATE) AS day, event, {_TOKENS['p']} AS p, {_TOKENS['c']} AS c, {_TOKENS['t']} AS t FROM (SELECT *, payload::JSON AS j FROM records) WHERE event IN ('generation.completed', 'intent.model_result')),
usage AS (SELECT day, event, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(c), 0) AS BIGINT) AS completion_tokens, CAST(sum(coalesce(t, coalesce(p, 0) + coalesce(c, 0))) AS BIGINT) AS total_tokens, count(coalesce(t, p, c)) AS calls FROM u GROUP BY ALL)"""
COMPLETIONS = ["generation.completed", "intent.model_result"]
TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


#: Runs after the sweep: silent ones are interrupted.
STALE = """swept AS (SELECT * EXCLUDE (stale) REPLACE (CASE WHEN stale THEN 'interrupted' ELSE status END AS status, CASE WHEN stale THEN updated_at ELSE completed_at END AS completed_at) FROM (
  SELECT folded.*, status = 'running' AND updated_at < (SELECT max(created_at) FROM records) - INTERVAL {silent} AS stale FROM folded))"""


def _retained(v):
    """Events of the runs that started in the last 20 days."""
    from gleaner.session import stored

    runs = stored(U.fold_trace_runs(v.records).select("trace_id", "started_at"), "runs")
    return U.retained(runs, v.records, F.lit(v.records.agg(F.max("created_at")).first()[0]), 20)[1].select("event_id", "trace_id")


def _throttles(v):
    """A bucket for each user, some of them blocked for days."""
    rows = v.logins.where("not success").groupBy("username").agg(F.max("attempt_at").alias("last_failed_at"), F.max("id").alias("id"))
    rows = rows.select("username", "last_failed_at", F.when(F.col("id") % 3 == 0, F.col("last_failed_at") + F.make_dt_interval((F.col("id") % 20).cast("int"))).alias("blocked_until"))
    return U.retained_throttles(rows.crossJoin(F.broadcast(_now(v.logins, "attempt_at"))), F.col("now")).drop("now")


def _covered(v):
    """Events of which some assess coverage, and payloads of which some are no objects."""
    event = F.when(F.col("event_id") % 8 == 0, "evidence.coverage_assessed").when(F.col("event_id") % 8 < 3, "evidence.coverage").otherwise(F.col("event"))
    payload = F.when(F.col("event_id") % 13 == 1, "[1]").when(F.col("event_id") % 13 > 1, F.col("payload"))
    return v.trace_events.withColumn("event", event).withColumn("payload", payload)


def _now(df, c):
    return df.agg(F.max(c).alias("now"))


def _actions(v: Views):
    return v.events.select(F.concat(F.col("event_type"), F.lit("."), F.col("event_id") % 3).alias("action"), F.concat(F.lit("User"), F.col("user_id") % 20).alias("username"), "event_id")


def _states(v: Views):
    states = F.array(*[F.lit(s) for s in T.TRANSITIONS])
    return v.events.select(F.col("user_id").alias("turn_id"), F.col("ts").alias("moment"), F.col("event_id").alias("n"), F.get(states, (F.col("event_id") % 7).cast("int")).alias("state"))


def _turns(v: Views):
    return v.events.select("user_id", (F.col("event_id") % 50).alias("request_id"), F.col("event_id").alias("turn_id"), F.col("ts").alias("moment"), F.col("event_type").alias("fingerprint"))


def _budget(v: Views):
    return v.trace_events.select("trace_id", "seq", "event", (F.octet_length("payload") * (1 + F.col("seq") % 5)).cast("long").alias("bytes"))


ACT = "acts AS (SELECT event_type || '.' || (event_id % 3) AS action, 'User' || (user_id % 20) AS username, event_id FROM events)"
ORDERED_STATES = "[" + ", ".join(f"'{s}'" for s in T.TRANSITIONS) + "]"
ALLOWED = " OR ".join(f"(previous = '{a}' AND state IN ({', '.join(repr(b) for b in bs)}))" for a, bs in T.TRANSITIONS.items())
Q = {
    "B7_filter_traces": (
        lambda v: T.filter_traces(v.runs.withColumn("conversation_id", F.col("duration_ms") % 5), "1", "success", "chat", conversation=3).select("trace_id", "status"),
        RUNS + " SELECT trace_id, status FROM runs WHERE CAST(trace_id AS VARCHAR) LIKE '1%' AND status = 'success' AND request_kind = 'chat' AND duration_ms % 5 = 3",
    ),
    "B8_filter_operations": (lambda v: T.filter_operations(_actions(v), "click", "USER1"), f"WITH {ACT} SELECT * FROM acts WHERE action LIKE 'click%' AND username ILIKE '%USER1%'"),
    "B11_mask_content": (
        lambda v: T.mask_content(v.runs.select("trace_id", F.col("request_kind").alias("preview"), (F.col("trace_id") % 2 == 0).alias("content_included")), False),
        RUNS + " SELECT trace_id, CASE WHEN trace_id % 2 <> 0 THEN request_kind END AS preview, trace_id % 2 = 0 AS content_included FROM runs",
    ),
    "C10_with_username": (lambda v: T.with_username(v.runs, v.users).select("trace_id", "user_id", "username"), duckdb_views("runs", "users") + " SELECT trace_id, r.user_id, CASE WHEN r.user_id IS NULL THEN NULL ELSE coalesce(u.username, 'deleted user') END AS username FROM runs r LEFT JOIN users u ON r.user_id = u.user_id"),
    "C19_runs_join_events": (lambda v: U.fold_trace_runs(v.records).select("trace_id", "status").join(v.trace_events, "trace_id").groupBy("status").agg(F.count("*").alias("events")), RE + f", {FOLD} SELECT status, count(*) AS events FROM folded JOIN trace_events USING (trace_id) GROUP BY status"),
    "D1_scale_counts": (lambda v: T.scale_counts(v.runs, v.users, v.kb, v.docs, v.chunks), duckdb_views("runs", "users", "docs", "kb") + " SELECT (SELECT count(*) FROM users) AS users, (SELECT count(DISTINCT user_id) FROM runs WHERE request_kind = 'chat') AS active_users, (SELECT count(*) FROM kb) AS kbs, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks"),
    "D2_documents_by_status": (lambda v: T.documents_by_status(v.docs.withColumn("status", F.when(F.col("doc_id") % 6 != 0, F.col("status")))), duckdb_views("docs") + " SELECT coalesce(CASE WHEN doc_id % 6 <> 0 THEN status END, 'unknown') AS status, count(*) AS n FROM docs GROUP BY 1"),
    "D3_qa_daily": (lambda v: T.qa_daily(v.runs), RUNS + " SELECT CAST(started_at AS DATE) AS day, count(*) AS n, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms FROM runs WHERE request_kind = 'chat' GROUP BY 1"),
    "D4_qa_per_user": (
        lambda v: T.qa_per_user(v.runs),
        RUNS + " SELECT user_id, count(*) AS n, CAST(count(*) FILTER (evidence_status IN ('hit', 'partial')) AS BIGINT) AS hits, round(avg(duration_ms), 2) AS avg_ms, max(started_at) AS last_active, round(count(*) FILTER (evidence_status IN ('hit', 'partial')) / count(*), 4) AS hit_rate FROM runs WHERE request_kind = 'chat' AND user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    ),
    "D5_evidence_quality": (
        lambda v: T.evidence_quality(v.runs),
        RUNS + " SELECT count(*) AS n, round(count(*) FILTER (evidence_status IN ('hit', 'partial')) / count(*), 4) AS hit_rate, round(count(*) FILTER (evidence_status = 'needs_clarification') / count(*), 4) AS clarify_rate, round(count(*) FILTER (evidence_status IN ('no_hit', 'insufficient_evidence')) / count(*), 4) AS no_answer_rate FROM runs WHERE evidence_status IS NOT NULL",
    ),
    "D6_latency_stats": (lambda v: T.latency_stats(v.runs), RUNS + " SELECT request_kind, round(avg(duration_ms), 4) AS avg_ms, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 4) AS p95_ms FROM runs GROUP BY 1"),
    "D7_hit_stats": (lambda v: T.hit_stats(v.runs), RUNS + " SELECT round(avg(hit_count), 2) AS avg_hits, round(avg(selected_kb_count), 2) AS avg_kbs FROM runs WHERE hit_count IS NOT NULL"),
    "D8_token_usage": (lambda v: T.token_usage(v.records, COMPLETIONS, *TOKENS), USAGE + " SELECT * FROM usage"),
    "D9_token_rollups": (lambda v: T.token_rollups(T.token_usage(v.records, COMPLETIONS, *TOKENS)), USAGE + " SELECT day, event, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(calls) AS BIGINT) AS calls FROM usage GROUP BY GROUPING SETS ((day), (event), ())"),
    "D10_login_security": (lambda v: T.login_security(v.logins), LOG + " SELECT count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, count(DISTINCT username) FILTER (success) AS users, count(DISTINCT ip) FILTER (NOT success) AS failing_ips FROM logins"),
    "D11_top_actions": (lambda v: T.top_actions(_actions(v)), f"WITH {ACT} SELECT action, count(*) AS n FROM acts GROUP BY action ORDER BY n DESC, action LIMIT 5"),
    "D12_overview": (lambda v: T.overview(v.runs, v.logins, v.docs, v.users, v.kb, v.chunks, v.records, v.events.select(F.concat(F.col("event_type"), F.lit("."), F.col("event_id") % 3).alias("action"), F.col("ts").alias("created_at")), COMPLETIONS, tokens=TOKENS), None),
    "D33_trace_stage_index": (lambda v: T.trace_stage_index(v.trace_events), TE + " SELECT trace_id, split_part(event, '.', 1) AS stage, array_to_string(list_sort(list(seq)), ',') AS seqs FROM trace_events GROUP BY 1, 2"),
    "D33_missing_sequences": (lambda v: T.missing_sequences(v.trace_events.where("event <> 'intent.model_result'")), TE + ", t AS (SELECT * FROM trace_events WHERE event <> 'intent.model_result'), m AS (SELECT trace_id, max(seq) AS last FROM t GROUP BY 1), a AS (SELECT trace_id, unnest(range(1, last + 1)) AS seq FROM m) SELECT m.trace_id, coalesce(x.missing, '') AS missing FROM m LEFT JOIN (SELECT trace_id, array_to_string(list_sort(list(seq)), ',') AS missing FROM a ANTI JOIN t USING (trace_id, seq) GROUP BY 1) x USING (trace_id)"),
    "D35_trace_diagnostics": (
        lambda v: T.trace_diagnostics(_covered(v)),
        TE + """, c AS (SELECT * REPLACE (CASE event_id % 8 WHEN 0 THEN 'evidence.coverage_assessed' WHEN 1 THEN 'evidence.coverage' WHEN 2 THEN 'evidence.coverage' ELSE event END AS event, CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '[1]' ELSE payload END AS payload) FROM trace_events),
        o AS (SELECT *, event_id % 13 > 1 AS fine FROM c)
        SELECT trace_id, arg_min(payload, seq) FILTER (event = 'chat.request' AND fine) AS request, arg_min(payload, seq) FILTER (event = 'intent.model_result' AND fine) AS intent, last(payload ORDER BY seq) AS latest,
        coalesce(arg_max(payload, seq) FILTER (event = 'evidence.coverage_assessed' AND fine), arg_max(payload, seq) FILTER (event = 'evidence.coverage' AND fine)) AS coverage,
        coalesce(list(payload ORDER BY seq) FILTER (event IN ('evidence.coverage_assessed', 'evidence.coverage') AND fine), []) AS coverage_history, coalesce(list(payload ORDER BY seq) FILTER (event = 'intent.model_result' AND fine), []) AS attempts FROM o GROUP BY trace_id""",
    ),
    "A7_export_stats": (
        lambda v: T.export_stats(v.trace_events, T.export_trace(v.trace_events, 3)),
        TE + " SELECT trace_id, count(*) AS persisted, least(count(*), 3) AS selected, greatest(count(*) - 3, 0) AS omitted, count(*) > 3 AS truncated, CAST(sum(strlen(payload) + 512) FILTER (place <= 3) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN seq = last THEN 0 ELSE 1 END, seq) AS place FROM (SELECT *, max(seq) FILTER (event IN " + ALL_TERM + ") OVER (PARTITION BY trace_id) AS last FROM trace_events)) GROUP BY trace_id",
    ),
    "W8_number_events": (
        lambda v: T.number_events(v.trace_events.withColumn("trace_id", F.col("user_id")), 50).select("trace_id", "event_id", "event", "sequence"),
        TE + f""", n AS (SELECT user_id AS trace_id, event_id, event, row_number() OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS n FROM trace_events),
        l AS (SELECT *, row_number() OVER (PARTITION BY trace_id, n >= 50 AND event IN {ALL_TERM} ORDER BY n) AS late FROM n)
        SELECT trace_id, event_id, event, least(n, 50) AS sequence FROM l WHERE n < 50 OR (event IN {ALL_TERM} AND late = 1)""",
    ),
    "J1_fold_trace_runs": (lambda v: U.fold_trace_runs(v.records), RE + f", {FOLD} SELECT * FROM folded"),
    "J2_stale_runs": (lambda v: U.stale_runs((r := U.fold_trace_runs(v.records)).crossJoin(F.broadcast(_now(v.records, "created_at"))), F.col("now")).select(r.columns), RE + f", {FOLD}, {STALE.format(silent='15 MINUTE')} SELECT * FROM swept"),
    "J4_retention": (
        lambda v: T.retention(v.trace_events.crossJoin(F.broadcast(_now(v.trace_events, "created_at"))), "created_at", F.col("now"), "trace").select("event_id", "trace_id"),
        TE + " SELECT event_id, trace_id FROM trace_events WHERE created_at >= (SELECT max(created_at) FROM trace_events) - INTERVAL 30 DAY",
    ),
    "J4_retention_cascade": (lambda v: _retained(v), RE + f", {FOLD} SELECT event_id, trace_id FROM records SEMI JOIN (SELECT * FROM folded WHERE started_at >= (SELECT max(created_at) FROM records) - INTERVAL 20 DAY) USING (trace_id)"),
    "J4_throttle_retention": (
        lambda v: _throttles(v),
        LOG + """, b AS (SELECT username, max(attempt_at) AS last_failed_at, CASE WHEN max(id) % 3 = 0 THEN max(attempt_at) + INTERVAL (max(id) % 20) DAY END AS blocked_until FROM logins WHERE NOT success GROUP BY username)
        SELECT * FROM b WHERE last_failed_at >= (SELECT max(attempt_at) FROM logins) - INTERVAL 48 HOUR OR blocked_until > (SELECT max(attempt_at) FROM logins)""",
    ),
    "J5_request_conflicts": (
        lambda v: T.request_conflicts(_turns(v)),
        "WITH t AS (SELECT user_id, event_id % 50 AS request_id, event_id AS turn_id, ts AS moment, event_type AS fingerprint FROM events) SELECT t.user_id, t.request_id, turn_id, n > 1 AS conflict FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id, request_id ORDER BY moment, turn_id) = 1) t JOIN (SELECT user_id, request_id, count(DISTINCT fingerprint) AS n FROM t GROUP BY 1, 2) c ON t.user_id = c.user_id AND t.request_id = c.request_id",
    ),
    "J6_validate_transitions": (
        lambda v: T.illegal_transitions(_states(v)),
        f"WITH s AS (SELECT user_id AS turn_id, ts AS moment, event_id AS n, {ORDERED_STATES}[1 + event_id % 7] AS state FROM events), m AS (SELECT *, lag(state) OVER (PARTITION BY turn_id ORDER BY moment, n) AS previous FROM s) SELECT turn_id, moment, previous, state FROM m WHERE previous IS NOT NULL AND NOT ({ALLOWED})",
    ),
    "W5_greedy_budget": (
        lambda v: T.greedy_budget(_budget(v), "trace_id", ["seq"], "bytes", 60, 4).select("trace_id", "seq", "event", "bytes"),
        TE + """, b AS (SELECT trace_id, seq, event, CAST(strlen(payload) * (1 + seq % 5) AS BIGINT) AS bytes FROM trace_events),
        r AS (WITH RECURSIVE w AS (
          SELECT trace_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS used, 0 AS n, false AS took FROM (SELECT DISTINCT trace_id FROM b)
          UNION ALL
          SELECT b.trace_id, b.seq, CASE WHEN used + bytes <= 60 AND n < 4 THEN used + bytes ELSE used END, CASE WHEN used + bytes <= 60 AND n < 4 THEN n + 1 ELSE n END, used + bytes <= 60 AND n < 4
          FROM w JOIN b ON b.trace_id = w.trace_id AND b.seq = w.seq + 1) SELECT * FROM w WHERE took)
        SELECT b.trace_id, b.seq, b.event, b.bytes FROM b JOIN r ON b.trace_id = r.trace_id AND b.seq = r.seq""",
    ),
    "A7_export_trace": (
        lambda v: T.export_trace(v.trace_events, 3, 2000),
        TE + f""", t AS (SELECT trace_id, seq, event, CAST(strlen(payload) + 512 AS BIGINT) AS bytes, CASE WHEN seq = max(seq) FILTER (event IN {ALL_TERM}) OVER (PARTITION BY trace_id) THEN 0 WHEN event IN ('retrieval.candidate', 'rerank.candidate') THEN 2 ELSE 1 END AS priority FROM trace_events),
        b AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY priority, seq) AS place FROM t),
        r AS (WITH RECURSIVE w AS (
          SELECT trace_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, 0 AS n, false AS took FROM (SELECT DISTINCT trace_id FROM b)
          UNION ALL
          SELECT b.trace_id, b.place, CASE WHEN used + bytes <= 2000 AND n < 3 THEN used + bytes ELSE used END, CASE WHEN used + bytes <= 2000 AND n < 3 THEN n + 1 ELSE n END, used + bytes <= 2000 AND n < 3
          FROM w JOIN b ON b.trace_id = w.trace_id AND b.place = w.place + 1) SELECT * FROM w WHERE took)
        SELECT b.trace_id, b.seq, b.event, b.bytes FROM b JOIN r ON b.trace_id = r.trace_id AND b.place = r.place""",
    ),
    "W6_recent_history": (lambda v: T.recent_history(v.messages).select("conv_id", "turn", "role", "back"), MSG + " SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages QUALIFY back <= 6"),
    "W6_last_exchange": (
        lambda v: T.last_exchange(v.messages),
        MSG + ", a AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS asked FROM messages) SELECT conv_id, arg_max(content, turn) FILTER (turn = asked) AS question, arg_min(content, turn) FILTER (role = 'assistant' AND turn > asked) AS answer FROM a GROUP BY conv_id",
    ),
    "W7_merge_failures": (
        lambda v: T.merge_failures(v.logins, "6 HOURS"),
        LOG + """, g AS (SELECT *, coalesce(CAST(attempt_at > lag(attempt_at) OVER w + INTERVAL 6 HOUR AS INT), 1) AS fresh FROM logins WHERE NOT success WINDOW w AS (PARTITION BY username, ip, fail_reason ORDER BY attempt_at, id)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY username, ip, fail_reason ORDER BY attempt_at, id ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT username, ip, fail_reason, min(id) AS id, count(*) AS attempts, max(attempt_at) AS last_at FROM r GROUP BY username, ip, fail_reason, run UNION ALL SELECT username, ip, fail_reason, id, 1, attempt_at FROM logins WHERE success""",
    ),
    "W9_turn_duration": (
        lambda v: T.turn_duration(U.fold_trace_runs(v.records).withColumnRenamed("started_at", "created_at")).select("trace_id", "duration_ms"),
        RE + f", {FOLD} SELECT trace_id, CASE WHEN completed_at IS NOT NULL THEN greatest((epoch_us(completed_at) - epoch_us(started_at)) // 1000, 0) END AS duration_ms FROM folded",
    ),
    "G2_page": (lambda v: __import__("gleaner.operators.catalog", fromlist=["latest_page"]).latest_page(v.runs, 3, 20).select("trace_id", "started_at"), RUNS + " SELECT trace_id, started_at FROM runs ORDER BY started_at DESC, trace_id DESC LIMIT 20 OFFSET 40"),
}


def _attempts(v: Views):
    """Logins with a month pressed into some 86 minutes."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("attempt_at").cast("timestamp")) / 500).cast("long"))
    return v.logins.select("id", "username", "ip", at.alias("attempt_at"), "success")


def _throttle(v: Views):
    from gleaner.functions.text import throttle_keys
    from gleaner.streaming.logs import login_throttle_batch

    keys = throttle_keys(F.col("username"), F.col("ip"))
    return login_throttle_batch(v.logins.select(keys["pair"].alias("bucket"), F.col("attempt_at").cast("timestamp").alias("attempt_at"), "success"), "pair")


def _scoped(v: Views):
    from gleaner.streaming.logs import longest_block, scoped_throttle

    return longest_block(scoped_throttle(_attempts(v)))


#: Attempt by attempt of every bucket: failures, start of the window, end of the block; times in microseconds.
THROTTLE_SQL = LOG + """, a AS (SELECT id, success, username, ip, epoch_us(attempt_at) // 500 AS tm FROM logins),
x AS (SELECT 'pair' AS scope, username || '|' || ip AS bucket, 5 AS most, 900 AS block, * FROM a UNION ALL SELECT 'ip', ip, 20, 3600, * FROM a UNION ALL SELECT 'account', username, 20, NULL, * FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY scope, bucket ORDER BY tm, id) AS n FROM x),
r AS (WITH RECURSIVE w AS (
  SELECT DISTINCT scope, bucket, CAST(0 AS BIGINT) AS n, 0 AS failures, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS blocked, CAST(0 AS BIGINT) AS wait, false AS alert, CAST(NULL AS BIGINT) AS id, true AS success FROM b
  UNION ALL
  SELECT scope, bucket, n,
    CASE WHEN success THEN CASE WHEN scope = 'pair' THEN 0 ELSE failures END WHEN held THEN failures WHEN full_ THEN 0 ELSE f END,
    CASE WHEN success THEN CASE WHEN scope = 'pair' THEN NULL ELSE start END WHEN held THEN start WHEN fresh OR full_ THEN tm ELSE start END,
    CASE WHEN success THEN CASE WHEN scope = 'pair' THEN NULL ELSE blocked END WHEN held THEN blocked WHEN full_ THEN tm + CAST(block AS BIGINT) * 1000000 END,
    CASE WHEN success THEN 0 WHEN held THEN greatest(1, CAST(ceil((blocked - tm) / 1000000.0) AS BIGINT)) WHEN full_ THEN block ELSE 0 END,
    NOT success AND NOT held AND block IS NULL AND f = most, id, success
  FROM (SELECT *, coalesce(block IS NOT NULL AND f >= most, false) AS full_ FROM (
    SELECT *, CASE WHEN fresh THEN 1 ELSE failures + 1 END AS f FROM (
      SELECT b.*, w.failures, w.start, w.blocked, coalesce(w.blocked > b.tm, false) AS held, w.start IS NULL OR b.tm - w.start >= 900000000 AS fresh
      FROM w JOIN b ON b.scope = w.scope AND b.bucket = w.bucket AND b.n = w.n + 1)))) SELECT * FROM w WHERE NOT success),
t AS (SELECT id, max(wait) FILTER (scope <> 'account') AS retry_after, bool_or(alert) AS account_alert FROM r GROUP BY id)
SELECT t.id AS attempt_id, retry_after, CASE WHEN retry_after = 0 THEN NULL WHEN i.wait = retry_after THEN 'ip' ELSE 'pair' END AS scope, account_alert FROM t JOIN r i ON i.id = t.id AND i.scope = 'ip'"""
Q["J3_login_throttle"] = (_throttle, None)
Q["J3_longest_block"] = (_scoped, THROTTLE_SQL)


def _as_stream(v: Views, name: str, stamp: str = "created_at"):
    """The view, written to the shared folder and read back as a stream."""
    import uuid

    from gleaner.session import shared_folder
    from gleaner.streaming.logs import stream_of

    base = f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"
    getattr(v, name).repartition(4).write.parquet(f"{base}/in")
    return stream_of(v.spark, f"{base}/in", v.spark.read.parquet(f"{base}/in").schema, stamp), base


def _sink(v: Views):
    from gleaner.streaming.logs import write_trace_events

    stream, base = _as_stream(v, "trace_events")
    query = write_trace_events(stream, f"{base}/out", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return v.spark.read.parquet(f"{base}/out").select("event_id", "event", "payload")


def _days(v: Views):
    from gleaner.streaming.logs import daily_activity

    stream, base = _as_stream(v, "trace_events")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    query = daily_activity(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return v.spark.read.parquet(f"{base}/out").select(F.to_date("day").alias("day"), "n")


def _run(v: Views, made, base: str, mode: str):
    """All that the stream has, batch by batch in one table with the number of the batch; state is kept by RocksDB."""
    state = "spark.sql.streaming.stateStore.providerClass"
    held = v.spark.conf.get(state)
    v.spark.conf.set(state, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
        made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        v.spark.conf.set(state, held)
    return v.spark.read.parquet(f"{base}/out")


def _run_stream(v: Views):
    """Runs as the stream leaves them, silent ones swept by the timers; times without a zone, as in the batch."""
    from gleaner.streaming.logs import fold_runs

    stream, base = _as_stream(v, "records")
    out = _run(v, fold_runs(stream), base, "update")
    last = out.groupBy("trace_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("trace_id", "batch")]), F.struct("batch", (F.col("status") == "interrupted").alias("i"))).alias("r")).select("trace_id", "r.*")
    return last.select([F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(c) for c in last.columns])


def _sessions(v: Views):
    from gleaner.streaming.logs import merged_failures

    stream, base = _as_stream(v, "logins", "attempt_at")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    merged_failures(stream, "6 hours").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = v.spark.read.parquet(f"{base}/out")
    return out.withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


Q["J2_stale_stream"] = (_run_stream, RE + f", {FOLD}, {STALE.format(silent='30 MINUTE')} SELECT * FROM swept")
Q["W7_merge_failures_stream"] = (_sessions, Q["W7_merge_failures"][1])
Q["A6_write_trace_events"] = (_sink, TE + " SELECT event_id, event, payload FROM trace_events")
Q["J8_daily_activity_stream"] = (_days, TE + " SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM trace_events GROUP BY 1")


def _ingest(v: Views):
    """Documents and their next revisions, as they come in, folded to the newest of each."""
    import uuid

    from gleaner.session import shared_folder
    from gleaner.streaming.logs import incremental_ingest, read_ingested, stream_of

    base = f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"
    docs = v.docs.select("doc_id", "status", "chunk_count", F.col("processing_revision").alias("revision"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    docs.unionByName(docs.where("status = 'ready'").withColumn("revision", F.col("revision") + 1)).repartition(3).write.parquet(f"{base}/in")
    stream = stream_of(v.spark, f"{base}/in", (schema := v.spark.read.parquet(f"{base}/in").schema), "created_at", files=2)
    chunks = lambda fresh: fresh.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunk_count"))).alias("n"), F.col("revision").alias("of"))
    incremental_ingest(stream, f"{base}/out", f"{base}/state", {"chunks": chunks}).trigger(availableNow=True).start().awaitTermination()
    kept = read_ingested(v.spark, f"{base}/out", "chunks", "doc_id long, n long, of long").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("of").alias("least"), F.max("of").alias("most"))
    return read_ingested(v.spark, f"{base}/out", "documents", schema).join(kept, "doc_id").select("doc_id", "status", "revision", "chunks", "least", "most")


Q["J9_incremental_ingest"] = (
    _ingest,
    duckdb_views("docs") + ", r AS (SELECT doc_id, status, chunk_count, processing_revision + CASE WHEN status = 'ready' THEN 1 ELSE 0 END AS revision FROM docs) SELECT doc_id, status, revision, chunk_count AS chunks, revision AS least, revision AS most FROM r",
)
Q["J7_out_of_order_start"] = (
    lambda v: U.fold_trace_runs(v.records.orderBy(F.col("created_at").desc())).select("trace_id", "started_at"),
    TE + " SELECT trace_id, min(created_at) AS started_at FROM trace_events GROUP BY trace_id",
)
