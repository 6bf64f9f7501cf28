"""Dashboards and folds over trace, login, message and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import variants as V
from gleaner.operators.runs import ALL_TERMINAL

#: Where a turn may go from each state.
TRANSITIONS = {
    "accepted": ["generating", "failed", "cancelled"],
    "generating": ["generated", "failed", "cancelled"],
    "generated": ["completed", "persist_failed", "failed", "cancelled"],
    "persist_failed": ["generated", "completed", "persist_failed", "failed"],
    "completed": ["completed"],
    "failed": ["failed"],
    "cancelled": ["cancelled"],
}
#: Days that logs are kept.
KEEP_DAYS = {"trace": 30, "login": 90, "operation": 180, "route": 180}
#: An export keeps these events last.
VERBOSE_EVENTS = ["retrieval.candidate", "rerank.candidate"]


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def day(c: str) -> Column:
    return F.to_date(c)


def filter_traces(runs: DataFrame, prefix: str = "", status: str | None = None, kind: str | None = None, since=None, until=None, conversation=None) -> DataFrame:
    out = runs.where(F.col("trace_id").cast("string").startswith(prefix))
    for c, x in (("status", status), ("request_kind", kind), ("conversation_id", conversation)):
        out = out if x is None else out.where(F.col(c) == x)
    out = out if since is None else out.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))
    return out if until is None else out.where(F.col("started_at") <= F.lit(until).cast("timestamp_ntz"))


def scale_counts(runs: DataFrame, users: DataFrame, kb: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row; each part is one row, so the joins are of single rows."""
    parts = [
        users.agg(F.count("*").alias("users")),
        runs.where("request_kind = 'chat'").agg(F.count_distinct("user_id").alias("active_users")),
        kb.agg(F.count("*").alias("kbs")),
        docs.agg(F.count("*").alias("documents")),
        chunks.agg(F.count("*").alias("chunks")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def documents_by_status(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def qa_daily(runs: DataFrame) -> DataFrame:
    return runs.where("request_kind = 'chat'").groupBy(day("started_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"))


def qa_per_user(runs: DataFrame, n: int = 10) -> DataFrame:
    hits = F.sum(F.col("evidence_status").isin("hit", "partial").cast("long"))
    out = runs.where("request_kind = 'chat' and user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(hits, F.lit(0)).alias("hits"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("started_at").alias("last_active"))
    return out.withColumn("hit_rate", share(F.col("hits"), F.col("n"))).orderBy(F.col("n").desc(), "user_id").limit(n)


def evidence_quality(runs: DataFrame) -> DataFrame:
    seen = runs.where("evidence_status is not null")
    of = lambda *s: F.sum(F.col("evidence_status").isin(*s).cast("long"))
    n = F.count("*")
    return seen.agg(n.alias("n"), share(of("hit", "partial"), n).alias("hit_rate"), share(of("needs_clarification"), n).alias("clarify_rate"), share(of("no_hit", "insufficient_evidence"), n).alias("no_answer_rate"))


def latency_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("request_kind").agg(F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.round(F.percentile("duration_ms", F.lit(0.95)), 4).alias("p95_ms"))


def hit_stats(runs: DataFrame) -> DataFrame:
    return runs.where("hit_count is not null").agg(F.round(F.avg("hit_count"), 2).alias("avg_hits"), F.round(F.avg("selected_kb_count"), 2).alias("avg_kbs"))


def token_usage(events: DataFrame, kinds: list[str], prompt: str = "k", completion: str = "c", total: str = "t") -> DataFrame:
    """By day and event.  Only JSON numbers count; a call's total is the one it states, else the sum of its parts; a call counts as measured with any of the three."""
    v = F.col("__v")
    rows = events.where(F.col("event").isin(kinds)).withColumn("__v", V.parsed("payload"))
    rows = rows.select("event", day("created_at").alias("day"), *[V.number(v, f"$.{name}").cast("decimal(38,0)").cast("long").alias(c) for c, name in (("p", prompt), ("c", completion), ("t", total))])
    parts = F.when(F.col("p").isNotNull() | F.col("c").isNotNull(), F.coalesce("p", F.lit(0)) + F.coalesce("c", F.lit(0)))
    rows = rows.withColumn("t", F.coalesce("t", parts))
    summed = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return rows.groupBy("day", "event").agg(summed("p").alias("prompt_tokens"), summed("c").alias("completion_tokens"), summed("t").alias("total_tokens"), F.count("t").alias("calls"))


def token_rollups(usage: DataFrame) -> DataFrame:
    """By day, by event and in all, in one pass."""
    names = ["prompt_tokens", "completion_tokens", "total_tokens", "calls"]
    out = usage.groupingSets([["day"], ["event"], []], "day", "event").agg(*[F.sum(n).alias(n) for n in names])
    return out


def login_security(logins: DataFrame) -> DataFrame:
    ok = F.col("success")
    return logins.agg(
        F.sum(ok.cast("long")).alias("successes"), F.sum((~ok).cast("long")).alias("failures"), F.count_distinct(F.when(ok, F.col("username"))).alias("users"), F.count_distinct(F.when(~ok, F.col("ip"))).alias("failing_ips")
    )


def top_actions(operations: DataFrame, n: int = 5) -> DataFrame:
    return operations.groupBy("action").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "action").limit(n)


def filter_operations(operations: DataFrame, prefix: str, name: str) -> DataFrame:
    return operations.where(F.col("action").startswith(prefix) & F.lower("username").contains(name.lower()))


def overview(runs: DataFrame, logins: DataFrame, docs: DataFrame, users: DataFrame, kb: DataFrame, chunks: DataFrame, events: DataFrame, operations: DataFrame, kinds: list[str], days: int = 7, tokens: tuple[str, str, str] = ("k", "c", "t")) -> DataFrame:
    """One nested row of the last days up to the latest run; tables without a time are taken whole."""
    now = runs.agg(F.max("started_at").alias("__now"))
    lately = lambda df, at: df.crossJoin(F.broadcast(now)).where(F.col(at) >= F.col("__now") - F.make_dt_interval(F.lit(days))).drop("__now")
    runs, logins, events, operations = lately(runs, "started_at"), lately(logins, "attempt_at"), lately(events, "created_at"), lately(operations, "created_at")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    most = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.struct(*df.columns).alias("x")))), lambda r: r["x"]).alias(name))
    usage = token_usage(events, kinds, *tokens)
    parts = [one(qa_daily(runs), "daily"), one(evidence_quality(runs), "quality"), one(latency_stats(runs), "latency"), one(hit_stats(runs), "hits"), one(login_security(logins), "security"), one(documents_by_status(docs), "documents")]
    parts += [one(scale_counts(runs, users, kb, docs, chunks), "scale"), most(qa_per_user(runs), "top_users"), one(usage, "tokens"), one(token_rollups(usage), "token_totals"), most(top_actions(operations), "top_actions")]
    out = parts[0].select(F.lit(days).alias("days"), "daily")
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def with_username(runs: DataFrame, users: DataFrame) -> DataFrame:
    named = runs.join(users.select("user_id", "username"), "user_id", "left")
    return named.withColumn("username", F.when(F.col("user_id").isNull(), None).otherwise(F.coalesce("username", F.lit("deleted user"))))


def mask_content(runs: DataFrame, is_superadmin: bool) -> DataFrame:
    shown = F.lit(is_superadmin) | ~F.col("content_included")
    return runs.withColumn("preview", F.when(shown, F.col("preview")))


def trace_stage_index(events: DataFrame) -> DataFrame:
    """Per trace and first part of the event name its sequence numbers."""
    return events.groupBy("trace_id", F.split_part("event", F.lit("."), F.lit(1)).alias("stage")).agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("seqs"))


def missing_sequences(events: DataFrame) -> DataFrame:
    out = events.groupBy("trace_id").agg(F.collect_set("seq").alias("seen"), F.max("seq").alias("last"))
    return out.select("trace_id", F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(1).cast("long"), "last"), "seen")), ",").alias("missing"))


#: Events that assess coverage, the canonical one first.
COVERAGE_EVENTS = ["evidence.coverage_assessed", "evidence.coverage"]


def trace_diagnostics(events: DataFrame, coverage: list[str] = COVERAGE_EVENTS, attempt: str = "intent.model_result") -> DataFrame:
    """A trace's first request and intent, its newest payload, its coverage and every model attempt in order.

    coverage: the newest payload of the canonical event, else of any other of them;
    coverage_history: all of these in order.  A payload that is null or no JSON
    object is not counted.
    """
    object_ = F.coalesce(F.schema_of_variant(V.parsed("payload")).startswith("OBJECT"), F.lit(False))
    rows = events.withColumn("__own", F.when(object_, F.col("payload")))
    at = lambda *names: F.when(F.col("event").isin(*names) & F.col("__own").isNotNull(), F.col("seq"))
    history = lambda *names: F.transform(F.array_sort(F.collect_list(F.when(at(*names).isNotNull(), F.struct("seq", "__own")))), lambda x: x["__own"])
    return rows.groupBy("trace_id").agg(
        F.min_by("__own", at("chat.request")).alias("request"), F.min_by("__own", at(attempt)).alias("intent"), F.max_by("payload", "seq").alias("latest"),
        F.coalesce(F.max_by("__own", at(coverage[0])), F.max_by("__own", at(*coverage))).alias("coverage"), history(*coverage).alias("coverage_history"), history(attempt).alias("attempts"),
    )


def number_events(events: DataFrame, cap: int = 500) -> DataFrame:
    """Sequence numbers of each trace; beyond cap - 1 only a terminal event, in the last place."""
    w = Window.partitionBy("trace_id").orderBy("created_at", "event_id")
    terminal = F.col("event").isin(ALL_TERMINAL)
    rows = events.withColumn("n", F.row_number().over(w)).withColumn("terminal", terminal)
    late = Window.partitionBy("trace_id", (F.col("n") >= cap) & F.col("terminal")).orderBy("n")
    rows = rows.withColumn("late", F.row_number().over(late))
    keep = (F.col("n") < cap) | (F.col("terminal") & (F.col("late") == 1))
    return rows.where(keep).withColumn("sequence", F.least("n", F.lit(cap))).drop("n", "terminal", "late")


def retention(rows: DataFrame, stamp: str, now: Column, kind: str) -> DataFrame:
    return rows.where(F.col(stamp) >= now - F.expr(f"INTERVAL {KEEP_DAYS[kind]} DAYS"))


def merge_failures(logins: DataFrame, gap: str = "60 SECONDS") -> DataFrame:
    """Equal failures at most `gap` after the one before fold into one row; successes never."""
    w = Window.partitionBy("username", "ip", "fail_reason").orderBy("attempt_at", "id")
    failed = logins.where("not success")
    fresh = F.coalesce((F.col("attempt_at") > F.lag("attempt_at").over(w) + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    rows = failed.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("username", "ip", "fail_reason", "run").agg(F.min("id").alias("id"), F.count("*").alias("attempts"), F.max("attempt_at").alias("last_at"))
    single = logins.where("success").select("username", "ip", "fail_reason", "id", F.lit(1).cast("long").alias("attempts"), F.col("attempt_at").alias("last_at"))
    return merged.drop("run").unionByName(single)


def recent_history(messages: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def last_exchange(messages: DataFrame) -> DataFrame:
    """The newest user message and the first assistant reply after it."""
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = messages.withColumn("asked", asked)
    reply = F.min_by("content", F.when((F.col("role") == "assistant") & (F.col("turn") > F.col("asked")), F.col("turn")))
    return rows.groupBy("conv_id").agg(F.max_by("content", F.when(F.col("turn") == F.col("asked"), F.col("turn"))).alias("question"), reply.alias("answer"))


def turn_duration(turns: DataFrame) -> DataFrame:
    ms = F.floor((F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000)
    return turns.withColumn("duration_ms", F.when(F.col("completed_at").isNotNull(), F.greatest(ms, F.lit(0))))


def request_conflicts(turns: DataFrame) -> DataFrame:
    """First turn of each (user, request) and whether later ones ask something else."""
    first = Window.partitionBy("user_id", "request_id").orderBy("moment", "turn_id")
    rows = turns.withColumn("r", F.row_number().over(first)).withColumn("n", F.size(F.collect_set("fingerprint").over(Window.partitionBy("user_id", "request_id"))))
    return rows.where("r = 1").select("user_id", "request_id", "turn_id", (F.col("n") > 1).alias("conflict"))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """(turn_id, moment, previous, state) of moves that are not allowed."""
    before = F.lag("state").over(Window.partitionBy("turn_id").orderBy("moment", "n"))
    moves = log.withColumn("previous", before).where("previous is not null")
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        allowed = allowed | ((F.col("previous") == a) & F.col("state").isin(bs))
    return moves.where(~allowed).select("turn_id", "moment", "previous", "state")


def greedy_budget(rows: DataFrame, by: str, order: list[str], size: str, most: int, most_items: int | None = None, counted: str | None = None, most_counted: int = 0) -> DataFrame:
    """In order, what still fits stays; what doesn't is skipped and later rows may fit again.
    Rows where `counted` is true have a limit of their own.

    A fold over each group's sorted rows, inside the JVM; groups are bounded by
    the candidate pools that come before.
    """
    others = [c for c in rows.columns if c not in (by, *order)]
    item = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others])
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("c"), F.array().cast(f"array<{rows.select(item.alias('x')).schema['x'].dataType.simpleString()}>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x[size] <= most
        fits = fits if most_items is None else fits & (acc["n"] < most_items)
        special = F.lit(0) if counted is None else x[counted].cast("int")
        fits = fits & ((special == 0) | (acc["c"] < most_counted))
        return F.when(fits, F.struct((acc["used"] + x[size]).cast("long").alias("used"), (acc["n"] + 1).alias("n"), (acc["c"] + special).alias("c"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    grouped = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    folded = grouped.select(by, F.aggregate("items", empty, step, lambda acc: acc["kept"]).alias("kept"))
    return folded.select(by, F.posexplode("kept").alias("place", "x")).select(by, "place", "x.*")


def export_trace(events: DataFrame, most_events: int = 500, most_bytes: int = 24 * 1024 * 1024) -> DataFrame:
    """Last terminal event first, then core events, then verbose ones, as far as they fit; in sequence order."""
    terminal = F.col("event").isin(ALL_TERMINAL)
    last = F.max(F.when(terminal, F.col("seq"))).over(Window.partitionBy("trace_id"))
    priority = F.when(F.col("seq") == last, 0).when(F.col("event").isin(VERBOSE_EVENTS), 2).otherwise(1)
    rows = events.select("trace_id", priority.alias("priority"), "seq", "event", (F.octet_length("payload") + 512).cast("long").alias("bytes"))
    return greedy_budget(rows, "trace_id", ["priority", "seq"], "bytes", most_bytes, most_events).select("trace_id", "seq", "event", "bytes")


def export_stats(events: DataFrame, exported: DataFrame) -> DataFrame:
    """(trace_id, persisted, selected, omitted, truncated, bytes) of every trace; exported: rows of export_trace()."""
    chosen = exported.groupBy("trace_id").agg(F.count("*").alias("selected"), F.sum("bytes").alias("bytes"))
    out = events.groupBy("trace_id").agg(F.count("*").alias("persisted")).join(chosen, "trace_id", "left")
    out = out.withColumn("selected", F.coalesce("selected", F.lit(0))).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    out = out.withColumn("omitted", F.col("persisted") - F.col("selected"))
    return out.select("trace_id", "persisted", "selected", "omitted", (F.col("omitted") > 0).alias("truncated"), "bytes")
