"""Summaries of trace runs: what one event tells, and the fold of all of a run's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions import variants as V
from gleaner.functions.payload import contains_business_content

#: Events that end a run, by the status they give.
TERMINAL = {"success": ["chat.response", "search_test.completed"], "error": ["chat.error", "search_test.error", "chat.persistence_error"], "interrupted": ["chat.cancelled"]}
ALL_TERMINAL = [e for names in TERMINAL.values() for e in names]
#: Outcomes without hits, and the length of a stored outcome.
NO_HITS, STATUS_LENGTH = ["no_hit", "skipped"], 32
#: Of these the newest value of a run stands.
NEWEST = ["request_kind", "user_id", "conversation_id", "input_preview", "output_preview", "selected_kb_count", "evidence_status", "hit_count"]
SUMMARY = (
    "trace_id {id}, current_stage string, request_kind string, user_id {user}, conversation_id string, input_preview string, output_preview string, content_included boolean, selected_kb_count long, "
    "evidence_status string, hit_count long, duration_ms long, started_at {time}, updated_at {time}, completed_at {time}, status string, events long"
)


def event_updates(events: DataFrame) -> DataFrame:
    """(trace_id, seq, event, created_at, outcome, stage_ms, has_content, NEWEST): what each event (with a JSON payload) tells of its run; null: nothing."""
    outcome = F.lit(None).cast("string")
    for status, names in TERMINAL.items():
        outcome = F.when(F.col("event").isin(names), status).otherwise(outcome)
    v = F.col("__v")
    said = lambda *names: F.coalesce(*[X.preview(V.text(v, f"$.{n}")) for n in names])
    evidence = F.nullif(V.text(v, "$.evidence_status"), F.lit(""))
    hits = lambda n: F.when(V.whole(v, f"$.{n}") >= 0, V.whole(v, f"$.{n}"))
    kind = X.request_kind(F.col("event"), F.coalesce(V.text(v, "$.surface"), F.lit("")))
    told = {
        "outcome": outcome,
        "stage_ms": F.when(V.number(v, "$.total_ms") >= 0, F.bround(V.number(v, "$.total_ms")).cast("long")),
        "request_kind": F.nullif(kind, F.lit("unknown")),
        "conversation_id": F.nullif(V.text(v, "$.conversation_id"), F.lit("")),
        "input_preview": said("question", "query"),
        "output_preview": said("answer", "partial_answer"),
        "selected_kb_count": F.coalesce(V.length(v, "$.selected_kb_ids").cast("long"), V.whole(v, "$.selected_kb_count")),
        "evidence_status": F.substring(evidence, 1, STATUS_LENGTH),
        "hit_count": F.when(evidence.isin(NO_HITS), F.lit(0).cast("long")).otherwise(F.coalesce(hits("hit_count"), hits("direct_evidence_count"))),
        "marked": V.true(v, "$.contains_business_content"),
    }
    rows = contains_business_content(events.select("trace_id", "seq", "event", "user_id", "created_at", "payload"), "payload")
    rows = rows.withColumn("__v", V.parsed("payload")).withColumns(told)
    content = F.col("marked") | F.coalesce("has_content", F.lit(False)) | F.col("input_preview").isNotNull() | F.col("output_preview").isNotNull()
    return rows.withColumn("has_content", content).drop("__v", "payload", "marked")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def status_of(stands: Column, stands_at: Column, won_at: Column) -> Column:
    """stands: the last outcome that is not a success.  An error is never undone by a later success; an interruption is."""
    return F.when(stands == "error", stands).when(won_at > F.coalesce(stands_at, F.lit(-(1 << 62))), "success").otherwise(F.coalesce(stands, F.lit("running")))


def fold_trace_runs(events: DataFrame) -> DataFrame:
    """One row a run, in the order of seq: the newest of each field, content by OR, the earliest start.

    Time is that of the wall clock where the newest event with a duration ends the
    run (from the earliest event up to it), else what the stage reports.  The
    window holds one run's events, whose number storage bounds.
    """
    so_far = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = event_updates(events).withColumn("__first", F.min("created_at").over(so_far))
    wall = F.greatest(F.bround((micros(F.col("created_at")) - micros(F.col("__first"))) / 1000), F.lit(0)).cast("long")
    rows = rows.withColumn("__ms", F.when(F.col("outcome").isNotNull(), wall).otherwise(F.col("stage_ms")))
    last = lambda c, where: F.max_by(c, F.when(where, F.col("seq")))
    lost = F.col("outcome").isin("error", "interrupted")
    out = rows.groupBy("trace_id").agg(
        F.max_by("event", "seq").alias("current_stage"), *[last(c, F.col(c).isNotNull()).alias(c) for c in NEWEST], F.bool_or("has_content").alias("content_included"),
        last("__ms", F.col("__ms").isNotNull()).alias("duration_ms"), F.min("created_at").alias("started_at"), F.max_by("created_at", "seq").alias("updated_at"), last("created_at", F.col("outcome").isNotNull()).alias("completed_at"),
        last("outcome", lost).alias("__stands"), F.max(F.when(lost, F.col("seq"))).alias("__lost"), F.max(F.when(F.col("outcome") == "success", F.col("seq"))).alias("__won"), F.count("*").alias("events"),
    )
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    return out.withColumn("status", status_of(F.col("__stands"), F.col("__lost"), F.col("__won"))).select(*names)


def stale_runs(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Running and silent: interrupted, completed when last heard of."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumn("completed_at", F.when(stale, F.col("updated_at")).otherwise(F.col("completed_at"))).withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def expired_runs(runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return runs.where(F.col("started_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def retained(runs: DataFrame, events: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(runs, events) after the cleaning: an expired run takes its events with it, whenever they are from."""
    kept = runs.where(F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return kept, events.join(kept.select("trace_id"), "trace_id", "left_semi")


def retained_throttles(throttles: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Throttle buckets (last_failed_at, blocked_until) that failed lately or are still blocked."""
    return throttles.where((F.col("last_failed_at") >= now - F.expr(f"INTERVAL {hours} HOURS")) | F.coalesce(F.col("blocked_until") > now, F.lit(False)))
