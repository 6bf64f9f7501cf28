"""Streams against their batch forms, and folds on literal runs."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import runs as U
from gleaner.operators import telemetry as T
from gleaner.streaming import logs as L

EVENTS = "trace_id long, seq long, event string, user_id long, created_at timestamp, payload string"
LOGINS = "id long, username string, ip string, success boolean, fail_reason string, attempt_at timestamp"


def at(minutes, seconds=0):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, held)


def in_files(spark, folder, rows, schema, size):
    """Rows as files of `size` rows each, in their order; a stream takes one file a batch."""
    for i, part in enumerate(itertools.batched(rows, size)):
        one = spark.createDataFrame(list(part), schema).coalesce(1)
        one.write.mode("append").parquet(f"{folder}/tmp{i}")
    import pathlib
    import shutil
    import time

    pathlib.Path(f"{folder}/in").mkdir()
    for i in range(-(-len(rows) // size)):
        source = next(pathlib.Path(f"{folder}/tmp{i}").glob("part-*.parquet"))
        shutil.move(source, f"{folder}/in/{i:03d}.parquet")
        time.sleep(0.01)
    return spark.read.parquet(f"{folder}/in")


def drained(spark, made, folder, mode):
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize(
    "events, status",
    [
        (["chat.request", "chat.cancelled", "chat.response"], "success"),
        (["chat.request", "chat.error", "chat.response"], "error"),
        (["chat.error", "chat.cancelled"], "interrupted"),
        (["chat.error", "chat.cancelled", "chat.response"], "success"),
        (["chat.response", "chat.error"], "error"),
        (["chat.response", "chat.cancelled"], "interrupted"),
        (["retrieval.error", "chat.response"], "success"),
        (["chat.request"], "running"),
    ],
)
def test_only_an_error_blocks_a_success(spark, events, status):
    rows = [(1, i + 1, e, 5, at(i), "{}") for i, e in enumerate(events)]
    assert U.fold_trace_runs(spark.createDataFrame(rows, EVENTS)).first()["status"] == status
    for order in itertools.permutations(rows):
        state = {}
        for _, seq, event, _, time, _ in order:
            outcome = next((s for s, names in U.TERMINAL.items() if event in names), None)
            state = L.folded(state, {"seq": seq, "at": time.timestamp() * 1e6, "event": event, "has_content": False, "outcome": outcome, "stage_ms": None} | dict.fromkeys(U.NEWEST))
        assert L.summary(1, state)["status"] == status


def test_a_run_is_summed_up(spark):
    long = "w " * 400
    rows = [
        (1, 1, "chat.request", 5, at(1), json.dumps({"question": f" {long}", "conversation_id": "c1", "selected_kb_ids": [1, 2]})),
        (1, 2, "retrieval.done", None, at(0), json.dumps({"evidence_status": "hit", "hit_count": 3, "total_ms": 12.5, "selected_kb_count": "9"})),
        (1, 3, "chat.response", None, at(2, 1), json.dumps({"answer": "yes", "evidence_status": "no_hit", "hit_count": 4, "selected_kb_count": 5})),
        (1, 4, "late.note", None, at(0, -30), "not json"),
        (2, 1, "x", None, at(0), json.dumps({"surface": "chat", "total_ms": "5", "hit_count": True, "direct_evidence_count": 2, "deep": [{"File_Name": "a"}]})),
        (3, 1, "x", None, at(0), None),
        (3, 2, "y", None, at(0), "[1]"),
        (4, 1, "x", None, at(0), json.dumps({"total_ms": 2.5, "evidence_status": "s" * 40, "contains_business_content": True})),
    ]
    got = {r["trace_id"]: r for r in U.fold_trace_runs(spark.createDataFrame(rows, EVENTS)).collect()}
    one = got[1]
    assert one["input_preview"] == ("w " * 250) + "…" and one["output_preview"] == "yes" and one["content_included"]
    assert (one["hit_count"], one["selected_kb_count"], one["conversation_id"], one["user_id"], one["events"]) == (0, 5, "c1", 5, 4)
    # Ended at seq 3, when the earliest event known was that of seq 2; the note moves the start back without a new duration.
    assert one["duration_ms"] == 121_000 and one["started_at"] == at(0, -30) and one["updated_at"] == at(0, -30) and one["completed_at"] == at(2, 1)
    assert (got[2]["request_kind"], got[2]["hit_count"], got[2]["duration_ms"], got[2]["content_included"]) == ("chat", 2, None, True)
    assert (got[3]["content_included"], got[3]["status"], got[3]["request_kind"]) == (False, "running", None)
    assert (got[4]["duration_ms"], len(got[4]["evidence_status"]), got[4]["content_included"]) == (2, 32, True)


def test_runs_in_shuffled_batches_end_like_the_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    names = ["chat.request", "retrieval.done", "chat.response", "chat.error", "chat.cancelled", "generation.completed"]
    rows = []
    for trace in range(1, 13):
        for seq in range(1, rng.randrange(2, 7)):
            payload = {"question": f"q{seq}" if rng.random() < 0.5 else "", "total_ms": rng.randrange(90), "hit_count": seq, "evidence_status": rng.choice(["hit", "no_hit", ""])}
            rows.append((trace, seq, rng.choice(names), rng.choice([None, trace]), at(trace % 4 + rng.random() * 8), json.dumps(payload)))
    rng.shuffle(rows)
    rows.append((99, 1, "chat.request", 1, at(240), "{}"))  # moves the watermark
    source = in_files(spark, tmp_path, rows, EVENTS, 7)
    stream = L.stream_of(spark, f"{tmp_path}/in", source.schema, "created_at", files=1)
    out = drained(spark, L.fold_runs(stream), tmp_path, "update")
    last = out.groupBy("trace_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("trace_id", "batch")]), "batch").alias("r")).select("trace_id", "r.*")
    want = U.stale_runs(U.fold_trace_runs(source), F.lit(at(225)).cast("timestamp"))
    assert "interrupted" in [r["status"] for r in last.collect()]
    assert sorted(map(tuple, last.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_the_state_of_an_old_run_goes(rocks, tmp_path):
    rows = [(1, 1, "chat.response", 5, at(0), "{}"), (2, 1, "chat.response", 5, at(60 * 24 * 31), "{}"), (2, 2, "chat.response", 5, at(60 * 24 * 31 + 40), "{}"), (1, 2, "chat.request", 5, at(60 * 24 * 31 + 41), "{}")]
    source = in_files(rocks, tmp_path, rows, EVENTS, 1)
    out = drained(rocks, L.fold_runs(L.stream_of(rocks, f"{tmp_path}/in", source.schema, "created_at", files=1)), tmp_path, "update")
    assert [(r["events"], r["status"]) for r in out.where("trace_id = 1").orderBy("batch").collect()][:2] == [(1, "success"), (1, "running")]


def attempts():
    rng = random.Random(9)
    rows = [(i, f"u{rng.randrange(2)}", f"10.0.0.{rng.randrange(2)}", rng.random() < 0.1, "r", at(0, i * 20 + rng.randrange(20))) for i in range(240)]
    return [(i, u, ip, ok, None if ok else r, t) for i, u, ip, ok, r, t in rows]


def test_throttle_over_three_scopes(rocks, tmp_path):
    source = in_files(rocks, tmp_path, attempts(), LOGINS, 40)
    stream = L.stream_of(rocks, f"{tmp_path}/in", source.schema, "attempt_at", files=1)
    got = drained(rocks, L.scoped_throttle(stream), tmp_path, "append").drop("batch")
    want = L.scoped_throttle(source)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    verdicts = {r["attempt_id"]: r for r in L.longest_block(want).collect()}
    scopes = {r["scope"] for r in verdicts.values()}
    assert scopes == {None, "pair", "ip"} and any(r["account_alert"] for r in verdicts.values())
    each = {}
    for r in want.collect():
        if r["scope"] != "account":
            each[r["attempt_id"]] = max(each.get(r["attempt_id"], 0), r["retry_after"])
    assert each == {k: r["retry_after"] for k, r in verdicts.items()}


def test_an_idle_throttle_is_forgotten(rocks, tmp_path):
    rows = [(i, "u", "i", False, "r", at(i)) for i in range(3)] + [(9, "v", "j", False, "r", at(60 * 50)), (10, "v", "j", False, "r", at(60 * 50 + 30)), (11, "v", "j", False, "r", at(60 * 50 + 31))]
    source = in_files(rocks, tmp_path, rows, LOGINS, 1)
    made = L.scoped_throttle(L.stream_of(rocks, f"{tmp_path}/in", source.schema, "attempt_at", files=1))
    drained(rocks, made, tmp_path, "append")
    held = rocks.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "bucket").load()
    assert held.where("value is not null").count() == 3  # the buckets of v only


def test_sessions_of_equal_failures(rocks, tmp_path):
    times = [0, 60, 120, 181, 181, 300, 361]
    rows = [(i, "u", "i", False, "r", at(0, t)) for i, t in enumerate(times)] + [(20, "u", "i", True, None, at(0, 30)), (21, "u", "i", True, None, at(0, 30)), (22, "u", None, False, "r", at(0, 61)), (23, "w", "i", False, "r", at(100))]
    source = in_files(rocks, tmp_path, rows, LOGINS, 4)
    stream = L.stream_of(rocks, f"{tmp_path}/in", source.schema, "attempt_at", files=1)
    got = drained(rocks, L.merged_failures(stream), tmp_path, "append").drop("batch")
    want = T.merge_failures(source)
    closed = [r for r in map(tuple, want.select(got.columns).collect()) if r[-1] < at(100)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, closed)) and len(closed) == 7


def test_expired_runs_take_their_events(spark):
    runs = spark.createDataFrame([(1, at(0)), (2, at(60 * 24 * 20))], "trace_id long, started_at timestamp")
    events = spark.createDataFrame([(1, at(60 * 24 * 31)), (2, at(60 * 24 * 20)), (3, at(60 * 24 * 31))], "trace_id long, created_at timestamp")
    kept, left = U.retained(runs, events, F.lit(at(60 * 24 * 32)))
    assert [r[0] for r in kept.collect()] == [2] and [r[0] for r in left.select("trace_id").collect()] == [2]
    buckets = [("old", at(0), None), ("old but blocked", at(0), at(60 * 80)), ("new", at(60 * 50), None), ("over", at(0), at(60 * 60))]
    left = U.retained_throttles(spark.createDataFrame(buckets, "b string, last_failed_at timestamp, blocked_until timestamp"), F.lit(at(60 * 72)))
    assert sorted(r["b"] for r in left.collect()) == ["new", "old but blocked"]
