"""Structured Streaming over trace, login and document logs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions.text import throttle_keys
from gleaner.operators import runs as U
from gleaner.session import discard, stored

#: Scope -> failures, minutes of the window, minutes blocked (None: alert only).
LIMITS = {"pair": (5, 15, 15), "ip": (20, 15, 60), "account": (20, 15, None)}
#: Minutes after which a silent run counts as interrupted, days a run is kept, hours an idle throttle is kept.
SILENT_MINUTES, RUN_DAYS, THROTTLE_HOURS = 15, 30, 48
THROTTLE = "bucket string, moment timestamp, retry_after long, alert boolean"
ATTEMPT = "scope string, attempt_id long, moment timestamp, retry_after long, alert boolean"


def stream_of(spark: SparkSession, path: str, schema: T.StructType, stamp: str, late: str = "15 minutes", files: int = 100) -> DataFrame:
    """A Parquet folder as a stream with event time; the watermark is ours, late rows beyond it are dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)


def write_trace_events(stream: DataFrame, path: str, checkpoint: str, most_bytes: int = 131_072):
    """Append sink of events; a payload beyond the limit is replaced by its size."""
    big = F.octet_length("payload") > most_bytes
    bounded = stream.withColumn("payload", F.when(big, F.to_json(F.struct(F.lit(True).alias("truncated"), F.octet_length("payload").alias("bytes")))).otherwise(F.col("payload")))
    return bounded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def daily_activity(stream: DataFrame, stamp: str = "created_at") -> DataFrame:
    return stream.groupBy(F.window(stamp, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def dedup_requests(stream: DataFrame) -> DataFrame:
    """One turn for each (user, request) within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["user_id", "request_id"])


def newer(held: list | None, seq: int, *value) -> list:
    return [seq, *value] if held is None or seq > held[0] else held


def prefix_minima(held: list, seq: int, at: int) -> list:
    """(seq, time) of events that were the earliest so far in the order of seq; arrivals may be in any order."""
    held = sorted([*held, [seq, at]])
    out: list = []
    for x in held:
        if not out or x[1] < out[-1][1]:
            out.append(x)
    return out


def folded(state: dict, update: dict) -> dict:
    """The state of a run with one more event; the outcome does not depend on the order of arrival."""
    seq, at = int(update["seq"]), int(update["at"])
    state["events"] = state.get("events", 0) + 1
    state["last"] = newer(state.get("last"), seq, update["event"], at)
    state["minima"] = prefix_minima(state.get("minima", []), seq, at)
    state["content"] = bool(state.get("content") or update["has_content"])
    for c in U.NEWEST:
        if update[c] is not None:
            state[c] = newer(state.get(c), seq, update[c])
    outcome = update["outcome"]
    if outcome is not None:
        state["ended"] = newer(state.get("ended"), seq, at)
        state["won" if outcome == "success" else "lost"] = newer(state.get("won" if outcome == "success" else "lost"), seq, outcome)
    if outcome is not None or update["stage_ms"] is not None:
        state["span"] = newer(state.get("span"), seq, at if outcome is not None else None, update["stage_ms"])
    return state


def summary(trace, state: dict) -> dict:
    """The row of SUMMARY that a state stands for; times in microseconds."""
    started = min(at for _, at in state["minima"])
    won, lost = state.get("won"), state.get("lost")
    status = lost[1] if lost and (lost[1] == "error" or not won or won[0] < lost[0]) else "success" if won else "running"
    span, ms = state.get("span"), None
    if span and span[1] is not None:
        ms = max(0, round((span[1] - min(at for seq, at in state["minima"] if seq <= span[0])) / 1000))
    elif span:
        ms = int(span[2])
    out = {"trace_id": trace, "current_stage": state["last"][1], "content_included": state["content"], "duration_ms": ms, "started_at": started, "updated_at": state["last"][2], "status": status, "events": state["events"]}
    return out | {"completed_at": state["ended"][1] if "ended" in state else None} | {c: state[c][1] if c in state else None for c in U.NEWEST}


class RunFold:
    """A run's state with a time-out of event time: silence ends a running one, age deletes it.

    A run that was reported as interrupted for its silence is open again with its
    next event, as in the batch form, which judges runs by their newest event.
    States come and go with the rows in batches of many runs, so that a run costs
    no calls of its own; an event and a summary are one JSON text each, since a column costs more than its value.
    """

    NOTHING = dict.fromkeys(["outcome", "stage_ms", *U.NEWEST])

    def _row(self, row: dict) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": [row["trace_id"]], "run": [json.dumps({c: x for c, x in row.items() if c != "trace_id"})]})

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        if not held.hasTimedOut:
            state.pop("told", None)
            for frame in frames:
                for told in frame["told"].tolist():
                    state = folded(state, self.NOTHING | json.loads(told))
        row = summary(key[0], state)
        if not held.hasTimedOut:
            yield self._row(row)
        # A time is due once the watermark has passed it: one millisecond beyond the last full one.
        now, end = held.getCurrentWatermarkMs(), row["started_at"] // 1000 + RUN_DAYS * 86_400_000
        silent = row["updated_at"] // 1000 + SILENT_MINUTES * 60_000
        waits = row["status"] == "running" and not state.get("told")
        if waits and silent < now and (end >= now or not held.hasTimedOut):
            yield self._row(row | {"status": "interrupted", "completed_at": row["updated_at"]})
            state["told"], waits = True, False
        if end < now:
            held.remove()
            return
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(now + 1, min(end, silent) if waits else end))


def fold_runs(stream: DataFrame) -> DataFrame:
    """The summary of a run after each batch with events of it, and once when it falls silent.

    stream: trace_id, seq, event, user_id, payload and created_at with a watermark.
    """
    kinds = dict(stream.dtypes)
    updates = U.event_updates(stream)
    told = F.to_json(F.struct("seq", "event", "outcome", "stage_ms", "has_content", *U.NEWEST, U.micros(F.col("created_at")).alias("at")))
    fold = RunFold()
    state = "state string", "update", "EventTimeTimeout"
    runs = updates.select("trace_id", "created_at", told.alias("told")).groupBy("trace_id").applyInPandasWithState(lambda key, frames, held: fold(key, frames, held), f"trace_id {kinds['trace_id']}, run string", *state)
    schema = U.SUMMARY.format(id=kinds["trace_id"], user=kinds["user_id"], time="long")
    names = [x.split()[0] for x in schema.split(", ")]
    run = F.from_json("run", ", ".join(x for x in schema.split(", ") if not x.startswith("trace_id ")))
    each = runs.select("trace_id", run.alias("run"))
    return each.select(*[F.col(c) if c == "trace_id" else F.timestamp_micros(f"run.{c}").alias(c) if c.endswith("_at") else F.col(f"run.{c}") for c in names])


def merged_failures(stream: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """The stream form of telemetry.merge_failures: equal failures at most `gap` after the one before are one row.

    A session of Spark's ends where the next event is a gap away; the microsecond
    lets an event that is exactly a gap away in.  Each success is a session of its own.
    """
    rows = stream.withColumn("single", F.when(F.col("success"), F.col("id")))
    session = F.session_window("attempt_at", f"{gap} 1 microseconds")
    out = rows.groupBy(session, "username", "ip", "fail_reason", "single").agg(F.min("id").alias("id"), F.count("*").alias("attempts"), F.max("attempt_at").alias("last_at"))
    return out.select("username", "ip", "fail_reason", "id", "attempts", "last_at")


def advance(state: tuple, at: float, limits: tuple[int, int, int | None]) -> tuple[tuple, int, bool]:
    """One failed login: (state, seconds blocked, alert).  state: failures, window start, blocked until."""
    failures, start, blocked = state
    threshold, window, block = limits
    if blocked is not None and blocked > at:
        return state, max(1, int(-(-(blocked - at) // 1))), False
    if start is None or at - start >= window * 60:
        failures, start = 0, at
    failures += 1
    if block is None:
        return (failures, start, None), 0, failures == threshold
    if failures < threshold:
        return (failures, start, None), 0, False
    return (0, at, at + block * 60), block * 60, False


def throttled(frame: pd.DataFrame, state: tuple, limits: tuple[int, int, int | None], clears: bool) -> tuple[list[tuple], tuple]:
    """Attempts of one bucket in the order of time and attempt_id (if any); a success clears the bucket where `clears`."""
    out = []
    named = "attempt_id" in frame
    ids = frame["attempt_id"] if named else [0] * len(frame)
    for at, attempt, ok in sorted(zip(frame["attempt_at"], ids, frame["success"], strict=True)):
        seconds = pd.Timestamp(at).value / 1e9
        if ok:
            state = (0, None, None) if clears else state
            continue
        state, wait, alert = advance(state, seconds, limits)
        out.append((at, wait, alert, attempt) if named else (at, wait, alert))
    return out, state


class Throttle(StatefulProcessor):
    """Failure counts of one bucket: blocked failures don't count, windows restart when they are next used.

    A bucket is forgotten once its last failure is 48 hours old and it is not blocked.
    """

    def __init__(self, scope: str | None = None):
        self.scope = scope

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "failures int, start double, blocked double")

    def _forget_at(self, state: tuple, last: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state == (0, None, None):
            self.bucket.clear()
            return
        self.bucket.update(state)
        self.handle.registerTimer(int(1000 * max(last + THROTTLE_HOURS * 3600, state[2] or 0)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.bucket.get() if self.bucket.exists() else (0, None, None)
        frame = pd.concat(list(rows))
        scope = self.scope or key[0]
        out, state = throttled(frame, tuple(state), LIMITS[scope], scope == "pair")
        self._forget_at(state, pd.Timestamp(frame["attempt_at"].max()).value / 1e9)
        if self.scope:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["bucket", "moment", "retry_after", "alert"])
        else:
            yield pd.DataFrame([(key[0], o[3], *o[:3]) for o in out], columns=["scope", "attempt_id", "moment", "retry_after", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def login_throttle(stream: DataFrame, scope: str) -> DataFrame:
    """Seconds of blocking after each failed login of a stream with `bucket`, attempt_at, success."""
    return stream.select("bucket", "attempt_at", "success").groupBy("bucket").transformWithStateInPandas(Throttle(scope), THROTTLE, "append", "eventTime")


def in_scopes(logins: DataFrame) -> DataFrame:
    """(scope, bucket, attempt_id, attempt_at, success): each attempt (id, username, ip, attempt_at, success) once in every scope."""
    keys = throttle_keys(F.col("username"), F.col("ip"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("bucket")) for s, k in keys.items()]))
    return logins.select(each.alias("b"), F.col("id").alias("attempt_id"), "attempt_at", "success").select("b.*", "attempt_id", "attempt_at", "success")


def longest_block(verdicts: DataFrame) -> DataFrame:
    """(attempt_id, retry_after, scope, account_alert) of each failed attempt: the longest block over its scopes; address before pair on a tie."""
    order = F.when(F.col("scope") == "ip", 0).otherwise(1)
    longest = F.max(F.when(F.col("scope") != "account", F.struct(F.col("retry_after"), (-order).alias("o"), "scope"))).alias("top")
    out = verdicts.groupBy("attempt_id").agg(longest, F.bool_or("alert").alias("account_alert"))
    return out.select("attempt_id", F.col("top.retry_after").alias("retry_after"), F.when(F.col("top.retry_after") > 0, F.col("top.scope")).alias("scope"), "account_alert")


def scoped_throttle(logins: DataFrame) -> DataFrame:
    """The verdict of each scope on each failed attempt, of a table or of a stream with a watermark on attempt_at.

    All scopes see an attempt in the batch that it comes in, so that
    longest_block() over a batch's rows is whole.
    """
    rows = in_scopes(logins)
    if rows.isStreaming:
        return rows.groupBy("scope", "bucket").transformWithStateInPandas(Throttle(), ATTEMPT, "append", "eventTime")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, (0, None, None)
        for frame in frames:
            out = []
            for key, part in frame.groupby(["scope", "bucket"], sort=False):
                state = state if key == at else (0, None, None)
                at = key
                found, state = throttled(part, state, LIMITS[key[0]], key[0] == "pair")
                out += [(key[0], r[3], *r[:3]) for r in found]
            yield pd.DataFrame(out, columns=["scope", "attempt_id", "moment", "retry_after", "alert"])

    ordered = rows.repartition("scope", "bucket").sortWithinPartitions("scope", "bucket", "attempt_at", "attempt_id")
    return ordered.mapInPandas(walk, ATTEMPT)


def login_throttle_batch(logins: DataFrame, scope: str) -> DataFrame:
    """The same over a table: each bucket's attempts pass by in time order, with nothing but its state held."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, state = None, (0, None, None)
        for frame in frames:
            out = []
            for key, part in frame.groupby("bucket", sort=False):
                state = state if key == bucket else (0, None, None)
                bucket = key
                rows, state = throttled(part, state, LIMITS[scope], scope == "pair")
                out += [(key, *r) for r in rows]
            yield pd.DataFrame(out, columns=["bucket", "moment", "retry_after", "alert"])

    ordered = logins.select("bucket", "attempt_at", "success").repartition("bucket").sortWithinPartitions("bucket", "attempt_at", "success")
    return ordered.mapInPandas(walk, THROTTLE)


#: Documents of a part; the number of parts doubles once there are more, which deals all documents anew.
PART_DOCUMENTS = 20_000


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@dataclass(frozen=True)
class Manifest:
    """The state after a batch: its number, how many parts there are, and each part's folder and documents."""

    number: int = 0
    parts: int = 1
    folders: dict[int, str] = field(default_factory=dict)
    documents: dict[int, int] = field(default_factory=dict)


MANIFEST = "parts int, part int, folder string, documents long"


def _complete(spark: SparkSession, target: str) -> list[str]:
    """Names of the complete manifests, the newest first."""
    if not _exists(spark, f"{target}/manifests"):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifests")
    names = [x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted((n for n in names if _exists(spark, f"{target}/manifests/{n}/_SUCCESS")), reverse=True)


def _manifest(spark: SparkSession, target: str, name: str | None) -> Manifest:
    if name is None:
        return Manifest()
    rows = spark.read.schema(MANIFEST).json(f"{target}/manifests/{name}").collect()  # one row a part
    return Manifest(int(name), rows[0]["parts"] if rows else 1, {r["part"]: r["folder"] for r in rows}, {r["part"]: r["documents"] for r in rows})


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _rows_of(spark: SparkSession, target: str, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
    paths = [f"{target}/{table}/{f}" for f in folders if _exists(spark, f"{target}/{table}/{f}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_ingested(spark: SparkSession, target: str, table: str, schema: T.StructType) -> DataFrame:
    """The rows of a table (documents, or one made of them) as of the newest complete batch."""
    return _rows_of(spark, target, table, sorted(_manifest(spark, target, next(iter(_complete(spark, target)), None)).folders.values()), schema)


def incremental_ingest(stream: DataFrame, target: str, checkpoint: str, made: dict[str, Callable[[DataFrame], DataFrame]] | None = None, counted: str = "chunks"):
    """New document versions replace older ones in `target`, with the tables made of them (say, their chunks by doc_id).

    Documents are dealt to parts by a digest; a batch writes new folders for the
    parts that it touches, then one manifest of all parts.  The parts grow in
    number with the documents, so that a batch rewrites a share of them that its
    own size bounds.  A crash before the manifest leaves the old state; a revision
    that is not newer than what is there is ignored, so that replays change
    nothing.  Folders that neither the newest nor the last manifest names are
    deleted: a reader has one batch's time.  Where documents have a chunk_count,
    it is the number of their rows in the table `counted`.
    """
    made = made or {}

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = stored(batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "revision").alias("r")).select("r.*"), "newest")
        known = _complete(spark, target)
        now = _manifest(spark, target, known[0] if known else None)
        part = lambda parts: F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        touched = lambda df, parts: sorted(r[0] for r in df.select(part(parts).alias("p")).distinct().collect())
        held = _rows_of(spark, target, "documents", [now.folders[p] for p in touched(newest, now.parts) if p in now.folders], batch.schema)
        fresh = newest.join(held.select("doc_id", F.col("revision").alias("had")), "doc_id", "left").where("had is null or revision > had")
        fresh = stored(fresh.select(batch.columns), "fresh")
        parts, expected = now.parts, sum(now.documents.values()) + fresh.count()
        while parts * PART_DOCUMENTS < expected:
            parts *= 2
        # More parts: the documents of every old part are dealt anew.
        old = touched(fresh, now.parts) if parts == now.parts else sorted(now.folders)
        version = f"{now.number + 1:012d}"
        tables = {n: stored(f(fresh), n) for n, f in made.items()}
        if counted in tables and "chunk_count" in batch.columns:
            sizes = tables[counted].groupBy("doc_id").agg(F.count("*").alias("__size"))
            own = fresh.drop("chunk_count").join(sizes, "doc_id", "left").withColumn("chunk_count", F.coalesce("__size", F.lit(0)).cast(fresh.schema["chunk_count"].dataType))
            tables = {"documents": own.select(batch.columns), **tables}
        else:
            tables = {"documents": fresh, **tables}
        if not fresh.isEmpty() or parts != now.parts:
            for name, rows in tables.items():
                kept = _rows_of(spark, target, name, [now.folders[p] for p in old if p in now.folders], rows.schema).join(fresh.select("doc_id"), "doc_id", "left_anti")
                dealt = kept.select(rows.columns).unionByName(rows).withColumn("part", part(parts))
                dealt.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{target}/{name}/{version}")
            sizes = {r["part"]: r["n"] for r in spark.read.parquet(f"{target}/documents/{version}").groupBy("part").agg(F.count("*").alias("n")).collect()}
            folders = {} if parts != now.parts else dict(now.folders)
            documents = {} if parts != now.parts else dict(now.documents)
            folders |= {p: f"{version}/part={p}" for p in sizes}
            rows = [(parts, p, folder, (documents | sizes)[p]) for p, folder in sorted(folders.items())]
            spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{target}/manifests/{version}")
            for name in known[1:]:
                before = _manifest(spark, target, name)
                for folder in set(before.folders.values()) - set(now.folders.values()) - set(folders.values()):
                    for table in tables:
                        _delete(spark, f"{target}/{table}/{folder}")
                _delete(spark, f"{target}/manifests/{name}")
        discard(newest, fresh, *tables.values())

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


__all__ = ["daily_activity", "dedup_requests", "fold_runs", "incremental_ingest", "login_throttle", "login_throttle_batch", "longest_block", "merged_failures", "read_ingested", "scoped_throttle", "stream_of", "write_trace_events"]
