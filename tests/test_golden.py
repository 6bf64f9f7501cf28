"""Small literal cases for what SQL does not check."""

import datetime as dt
import json
import random
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import documents as D
from gleaner.operators import retrieval as R
from gleaner.operators import runs as U
from gleaner.operators import telemetry as T
from gleaner.plans import registry
from gleaner.sources.files import read_documents, rebuild_knowledge_records
from gleaner.streaming import logs as L


def test_split_text_keeps_sentences_and_merges_short_ends():
    text = "。".join("知识库" * 30 for _ in range(12)) + "。\n短"
    chunks = D.split_text(text)
    assert all(len(c) <= 500 + 50 + 5 for c in chunks) and chunks[-1].endswith("短")
    assert D.split_text("OK") == ["OK"] and D.split_text("") == [] and D.split_text(None) == []
    english = " ".join(f"Sentence number {i} is here." for i in range(300))
    assert D.split_text(english)[1].startswith("Sentence number 7") or len(D.split_text(english)) > 1
    assert D.split_text("a" * 5000)[0] == "a" * 2000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc知识 .!。\n", min_size=0, max_size=200), max_size=30))
def test_split_text_covers_every_sentence(parts):
    text = "\n".join(parts)
    whole = "".join("".join(D.split_text(text)).split())
    for line in text.split("\n"):
        for piece in line.split():
            assert piece[:100] in whole or len(piece) > 100


def test_table_parts_repeat_the_header():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * 90} |" for i in range(60))
    parts = D.split_table_rows(table)
    assert len(parts) == parts[0]["part_count"] > 2
    assert all(p["content"].startswith("| a | b |\n| --- | --- |\n") for p in parts)
    assert [p["row_start"] for p in parts[1:]] == [p["row_end"] + 1 for p in parts[:-1]] and parts[-1]["row_end"] == 60


def test_sections_and_chunks(spark):
    text = "intro\n# A\none\n## B\n| h | v |\n| --- | --- |\n| k | 1 |\n# C\n> 无\n## D\ntwo"
    docs = spark.createDataFrame([(1, "T", text)], "doc_id long, title string, text string")
    sections = {(r["path"], r["kind"]): r["content"] for r in D.parse_sections(docs, "doc_id").collect()}
    assert sections[("", "text")] == "intro" and sections[("A", "text")] == "one" and sections[("C › D", "text")] == "two"
    assert sections[("A › B", "table")].count("\n") == 2
    chunks = D.chunk_documents(docs, "doc_id", "title").orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == list(range(4))
    assert chunks[2]["content"].startswith("【T › A › B】\n| h | v |") and not any("无" in c["content"] for c in chunks)


def test_records_from_tables(spark, tmp_path):
    md = "| name | port |\n| --- | --- |\n| a | 1 |\n| a | 1 |\n|  | 2 |\n| b | 3 | 4 |\n| c | 5 |"
    chunks = spark.createDataFrame([(1, 0, 7, md), (2, 1, 8, md)], "id long, kb_id long, doc_id long, content string")
    docs = spark.createDataFrame([(7, 0, "ready", True), (8, 1, "draft", True)], "doc_id long, kb_id long, status string, is_active boolean")
    got = rebuild_knowledge_records(None, chunks, docs)
    assert sorted((r["subject"], r["predicate"], r["value"]) for r in got.collect()) == [("a", "port", "1"), ("c", "port", "5")]
    old = got.withColumn("kb_id", F.lit(5).cast("long"))
    assert rebuild_knowledge_records(old, chunks, docs, [0]).count() == 4


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("ok é".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    rows = {r["filename"]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["text"] == "ok é" and rows["b.pdf"]["text"] is None and rows["b.pdf"]["file_type"] == "pdf"


def test_embed_table_checks_the_count(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id long, t string")
    got = D.embed_table(rows, "t", lambda ts: [[len(t), 1.0] for t in ts], 3).orderBy("id").collect()
    assert [r["embedding"][0] for r in got] == list(range(10))
    with pytest.raises(Exception, match="vectors for"):
        D.embed_table(rows, "t", lambda ts: [[1.0]], 3).collect()


def test_redaction(spark):
    t = 'api_key: "abc", go postgres://u:p@db:5432/x?sslmode=1 Bearer aa.bb'
    got = spark.createDataFrame([(t,)], "t string").select(X.redact_text(F.col("t"))).first()[0]
    assert "abc" not in got and "u:p" not in got and "sslmode" not in got and "postgres://db:5432/x" in got and "Bearer [REDACTED]" in got


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40), (1, 4, 10), (2, 1, 101)], "g long, pos long, size long")
    got = [(r["g"], r["pos"]) for r in T.greedy_budget(rows, "g", ["pos"], "size", 100).orderBy("g", "pos").collect()]
    assert got == [(1, 1), (1, 3), (1, 4)]


def test_fusion_does_not_depend_on_channel_order(spark):
    a = spark.createDataFrame([(1, 1, 1, 0, 0.9, 1), (1, 2, 1, 1, 0.8, 2)], "query_id long, id long, doc_id long, chunk_index int, score double, rank int")
    b = a.where("id = 2").withColumn("rank", F.lit(1))
    one = {r["id"]: r["score"] for r in R.fuse({"x": a, "y": b}).collect()}
    two = {r["id"]: r["score"] for r in R.fuse({"y": b, "x": a}).collect()}
    assert one == two and one[2] > one[1]


def test_overview_is_one_row(spark):
    row = registry.queries()["D12_overview"](spark, "/root/testdata/sf0.001").collect()
    assert len(row) == 1 and row[0]["daily"]


def test_export_prefers_the_last_terminal_event(spark):
    events = spark.createDataFrame([(1, 1, "retrieval.candidate", "x"), (1, 2, "chat.request", "x"), (1, 3, "chat.response", "x")], "trace_id long, seq long, event string, payload string")
    assert [r["event"] for r in T.export_trace(events, 2).orderBy("seq").collect()] == ["chat.request", "chat.response"]


def minute(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def test_throttle_blocks_and_does_not_extend(spark):
    frame = pd.DataFrame({"attempt_at": [minute(i) for i in (0, 1, 2, 3, 4, 5, 19, 40)], "success": [False] * 8})
    out, state = L.throttled(frame, (0, None, None), L.LIMITS["pair"], True)
    assert [w for _, w, _ in out] == [0, 0, 0, 0, 900, 840, 0, 0] and state[0] == 1
    logins = spark.createDataFrame([("b", minute(i), False) for i in range(6)] + [("c", minute(0), True)], "bucket string, attempt_at timestamp, success boolean")
    assert L.login_throttle_batch(logins, "pair").agg(F.max("retry_after")).first()[0] == 900


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = [(1, 1, "chat.request", minute(1)), (1, 2, "chat.error", minute(2)), (1, 3, "chat.response", minute(3)), (2, 2, "chat.response", minute(9)), (2, 1, "chat.request", minute(0)), (3, 1, "chat.request", minute(4))]
    schema = "trace_id long, seq long, event string, created_at timestamp"
    spark.createDataFrame(rows, schema).withColumn("user_id", F.lit(1).cast("long")).withColumn("payload", F.lit("{}")).repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = L.stream_of(spark, str(tmp_path / "in"), source.schema, "created_at")
    q = L.fold_runs(stream).writeStream.format("memory").queryName("runs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select trace_id, max_by(status, events) status, min(started_at) s from runs group by 1").collect()
    want = U.fold_trace_runs(source).select("trace_id", "status", F.col("started_at").alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sink_days_and_ingest(spark, tmp_path):
    rows = [(1, "chat.request", "x" * 50, minute(0), 7, 1), (2, "chat.request", "y", minute(5), 7, 1), (3, "chat.error", "z", minute(3000), 8, 2)]
    spark.createDataFrame(rows, "event_id long, event string, payload string, created_at timestamp, doc_id long, revision long").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = L.stream_of(spark, str(tmp_path / "in"), schema, "created_at")
    q = L.write_trace_events(stream, str(tmp_path / "out"), str(tmp_path / "c1"), 20).start()
    q.processAllAvailable()
    q.stop()
    out = {r["event_id"]: r["payload"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert json.loads(out[1]) == {"truncated": True, "bytes": 50} and out[2] == "y"
    q = L.daily_activity(stream).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("select * from days").collect()) == [1, 2]
    for _ in range(2):
        q = L.incremental_ingest(stream, str(tmp_path / "t"), str(tmp_path / f"c{time.time_ns()}")).start()
        q.processAllAvailable()
        q.stop()
    assert L.read_ingested(spark, str(tmp_path / "t"), "documents", schema).count() == 2


def test_payload_rules():
    from gleaner.functions import payload as P

    event = {"apiKey": "x", "total_tokens": 3, "a": [{"refresh-token": "y", "content": " "}], "Cookie": "z"}
    assert P.redacted(event) == {"apiKey": "[REDACTED]", "total_tokens": 3, "a": [{"refresh-token": "[REDACTED]", "content": " "}], "Cookie": "[REDACTED]"}
    assert not P.holds_content(event) and P.holds_content({"a": [{"question": "x"}]}) and not P.holds_content({"tags": []})
    big = {"event": "e" * 400, "x": "y" * 500, "hit_count": 3, "z": 1}
    small = P.capped(big, 400)
    assert small["truncated"] and small["hit_count"] == 3 and small["z"] == 1 and "x" not in small and len(small["event"]) == 256
    assert P.capped({"a": 1}, 100) == {"a": 1}


def test_config_assignments():
    from gleaner.functions.payload import config_assignments

    text = "a:\n  b: 1 # how many\n  c:\n    d: 'x'\n  e: 1.50\nf: yes\nk.l = true\na:\n  b: 1\nhttp://x.org"
    assert config_assignments(text) == [("a.b", "1", "how many"), ("a.c.d", '"x"', None), ("a.e", "1.5", None), ("f", '"yes"', None), ("k.l", "true", None)]
    assert config_assignments(None) == []


def test_query_terms(spark):
    from gleaner.operators.packs import query_terms

    got = spark.createDataFrame([("请问 产品8.6 缓存失效怎么配置",), ("",), (None,), ("a Foo foo",)], "q string").select(query_terms(F.col("q"))).collect()
    assert "缓存失效" in got[0][0] and "产品8.6" in got[0][0] and "8.6" in got[0][0] and got[1][0] == got[2][0] == []
    assert got[3][0] == ["a Foo foo", "Foo"]


def test_bridge_and_groups(spark):
    from gleaner.operators import packs as K

    records = spark.createDataFrame([("Alpha box", "node 7"), ("Alpha", "x")], "subject string, value string")
    asked = spark.createDataFrame([(1, "where is alpha Box now"), (2, "none here")], "query_id long, query string")
    assert [tuple(r) for r in K.bridge_two_hop(asked, records).collect()] == [(1, "alpha box", "where is node 7 now")]
    rows = [(i, [f"p{i}", f"p{i + 1}"], [f"v{i % 2}"], None) for i in range(120)] + [(500, ["z"], None, ["j"]), (501, ["z"], ["v"], ["k"]), (502, None, None, None)]
    got = {r["doc_id"]: r for r in K.scope_groups(spark.createDataFrame(rows, "doc_id long, products array<string>, versions array<string>, projects array<string>")).collect()}
    assert all((got[i]["product_group"], got[i]["version_group"]) == (0, i % 2) for i in range(120)) and {r["dimension"] for r in got.values()} == {"product_version"}
    assert tuple(got[500])[1:4] == (500, None, 500) and tuple(got[501])[1:4] == (500, 501, 501) and tuple(got[502])[1:4] == (None, None, None)


def test_members_of_scopes_against_plain_python(spark):
    """Clusters by repeated merging, companions copied into each, level after level."""
    from gleaner.operators import packs as K

    def clusters(own, values):
        found = []
        for d in own:
            if values(d):
                met = [c for c in found if any(values(x) & values(d) for x in c)]
                found = [c for c in found if c not in met] + [[d, *[x for c in met for x in c]]]
        rest = [d for d in own if not values(d)]
        return [(min(x[1] for x in c), c + rest) for c in found] or [(None, rest)]

    rng = random.Random(8)
    some = lambda letter, n, most: rng.choice([None, [], [None], [f"{letter}{rng.randrange(n)}" for _ in range(rng.randrange(1, most))]])
    rows = [(rng.choice([1, 2, 3, None]), i, some("p", 9, 3), some("v", 4, 3), some("j", 3, 2)) for i in range(60)]
    rows += [(7, 1, None, None, None), (7, 2, None, ["v"], None), (8, 1, ["p"], None, ["j1"]), (8, 2, ["p"], None, ["j2"]), (9, 1, ["p"], ["a"], None), (9, 2, ["p"], ["b"], None), (9, 3, None, None, None), (9, None, ["p"], None, None)]
    rows += [(10, 1, ["p"], ["a"], None), (10, 2, ["p"], ["b"], None), (10, 3, None, ["a", "b"], None)]
    want = []
    for q in {r[0] for r in rows}:
        own = [(r[0], r[1], *[frozenset(x for x in v or [] if x) for v in r[2:]]) for r in rows if r[0] == q and r[1] is not None]
        groups = [(p, v, j, c) for p, a in clusters(own, lambda d: d[2]) for v, b in clusters(a, lambda d: d[3]) for j, c in clusters(b, lambda d: d[4])]
        union = lambda c, k: frozenset().union(*[d[k] for d in c])
        versions = {union(c, 3) for *_, c in groups} - {frozenset()}
        dimension = "product_version" if len({union(c, 2) for *_, c in groups}) > 1 else "version" if len(versions) > 1 else "project" if len(groups) > 1 and all(union(c, 4) for *_, c in groups) else None
        want += [(q, p, v, j, d[1], any(n is not None and not x for n, x in zip((p, v, j), d[2:])), dimension) for p, v, j, c in groups for d in c]
    schema = "question long, doc_id long, products array<string>, versions array<string>, projects array<string>"
    got = K.scope_members(spark.createDataFrame(rows + rows[:5], schema))
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert {r[6] for r in want} == {"product_version", "version", "project", None}
    assert K.scope_members(spark.createDataFrame([], schema)).count() == 0


def test_evidence_pack_stages_can_be_replaced(spark):
    from gleaner.operators import packs as K

    chunks = spark.createDataFrame([(1, 1, 0, "alpha beta", [1.0, 0.0]), (2, 2, 0, "gamma delta", [0.0, 1.0])], "id long, doc_id long, chunk_index int, content string, embedding array<float>")
    asked = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "zzz qqq", [-1.0, -1.0])], "query_id long, query string, query_vec array<float>")
    records = spark.createDataFrame([(9, 1, "alpha", "alpha beta")], "id long, doc_id long, subject string, search_text string")
    got = {r["query_id"]: r for r in K.evidence_pack(asked, chunks, records).collect()}
    assert got[1]["outcome"] == "answered" and "r9" in got[1]["selected"] and got[2]["outcome"] in ("insufficient_evidence", "answered")
    assert got[1]["reason"] == "structured_or_document_evidence_admitted"
    only = {r["query_id"]: r for r in K.evidence_pack(asked, chunks, records, doc_ids=chunks.where("doc_id = 2")).collect()}
    assert "r9" not in only[1]["selected"] and "c1" not in only[1]["selected"]
    facts = {r["query_id"]: r for r in K.evidence_pack(asked, chunks, records, record_ids=records.limit(0)).collect()}
    assert {r["outcome"] for r in facts.values()} == {"no_hit"} and {r["reason"] for r in facts.values()} == {"no_candidates"}
    none = K.evidence_pack(asked, chunks, records, verify=lambda df: df.withColumn("ok", F.lit(False)))
    assert {r["outcome"] for r in none.collect()} == {"insufficient_evidence"}


def test_markdown_outside_of_fences(spark):
    t = "a * b * c\n```yaml\nx: 1\n\n\n\n\ny * z * w\n```\nend<br>now <code>k</code> in ```sh ls``` line"
    got = spark.createDataFrame([(t,)], "t string").select(X.normalize_markdown(F.col("t"))).first()[0]
    assert "a\n* b\n* c" in got and "x: 1\n\n\n\n\ny * z * w" in got and "end\nnow `k` in" in got and "\n```sh ls\n```\n line" in got


def test_throttle_and_dedup_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    logins = [("b", minute(i), False) for i in range(7)] + [("c", minute(0), False), ("c", minute(1), True), ("c", minute(2), False)]
    spark.createDataFrame(logins, "bucket string, attempt_at timestamp, success boolean").write.parquet(str(tmp_path / "l"))
    table = spark.read.parquet(str(tmp_path / "l"))
    q = L.login_throttle(L.stream_of(spark, str(tmp_path / "l"), table.schema, "attempt_at"), "pair").writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from blocks").collect())) == sorted(map(tuple, L.login_throttle_batch(table, "pair").collect()))
    turns = [(1, 1, minute(0)), (1, 1, minute(1)), (1, 2, minute(2)), (2, 1, minute(3))]
    spark.createDataFrame(turns, "user_id long, request_id long, at_time timestamp").write.parquet(str(tmp_path / "t"))
    stream = L.stream_of(spark, str(tmp_path / "t"), spark.read.parquet(str(tmp_path / "t")).schema, "at_time")
    q = L.dedup_requests(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["request_id"]) for r in spark.sql("select * from turns").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_scoped_search_looks_in_its_own_documents_only(spark, monkeypatch):
    from gleaner.operators import packs as K

    rows = [(i, 1000 + i, 0, "alpha", [0.0, 1.0]) for i in range(300)]
    rows += [(900, 1, 0, "alpha " + "filler words of a long chunk " * 9, [0.0, 1.0]), (901, 1, 1, "other", [1.0, 0.0]), (902, 2, 0, "outside", [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, doc_id long, chunk_index int, content string, embedding array<float>")
    asked = spark.createDataFrame([(7, "alpha", [1.0, 0.0]), (8, "alpha", [1.0, 0.0])], "query_id long, query string, query_vec array<float>")
    scope = spark.createDataFrame([(7, 1), (7, 1)], "query_id long, doc_id long")
    got = {r["id"]: r for r in K.search_within_documents(asked, chunks, scope).collect()}
    assert set(got) == {900, 901} and {r["query_id"] for r in got.values()} == {7}
    assert got[900]["keyword_rank"] == got[900]["trigram_rank"] == 1 and got[901]["vector_rank"] == 1 and got[901]["keyword_rank"] is None
    monkeypatch.setattr(K, "SCOPE_CHUNKS", 1)
    assert [(r["id"], r["vector_rank"], r["trigram_rank"]) for r in K.search_within_documents(asked, chunks, scope).collect()] == [(900, None, None)]


def test_second_stage_finds_records_below_ten_thousand_others(spark):
    from gleaner.operators import packs as K

    others = spark.range(10_050).selectExpr("concat('a', id) AS id", "1L AS chunk_id", "'alpha beta' AS subject", "'alpha beta' AS search_text")
    own = spark.createDataFrame([("z1", 2, "alpha", "alpha gamma"), ("z2", 2, "delta", "alpha delta")], others.schema)
    asked = spark.createDataFrame([(7, "alpha beta")], "query_id long, query string")
    chosen = spark.createDataFrame([(7, 2, 1)], "query_id long, chunk_id long, pos long")
    assert [(r["id"], r["place"]) for r in K.search_records_for_chunks(asked, chosen, others.unionByName(own)).orderBy("place").collect()] == [("z2", 1), ("z1", 2)]
    assert [(r["item"], r["place"]) for r in K.second_stage_records(asked, chosen, others.unionByName(own)).orderBy("place").collect()] == [("rz2", 1), ("c2", 2), ("rz1", 3)]


def test_expansion_takes_small_documents_hits_and_neighbours(spark):
    from gleaner.operators import packs as K

    cols = "id long, doc_id long, kb_id long, chunk_index int, content string, embedding array<float>, section_key string, table_id string, table_part_index int"
    small = [(i, 1, 0, i, f"alpha {i}", [1.0, 0.0], "s", None, None) for i in range(4)]
    large = [(100 + i, 2, 0, i, ("beta " if i % 9 == 0 else "other ") * 100, [0.0, 1.0], f"s{i // 8}", None, None) for i in range(40)]
    chunks = spark.createDataFrame(small + large, cols)
    docs = spark.createDataFrame([(1, 0, "ready", True), (2, 0, "ready", True)], "doc_id long, kb_id long, status string, is_active boolean")
    asked = spark.createDataFrame([(7, "beta", [0.0, 1.0])], "query_id long, query string, query_vec array<float>")
    seeds = spark.createDataFrame([(7, 0, 1), (7, 118, 2)], "query_id long, id long, pos long")
    got = K.expand_evidence(asked, seeds, chunks, docs).collect()
    by = {r["id"]: r["stage"] for r in got}
    assert {1, 2, 3} <= {i for i, s in by.items() if s == 0} and 118 not in by and 0 not in by
    assert sum(s > 0 for s in by.values()) <= 12 and {s for s in by.values()} >= {0, 1} and sum(r["chars"] for r in got) <= 16_000
    assert all(r["doc_id"] in (1, 2) for r in got)


def test_ingest_replaces_chunks_by_revision_and_survives_a_crash(spark, tmp_path):
    schema = "doc_id long, revision long, text string, created_at timestamp"
    chunk = lambda fresh: fresh.select("doc_id", F.explode(F.split("text", " ")).alias("word"))

    def ingest(rows, made=chunk):
        spark.createDataFrame([(*r, minute(0)) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = L.stream_of(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "created_at")
        L.incremental_ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"), {"chunks": made}).trigger(availableNow=True).start().awaitTermination()

    words = lambda: sorted(tuple(r) for r in L.read_ingested(spark, str(tmp_path / "t"), "chunks", "doc_id long, word string").collect())
    assert words() == []
    ingest([(1, 2, "a b"), (2, 1, "c")])
    ingest([(1, 1, "old"), (3, 1, "d")])
    assert words() == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]

    def fails(fresh):
        raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        ingest([(1, 3, "new")], fails)
    assert words() == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    ingest([(2, 5, "e f")])
    assert words() == [(1, "new"), (2, "e"), (2, "f"), (3, "d")]


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    from gleaner.operators import terms as V

    terms = spark.createDataFrame([("the",), ("über",), ("of it",), ("x",), ("知识",)], "term string")
    texts = spark.createDataFrame([(1, "The end  of it, überall"), (2, "other"), (3, "我的知识库"), (4, "")], "text_id long, text string")
    few = sorted(map(tuple, V.term_matches(terms, texts).collect()))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 4)
    monkeypatch.setattr(V, "TEXT_BYTES", 20)
    assert few == sorted(map(tuple, V.term_matches(terms, texts).distinct().collect())) == [(1, "of it"), (1, "the"), (1, "über"), (3, "知识")]


def test_reduced_precision_search_finds_the_nearest(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    chunks = spark.createDataFrame([(i, i // 3, i % 3, v.tolist()) for i, v in enumerate(x)] + [(9999, 1, 0, None)], "id long, doc_id long, chunk_index int, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 2000, 100)] + [(5000, None)], "query_id long, query_vec array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for bound in (1_000_000, 400):
        monkeypatch.setattr(R, "TASK_CANDIDATES", bound)
        got = {}
        for r in R.vector_candidates(asked, chunks, 40).collect():
            got.setdefault(r["query_id"], set()).add(r["id"])
        recall = np.mean([len(got[q] & set(np.argsort(-(unit @ unit[q]))[:40].tolist())) / 40 for q in range(0, 2000, 100)])
        assert recall > 0.99 and 5000 not in got


def test_verifiers_must_answer_every_row(spark):
    from gleaner.operators import evidence as V

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    good = V.with_verdicts(rows, lambda f: f.assign(topic_relevance=1.7, answer_support=-1, role="direct")).collect()
    assert [(r["topic_relevance"], r["answer_support"], r["role"]) for r in good] == [(1.0, 0.0, "direct")] * 2
    with pytest.raises(Exception, match="verdicts for"):
        V.with_verdicts(rows, lambda f: f.head(0).assign(topic_relevance=1.0, answer_support=1.0, role="direct")).collect()


def test_table_functions_in_sql(spark):
    from gleaner.sources.table_functions import register_table_functions

    register_table_functions(spark)
    assert [r[0] for r in spark.sql("SELECT content FROM text_chunks('Some text that is long enough.')").collect()] == ["Some text that is long enough."]
    assert spark.sql("SELECT * FROM table_parts('| a | b |\n| --- | --- |\n| 1 | 2 |')").count() == 1


def test_overview_has_every_part_of_its_window(spark):
    new, old = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 1)
    make = spark.createDataFrame
    run = "trace_id long, user_id long, request_kind string, evidence_status string, duration_ms long, hit_count long, selected_kb_count long, started_at timestamp_ntz"
    runs = make([(1, 5, "chat", "hit", 10, 2, 1, new), (2, 5, "chat", "no_hit", 30, 0, 1, new), (3, 4, "chat", "hit", 20, 1, 1, new), (4, 6, "chat", "hit", 90, 9, 9, old)], run)
    logins = make([("a", "i", True, new), ("b", "j", False, new), ("c", "k", False, old)], "username string, ip string, success boolean, attempt_at timestamp_ntz")
    docs, users, kb, chunks = make([(1, "ready")], "doc_id long, status string"), spark.range(3), spark.range(2), spark.range(4)
    events = make([("g", '{"k": 3}', new), ("g", '{"k": 5}', old), ("x", '{"k": 7}', new)], "event string, payload string, created_at timestamp_ntz")
    acts = make([("b", new), ("b", new), ("a", new), ("c", old)], "action string, created_at timestamp_ntz")
    rows = T.overview(runs, logins, docs, users, kb, chunks, events, acts, ["g"], 7).collect()
    assert len(rows) == 1
    got = {k: [tuple(x) for x in v] if isinstance(v, list) else v for k, v in rows[0].asDict().items()}
    assert got["days"] == 7 and got["daily"] == [(new.date(), 3, 20)] and got["latency"] == [("chat", 20.0, 29.0)]
    assert [(x["n"], x["hit_rate"]) for x in rows[0]["quality"]][0][0] == 3 and got["hits"] == [(1.0, 1.0)]
    assert got["security"] == [(1, 1, 1, 1)] and got["documents"] == [("ready", 1)] and got["scale"] == [(3, 2, 2, 1, 4)]
    assert [(x["user_id"], x["n"], x["hits"]) for x in rows[0]["top_users"]] == [(5, 2, 1), (4, 1, 1)]
    assert got["tokens"] == [(new.date(), "g", 3, 0, 3, 1)] and len(got["token_totals"]) == 3
    assert got["top_actions"] == [("b", 2), ("a", 1)]


def test_terms_whatever_width_case_and_space(spark):
    from gleaner.operators import terms as V

    words = ["R1", "餐补", "Ｃａｆé", "a b", "x", "", None, "straße", "c++", "r1"]
    texts = {1: "r1", 2: "R10 and xr1", 3: "版本R 1号", 4: "聚餐补录", 5: "餐 \n补", 6: "CAFÉ!", 7: "cafés", 8: "A\tB", 9: "STRASSE", 10: "use c++, or C++11", 11: None, 12: "", 13: "r1." + "y" * 100_000 + " R1"}
    got = V.term_matches(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame(list(texts.items()), "text_id long, text string"))
    r1 = {"R1", "r1"}
    want = {1: r1, 3: r1, 4: {"餐补"}, 5: {"餐补"}, 6: {"Ｃａｆé"}, 7: {"Ｃａｆé"}, 8: {"a b"}, 9: {"straße"}, 10: {"c++"}, 13: r1}
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i, ts in want.items() for t in ts)
    assert V.replaced_once("use  R1 and r1", "r1", "R2 (new)") == "use R2 (new) and r1" and V.replaced_once("餐 补", "餐补", "x") is None
    assert V.replaced_once("R1", "R1", "ｒ1") is None and V.replaced_once("a\\1", "a", r"\1") == "\\1\\1" and V.replaced_once("R1" * 600, "R1", "x") is None


def test_configuration_that_was_run_together():
    from gleaner.functions.payload import config_assignments as read

    fenced = "Set it so: ```yaml server: port: 8080 # listen port; tls: enabled: true cert: /etc/a.pem url: http://h:90/x name: \"a b\"``` then go."
    assert read(fenced) == [("port", "8080", "listen port"), ("enabled", "true", None), ("cert", '"/etc/a.pem"', None), ("url", '"http://h:90/x"', None), ("name", '"a b"', None)]
    assert read("```\na:\n  b: 1\n```") == [("a.b", "1", None)]
    assert read("``` {x: 1, y: two}```") == [("x", "1", None), ("y", '"two}"', None)]
    prose = "with retry.count=5 max-wait: 2.50 and mode='fast' # how it goes level=3"
    assert read(prose) == [("retry.count", "5", None), ("mode", '"fast"', "how it goes"), ("level", "3", None)]
    assert read("see a=5 now") == [] and read("x=true") == [("x", "true", None)] and read("use `debug=true") == [("debug", "true", None)]
    assert read("export PATH_OF.x = y") == [("path_of.x", '"y"', None)]
    assert read("k: 1\nk: 1\nk: 2\n") == [("k", "1", None), ("k", "2", None)] and len(read("\n".join(f"k{i}: {i}" for i in range(130)))) == 100
    assert read("```") == [] and read("```a: 1") == [("a", "1", None)][:0] and read("a" * 300 + "=1 x") == []


def test_deep_json_and_wide_records(spark):
    from gleaner.functions import payload as P

    rows = spark.createDataFrame([(1, "[" * 20_000 + "]" * 20_000), (2, '{"content":"x"}')], "id int, payload string")
    assert sorted((r["id"], r["has_content"]) for r in P.contains_business_content(rows, "payload").collect()) == [(1, None), (2, True)]
    table = "|" + "|".join(f" h{i} " for i in range(130)) + "|\n|" + " --- |" * 130 + "\n|" + "|".join(f" c{i} " for i in range(130)) + "|"
    value = D.extract_records(spark.createDataFrame([(1, table)], "k int, content string"), "k").first()["value"]
    assert value.split(" | ") == [f"c{i}" for i in range(1, 130)]


def test_ingest_parts_grow_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "PART_DOCUMENTS", 10)
    schema = "doc_id long, revision long, text string, chunk_count long, created_at timestamp"
    chunk = lambda fresh: fresh.where("text <> ''").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    target, want = str(tmp_path / "t"), {}
    for batch in ([(i, 1, "a b", None) for i in range(5)], [(i, 1, f"c{i}", 9) for i in range(5, 60)], [(2, 2, "", 7)], [(3, 2, "x y z", 7)], [(4, 0, "old", 7)]):
        spark.createDataFrame([(*r, minute(0)) for r in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = L.stream_of(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "created_at")
        L.incremental_ingest(stream, target, str(tmp_path / "c"), {"chunks": chunk}).trigger(availableNow=True).start().awaitTermination()
        want |= {d: (r, t, len(t.split())) for d, r, t, _ in batch if d not in want or r > want[d][0]}
        got = {x["doc_id"]: (x["revision"], x["text"], x["chunk_count"]) for x in L.read_ingested(spark, target, "documents", schema).collect()}
        words = sorted(map(tuple, L.read_ingested(spark, target, "chunks", "doc_id long, word string").collect()))
        assert got == want and words == sorted((d, w) for d, (_, t, _) in want.items() for w in t.split())
    now = L._manifest(spark, target, L._complete(spark, target)[0])
    assert now.parts == 8 and sum(now.documents.values()) == 60 and len(L._complete(spark, target)) == 2
    kept = {p.relative_to(tmp_path / "t/documents").as_posix() for p in (tmp_path / "t/documents").glob("*/part=*")}
    assert set(now.folders.values()) <= kept and len(kept) <= len(now.folders) + 2
