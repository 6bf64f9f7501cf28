"""What the findings of the fourth round asked for, on small tables."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog as C
from gleaner.operators import packs as K
from gleaner.operators import retrieval as R
from gleaner.operators import scan
from gleaner.operators import text_index as I
from gleaner.plans import registry
from gleaner.streaming import logs as L
from tests.compare import assert_same

RECORD = "id string, doc_id long, chunk_id long, subject string, value string, search_text string"


def shuffled(spark, make):
    """(rows, bytes of shuffle) of what make() gives."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda e: [e.apply(i) for i in range(e.size())])(store.executorList(False)))
    before = written()
    rows = sorted(map(tuple, make().collect()))
    return rows, written() - before


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    names, kinds = ["old rod", "cold rod", "ring", "new ring", "Straße", ""], ["LARGE", "red", "rod", None]
    rows = []
    for i in range(300):
        a, b = rng.choice(names), rng.choice(kinds)
        rows.append((f"r{i:04}", i // 10, i // 10, a or None if i % 50 else None, b, " ".join(x for x in (a, b) if x)))
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["old rod", "cold rod", "the new ring", "STRASSE", "large", "?", "", None]
    return spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(40)], "query_id long, query string")


def grams(text):
    words = set("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}, words


def scores(query, record):
    """(score, all words) of a record for a query; None without a shared trigram in its text."""
    (g, w), (t, words), (s, _) = grams(query), grams(record["search_text"]), grams(record["subject"])
    return (round(max(len(g & t), len(g & s)) / len(g), 6), w <= words) if g & t else None


def searched(asked, records, k, least, own=lambda q, r: True):
    out = []
    for q in asked.collect():
        found = [(-x[0], r["id"], x[1]) for r in records.collect() if own(q, r) and (x := scores(q["query"], r)) and (x[0] >= least or x[1])]
        out += [(q["query_id"], i, -s, every, n) for n, (s, i, every) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_records_of_equal_texts_rank_as_if_each_was_compared(asked, records, k):
    got = K.search_records(asked, records, k).select("query_id", "id", "score", "all_words", "rank")
    assert sorted(map(tuple, got.collect())) == searched(asked, records, k, 0.18)


def test_own_records_of_equal_texts(asked, records):
    chosen = asked.select("query_id", F.col("query_id").alias("chunk_id")).where("query_id < 25")
    got = K.search_records_for_chunks(asked, chosen, records, 4).select("query_id", "id", "score", "place")
    assert sorted(map(tuple, got.collect())) == [(q, i, s, n) for q, i, s, _, n in searched(asked, records, 4, 0.0, lambda q, r: q["query_id"] < 25 and r["chunk_id"] == q["query_id"])]


@pytest.mark.parametrize("most", [1, 9, 400])
def test_facts_of_equal_records_rank_as_if_each_was_compared(asked, records, most):
    want = []
    for q in asked.collect():
        text, (_, words) = (q["query"] or "").lower(), grams(q["query"])
        found = []
        for r in records.collect():
            if r["subject"] is not None and r["value"] is not None and words & (grams(r["subject"])[1] | grams(r["value"])[1]):
                by = "subject" if r["subject"].lower() in text else "value" if r["value"].lower() in text else None
                found += [(by, r["subject"], r["id"])] if by else []
        want += [(q["query_id"], i, by, n) for n, (by, _, i) in enumerate(sorted(found)[:most], 1)]
    assert sorted(map(tuple, K.entity_facts(asked, records, most).select("query_id", "id", "by", "place").collect())) == sorted(want)


@pytest.fixture(scope="module")
def alike(spark):
    """1,500 equal questions and 1,500 equal records, of 100 documents."""
    asked = spark.range(1500).select(F.col("id").alias("query_id"), F.lit("cold rod").alias("query"))
    held = spark.range(1500).select(F.format_string("r%05d", "id").alias("id"), (F.col("id") % 100).alias("doc_id"), (F.col("id") % 100).alias("chunk_id"), F.lit("cold rod").alias("subject"), F.lit("LARGE").alias("value"), F.lit("cold rod LARGE").alias("search_text"))
    return asked, held


def test_equal_questions_and_facts_are_compared_once(spark, alike):
    rows, written = shuffled(spark, lambda: K.entity_facts(*alike, 2))
    assert len(rows) == 3000 and {r[1] for r in rows} == {"r00000", "r00001"} and written < 1_000_000


def test_equal_questions_and_records_are_compared_once(spark, alike, monkeypatch):
    compared = []
    whole = scan.record_candidates
    monkeypatch.setattr(scan, "record_candidates", lambda terms, texts, *args: compared.append((terms.count(), texts.count())) or whole(terms, texts, *args))
    assert K.search_records(*alike, 3).count() == 4500 and set(compared) == {(1, 1)}
    asked, held = alike
    chosen = asked.select("query_id", (F.col("query_id") % 100).alias("chunk_id"))
    compared.clear()
    assert K.search_records_for_chunks(asked, chosen, held, 2).count() == 3000 and not compared


def test_tables_of_one_document_keep_their_own_headers_and_records(spark, tmp_path):
    """Brand#1-10 and Brand#11-0 both are document 110; their equal rows are records of each table."""
    parts = [(10_000, "old rod", "Brand#1"), (10_001, "ring", "Brand#1"), (1, "old rod", "Brand#11"), (2, "gear", "Brand#11")]
    spark.createDataFrame([(k, n, b, "LARGE", 1) for k, n, b in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    name = "A5_rebuild_knowledge_records"
    rebuilt = registry.queries()[name](spark, str(tmp_path))
    assert rebuilt.count() == 4
    assert_same(rebuilt, con, registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "Straße", "知识库", "alpha-beta", "𝒳y"]
    rows = [(i, i // 4, i % 4, " ".join(rng.choices(words, weights=[1] * 40 + [60, 40, 3, 2, 2, 2], k=rng.randrange(0, 60))), f"file-{i // 4}.md") for i in range(700)]
    rows += [(900, 300, 0, None, "file-300.md"), (901, 300, 1, "", None), (902, 300, 2, " the the \n of", None), (903, 301, 0, None, None)]
    return spark.createDataFrame(rows, "id long, doc_id long, chunk_index int, content string, filename string").repartition(5)


@pytest.mark.parametrize("texts, columns, held", [(500, 512, 1_000_000), (7, 2, 1_000_000), (50, 3, 1)])
@pytest.mark.parametrize("pool", [1, 6, 240])
def test_one_pass_finds_the_rows_of_the_joins(spark, chunks, monkeypatch, texts, columns, held, pool):
    """Batches and blocks of any size, and queries in several passes."""
    for name, x in (("TEXTS", texts), ("COLUMNS", columns), ("TABLE", 1 if held == 1 else scan.TABLE)):
        monkeypatch.setattr(scan, name, x)
    monkeypatch.setattr(R, "TASK_CANDIDATES", held)
    asked = ["the of", "w1 the", "STRASSE straße", "知识库", "absent the", "", None, "w3 w4 w5", "file md the of", "the the", "𝒳Y", "?"]
    queries = spark.createDataFrame([(i, asked[i % 12]) for i in range(90 if held == 1 else 12)], "query_id long, query string")
    terms = queries.select("query_id", F.col("query").alias("term")).union(queries.where("query_id % 2 = 0").select("query_id", F.lit("file-7")))
    words = scan.tokenized(chunks)
    same = lambda a, b: sorted(map(tuple, a.select("query_id", "id", "doc_id", "chunk_index", "score").collect())) == sorted(map(tuple, b.select("query_id", "id", "doc_id", "chunk_index", "score").collect()))
    assert same(scan.keyword_candidates(queries, words, pool), R.keyword_candidates(queries, chunks, pool))
    assert same(scan.trigram_candidates(terms, words, pool), R.trigram_candidates(terms, chunks, pool))


def test_searches_of_an_index_shuffle_no_postings(spark, chunks):
    queries = spark.createDataFrame([(1, "the of")], "query_id long, query string")
    terms = queries.select("query_id", F.col("query").alias("term"))

    def searched():
        index = I.build_text_index(chunks)
        return index.keyword_candidates(queries, 3).unionByName(index.trigram_candidates(terms, 3))

    rows, written = shuffled(spark, searched)
    assert len(rows) == 6 and written < 150_000
    index = I.build_text_index(chunks)
    assert sorted(map(tuple, I.keyword_candidates(queries, index, 9).collect())) == sorted(map(tuple, scan.keyword_candidates(queries, index.texts, 9).collect()))
    index.drop()


@pytest.mark.parametrize("most", [60_000, 0])
def test_documents_meet_superadmins_in_many_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(C, "BROADCAST_ROWS", most)
    docs = spark.range(40).groupBy(F.col("id").alias("doc_id")).agg(F.max(F.col("id") % 5).alias("created_by"), F.min(F.when(F.col("id") % 2 == 0, "draft").otherwise("ready")).alias("status"))
    users = spark.createDataFrame([(1, False), (2, None), (3, True), (4, True), (None, True)], "user_id long, is_superadmin boolean")
    made = C.document_actions(docs, users)
    want = [(u, d, True, True, True) for u in (3, 4, None) for d in range(40)]
    want += [(u, d, True, True, True) for u in (1, 2) for d in range(40) if d % 5 == u]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
    tasks = made.withColumn("task", F.spark_partition_id()).where("uid = 3").select("task").distinct().count()
    assert tasks >= 4 or most == 0


def test_runs_of_a_stream_keep_long_numbers_and_share_calls(spark, tmp_path):
    """Beside a null, a user beyond 2^53 was a float before."""
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    user = 2**53 + 1
    rows = [(1, 1, "chat.request", None, at(0), "{}"), (1, 2, "chat.request", user, at(1), "{}"), (2, 1, "chat.request", None, at(59), "{}")]
    spark.createDataFrame(rows, "trace_id long, seq long, event string, user_id long, created_at timestamp, payload string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    made = L.fold_runs(L.stream_of(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, "created_at"))
    assert "FlatMapGroupsInPandasWithState" in made._jdf.queryExecution().analyzed().toString()
    write = lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")
    made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["trace_id"], r["user_id"], r["status"]) for r in out.collect()) == [(1, user, "interrupted"), (1, user, "running"), (2, None, "running")]
