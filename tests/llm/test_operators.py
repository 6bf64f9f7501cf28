"""Operators on small tables with odd rows, against plain Python or the library that they must agree with."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import jaccard, language, mixing, neighbours, packets, page_rounds, pages, repeats, suffixes, tokens, urls
from gleaner.llm import decontamination as dc
from gleaner.llm import queries as Q
from gleaner.session import stored
from tests.compare import assert_same, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents, copies with edits, and odd rows."""
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    base = own[7][1].split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "yy", str(i)])
        own.append((5000 + i, " ".join(w)))
    long = own[9][1] * 2
    for i in range(40):
        a = rng.randrange(len(long) - 300)
        own.append((6000 + i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + " " + long[a : a + rng.randrange(150, 700)] + str(i)))
    own += [(None, own[3][1]), (None, "unique text of a row without id"), (7, None), (8001, ""), (8002, "A b"), (8003, "a B"), (8003, "a b"), (8004, " \n\t "), (8005, "é" * 300), (8006, "q" + "é" * 150), (8007, "ab" * 400), (8008, "x " * 120), (8009, "y" * 100_000)]
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(d, t, 1, "x", "y", "U") for d, t in rows]
    return spark.createDataFrame(clash, DOC + ", size int, batch string, node string, __batch string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def ordered(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("batch", [20_000, 4_000_000])
def test_suffix_dedup(docs, none, rows, monkeypatch, batch):
    monkeypatch.setattr(suffixes, "layout", lambda d, u: packets.layout(d, u, batch))
    digest = lambda df: suffixes.remove_repeated_strings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256))
    assert ordered(digest(docs)) == brute.repeated_bytes(rows)
    assert digest(none).count() == 0


def test_suffix_dedup_of_texts_with_fewer_characters_than_bytes(spark):
    rows = [(1, "ж" * 100), (2, "".join(chr(0x430 + i % 32) for i in range(100))), (3, "".join(chr(0x4E00 + i) for i in range(100))), (4, "".join(chr(0x4E00 + i) for i in range(70))), (5, "\U0001f600" * 50), (6, "short")]
    few = spark.createDataFrame(rows, DOC)
    assert suffixes.sampled_splitters(few, 4, len(rows)).upto[-1] == 3
    digest = suffixes.remove_repeated_strings(few).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256))
    assert ordered(digest) == brute.repeated_bytes(rows)


def test_suffix_dedup_with_hot_grams(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BATCHES", 2)
    monkeypatch.setattr(suffixes, "layout", lambda d, u: packets.layout(d, u, 20_000))
    got = suffixes.remove_repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256))
    assert ordered(got) == brute.repeated_bytes(rows)


def test_splitters_are_the_even_ranks_of_the_sample():
    rng = np.random.default_rng(4)
    for n, buckets in ((0, 5), (1, 4), (50, 7), (200, 64), (30, 400)):
        sample = np.sort(rng.integers(0, 25, n).astype(np.uint64))
        plain = sample[(np.arange(1, buckets) * n) // buckets] if n else sample
        low, high = suffixes.Splitters.of(sample, buckets).ranges(np.arange(27, dtype=np.uint64))
        assert low.tolist() == np.searchsorted(plain, np.arange(27), side="left").tolist() and high.tolist() == np.searchsorted(plain, np.arange(27), side="right").tolist()


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_multikey_quicksort(monkeypatch, part):
    monkeypatch.setattr(suffixes, "SMALL_PART", part)
    rng = np.random.default_rng(part)
    a, b = rng.integers(0, 9, 3000).astype(np.uint64), rng.integers(0, 2**60, 3000).astype(np.uint64) % np.uint64(50)
    order = suffixes.multikey_quicksort(a, b)
    assert sorted(order.tolist()) == list(range(3000)) and [(a[i], b[i]) for i in order] == sorted(zip(a, b))


@pytest.mark.parametrize("batch", [20_000, 4_000_000])
def test_substring_dedup(docs, none, rows, monkeypatch, batch):
    monkeypatch.setattr(repeats, "layout", lambda d, u: packets.layout(d, u, batch))
    digest = lambda df: repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256))
    assert ordered(digest(docs)) == brute.earlier_windows(rows)
    assert digest(none).count() == 0
    assert {r[0] for r in repeats.remove_repeats(docs).select("__batch").distinct().collect()} == {"U"}


@pytest.mark.parametrize("crowd", [4, 48])
def test_jaccard_join(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    got = jaccard.similar_classes(docs, jaccard.Similarity(3, 90, 100)).drop("__th", "class")
    assert ordered(got) == brute.near_classes(rows)


def test_jaccard_keeps_one_of_each_class(spark, none):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text), (2, text + " end"), (2, text + " end"), (9, None), (9, ""), (None, "alone in the world today"), (None, "another one of these rows"), (5, "Short")]
    got = jaccard.one_of_each_class(spark.createDataFrame(rows, DOC))
    assert ordered(got) == sorted([(2, text + " end"), (9, None), (9, ""), (None, "alone in the world today"), (None, "another one of these rows"), (5, "Short")], key=str)
    assert jaccard.one_of_each_class(none).count() == 0
    clash = spark.createDataFrame([(*r, "c", "t") for r in rows], DOC + ", __copies string, __th string")
    assert ordered(jaccard.one_of_each_class(clash)) == sorted([(*r, "c", "t") for r in ordered(jaccard.one_of_each_class(spark.createDataFrame(rows, DOC)))], key=str)


def test_decontamination(spark, docs, none, rows, monkeypatch):
    items = [(i, rows[i][1][:120] if i % 2 else rows[i][1][40:90]) for i in range(12)] + [(50, "a B"), (51, None), (51, ""), (None, "y" * 100_000), (3, rows[3][1][:120])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated(rows, items)
    assert ordered(dc.decontaminate(docs, bench)) == want
    few = docs.where("doc_id < 30 or doc_id > 8000")
    kept = {r["doc_id"] for r in dc.without_contaminated(few, bench).collect()}
    assert kept == {r[0] for r in want if not r[5] and r[0] is not None and (r[0] < 30 or r[0] > 8000)}
    assert not dc.decontaminate(few, bench.limit(0)).where("contaminated").count() and dc.decontaminate(none, bench).count() == 0
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    again = [r for r in rows if r[0] is not None and r[0] < 30]
    assert ordered(dc.decontaminate(docs.where("doc_id < 30").unionAll(docs.where("doc_id < 30")), bench)) == brute.contaminated(again * 2, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "five x three y one z two four"), (3, "one two")], DOC)
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    postings = dc.build_postings(docs)
    ranked = dc.from_the_rarest(postings, dc.test_windows(items, 5))
    keys = {r["doc"]: r["doc_id"] for r in docs.select("doc_id", dc.doc_key().alias("doc")).collect()}
    of = lambda found: {keys[r["doc"]] for r in found.collect()}
    assert of(dc.proximity_matches(postings, ranked, 8)) == {1, 2}
    assert of(dc.proximity_matches(postings, ranked, 4)) == {1}
    assert of(dc.phrase_matches(postings, ranked)) == {1}


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))) for i in range(12)]
    docs, bench = spark.createDataFrame(texts, DOC), spark.createDataFrame(items, "item_id long, text string")
    postings, windows = dc.build_postings(docs), dc.test_windows(bench, 4)
    words = {r["window_id"]: r["words"] for r in windows.phrases.collect()}
    spelled = {r["term"]: r["word"] for r in spark.createDataFrame([(c,) for c in "abcdefg"], "word string").select("word", dc.term_of(F.col("word")).alias("term")).collect()}
    keys = {r["doc"]: r["doc_id"] for r in docs.select("doc_id", dc.doc_key().alias("doc")).collect()}
    ranked = dc.from_the_rarest(postings, windows)
    rare = {r["window_id"]: spelled[r["rare"][0]["term"]] for r in ranked.collect()}
    got = {(keys[r["doc"]], r["pos"], r["window_id"]) for r in dc.proximity_matches(postings, ranked, 3).collect()}
    want = {(d, i, w) for d, t in texts for ws in [t.split()] for i, x in enumerate(ws) for w in rare if rare[w] == x and set(words[w]) <= set(ws[max(0, i - 3) : i + 4])}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_token_counts_agree_with_the_library(text):
    from tokenizers import Tokenizer

    global LIBRARY
    LIBRARY = globals().get("LIBRARY") or Tokenizer.from_file(Q.vocabulary())
    assert tokens.merger(Q.vocabulary()).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(spark, docs, none, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.vocabulary())
    odd = ["<|endoftext|> a<|startoftext|>", "it's 'S", "ΑΣ ΣΣ İ", "a\x1cb\x85c", None]
    all_rows = rows + [(9000 + i, t) for i, t in enumerate(odd)]
    got = tokens.count_tokens(spark.createDataFrame(all_rows, DOC), Q.vocabulary())
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in all_rows]
    assert ordered(got) == sorted(want, key=str)
    assert tokens.count_tokens(none, Q.vocabulary()).count() == 0


def test_unknown_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not known here"):
        tokens.PairMerger(public_tokenizers.path("byte_bpe_50k.json"))


def test_mixing_against_water_filling_step_by_step(spark):
    """Level by level, as the operator's name says, and word by word in the order of the digest."""
    rng = random.Random(2)
    for sources in (["a"], ["a", "b", "c", "d", None], [f"s{i}" for i in range(9)]):
        rows = [(i, rng.choice(sources), " ".join("w" * rng.choice([0, 1, 5, 400]))) for i in range(120)] + [(121, sources[0], None), (122, sources[0], "w " * 300_000)]
        internal = ["__digest", "__slice", "__whole", "__quota", "__ahead"]
        clash = spark.createDataFrame([(*r, "x", 3, *internal) for r in rows], "doc_id long, source string, text string, taken string, weight int, " + ", ".join(f"{c} string" for c in internal))
        got = {r["doc_id"]: r for r in mixing.mix_sources(clash).collect()}
        sizes = {}
        for d, s, t in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
        while free:
            unit = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
            if not over:
                target |= {s: weight[s] * unit for s in free}
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            left -= sum(target[s] for s in over)
            free -= over
        for s in sizes:
            own = [got[d] for d, x, _ in rows if x == s]
            assert abs(own[0]["target"] - target[s]) < 1e-6 * max(1, target[s]) and abs(sum(r["taken"] for r in own) - target[s]) <= 1
            assert all(r["size"] == len((r["text"] or "").split()) and (r["taken"] // max(1, r["size"])) <= 2 and r["weight"] == 3 and all(r[c] == c for c in internal) for r in own)


def test_mixing_meets_targets(spark, none):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None, "ü"]), " ".join("w" * rng.randrange(1, 40))) for i in range(600)] + [(600, "d", None), (600, "d", None), (None, "d", "x y")]
    mixed = stored(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    got = mixed.groupBy("source").agg(F.sum("taken"), F.max("target"), F.max("source_size"), F.sum("size")).collect()
    assert all(abs(r[1] - r[2]) <= 1 and r[2] <= 2 * r[3] + 1e-9 and r[3] == r[4] for r in got)
    assert abs(sum(r[2] for r in got) - 1.5 * sum(r[3] for r in got)) < 1e-6
    assert mixed.where("taken > 2 * size").count() == 0
    assert mixing.mix_sources(none).count() == 0
    levels = sorted((r[0] is None, r[0] or "", r[2], r[3]) for r in got)
    free = [t / w for (_, _, t, s), w in zip(levels, [5, 2, 1] * 2) if t < 2 * s - 1e-6]
    assert max(free) - min(free) < 1e-6


@pytest.mark.parametrize("name", ["op2_mixing", "op5_suffix_dedup", "op8_jaccard_join", "op9_substring_dedup", "op10_decontamination"])
def test_same_rows_as_duckdb(spark, name):
    assert_same(Q.queries()[name](spark, SF), connect(SF), Q.oracle_sql()[name])


def test_language_on_held_out_documents(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.select("doc_id", "text"), learn_from=docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "The other thing is that of the")], DOC)
    answers = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, learn_from=docs).collect()}
    assert answers[1] == answers[2] == answers[3] == "und" and answers[None] == "en"
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, learn_from=none).collect()} == {"und"}


def test_texts_without_a_letter_have_no_language(spark):
    taught = spark.createDataFrame([(i, " ".join([w] * (i % 3 + 2)), lang) for lang, w in (("en", "the river"), ("de", "der flüsse")) for i in range(1, 30)], DOC + ", lang string")
    odd = ["… — ！", "１２３ ٣٤", "😀😀", "12 3", "", None, " \n", "\u0301"]
    rows = [(i, t, "x", True) for i, t in enumerate(odd)] + [(100, "ß", "y", False), (101, "the " * 200_000 + "😀", "z", None)]
    clash = spark.createDataFrame(rows, DOC + ", lang_pred string, lettered boolean")
    got = {r["doc_id"]: r for r in language.identify(clash, learn_from=taught).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(len(odd)))
    assert got[100]["lang_pred"] in ("de", "en") and got[101]["lang_pred"] == "en" and got[101]["lettered"] is None


def test_a_language_of_one_repeated_text_is_learned(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the of and river over under stone light".split()) for _ in range(40)), "en") for i in range(300)]
    rows += [(1000 + i, "der große Fluss fließt unter den alten Brücken hindurch zum Meer " * 3, "de") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    got = language.identify(docs, language.FitLimits(documents=20)).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]): r["count"] for r in got} == {("en", "en"): 300, ("de", "de"): 2000}


def test_chain_expectations_are_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    e, t, o = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    word, pair, total = language.chain_expectations(e, t, o)
    paths = list(itertools.product(range(3), repeat=4))
    for n in range(2):
        score = np.array([o[p[0]] + sum(e[n, i, p[i]] for i in range(4)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(np.log(np.exp(score).sum()), total[n])
        share = np.exp(score - total[n])
        assert np.allclose(word[n, 0], [share[[p[0] == k for p in paths]].sum() for k in range(3)])
    step = 1e-5
    for i, j in itertools.product(range(3), repeat=2):
        d = np.zeros((3, 3))
        d[i, j] = step
        ahead, behind = (language.chain_expectations(e, t + s * d, o)[2].sum() for s in (1, -1))
        assert np.isclose((ahead - behind) / (2 * step), pair[i, j], atol=1e-6)
    ahead, behind = (language.chain_expectations(e, t, o + s * np.array([step, 0, 0]))[2].sum() for s in (1, -1))
    assert np.isclose((ahead - behind) / (2 * step), word[:, 0, 0].sum(), atol=1e-6)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    emission = rng.normal(size=(700, 3)).astype(np.float32)
    first = np.array([0, 1, 5, 300])
    got = language.marginals(model, emission, first)
    edges = [*first, 700]
    for a, b in zip(edges, edges[1:]):
        e, t = np.exp(emission[a:b].astype(float)), np.exp(model.transitions)
        f, back = [np.exp(model.opening) * e[0]], [np.ones(3)]
        for i in range(1, b - a):
            f.append((f[-1] / f[-1].sum()) @ t * e[i])
        for i in range(b - a - 1, 0, -1):
            x = t @ (e[i] * back[-1])
            back.append(x / x.sum())
        p = np.array(f) * np.array(back[::-1])
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True), atol=1e-5)


@pytest.mark.parametrize("clusters", [1, 12])
def test_neighbours(spark, clusters):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(900, 16)) + 40 * rng.normal(size=(clusters, 16))[rng.integers(clusters, size=900)]).astype(np.float32)
    x[50] = x[51]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] * 8), (5400, []), (0, x[0].tolist()), (5500, [1.0, 2.0]), (5600, [2.0, 2.0])]
    clash = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cell int, code string")
    index = neighbours.build_index(clash, neighbours.SearchPlan(group=60, query_block=4))
    queries = index.rows.where("vec_id % 100 = 0")
    found = {}
    for r in neighbours.nearest(index, queries).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {*range(0, 900, 100), 5500, 5600} and found[5500] == {1: (5600, 1.0)}
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        hits += len({v for v, _ in found[q].values()} & set(best.tolist()))
        assert all(abs(s - d[v]) < 1e-9 for v, s in found[q].values()) and [found[q][k][1] for k in sorted(found[q])] == sorted(s for _, s in found[q].values())
    assert hits >= 0.9 * 90
    members = {(r["dim"], r["cell"]): (r["n"], r["far"]) for r in index.rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("length").alias("far")).collect()}
    cells = neighbours.reachable_cells(queries.where("dim = 16"), index, members).count()
    assert clusters == 1 or cells <= 9 * 6  # of some 15 cells each
    none = neighbours.build_index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.nearest(none, none.rows).count() == 0


def test_url_rules(spark):
    table = [("https://a.NET/x", "a.net", "/x", "net/", "block"), ("http://example.net/en/1?q", "example.net", "/en/1", "example.net/en/", "allow"), ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), ("x://b.org/fr/#z", "b.org", "/fr/", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://net?x=/", "net", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("://", "", "", None, None)]
    rows = [(i, t[0]) for i, t in enumerate(table)] + [(1, table[1][0])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), Q.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = table[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), Q.URL_RULES).count() == 0


def test_url_rules_against_plain_python(spark):
    rng = random.Random(6)
    hosts = ["net", "a.net", "example.net", "x.Example.NET", "example.com", "w.example.com", "org", "b.org", "other.io", ""]
    urls_ = [f"{rng.choice(['http', 'x', ''])}{rng.choice(['://', ':/'])}{rng.choice(hosts)}{rng.choice(['/', '/en/', '/de/a', '/fr/?q=1', '?a=/en/', '#/fr/', '', '/EN/'])}" for _ in range(300)] + ["http://net/" + "a" * 200_000]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame([(i, u, 1, "x", "y") for i, u in enumerate(urls_)], "page_id long, url string, suffix int, guess string, verdict string"), Q.URL_RULES).collect()}
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fits = [r for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.name)
        assert best is None or got[i]["verdict"] == best.verdict
        assert got[i]["verdict"] in ("allow", "block") and got[i]["suffix"] == 1 and got[i]["guess"] == "x"
    same = {}
    assert all(same.setdefault(u, got[i]["verdict"]) == got[i]["verdict"] for i, u in enumerate(urls_))


def test_trees_learn_the_look_of_urls(spark):
    rows = [(i, f"http://good.net/{i}" if i % 2 else f"http://s{i}{i}-win.bad/{i}?a=1&b=2&c={i}") for i in range(400)] + [(1000 + i, f"http://t{i}{i}-bet.other/{i}?x=1&y=2&z={i}") for i in range(20)]
    rules = [urls.Rule("allow", "good.net", "/"), urls.Rule("block", "bad", "/")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("page_id >= 1000").groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got}.get("block", 0) >= 15


PAGE = "<html><head><title>T</title><script>var a='</p>'</script></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head</h1><p>One &amp; <b>two</b>\n three<p>Four&nbsp;five<br>six<div class=ad>Buy</div><form>Your mail <input></form></article><section id=comments><p>First!</section><aside>More</aside><footer>&copy; me</footer></body></html>"


SHELL = "<html><body><div>Welcome to our big site where we sell many things for you</div><p>{}</p><div><a href=x>Home</a> <a>About</a></div><p>Copyright by the owners of this site all rights reserved</p></body></html>"
HTML = "page_id long, url string, html string"


def mains(source):
    return [b.text for b in pages.blocks_of(source) if b.mark == pages.MAIN]


def test_main_text(spark):
    assert mains(PAGE) == ["Head", "One & two three", "Four five six"]
    unique = [f"unique {' '.join(str(i * 100 + k) for k in range(30))}" for i in range(20)]
    rows = [(i, f"http://h.org/{i}", SHELL.format(u)) for i, u in enumerate(unique)] + [(90, None, None), (91, "http://h.org/x", ""), (92, "http://h.org/y", PAGE), (92, "http://h.org/y", PAGE), (93, "u", "plain < text & more")]
    for size in (4_000_000, 2_500):
        clash = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], HTML + ", host string, shard int, text string, blocks int")
        got = {r["page_id"]: r for r in pages.extract_main_text(clash, pages.PagePlan(shard_bytes=size, far_sample=1)).collect()}
        texts = {k: r["text"] for k, r in got.items()}
        assert [texts[i] for i in range(20)] == unique and texts[90] == texts[91] == "" and texts[92] == "Head\nOne & two three\nFour five six"
        assert texts[93].startswith("plain") and all(got[i]["n_repeated"] >= 20 and (got[i]["host"], got[i]["shard"], got[i]["blocks"]) == ("x", 1, 2) for i in range(20))
    assert pages.extract_main_text(spark.createDataFrame([], HTML)).count() == 0


def test_repeats_of_a_host_decide_what_markup_leaves_open(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    share = "<p class=end>Send this text to a friend of yours or print it out now</p>"
    plain = [(i, f"http://a.org/{i}", f"<article><h1>Title {i}</h1><p>{body(i)}</p>{share}</article>") for i in range(12)]
    copies = [(100 + i, f"http://b.org/{i}", f"<article><h1>One and the same</h1><p>{body(7)}</p><p>{body(8)} end {i}</p></article>") for i in range(8)]
    teaser = [(200, "http://c.org/1", f"<article><p>Read more</p></article><div><p>{body(1)}</p><p>{body(2)}</p></div>")]
    bare = [(300 + i, f"http://d.org/{i}", f"<div>{body(9)} {i % 2}</div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(spark.createDataFrame(plain + copies + teaser + bare, HTML)).collect()}
    assert all(got[i] == f"Title {i}\n{body(i)}" for i in range(12))
    assert all(got[100 + i] == f"One and the same\n{body(7)}\n{body(8)} end {i}" for i in range(8))
    assert got[200] == f"Read more\n{body(1)}\n{body(2)}" and all(got[300 + i] == f"{body(9)} {i % 2}" for i in range(3))


def test_main_text_does_not_depend_on_shards(spark):
    rng = random.Random(11)
    fresh = lambda i, n: " ".join(f"u{i}x{k}" for k in range(n))
    line = "this very line of twelve words stands on all of these pages"
    few = ["a line of ten words that few pages hold here " + str(j) for j in range(20)]  # on two pages each: seldom in one shard
    page = lambda i: f"<article><p>{fresh(i, 40)}</p><p class=end>{line}</p></article><div class=x>{few[i % 20]}</div>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i}", f"<div>{fresh(900 + i, 25)} {few[i % 20]}</div><p class=k>{' '.join(rng.choice('abc') for _ in range(12))}</p>") for i in range(40)]
    rows += [(200, "http://a.org/0", page(0)), (201, "http://b.org/e", ""), (202, None, None)]
    found = {}
    for size in (4_000_000, 3_000, 400):
        made = pages.extract_main_text(spark.createDataFrame(rows, HTML).repartition(3), pages.PagePlan(shard_bytes=size))
        found[size] = sorted((r["page_id"], r["text"], r["n_repeated"]) for r in made.collect())
    assert found[4_000_000] == found[3_000] == found[400] and len(found[400]) == len(rows)
    got = {p: (t, n) for p, t, n in found[400]}
    assert all(got[i][0] == fresh(i, 40) and got[i][1] == 12 + len(few[i % 20].split()) for i in range(40))
    assert all(got[100 + i][0].startswith(fresh(900 + i, 25)) and few[i % 20] not in got[100 + i][0] for i in range(40))


def test_slot_counts_do_not_depend_on_shards(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet").withColumn("url", F.concat(F.lit("http://one.org/"), "page_id"))
    found = []
    for size in (1_000_000_000, 60_000):
        found.append(sorted((r["page_id"], r["text"], r["n_repeated"]) for r in pages.extract_main_text(given, pages.PagePlan(shard_bytes=size)).collect()))
    assert found[0] == found[1] and any(r[2] for r in found[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=50, unique=True))
def test_packed_numbers(values):
    want = np.array(sorted(values), np.uint64)
    assert page_rounds.unpack_sorted(page_rounds.pack_sorted(want)).tolist() == want.tolist()
    assert page_rounds.unpack_numbers(page_rounds.pack_numbers(want)).tolist() == want.tolist()


def test_pictures_and_side_classes_lose_no_text(spark):
    assert mains("<article><p>x <svg class='i'/> mid</p><p>After</p><p>in <svg><title>no</title></svg> line</p><p class=side>Side</p></article>") == ["x mid", "After", "in line", "Side"]
    long = "<article>" + "".join(f"<p>{'word%d ' % i * 200}</p>" for i in range(1500)) + "</article>"
    got = pages.extract_main_text(spark.createDataFrame([(1, "http://h.org/", long)], HTML)).first()
    assert got["text"].count("\n") == 1499 and len(got["text"].split()) == 300_000


def test_comments_marked_as_articles_go():
    source = "<article class='post'><p>Text</p><article class='comment'><p>First!</p></article><article itemprop=comment><p>Second</p></article><article class='card'><p>Part</p></article><p>End</p></article>"
    assert mains(source) == ["Text", "Part", "End"]
    assert mains("<main class='sidebar-left'><article class='post social'><p>Text</p></article></main>") == ["Text"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abdivp =\"'!-&;", max_size=120))
def test_any_html_is_read(source):
    assert all(b.text == " ".join(b.text.split()) and b.text for b in pages.blocks_of(source))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 9))
def test_suffix_order(codes, depth):
    order, rank = pages.suffix_order(np.array(codes, dtype=np.uint64), depth)
    assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i : i + depth])
    assert all((rank[i] == rank[j]) == (codes[i : i + depth] == codes[j : j + depth]) for i in range(len(codes)) for j in range(len(codes)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), max_size=4), min_size=1, max_size=5), st.integers(1, 4))
def test_covered_words_against_brute_force(own, n):
    stream = pages.Stream(np.arange(len(own)), [[" ".join(b) for b in p] for p in own])
    words = [[w for b in p for w in b] for p in own]
    want = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if any(w[k : k + n] == v[m : m + n] for j, v in enumerate(words) if j != i for m in range(len(v) - n + 1)):
                gone[k : k + n] = [True] * n
        want += gone
    assert stream.covered(n, np.zeros(0, np.uint64)).tolist() == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = docs.orderBy("doc_id").first()
    extra = [(90_000, item["text"] + " and a new end of it", "en", "src0", 1), (90_001, None, None, None, None), (90_002, "123 456", "en", None, 7), (None, item["text"], "en", "src1", 2), (90_003, item["text"], None, "src1", 2), (90_003, item["text"], None, "src1", 2)]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("size", F.lit("clash")).withColumn("score", F.lit(1))
    rows = all_docs.collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in C.STAGES:
        before = all_docs
        all_docs = stored(stage(spark, before, SF), name)
        if name != "mix":
            assert all_docs.columns == before.columns
        now = all_docs.collect()
        if name == "language":
            assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in now} >= {90_001, 90_002}
        if name == "near_duplicates":
            pairs = [(r["doc_id"], r["text"]) for r in rows]
            classes = {}
            for (d, _, c), in zip(brute.near_classes(pairs, 5, 80, 100)):
                classes.setdefault(c, set()).add(d)
            assert sorted(r["doc_id"] for r in now) == sorted(classes)
        if name == "substrings":
            want = {d: n for d, _, n, _ in brute.earlier_windows([(r["doc_id"], r["text"]) for r in rows])}
            cut = {r["doc_id"]: r["text"] for r in now}
            assert all((cut[r["doc_id"]] == r["text"]) == (want[r["doc_id"]] == 0) for r in rows if r["doc_id"] in cut)
        if name == "decontaminate":
            hit = {r[0] for r in brute.contaminated([(r["doc_id"], r["text"]) for r in rows], bench) if r[5]}
            assert sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in rows if r["doc_id"] not in hit)
        rows = now
    assert all(0 < r["taken"] <= 2 * r["size"] for r in rows)
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        empty = stored(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_label_texts_gives_a_row_for_each_text():
    names, scores = language.label_texts(language.Model([], np.zeros((1 << language.FEATURE_BITS, 1)), np.zeros((0, 0)), np.zeros(0)), pa.array(["a", None, ""]))
    assert names == ["und"] * 3 and scores.tolist() == [0, 0, 0]
