"""Near vectors, manifest and spelling variants against plain Python, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import blocks, manifest, near_vectors, spelling
from gleaner.llm import queries as Q

VECTORS = "vec_id long, label int, embedding array<float>, node string, n_links string, part int, digest string"


def ordered(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# --- near vectors


def linked_by_hand(rows, least=0.98):
    fine = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) and label is not None and i is not None for i, label, e in rows]
    unit = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if ok else None for ok, (_, _, e) in zip(fine, rows)]
    near = [[] for _ in rows]
    for i, (_, label, e) in enumerate(rows):
        for j in range(i):
            if fine[i] and fine[j] and label == rows[j][1] and len(e) == len(rows[j][2]) and unit[i] @ unit[j] >= least:
                near[i].append(j)
                near[j].append(i)
    ids = collections.defaultdict(set)
    for i, (v, _, _) in enumerate(rows):
        if fine[i]:
            ids[v] |= {rows[j][0] for j in near[i]}
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {v}, [v] if fine[i] else []
        while todo:
            for w in ids[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        c = None if v is None else min(seen)
        out.append((v, len(near[i]), c, v is not None and v == c))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows, middle = [], rng.standard_normal((6, 24))
    for i in range(420):
        spread = [0.02, 0.1, 0.14, 2.0][i % 4]
        rows.append((1000 + i, int(i % 3), (middle[i % 6] + spread * rng.standard_normal(24)).tolist()))
    rows += [(i, 0, rows[0][2]) for i in (7, 5, 5, 2000)] + [(3, 0, [2 * x for x in rows[4][2]]), (4, 1, rows[0][2]), (5, 0, rows[9][2]), (6, None, rows[0][2]), (None, 0, rows[0][2])]
    rows += [(20, 0, None), (21, 0, []), (22, 0, [0.0] * 24), (23, 0, [float("nan")] * 24), (24, 0, [float("inf")] + [1.0] * 23), (25, 0, [None] + [1.0] * 23), (26, 0, [1.0, 2.0]), (27, 0, [2.0, 4.0]), (28, 0, [-0.0, 1.0]), (29, 0, [0.0, 1.0]), (30, 0, [1e-30, 0.0])]
    return rows


@pytest.mark.parametrize("plan", [near_vectors.LinkPlan(), near_vectors.LinkPlan(crowd=2, block=9, part_rows=50), near_vectors.LinkPlan(crowd=1 << 20, block=16)])
def test_near_vectors_like_all_pairs(spark, vectors, plan):
    table = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in vectors], VECTORS).repartition(5)
    assert ordered(near_vectors.near_vector_classes(table, plan)) == linked_by_hand(vectors)


def test_near_vectors_of_an_empty_table(spark):
    assert near_vectors.near_vector_classes(spark.createDataFrame([], VECTORS)).collect() == []


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    plan, half = near_vectors.LinkPlan(), 128
    x = rng.standard_normal((400, 24))
    x[200:] = x[:200] + 0.2 * rng.standard_normal((200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    errors = []
    for seed in range(40):
        packed, factors = near_vectors.encode(x, half, seed)
        bits = np.unpackbits(packed, axis=1, count=2 * half)
        a, b = near_vectors.decode(bits, factors, 24, half, seed)
        estimate = ((a[:200] * b[200:]).sum(1) + (b[:200] * a[200:]).sum(1)) / 2
        errors.append(estimate - (x[:200] * x[200:]).sum(1))
        reached = near_vectors.may_link((a, b), factors, half, plan)
        assert reached[x @ x.T >= plan.cosine].all()
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.005 and np.abs(errors.mean(axis=0)).max() < 5 * errors.std() / np.sqrt(40)


def test_links_at_the_threshold_share_a_bucket():
    plan, rng = near_vectors.LinkPlan(), np.random.default_rng(5)
    for n in (10_000, 10_000_000):
        bands = near_vectors.bands_for(n, plan)
        half = bands.half(32)
        x = rng.standard_normal((3000, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        other = rng.standard_normal((3000, 32))
        other -= (other * x).sum(1)[:, None] * x
        other /= np.linalg.norm(other, axis=1)[:, None]
        y = plan.cosine * x + np.sqrt(1 - plan.cosine**2) * other
        keys = [bands.keys(np.unpackbits(near_vectors.encode(v, half, plan.seed)[0], axis=1, count=2 * half), plan.seed) for v in (x, y)]
        assert (keys[0] == keys[1]).any(axis=1).all()
        far = bands.keys(np.unpackbits(near_vectors.encode(rng.permutation(x), half, plan.seed)[0], axis=1, count=2 * half), plan.seed)
        assert (keys[0] == far).mean() < 20 * 0.5**bands.width


def test_query_on_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert ordered(Q.op11_near_vectors(spark, sf)) == linked_by_hand(rows)


def test_crowded_groups_meet_in_blocks(spark):
    rows = spark.createDataFrame([(i % 2, i) for i in range(100)] + [(7, 1000)], "k int, id long")
    parts = blocks.in_parts(rows, ["k"], "id", 10, 40)
    met = collections.Counter()
    for key in parts.select("part").distinct().collect():
        table = parts.where(F.col("part") == key[0]).toArrow()
        for run in blocks.groups(table, ["k"]):
            ids, shard = np.asarray(table.column("id"))[run], np.asarray(table.column("shard"))[run]
            same = table.column("low")[int(run[0])] == table.column("high")[int(run[0])]
            met.update((min(a, b), max(a, b)) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and (same or shard[i] != shard[j]))
            assert len(run) <= 40
    assert met == collections.Counter({(a, b): 1 for a in range(100) for b in range(a + 2, 100, 2)})


# --- manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, pos long, kids string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def manifest_by_hand(rows):
    def leaf(fields):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            a = at // 8 * 8
            out.append(("".join(level[a:at]), "".join(level[at + 1 : a + 8])))
            at //= 8
        return out

    groups = collections.defaultdict(list)
    for d, source, lang, n, text in rows:
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        found = low if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else text
        groups[lang].append((d, leaf((d, source, lang, n, text)), leaf((d, source, lang, n, found))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = up([x[1] for x in groups[lang]])
    top = up([trees[lang][-1][0] for lang in order])
    out = []
    for i, lang in enumerate(order):
        for at, (d, own, found) in enumerate(groups[lang]):
            way = path(trees[lang], at) + path(top, i)
            h = found
            for left, right in way:
                h = sha(left + h + right)
            out.append((d, own, trees[lang][-1][0], top[-1][0], sha("".join(x + y for x, y in way)), h, h == top[-1][0]))
    return sorted(out, key=str)


def odd_documents():
    rng = random.Random(6)
    rows = [(i * rng.choice([1, 1, 70, 5_000_000]), rng.choice("ab"), rng.choice(["en", "en", "de", "É", "z", None]), i, rng.choice(["Text", "é", "low", ""]) * i) for i in range(500)]
    rows += [(-5, "a", "en", 1, "x"), (-64, "a", "en", 1, "X"), (9_000_000_000_000_000_000, "a", "en", 1, "X"), (None, None, None, None, None), (None, "a", "en", 2, "Q"), (None, "a", "en", 2, "R"), (None, "a", "en", 2, "R")]
    rows += [(77, "a", "en", 2, "Twice"), (77, "a", "en", 2, "Twice"), (77, "b", "en", 2, "TWICE"), (1, "a", "lone", 1, "A" * 300_000), (2, "a", "", 1, "-"), (3, "a", "=", 1, None)]
    return rows


def test_manifest_like_plain_python(spark):
    rows = odd_documents()
    table = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCS).repartition(5)
    assert ordered(manifest.build_manifest(table, manifest.lower_cased_third())) == manifest_by_hand(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_of_one_language(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert ordered(manifest.build_manifest(spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCS), manifest.lower_cased_third())) == manifest_by_hand(rows)


def test_manifest_of_nothing(spark):
    assert manifest.build_manifest(spark.createDataFrame([], DOCS), manifest.lower_cased_third()).collect() == []


def test_ranks_are_those_of_a_sort(spark):
    rows = [(("=a" if i % 3 else ""), i * 7919 % 100_003 - 50_000, sha(str(i))) for i in range(3000)]
    from gleaner.session import stored

    got = manifest.with_ranks(stored(spark.createDataFrame(rows, "g string, doc_id long, leaf string"))).collect()
    for g in ("", "=a"):
        own = sorted((r["doc_id"], r["pos"], r["n"]) for r in got if r["g"] == g)
        assert [p for _, p, _ in own] == list(range(len(own))) and {n for _, _, n in own} == {len(own)}


# --- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, ratio=5):
    counts = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: v if v and words[v] >= ratio * words[w] else None for w, v in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(12)
    base = ["grammar", "grammer", "gramar", "grammars", "straße", "strasse", "Éclair", "éclair", "eclair", "aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abcdef", "abcdefg", "xbcdefg", "naïveté", "naivete", "ÀÀÀÀÀÀ", "short", "mississippi", "missisippi"]
    base += ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(160)]
    weights = [1000 // (i + 1) + 3 for i in range(len(base))]
    rng.shuffle(weights)
    rows = [(i, " ".join(rng.choices(base, weights, k=60)) + rng.choice([" 1x2 ", "\n", "ß×÷ÿ!"])) for i in range(150)]
    rows += [(200, "chainaa " * 5 + "chainab " * 30 + "chainbb " * 160)]
    return rows + [(None, "grammar " * 12), (7, None), (8, ""), (9, " .. "), (10, "grammar" * 40_000), (10, "Grammar GRAMMAR grammaR " * 30), (10, "Grammar GRAMMAR grammaR " * 30)]


@pytest.mark.parametrize("plan", [spelling.SpellingPlan(), spelling.SpellingPlan(block=3, part_rows=20)])
def test_spelling_like_all_pairs(spark, plan):
    rows = odd_texts()
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, key string").repartition(5)
    got = ordered(spelling.spelling_variants(table, plan).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == variants_by_hand(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a form of a form


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_scan_finds_what_is_one_edit_away():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        shared = spelling.shared_prefixes(words)
        for query in [*words, "abcab", "aa"]:
            assert [words[i] for i in spelling.one_edit_away(query, words, shared)] == [w for w in words if one_edit(w, query)]
