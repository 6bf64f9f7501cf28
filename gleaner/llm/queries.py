"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontamination import decontaminate
from gleaner.llm.jaccard import Similarity, similar_classes
from gleaner.llm.language import identify
from gleaner.llm.manifest import build_manifest, lower_cased_third
from gleaner.llm.mixing import mix_sources
from gleaner.llm.near_vectors import near_vector_classes
from gleaner.llm.neighbours import build_index, nearest
from gleaner.llm.pages import extract_main_text
from gleaner.llm.repeats import remove_repeats
from gleaner.llm.spelling import spelling_variants
from gleaner.llm.suffixes import remove_repeated_strings
from gleaner.llm.tokens import count_tokens
from gleaner.llm.urls import Rule, judge_urls
from gleaner.tables import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_main_text(table(spark, sf, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return identify(docs.select("doc_id", "text"), learn_from=docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), vocabulary())


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeated_strings(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"))


#: The URL rules.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    index = build_index(table(spark, sf, "embeddings"))
    return nearest(index, index.rows.where(F.col("vec_id") % 100 == 0))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return similar_classes(table(spark, sf, "documents"), Similarity(n=3, num=90, den=100)).drop("__th", "class")


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op11_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vector_classes(table(spark, sf, "embeddings"))


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return build_manifest(table(spark, sf, "documents"), lower_cased_third())


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_main_text, op2_mixing, op3_language_id, op4_token_counts, op5_suffix_dedup, op6_url_filter, op7_nearest_neighbours, op8_jaccard_join, op9_substring_dedup, op10_decontamination, op11_near_vectors, op12_manifest, op13_spelling_variants)}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '-')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT *, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target
  FROM (SELECT *, (SELECT level FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1) AS final FROM l)),
q AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS BIGINT)::DOUBLE / source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(round(target) AS BIGINT) AS goal
  FROM t),
c AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT c.doc_id, c.size, q.source_size, q.target,
       CAST(q.whole * c.size + greatest(0, least(c.size, q.goal - q.whole * q.source_size - c.start)) AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""

DECONTAMINATION_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT len(words) AS k FROM win),
spots AS (
  SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM spots JOIN win USING (words)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT k, min(doc_id) AS owner FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (k) WHERE owner < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 198)) AS i FROM d WHERE length(h) >= 400)),
rep AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM rep),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
gaps AS (
  SELECT s.doc_id, s.a, substr(h, CAST(2 * coalesce(lag(s.b) OVER w, 1) - 1 AS BIGINT), CAST(2 * (s.a - coalesce(lag(s.b) OVER w, 1)) AS BIGINT)) AS part
  FROM span s JOIN d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.a)),
per AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM span GROUP BY doc_id),
head AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS t FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE t || substr(h, CAST(2 * last - 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN head USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, md5(array_to_string(g, ' ')) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM h x JOIN h y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
    AND list_contains(list_transform(e, lambda x: x <> 0), true)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

#: One step of crc32 over a byte, and crc32 of bytes, as DuckDB expressions.
CRC_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, unsigned."""
    at = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {at}), lambda c, b: {CRC_STEP}))"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def manifest_sql(height: int = 9) -> str:
    """Trees of up to 8**height leaves and languages: one step of SQL for each level."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, leaves: str, levels: int) -> str:
        out = f"{name}0 AS (SELECT g, pos, n, h FROM {leaves})"
        for k in range(levels):
            out += f""",
{name}s{k} AS (SELECT g, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT g, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, pos // 8)"""
        return out

    def climb(name: str, alias: str, levels: int, source: str, target: str) -> str:
        out, at = "", source
        for k in range(levels):
            to = f"{target}{k}"
            out += f""",
{to} AS (SELECT x.* REPLACE (x.{alias} // 8 AS {alias}, CASE WHEN s.n > 1 THEN sha256(s.l || x.folded || s.r) ELSE x.folded END AS folded, x.proof || s.l || s.r AS proof)
  FROM {at} x JOIN {name}s{k} s ON s.g = x.{'g' if name == 't' else 'one'} AND s.pos = x.{alias})"""
            at = to
        return out

    top = 4
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf,
         CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(LOWER.format('text'))} ELSE {leaf('text')} END AS found
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d),
{tree('t', 'p', height)},
sub AS (SELECT g AS of, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, h FROM t{height}),
{tree('r', 'sub', top)},
start AS (SELECT p.doc_id, p.leaf, p.g, p.pos, p.found AS folded, '' AS proof, sub.h AS subroot, sub.pos AS top, '' AS one FROM p JOIN sub ON sub.of = p.g)
{climb('t', 'pos', height, 'start', 'c')}
{climb('r', 'top', top, f'c{height - 1}', 'e')}
SELECT doc_id, leaf, subroot, r{top}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r{top}.h AS verified FROM e{top - 1}, r{top}
"""


#: Letters beyond ASCII that a word may hold, and a byte that stands for each in the edit distance.
BEYOND = "".join(map(chr, range(0xC0, 0x100)))
BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}"

SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {LOWER.format('unnest(regexp_extract_all(text, ' + "'[A-Za-zÀ-ÿ]+'" + '))')} AS run FROM documents),
per AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {crc_sql('id')} AS h FROM per),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{BEYOND}', '{BYTES}') AS key FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM w a JOIN w b ON abs(length(a.key) - length(b.key)) <= 1 AND a.word <> b.word AND levenshtein(a.key, b.key) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS top, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN top END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
r(word, last) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.last WHERE f.form IS NOT NULL),
roots AS (SELECT r.word, r.last AS root FROM r JOIN f ON f.word = r.last WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_near_vectors": VECTORS_SQL, "op12_manifest": manifest_sql(), "op13_spelling_variants": SPELLING_SQL, "op5_suffix_dedup": SUFFIX_SQL, "op8_jaccard_join": JACCARD_SQL, "op9_substring_dedup": REPEATS_SQL, "op2_mixing": MIX_SQL, "op10_decontamination": DECONTAMINATION_SQL}
