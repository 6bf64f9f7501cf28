"""Scopes, conflicts, coverage and order of evidence rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as X

STATUS_RANK = {"exact": 3, "compatible": 2, "neutral": 1}
ROLE_RANK = {"direct": 3, "related": 2, "irrelevant": 1}
CONSTRAINT_RANK = {"exact": 5, "compatible": 4, "neutral": 3, "unknown": 2, "mismatch": 1}
SECTION_RANK = {"table": 4, "specific": 3}


def ranked(column: str, ranks: dict[str, int], other: int = 0):
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def scope_match_join(cands: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each candidate with the best of its query's scopes that it fits; without any it is rejected."""
    pairs = cands.join(scopes, "query_id")
    status = X.scope_status(F.col("target_product"), F.col("target_version"), F.col("product"), F.col("versions"), F.col("compatible"), F.col("unsupported"))
    pairs = pairs.withColumn("constraint_status", status).withColumn("fit", ranked("constraint_status", STATUS_RANK))
    w = Window.partitionBy("query_id", "id").orderBy(F.col("fit").desc(), "scope_id")
    best = pairs.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("query_id", "id", F.when(F.col("fit") > 0, F.col("scope_id")).alias("scope_id"), "constraint_status", (F.col("fit") > 0).alias("accepted"))


def document_identity(chunks: DataFrame, grain: list[str]) -> DataFrame:
    """Products and versions of a document or section; a version that leads a longer one of the same chunk is absorbed."""
    own = F.filter("versions", lambda v: ~F.exists("versions", lambda o: o.startswith(F.concat(v, F.lit(".")))))
    rows = chunks.withColumn("own", own)
    return rows.groupBy(*grain).agg(
        F.array_join(F.array_sort(F.collect_set("product")), ",").alias("products"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))), ",").alias("versions")
    )


def inherit_identity(chunks: DataFrame) -> DataFrame:
    """A missing product is inherited where the section, else the document, names exactly one."""
    section, doc = Window.partitionBy("doc_id", "section_key"), Window.partitionBy("doc_id")
    rows = chunks.withColumn("s", F.collect_set("product").over(section)).withColumn("d", F.collect_set("product").over(doc))
    given = F.col("product").isNotNull()
    found = F.when(F.size("s") == 1, F.col("s")[0]).when((F.size("s") == 0) & (F.size("d") == 1), F.col("d")[0])
    unclear = ~given & ((F.size("s") > 1) | ((F.size("s") == 0) & (F.size("d") > 1)))
    return rows.select("id", "doc_id", "section_key", F.coalesce("product", found).alias("product"), unclear.alias("ambiguous"))


def version_choices(docs: DataFrame) -> DataFrame:
    """(product, version) with its documents, where there is a choice, in natural order."""
    rows = docs.groupBy("product", "version").agg(F.count_distinct("doc_id").alias("documents"))
    own = Window.partitionBy("product")
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("total", F.sum("documents").over(own)).where("n >= 2 and total >= 2")
    order = Window.partitionBy("product").orderBy(X.version_key(F.col("version")))
    return rows.withColumn("place", F.row_number().over(order)).select("product", "version", "documents", "place", (F.col("n") > 8).alias("too_many"))


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Subjects of a document and scope with more than one value."""
    rows = facts.groupBy("doc_id", "scope", "subject").agg(F.array_sort(F.collect_set(F.lower(F.trim("value")))).alias("v"))
    return rows.select("doc_id", "scope", "subject", F.size("v").alias("n_values"), (F.size("v") > 1).alias("conflict"))


def fact_scope_ambiguity(facts: DataFrame) -> DataFrame:
    """Pairs of scopes of a subject whose value sets have nothing in common."""
    by_scope = facts.groupBy("subject", "scope").agg(F.collect_set("value").alias("v"))
    other = by_scope.select("subject", F.col("scope").alias("other"), F.col("v").alias("w"))
    return by_scope.join(other, "subject").where((F.col("scope") < F.col("other")) & ~F.arrays_overlap("v", "w")).select("subject", "scope", "other")


def claim_conflicts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("requirement_id", "kind", "claim_key").agg(F.count_distinct(F.lower("result")).alias("n")).where("n >= 2")


def evidence_set_coverage(members: DataFrame, required: DataFrame) -> DataFrame:
    """Which required items the members of each set support, and how well the set answers."""
    own = members.groupBy("query_id", "set_id").agg(F.collect_set(F.when(F.col("eligible"), F.col("requirement_id"))).alias("got"), F.max(F.when(F.col("eligible"), F.col("support"))).alias("support"), F.count("*").alias("size"))
    need = required.groupBy("query_id").agg(F.collect_set("requirement_id").alias("need"))
    rows = own.join(need, "query_id").withColumn("missing", F.size(F.array_except("need", "got"))).withColumn("covered", F.size(F.array_intersect("need", "got")))
    support = F.coalesce("support", F.lit(0.0))
    status = F.when((F.col("missing") == 0) & (support >= 0.7), "complete").when((F.col("covered") > 0) & (support >= 0.3), "partial").otherwise("insufficient")
    return rows.select("query_id", "set_id", "size", "covered", "missing", support.alias("support"), status.alias("status"))


def best_evidence_set(coverage: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(ranked("status", {"complete": 3, "partial": 2}, 1).desc(), F.col("covered").desc(), F.col("support").desc(), "size", "set_id")
    return coverage.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rerank_order(rows: DataFrame) -> DataFrame:
    order = [ranked("role", ROLE_RANK).desc(), ranked("constraint_status", CONSTRAINT_RANK).desc(), F.col("support").desc(), F.col("topic").desc(), F.col("score").desc(), F.col("doc_id"), F.col("chunk_index"), F.col("id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def context_order(rows: DataFrame) -> DataFrame:
    """Documents by first appearance, then by place in the document."""
    first = F.min("pos").over(Window.partitionBy("query_id", "doc_id"))
    return rows.withColumn("first", first).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "chunk_index", "id"))).drop("first")


def context_priority(rows: DataFrame) -> DataFrame:
    order = [F.col("is_seed").desc(), ranked("kind", SECTION_RANK, 2).desc(), ranked("role", ROLE_RANK).desc(), F.col("score").desc(), F.col("pos")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def group_visibility(items: DataFrame, visible: DataFrame) -> DataFrame:
    """A unit is closed where all its items are visible; else the missing ones."""
    seen = items.join(visible.select("id", F.lit(True).alias("seen")), "id", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("id"))))
    return seen.groupBy("unit").agg(missing.alias("m")).select("unit", (F.size("m") == 0).alias("closed"), F.array_join("m", ",").alias("missing"))


def anchor_coverage(choices: DataFrame, hits: DataFrame) -> DataFrame:
    """Every chosen scope needs a hit in one of its documents."""
    joined = choices.join(hits.select("doc_id", F.col("id").alias("hit")), "doc_id", "left")
    return joined.groupBy("choice").agg((F.count("hit") > 0).alias("covered"), F.array_join(F.array_sort(F.collect_set("hit")), ",").alias("hits"))


def restrict_to_scope_slices(cands: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows of a chosen document, and of its slices (section_key) where it has any."""
    return cands.join(choices, (cands["doc_id"] == choices["c_doc"]) & (choices["c_section"].isNull() | (choices["c_section"] == cands["section_key"])), "left_semi")



def ambiguous_terms(bindings: DataFrame) -> DataFrame:
    """One spelling for two concepts of a knowledge base with overlapping scopes (null overlaps all)."""
    known = bindings.select("kb_id", "spelling", "concept", "scope").distinct()
    several = known.groupBy("kb_id", "spelling").agg(F.min("concept").alias("x"), F.max("concept").alias("y")).where("x < y")
    known = known.join(several.select("kb_id", "spelling"), ["kb_id", "spelling"], "left_semi")
    a, b = known.alias("a"), known.alias("b")
    same = (F.col("a.kb_id") == F.col("b.kb_id")) & (F.col("a.spelling") == F.col("b.spelling")) & (F.col("a.concept") < F.col("b.concept"))
    overlap = F.coalesce(F.col("a.scope") == F.col("b.scope"), F.lit(True))
    return a.join(b, same).where(overlap).select("a.kb_id", "a.spelling", F.col("a.concept").alias("concept"), F.col("b.concept").alias("other")).distinct()


def topic_documents(rows: DataFrame, most_chars: int = 1800) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("content", 1, most_chars).alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("query_id", "doc_id").agg(F.min("pos").alias("first_pos"), F.max("score").alias("best"), text.alias("text")).withColumn("n_terms", F.size(X.topic_terms(F.col("text")))).drop("text")


def with_verdicts(rows: DataFrame, verify: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """rows with topic_relevance, answer_support (0 to 1) and role, from the caller's verifier, batch by batch.

    A verifier that gives another number of rows is refused; scores are held to 0..1, unknown roles are irrelevant.
    """
    made = T.StructType([T.StructField("topic_relevance", T.DoubleType()), T.StructField("answer_support", T.DoubleType()), T.StructField("role", T.StringType())])
    rows = rows.drop(*made.names)
    schema = T.StructType([*rows.schema.fields, *made.fields])

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = verify(f)
            if len(v) != len(f):
                raise ValueError(f"{len(v)} verdicts for {len(f)} rows")
            scores = {n: v[n].astype(float).clip(0, 1).to_numpy() for n in made.names[:2]}
            yield f.assign(**scores, role=v["role"].where(v["role"].isin(list(ROLE_RANK)), "irrelevant").to_numpy())[schema.names]

    return rows.mapInPandas(judged, schema)
