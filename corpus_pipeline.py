"""From raw documents to a training mix, in five stages.

Each stage takes what its predecessor kept and returns the columns of documents;
the last adds what the mix takes of each.  Columns that a stage's operator makes
never replace columns of the same name in documents: those are renamed meanwhile.
The last stage alone gives its result columns (size, source_size, target, taken)
precedence over columns of these names.
Nulls, empty tables and repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.columns import restored, shielded
from gleaner.llm.decontamination import without_contaminated
from gleaner.llm.jaccard import Similarity, one_of_each_class
from gleaner.llm.language import identify
from gleaner.llm.mixing import mix_sources
from gleaner.llm.repeats import remove_repeats
from gleaner.session import stored
from gleaner.tables import table

#: A document whose best language gets less of its words' marginals is rejected.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language of their own stay."""
    rows, names = shielded(docs, "doc_id", "text")
    judged = identify(rows, learn_from=docs.select("doc_id", "text", "lang"))
    return restored(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays: five words, 0.8 or more."""
    rows, names = shielded(docs, "doc_id", "text")
    return restored(one_of_each_class(rows, Similarity(n=5, num=80, den=100)), names)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document holds go; so do documents of which nothing is left."""
    rows, names = shielded(docs, "doc_id", "text")
    cut = remove_repeats(rows)
    changed = F.col("n_removed") > 0
    made = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))
    return restored(cut.where(~changed | (F.col("n_removed") < F.col("n_words"))), names, **made)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    rows, names = shielded(docs, "doc_id", "text")
    return restored(without_contaminated(rows, table(spark, sf_dir, "benchmark")), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that it takes from."""
    return mix_sources(docs).where("taken > 0")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminate", decontaminate), ("mix", mix)]
#: Language ID has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
