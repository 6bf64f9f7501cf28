"""Documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.documents import extract_records
from gleaner.operators.retrieval import visible_chunks

OFFICE = ["pdf", "docx", "pptx", "xlsx", "xls"]


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, file_type, text): all but office files as UTF-8 text; those have a null text for a parser of the caller's."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(~kind.isin(OFFICE), F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(F.col("content").cast("string"))), "�", ""))
    return raw.select("path", name.alias("filename"), kind.alias("file_type"), text.alias("text"))


def rebuild_knowledge_records(records: DataFrame | None, chunks: DataFrame, docs: DataFrame, kb_ids: list[int] | None = None) -> DataFrame:
    """Records of the visible chunks; with kb_ids, other knowledge bases keep the records they have."""
    fresh = extract_records(visible_chunks(chunks, docs, kb_ids).select(F.struct("kb_id", "doc_id", "id").alias("key"), "content"), "key").select("key.*", "subject", "predicate", "value", "search_text")
    if records is None or kb_ids is None:
        return fresh
    return records.where(~F.col("kb_id").isin(kb_ids)).unionByName(fresh)
