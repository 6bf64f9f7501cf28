"""Row generators for use in SQL: `SELECT ... FROM t, LATERAL text_chunks(t.text)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gleaner.functions.payload import config_assignments
from gleaner.operators.documents import split_table_rows, split_text


class TextChunks:
    """The chunks of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(split_text(text))


class TableParts:
    """The parts of a Markdown table with the rows that each holds."""

    def eval(self, table: str) -> Iterator[tuple]:
        for part in split_table_rows(table) if table else []:
            yield part["part_index"], part["content"], part["row_start"], part["row_end"]


class ConfigAssignments:
    """The assignments of a configuration text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from config_assignments(text)


def register_table_functions(spark: SparkSession) -> None:
    """text_chunks, table_parts and config_assignments, for this session."""
    spark.udtf.register("text_chunks", udtf(TextChunks, returnType="piece int, content string"))
    spark.udtf.register("table_parts", udtf(TableParts, returnType="part int, content string, row_start int, row_end int"))
    spark.udtf.register("config_assignments", udtf(ConfigAssignments, returnType="path string, value string, meaning string"))
