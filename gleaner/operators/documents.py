"""Documents to chunks and records: the text side of ingestion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as X

SENTENCE_ENDS = "。！？；!?;"
CJK = ((0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7A3))


def rows_to_kv_text(rows: DataFrame, columns: list[str], group: str, order: str) -> DataFrame:
    """Rows as `name: value` pairs; blanks and empty rows go, so do groups of fewer than two rows."""
    pair = lambda c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c))))
    lines = rows.select(group, order, F.concat_ws("，", *[pair(c) for c in columns]).alias("line")).where("line <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(group).agg(F.count("*").alias("n"), text.alias("t")).where("n >= 2").select(group, F.concat(F.lit("["), group, F.lit("]\n"), "t").alias("text"))


def rows_to_markdown_table(rows: DataFrame, columns: list[str], group: str, order: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return rows.groupBy(group).agg(F.concat(F.lit(head), body).alias("content"))


def extract_records(chunks: DataFrame, key: str) -> DataFrame:
    """Rows of Markdown tables: subject, predicate, value, search_text.  The first row is the header."""
    lines = chunks.select(key, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("cells", X.row_cells(F.col("line"))).where("cells is not null")
    first = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("header", F.first("cells").over(first)).withColumn("n", F.row_number().over(first)).where("n > 1")
    rows = rows.where((F.size("cells") == F.size("header")) & (F.col("cells")[0] != ""))
    value = F.when(F.size("cells") == 2, F.col("cells")[1]).otherwise(F.array_join(F.slice("cells", 2, F.size("cells")), " | "))
    made = rows.select(key, "line_no", F.col("cells")[0].alias("subject"), F.when(F.size("cells") == 2, F.col("header")[1]).otherwise("table_row").alias("predicate"), value.alias("value"), F.array_join("cells", " ").alias("search_text"))
    once = Window.partitionBy(key, "subject", "predicate", "value").orderBy("line_no")
    return made.where("trim(value) <> ''").withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")


def parse_sections(docs: DataFrame, key: str) -> DataFrame:
    """One row a block (table or prose) with its path of headings."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    lines = lines.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+", ""))))
    w = Window.partitionBy(key).orderBy("n")
    for k in range(1, 7):
        # A heading of level k holds until one of a level up to k.
        lines = lines.withColumn(f"s{k}", F.last(F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct("level", "title")), ignorenulls=True).over(w))
    titles = [F.when(F.col(f"s{k}.level") == k, F.col(f"s{k}.title")) for k in range(1, 7)]
    lines = lines.withColumn("path", F.array_join(F.array_compact(F.array(*titles)), " › "))
    kind = F.when(F.col("level") > 0, "heading").when(F.trim("line") == "", "blank").when(F.trim("line").rlike(r"^\|.*\|$"), "table").otherwise("text")
    lines = lines.withColumn("kind", kind)
    change = ((F.col("kind") != F.lag("kind").over(w)) | F.lag("kind").over(w).isNull() | (F.col("kind") == "heading")).cast("int")
    blocks = lines.withColumn("change", change).withColumn("block", F.sum("change").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return blocks.where("kind in ('table', 'text')").groupBy(key, "block", "path", "kind").agg(F.min("n").alias("first_line"), text.alias("content"))


def is_cjk(text: str) -> bool:
    """More than a fifth of what is not white space is Chinese, Japanese or Korean."""
    seen = [ord(c) for c in text if not c.isspace()]
    return not seen or sum(any(a <= c <= b for a, b in CJK) for c in seen) > 0.2 * len(seen)


def pack(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of neighbours that fit together, each as (first, behind last)."""
    runs, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            runs.append((start, i))
            start, total = i, 0
        total += n
    return [*runs, (start, len(sizes))] if sizes else runs


def split_text(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Sentences packed to chunks, each opening with the last sentences of the one before."""
    text = re.sub(r"\n{3,}", "\n\n", text or "").strip()
    if not text:
        return []
    cjk = is_cjk(text)
    glue, scale = ("", 1) if cjk else (" ", 4)
    size, overlap = size * scale, overlap * scale
    units = [s.strip() for line in text.split("\n") for s in re.split(f"(?<=[{SENTENCE_ENDS}])", line) if s.strip()]
    units = [u[i : i + size] for u in units for i in range(0, len(u), size) if u[i : i + size].strip()]
    made, before = [], 0
    for a, b in pack([len(u) for u in units], size):
        lead, room = a, overlap
        while made and lead > before and len(units[lead - 1]) <= room:
            lead -= 1
            room -= len(units[lead])
        made.append(glue.join(units[lead:b]).strip())
        before = a
    least = 5 if cjk else 20
    out: list[str] = []
    waiting = ""
    for chunk in filter(None, made):
        if len(chunk) >= least:
            out.append(f"{waiting}{glue}{chunk}".strip())
            waiting = ""
        elif out:
            out[-1] = f"{out[-1]}{glue}{chunk}".strip()
        else:
            waiting = f"{waiting}{glue}{chunk}".strip()
    return [*out, waiting] if waiting else out


def split_table_rows(table: str, most: int = 1800) -> list[dict]:
    """Parts of a Markdown table, each with the header, and the rows (from 1) that it holds."""
    head, body = table.split("\n")[:2], table.split("\n")[2:]
    if len(table) <= most or not body:
        return [{"content": table, "part_index": 0, "part_count": 1, "row_start": 1 if body else None, "row_end": len(body) or None}]
    runs = pack([len(r) for r in body], most - sum(map(len, head)))
    return [{"content": "\n".join(head + body[a:b]), "part_index": i, "part_count": len(runs), "row_start": a + 1, "row_end": b} for i, (a, b) in enumerate(runs)]


def _parts(rows: DataFrame, key: str, column: str, cut: Callable[[str], list[dict]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """One row for each part that `cut` makes of a text, with the text's key and the part's number."""
    schema = T.StructType([rows.schema[key], T.StructField("piece", T.LongType()), *[T.StructField(n, t) for n, t in fields]])

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, i, *[p[n] for n, _ in fields]) for k, t in zip(f[key], f[column], strict=True) for i, p in enumerate(cut(t))], columns=schema.names)

    return rows.select(key, column).mapInPandas(made, schema)


def split_texts(rows: DataFrame, key: str, column: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, piece, content): the chunks of each text."""
    return _parts(rows, key, column, lambda t: [{"content": c} for c in split_text(t, size, overlap)], [("content", T.StringType())])


def split_tables(rows: DataFrame, key: str, column: str, most: int = 1800) -> DataFrame:
    """(key, piece, content, row_start, row_end, part_count): the parts of each Markdown table."""
    numbers = [(n, T.LongType()) for n in ("row_start", "row_end", "part_count")]
    return _parts(rows, key, column, lambda t: split_table_rows(t, most) if t else [], [("content", T.StringType()), *numbers])


CHUNK = T.StructType([T.StructField(n, t) for n, t in (("section_path", T.StringType()), ("block_type", T.StringType()), ("content", T.StringType()), ("part_index", T.LongType()), ("part_count", T.LongType()), ("first_line", T.LongType()), ("piece", T.LongType()))])


def chunk_documents(docs: DataFrame, key: str, title: str) -> DataFrame:
    """Documents to numbered chunks: sections, then sentences or table rows packed to size."""
    blocks = parse_sections(docs, key).where(~X.is_placeholder(F.col("content")))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *CHUNK.fields])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, path, what, content, line in zip(f[key], f["path"], f["kind"], f["content"], f["first_line"], strict=True):
                parts = split_table_rows(content) if what == "table" else [{"content": c, "part_index": None, "part_count": None} for c in split_text(content)]
                rows += [(k, path, what, p["content"], p["part_index"], p["part_count"], line, i) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=schema.names)

    pieces = blocks.mapInPandas(cut, schema).join(docs.select(key, F.col(title).alias("__title")), key)
    prefix = F.concat(F.lit("【"), F.concat_ws(" › ", "__title", F.nullif("section_path", F.lit(""))), F.lit("】\n"))
    numbered = pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("first_line", "piece")) - 1)
    return numbered.withColumn("content", F.concat(prefix, "content")).drop("__title", "piece", "first_line")


def embed_table(rows: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """rows with `embedding`, made by the caller's function in batches; it must give one vector a text."""
    rows = rows.drop("embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column).to_pylist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                got = embed(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError(f"{len(got)} vectors for {len(texts[i : i + batch])} texts")
                vectors += [list(map(float, v)) for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return rows.mapInArrow(made, schema)
