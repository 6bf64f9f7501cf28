"""Typed values of JSON payloads, as expressions over VARIANT: a number in a string is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column | str) -> Column:
    """The payload as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(payload)


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """The JSON type of a part: BIGINT, DECIMAL(...), DOUBLE, STRING, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID; null if absent."""
    return F.schema_of_variant(part(v, path))


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


def whole(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def text(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def true(v: Column, path: str) -> Column:
    return F.coalesce((kind(v, path) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def length(v: Column, path: str) -> Column:
    """Number of members of a list."""
    return F.when(kind(v, path).startswith("ARRAY"), F.size(F.try_variant_get(v, path, "array<variant>")))
