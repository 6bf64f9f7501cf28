"""Column expressions that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import stored

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII letters and digits and anything beyond ASCII, before A-Z are lower-cased.
ALNUM_WORD = r"[\p{Alnum}\P{ASCII}]++"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else unchanged (the built-in lower also folds É)."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_count(text: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def untaken(names: list[str], wanted: str) -> str:
    """A column name that is not among the names, built from the wanted one."""
    taken = {x.lower() for x in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shielded(rows: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """rows with all but the known columns renamed out of an operator's way; original name -> name now."""
    wanted = {k.lower() for k in known}
    names = {c: c if c.lower() in wanted else f"__own{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def restored(rows: DataFrame, names: dict[str, str], *added: str, **made: Column) -> DataFrame:
    """The columns of what was shielded, under their own names, some of them made anew, and the added ones."""
    return rows.select(*[made.get(c, F.col(now)).alias(c) for c, now in names.items()], *added)


#: A key is heavy with more than one in so many rows; there are at most so many heavy keys.
HEAVY = 1000


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """Keys of (key, n) with over a thousandth of all rows: a thousand at most, so that they may be broadcast; None if there are none."""
    heavy = stored(counts.where(F.col(n) * HEAVY > total).select(key), "heavy")
    return None if heavy.isEmpty() else heavy


def spread_join(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """rows joined with facts (one row a key): heavy keys' facts are broadcast, so that their rows stay where they are."""
    if heavy is None:
        return rows.join(facts, key)
    hot = stored(facts.join(F.broadcast(heavy), key), "hot")
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
