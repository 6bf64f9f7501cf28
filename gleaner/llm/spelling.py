"""Spelling variants: words one edit apart, found by scans of sorted vocabularies.

Two words of which one edit makes the other agree before the edit and after it,
so that they share the first or the last half of the shorter one.  Words meet in
groups by such a half, forwards and backwards (mirrored).  Within a group the
sorted list is scanned once for each word, with the three cells of the edit
matrix that lie within one edit of the diagonal: rows of the prefix that a word
shares with the one before it are kept, and where all cells of a row exceed one
edit, all words with that prefix are passed over.

Words are counted over all documents before anything else; what follows grows
with the vocabulary.  Groups of more than `block` words are compared shard by
shard.  A group returns one row for each of its words, never pairs.

Cases: null and empty texts have no words; a null doc_id counts as the empty
text in the digest; ties of n go to the smaller word in code-point order; an
empty table gives no rows; texts of any length are read whole; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import groups, in_parts
from gleaner.llm.columns import lower_ascii
from gleaner.session import discard, stored

LETTERS = "A-Za-zÀ-ÿ"
LAST = "\U0010ffff"
GROUP = ["side", "least", "key"]
NEAR = "word string, n_near long, best_n long, best string"


@dataclass(frozen=True)
class SpellingPlan:
    #: Least code points and occurrences of a word.
    length: int = 6
    occurrences: int = 5
    #: A form occurs at least so many times as often.
    ratio: int = 5
    #: One run in so many loses a letter.
    noise: int = 199
    #: Words of a shard of a crowded group, and rows of a part.
    block: int = 4_096
    part_rows: int = 16_384


def counted_words(docs: DataFrame, plan: SpellingPlan) -> DataFrame:
    """(word, n): runs of letters, every 199th (by digest) with a letter deleted.

    Runs shorter than the least length can't become words and are not cut out.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{plan.length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(h % plan.noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= plan.occurrences) & (F.char_length("word") >= plan.length))


def half(least: int) -> int:
    """Words one edit apart, the shorter of this length, share so many first or so many last letters."""
    return least // 2


def in_halves(words: DataFrame, plan: SpellingPlan) -> DataFrame:
    """(side, least, key, word, n): groups of words of length `least` and one more with a common first or last half."""
    length = F.char_length("word")
    sizes = F.when(length > plan.length, F.array(length - 1, length)).otherwise(F.array(length))
    each = words.withColumn("least", F.explode(sizes)).withColumn("side", F.explode(F.array(F.lit("first"), F.lit("last"))))
    size = F.shiftright("least", 1)
    key = F.when(F.col("side") == "first", F.substring(F.col("word"), F.lit(1), size)).otherwise(F.substring(F.col("word"), length - size + 1, size))
    return each.select("side", "least", key.alias("key"), "word", "n")


def shared_prefixes(words: list[str]) -> list[int]:
    """Length of the common prefix of each word with the one before it."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def one_edit_away(query: str, words: list[str], shared: list[int]) -> Iterator[int]:
    """Places of the sorted words that are one edit from the query.

    rows[r] holds the cells D[r][r-1], D[r][r], D[r][r+1] of the edit matrix of a
    word's first r letters against the query's; 2 stands for 2 and more.
    """
    size = len(query)
    end = f"{query}\0\0"  # letters that no word has, for cells beyond the query
    rows = [(2, 0, 1)] + [(2, 2, 2)] * (size + 2)
    i, n, known = 0, len(words), 0
    while i < n:
        word = words[i]
        most = len(word)
        if most > size + 1:
            known = min(known, shared[i + 1]) if i + 1 < n else 0
            i += 1
            continue
        left, middle, right = rows[known]
        r, dead = known, False
        while r < most:
            letter = word[r]
            a = left + (r == 0 or letter != end[r - 1])
            if middle < a - 1:
                a = middle + 1
            b = middle + (r >= size or letter != end[r])
            if right < b - 1:
                b = right + 1
            if a < b - 1:
                b = a + 1
            c = right + (r + 1 >= size or letter != end[r + 1])
            if b < c - 1:
                c = b + 1
            left, middle, right = a, b, c
            r += 1
            rows[r] = (a, b, c)
            if a > 1 and b > 1 and c > 1:
                dead = True
                break
        if dead:
            i = bisect_left(words, word[:r] + LAST, i + 1)
            known = shared[i] if i < n else 0
            continue
        reach = size - most
        if -1 <= reach <= 1 and (left, middle, right)[reach + 1] == 1:
            yield i
        i += 1
        known = shared[i] if i < n else 0


def near_in_groups(table: pa.Table) -> pa.Table:
    """For the words of a part that have a near one in a group: how many, and the most frequent (ties: the smallest).

    In the mirrored groups, pairs that share the first half as well are left to that.
    """
    found: list[tuple[str, int, int, str]] = []
    for run in groups(table, GROUP):
        rows = table.take(pa.array(run)).to_pydict()
        least, mirrored, across = rows["least"][0], rows["side"][0] == "last", rows["low"][0] != rows["high"][0]
        size = half(least)
        listed = sorted((w[::-1] if mirrored else w, w, n, shard) for w, n, shard in zip(rows["word"], rows["n"], rows["shard"], strict=True))
        words = [x[0] for x in listed]
        shared = shared_prefixes(words)
        best: dict[int, tuple[int, int, str]] = {}
        for i, (query, word, n, shard) in enumerate(listed):
            if len(query) != least:
                continue
            for j in one_edit_away(query, words, shared):
                _, other, m, its_shard = listed[j]
                if (len(other) == least and j < i) or (across and shard == its_shard) or (mirrored and word[:size] == other[:size]):
                    continue
                for mine, its_n, its in ((i, m, other), (j, n, word)):
                    near, top_n, top = best.get(mine, (0, -1, ""))
                    best[mine] = (near + 1, its_n, its) if its_n > top_n or (its_n == top_n and its < top) else (near + 1, top_n, top)
        found += [(listed[i][1], *b) for i, b in best.items()]
    cols = list(zip(*found, strict=True)) or [(), (), (), ()]
    return pa.table({"word": pa.array(cols[0], pa.string()), "n_near": pa.array(cols[1], pa.int64()), "best_n": pa.array(cols[2], pa.int64()), "best": pa.array(cols[3], pa.string())})


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every form is followed to the last one, in rounds that double the steps.

    A form is at least `ratio` times as frequent, so there are no circles and few steps.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turned = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = turned.drop("moved")
        if turned.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, plan: SpellingPlan = SpellingPlan()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(counted_words(docs.select("doc_id", "text"), plan), "words")
    halves = stored(in_halves(words, plan), "halves")
    parts = in_parts(halves, GROUP, "word", plan.block, plan.part_rows)
    near = parts.groupBy("part").applyInArrow(near_in_groups, NEAR)
    # Smallest word of the largest n: the order of strings in Spark is that of code points.
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top"))
    near = stored(near.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n")), "near")
    discard(halves)
    known = words.join(near, "word", "left")
    fits = F.col("best_n") >= plan.ratio * F.col("n")
    known = stored(known.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")), "known")
    roots = followed(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
