"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

Rules decide where they fit.  The trees (Spark ML's gradient-boosted trees) learn
from the URLs that rules decide and judge the others by the look of the URL:
length, depth, digit share, character entropy, number of parameters and
statistics of the host's suffix among the labelled URLs.  For training, a URL's
suffix statistics leave out the fold that it is in, so that they don't hold its
own label.

Cases: a null URL or one without "://" has an empty host and path; with labels
of one kind only, every other URL gets that verdict, with none `allow`; equal
rows get equal verdicts; very long URLs are read whole; an empty table gives no
rows; other columns are kept, and a clash with a result column is resolved in
favour of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.columns import lower_ascii, untaken
from gleaner.session import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreePlan:
    #: The trees see at most this many labelled URLs (a digest chooses them).
    labelled: int = 20_000
    trees: int = 10
    depth: int = 4
    folds: int = 5
    seed: int = 5


#: A table of at most this many suffixes may be broadcast.
BROADCAST_ROWS = 60_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_share", "entropy", "n_params", "hyphens", "suffix_count", "suffix_block_share")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages with host, path, rule and its verdict; the longest fitting rule wins."""
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        chosen, verdict = F.when(fits, F.lit(r.name)).otherwise(chosen), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rows.withColumn("rule", chosen).withColumn("verdict", verdict)


def entropy(c: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def lexical() -> dict[str, Column]:
    """The features that a URL itself gives."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url)
    number = lambda c: c.cast("double")
    return {
        "url_length": number(length),
        "host_length": number(F.length("host")),
        "path_length": number(F.length("path")),
        "depth": number(F.regexp_count("path", F.lit("/[^/]+"))),
        "host_labels": number(F.size(F.split("host", r"\."))),
        "digit_share": F.when(length > 0, F.regexp_count(url, F.lit("[0-9]")) / length).otherwise(0.0),
        "entropy": entropy(F.concat("host", "path")),
        "n_params": number(F.regexp_count(url, F.lit("[?&][^?&=#]+="))),
        "hyphens": number(F.regexp_count("host", F.lit("-"))),
    }


def featured(rows: DataFrame, stats: DataFrame, on: list[str], into: str) -> DataFrame:
    """rows (url, host, path, suffix, ...) with all features as one vector."""
    few = F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats
    joined = rows.join(few, on, "left")
    count, share = F.coalesce("suffix_count", F.lit(0.0)), F.coalesce("suffix_block_share", F.lit(0.5))
    values = {**lexical(), "suffix_count": count, "suffix_block_share": share}
    return joined.withColumn(into, array_to_vector(F.array(*[values[n].cast("double") for n in FEATURES]))).drop("suffix_count", "suffix_block_share")


def judge_urls(pages: DataFrame, rules: list[Rule], plan: TreePlan = TreePlan()) -> DataFrame:
    """pages with host, path, rule, verdict.  Scoring needs no shuffle, so that a hot URL is no hot task."""
    ruled = with_rule(pages, rules)
    suffix, into, guess = (untaken(ruled.columns, n) for n in ("suffix", "features", "guess"))
    known = ruled.where("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("y"), F.xxhash64("url").alias("u"))
    urls = known.select("u", "host", "y", F.pmod("u", F.lit(plan.folds)).alias("fold")).distinct()
    counts = urls.groupBy(suffix_of(F.col("host")).alias("suffix"), "fold").agg(F.count("*").alias("n"), F.sum("y").alias("blocks"))
    counts = stored(counts, "suffixes")
    seen = counts.agg(F.sum("n"), F.sum("blocks")).first()
    n, blocks = seen[0] or 0, seen[1] or 0.0
    if n == 0 or blocks in (0, n):
        return ruled.withColumn("verdict", F.coalesce("verdict", F.lit("block" if blocks else "allow")))
    stat = lambda m, b: (F.log1p(m.cast("double")).alias("suffix_count"), F.when(m > 0, b / m).otherwise(0.5).alias("suffix_block_share"))
    whole = counts.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocks").alias("all_blocks"))
    every = counts.select("suffix").distinct().withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(plan.folds)])))
    rest = every.join(whole, "suffix").join(counts, ["suffix", "fold"], "left")
    others = stored(rest.select("suffix", "fold", *stat(F.col("all_n") - F.coalesce("n", F.lit(0)), F.col("all_blocks") - F.coalesce("blocks", F.lit(0.0)))), "others")
    whole = stored(whole.select(F.col("suffix").alias(suffix), *stat(F.col("all_n"), F.col("all_blocks"))), "whole")

    share = min(1.0, plan.labelled / n)
    sample = known.where(F.pmod("u", F.lit(1_000_003)) < F.lit(share * 1_000_003)).dropDuplicates(["u"])
    sample = sample.withColumn("suffix", suffix_of(F.col("host"))).withColumn("fold", F.pmod("u", F.lit(plan.folds)))
    train = stored(featured(sample, others, ["suffix", "fold"], "features").select("features", "y"), "labelled")
    model = GBTClassifier(labelCol="y", maxIter=plan.trees, maxDepth=plan.depth, seed=plan.seed).fit(train)
    model = model.setFeaturesCol(into).setPredictionCol(guess).setProbabilityCol("").setRawPredictionCol("")
    scored = model.transform(featured(ruled.withColumn(suffix, suffix_of(F.col("host"))), whole, [suffix], into))
    made = F.when(F.col(guess) >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", made)).select(ruled.columns)
