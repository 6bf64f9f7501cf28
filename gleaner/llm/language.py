"""Language of whole texts by a linear-chain conditional random field over words.

Each word's score for a language is a sum of learned weights of its features:
prefixes and suffixes of up to four bytes, byte 2- to 4-grams, and its place in the
lexicon (the sampled words, one weight each).  Learned transitions and opening
weights tie neighbours, so code-switched text is labelled word by word;
forward-backward gives each word's marginals, and a document's score is the mean
marginal of its best language.

The classifier is fitted on a bounded sample (`FitLimits`); predictions use all
words of all texts.

Cases: a null text, or one without a letter (Unicode category L), is `und` with
score 0; with nothing to learn from, every text is; a null lang or doc_id, or a
text without a letter, takes no part in learning; copies of a text count once, so
that a language of few texts is learned, too; ties go to the first language in
order; very long texts are labelled whole; other columns pass through, and a
clash with a result column is resolved in favour of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.columns import untaken
from gleaner.llm.grams import BYTE_BASE, BYTE_CODES, doc_slices, mix, rolling, text_bytes, word_codes, word_spans
from gleaner.session import bounded_batches, stored

FEATURE_BITS = 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 60_000
#: Bytes that letters are made of: ASCII letters and everything beyond ASCII.  It tells which
#: words of a lettered text count; whether a text has a letter is asked of Unicode.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


@dataclass(frozen=True)
class FitLimits:
    """Bounds of what is learned from: documents of each language, and words of each document (at a chosen place)."""

    documents: int = 400
    words: int = 160
    chains: int = 1500
    chain_words: int = 40
    epochs: int = 6
    rate: float = 0.15
    seed: int = 7


def feature_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Each word's summed weights, one column a language."""
    index, owner = features(data, starts, ends, lexicon)
    out = np.empty((len(starts), weights.shape[1]), np.float32)
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(owner, weights=weights[index, k], minlength=len(starts))
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, word) pairs of all words; the lexicon's words follow the hashed features."""
    data = LOWER[data]
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    shift = np.uint64(64 - FEATURE_BITS)
    index, owner = [], []

    def add(h: np.ndarray, kind: int, words: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            index.append((mix(h + np.uint64(kind * 0x9E3779B9)) >> shift).astype(np.int64))
        owner.append(words)

    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    for n in (2, 3, 4):
        grams = rolling(BYTE_CODES[data], n, BYTE_BASE)
        fits = place + n <= np.repeat(ends, size)
        add(grams[place[fits]], n, word[fits])
    for n in (1, 2, 3, 4):
        grams = rolling(BYTE_CODES[data], n, BYTE_BASE)
        long = np.flatnonzero(size >= n)
        add(grams[starts[long]], 10 + n, long)
        add(grams[ends[long] - n], 20 + n, long)
    if len(lexicon):
        codes = word_codes(data, starts, ends)
        at = np.minimum(np.searchsorted(lexicon, codes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == codes)
        index.append((1 << FEATURE_BITS) + at[known])
        owner.append(known)
    return np.concatenate(index), np.concatenate(owner)


def lettered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(LETTER[data])))
    return total[ends] > total[starts]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features and lexicon x languages
    transitions: np.ndarray  # from x to
    opening: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted fingerprints of words


def marginals(model: Model, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over many chains laid end to end.

    The whole row is cut into equal lanes that run side by side; a first sweep
    gives each lane's transfer matrix, so that the second starts every lane with
    its exact message.  At a chain's first word the message starts anew.
    """
    n, k = emission.shape
    if not n:
        return emission
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(model.transitions)
    fresh_row = np.exp(model.opening)
    lanes = int(min(2048, max(1, n // 64)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(lanes, steps, k)
    new = np.zeros(lanes * steps, bool)
    new[first[first < n]] = True
    new[n:] = True
    new = new.reshape(lanes, steps)

    def moves(t: int) -> np.ndarray:
        """lanes x from x to: the step into word t."""
        return np.where(new[:, t, None, None], fresh_row[None, None, :], a[None]) * e[:, t, None, :]

    whole = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for t in range(steps):
        whole = whole @ moves(t)
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    forward = np.empty((lanes, steps, k))
    start = np.empty((lanes, k))
    message = np.full(k, 1.0 / k)
    for s in range(lanes):
        start[s] = message
        message = message @ whole[s]
        message /= message.sum()
    now = start
    for t in range(steps):
        now = (now[:, None, :] @ moves(t))[:, 0]
        now /= now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    end = np.empty((lanes, k))
    message = np.ones(k)
    for s in range(lanes - 1, -1, -1):
        end[s] = message
        message = whole[s] @ message
        message /= message.sum()
    back = end
    for t in range(steps - 1, -1, -1):
        here = forward[:, t] * back
        forward[:, t] = here / here.sum(axis=1, keepdims=True)
        if t:
            back = (moves(t) @ back[:, :, None])[:, :, 0]
            back /= back.sum(axis=1, keepdims=True)
    return forward.reshape(-1, k)[:n]


def chain_expectations(emission: np.ndarray, transitions: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word marginals, summed pair marginals, log partition functions) of chains of one length.

    emission: chains x words x languages.  These are the expectations in the
    gradient of the chain likelihood.
    """
    n, length, k = emission.shape
    top = emission.max(axis=2)
    e = np.exp(emission - top[:, :, None])
    a = np.exp(transitions)
    alpha, beta = np.empty((n, length, k)), np.ones((n, length, k))
    total = top.sum(axis=1)
    for t in range(length):
        now = (np.exp(opening) if t == 0 else alpha[:, t - 1] @ a) * e[:, t]
        norm = now.sum(axis=1)
        alpha[:, t] = now / norm[:, None]
        total = total + np.log(norm)
    for t in range(length - 2, -1, -1):
        back = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = back / back.sum(axis=1, keepdims=True)
    word = alpha * beta
    word /= word.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
    pair = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    return word, pair, total


def fit(texts: list[tuple[str, str]], limits: FitLimits) -> Model:
    """Stochastic ascent of the chain likelihood on code-switched chains of sampled words."""
    languages = sorted({lang for lang, _ in texts})
    k = len(languages)
    rng = np.random.default_rng(limits.seed)
    own: dict[str, list[list[str]]] = {lang: [] for lang in languages}
    for lang, text in sorted(texts):
        words = text.split()
        if words:
            own[lang].append(words)
    languages = [x for x in languages if own[x]]
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((1 << FEATURE_BITS, max(k, 1)), np.float32), np.zeros((k, k)), np.zeros(k))
    length = limits.chain_words
    chains, labels = [], []
    for _ in range(limits.chains):
        words: list[str] = []
        label: list[int] = []
        while len(words) < length:
            lang = int(rng.integers(k))
            source = own[languages[lang]][int(rng.integers(len(own[languages[lang]])))]
            take = min(int(rng.integers(5, length + 1)), length - len(words))
            at = int(rng.integers(max(1, len(source) - take + 1)))
            part = source[at : at + take]
            words += part
            label += [lang] * len(part)
        chains.append(words[:length])
        labels.append(label[:length])
    vocabulary = sorted({w for c in chains for w in c})
    number = {w: i for i, w in enumerate(vocabulary)}
    data, offsets = text_bytes(pa.array(vocabulary))
    lexicon = np.unique(word_codes(LOWER[data], offsets[:-1], offsets[1:]))
    model = Model(languages, np.zeros(((1 << FEATURE_BITS) + len(lexicon), k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    index, owner = features(data, offsets[:-1], offsets[1:], lexicon)
    order = np.argsort(owner, kind="stable")
    index, owner = index[order], owner[order]
    firsts = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    x = np.array([[number[w] for w in c] for c in chains])
    y = np.array(labels)
    grad_sq = np.full_like(model.weights, 1e-2)
    trans_sq, open_sq = np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(limits.epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            words = x[rows].ravel()
            used, inverse = np.unique(words, return_inverse=True)
            feats = np.concatenate([index[firsts[u] : firsts[u + 1]] for u in used])
            feat_owner = np.repeat(np.arange(len(used)), firsts[used + 1] - firsts[used])
            score = np.stack([np.bincount(feat_owner, weights=model.weights[feats, j], minlength=len(used)) for j in range(k)], axis=1)
            p, pairs, _ = chain_expectations(score[inverse].reshape(len(rows), length, k), model.transitions, model.opening)
            truth = np.eye(k)[y[rows]]
            delta = (truth - p).reshape(-1, k)
            per_word = np.stack([np.bincount(inverse, weights=delta[:, j], minlength=len(used)) for j in range(k)], axis=1)
            for j in range(k):
                g = np.bincount(feats, weights=per_word[feat_owner, j], minlength=len(model.weights))
                hit = g != 0
                grad_sq[hit, j] += g[hit] ** 2
                model.weights[hit, j] += limits.rate * g[hit] / np.sqrt(grad_sq[hit, j])
            g = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pairs
            trans_sq += g**2
            model.transitions += limits.rate * g / np.sqrt(trans_sq)
            g = delta.reshape(len(rows), length, k)[:, 0].sum(axis=0)
            open_sq += g**2
            model.opening += limits.rate * g / np.sqrt(open_sq)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, limits: FitLimits) -> list[tuple[str, str]]:
    """(lang, snippet) of a bounded number of distinct texts of each language: those of the smallest digests."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("text").alias("h"))
    texts = stored(known.select("lang", "h").distinct(), "taught")
    # A digest below the share keeps about twice the documents of each language: no task sorts a whole language.
    share = F.least(F.lit(1.0), F.lit(2.0 * limits.documents + 100) / F.count("*"))
    counts = texts.groupBy("lang").agg(share.alias("share"))
    place = F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0)
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = stored(texts.join(counts, "lang").where(place < F.col("share")).select("lang", "h", least.alias("n")).where(F.col("n") <= limits.documents).drop("n"), "chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    words = known.join(few, ["lang", "h"]).select("lang", "h", F.split("text", r"[\s]+").alias("w"))
    at = F.pmod("h", F.greatest(F.lit(1), F.size("w") - limits.words + 1)).cast("int") + 1
    snippet = words.select("lang", "h", F.array_join(F.slice("w", at, limits.words), " ").alias("t"))
    return [(r["lang"], r["t"]) for r in snippet.groupBy("lang", "h").agg(F.first("t").alias("t")).collect()]


def label_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of whole texts."""
    data, offsets = text_bytes(texts)
    names, scores = [], []
    k = len(model.languages)
    for a, b in doc_slices(offsets, 1_000_000):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, offs)
        if not len(starts) or k == 0:
            names += ["und"] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        codes = word_codes(part, starts, ends)
        _, one, inverse = np.unique(codes, return_index=True, return_inverse=True)
        # The distinct words side by side, with a byte between, are all that features are made of.
        size = ends[one] - starts[one]
        place = np.cumsum(size) - size
        take = np.arange(size.sum()) - np.repeat(place, size) + np.repeat(starts[one], size)
        emission = feature_sums(part[take], place, place + size, model.weights, model.lexicon)
        p = marginals(model, emission[inverse], first[:-1])
        row = np.repeat(np.arange(b - a), np.diff(first))
        use = lettered(part, starts, ends)
        total = np.stack([np.bincount(row[use], weights=p[use, j], minlength=b - a) for j in range(k)], axis=1)
        n = np.bincount(row[use], minlength=b - a)
        best = total.argmax(axis=1)
        score = total[np.arange(b - a), best] / np.maximum(n, 1)
        names += [model.languages[i] if c else "und" for i, c in zip(best, n, strict=True)]
        scores.append(np.where(n > 0, np.clip(score, 0.0, 1.0), 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, limits: FitLimits = FitLimits(), learn_from: DataFrame | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score.  No shuffle beyond that of the sample."""
    learn_from = docs if learn_from is None else learn_from
    bounded_batches(docs.sparkSession)
    model = fit(training_sample(learn_from, limits), limits)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by FEATURE_BITS and FitLimits
    docs = docs.drop("held_out", "lang_pred", "score")
    flag = untaken(docs.columns, "lettered")
    names = [*docs.columns, "lang_pred", "score"]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, named = b.column("text"), b.column(flag)
            langs, scores = label_texts(shared.value, pc.if_else(named, texts, pa.scalar(None, texts.type)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    judged = docs.withColumn(flag, has_letter(F.col("text"))).mapInArrow(labelled, out)
    return judged.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
