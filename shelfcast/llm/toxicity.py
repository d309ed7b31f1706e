"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are lower-cased runs of letters. A token's score is its log-odds between toxic and other
labelled texts under a Dirichlet prior, whose weights follow the token's share of the whole corpus.
One scan per document finds all maximal scoring segments; the scores of the best segments are held
against their extreme-value distribution, and that surprise is calibrated to a probability.

Labelled near copies share the weight of one text. A cluster is what agrees in a band of minwise
shingles; without this, thousands of variants of one text shift the class totals, and ordinary words
get log-odds of their own.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import text as tx
from shelfcast.llm.storage import small_enough, staged

#: Labelled rows that a model is fitted on, about; of more, those with the smallest hashes.
TRAINING_ROWS = 400_000
#: Weight of the prior, as a share of the labelled texts.
PRIOR_SHARE = 0.1
#: Tokens that may get a score of their own by chance, over all tokens looked at, and the least
#: toxic texts of a token with one.
CHANCE_TOKENS = 0.5
LEAST_TEXTS = 3
#: Least factor between the odds of a token in toxic and in other texts. On many texts every common
#: word of a language differs a little, by length and mix of the texts; that speaks for nothing.
LEAST_FACTOR = 2.0
#: Words of a shingle, bands of a labelled text and minwise shingles of a band.
SHINGLE, BANDS, BAND_ROWS = 5, 8, 3
#: A text's weight is a whole number of these parts, so sums don't depend on their order.
WHOLE = 1 << 20
#: Expected chance segments as good as a segment, below which it is significant.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
_TOP_SURPRISE = 40.0

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a"): ord("z") + 1] = True
LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    """Sorted token hashes, their scores, the score of all other tokens, the extreme-value
    parameters and the calibration's intercept and slope."""

    tokens: np.ndarray
    scores: np.ndarray
    other: float
    decay: float = 1.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes, their rows, starts and ends in the row's bytes)."""
    for first, last, data, offsets in tx.slices(pc.utf8_lower(column)):
        starts, ends, rows = tx.word_spans(LETTER[data], offsets)
        hashes = tx.word_hash(data, starts, ends)
        yield first, last, hashes, rows, starts - offsets[rows], ends - offsets[rows]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text, a key of each band: near copies agree in some, other texts hardly ever."""
    factors = tx.constants(BANDS * BAND_ROWS, 41)
    for batch in batches:
        for first, last, data, offsets in tx.slices(batch.column("text")):
            words, rows = tx.word_hashes(data, offsets)
            shingles, at = tx.windows(words, rows, last - first, SHINGLE)
            some = np.flatnonzero(np.diff(at))
            least = np.full((BANDS * BAND_ROWS, last - first), np.iinfo(np.uint64).max, dtype=np.uint64)
            for j, factor in enumerate(factors):
                if len(some):
                    least[j, some] = np.minimum.reduceat(shingles * factor, at[some])
            keys = np.zeros((BANDS, last - first), dtype=np.uint64)
            for j, row in enumerate(least):
                keys[j // BAND_ROWS] = tx.mix(keys[j // BAND_ROWS] + row)
            keys += np.arange(BANDS, dtype=np.uint64)[:, None]
            n = last - first
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, n), batch.column("toxic").slice(first, n),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype="i4") * BANDS), pa.array(keys.T.ravel().view("i8"))
                    ),
                ],
                names=["id", "toxic", "keys"],
            )


def weighted(texts: DataFrame) -> DataFrame:
    """(id, toxic, weight) of labelled ``texts``: ``WHOLE`` parts over the largest number of texts
    that agree with one in a band. Keys alone are shuffled, and counted before they are."""
    banded = staged(texts.mapInArrow(_bands, "id long, toxic int, keys array<long>"), "toxic-bands")
    rows = banded.select("id", "toxic", F.explode("keys").alias("key"))
    groups = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "toxic-groups")
    largest = rows.join(small_enough(groups, 24), "key").groupBy("id").agg(F.max("n").alias("n"))
    largest = staged(largest, "toxic-largest")
    return banded.join(small_enough(largest, 24), "id", "left").select(
        "id", "toxic", F.round(WHOLE / F.coalesce("n", F.lit(1))).cast("long").alias("weight")
    )


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice, the weight of the toxic and of the other texts in which a token occurs."""
    for batch in batches:
        toxic, weight = batch.column("toxic").to_numpy(), batch.column("weight").to_numpy()
        for first, _, hashes, rows, _, _ in _words(batch.column("text")):
            order = np.lexsort((rows, hashes))
            h, r = hashes[order], rows[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, y, w = h[new], toxic[first + r[new]], weight[first + r[new]]
            tokens, at = np.unique(h, return_inverse=True)
            bad = np.bincount(at, weights=y * w, minlength=len(tokens)).astype("i8")
            all_ = np.bincount(at, weights=w, minlength=len(tokens)).astype("i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view("i8")), pa.array(bad), pa.array(all_ - bad)], names=["token", "bad", "good"]
            )


def _corpus_counts(tokens: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition, how often each of ``tokens`` occurs and in how many texts; as null token, how
    many tokens and texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts, total, n_texts = np.zeros(len(tokens), "i8"), np.zeros(len(tokens), "i8"), 0, 0
        for batch in batches:
            n_texts += batch.num_rows
            for first, last, hashes, rows, _, _ in _words(batch.column("text")):
                at = _places(tokens, hashes)
                known = at < len(tokens)
                counts += np.bincount(at[known], minlength=len(tokens))
                pairs = np.unique(at[known] * (last - first) + rows[known])
                texts += np.bincount(pairs // (last - first), minlength=len(tokens))
                total += len(hashes)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*tokens[seen].view("i8").tolist(), None], pa.int64()),
                pa.array([*counts[seen].tolist(), total], pa.int64()),
                pa.array([*texts[seen].tolist(), n_texts], pa.int64()),
            ],
            names=["token", "n", "texts"],
        )

    return run


def _places(tokens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash among sorted ``tokens``, their number if it isn't there."""
    if not len(tokens):
        return np.zeros(len(hashes), dtype="i8")
    at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
    return np.where(tokens[at] == hashes, at, len(tokens))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of ``scores`` with their sums, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total = 0.0
    for at, score in enumerate(scores):
        if score > 0:
            start, end, before, after = at, at + 1, total, total + score
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= before:
                    j -= 1
                if j < 0 or found[j][3] >= after:
                    found.append((start, end, before, after))
                    break
                start, before = found[j][0], found[j][2]
                del found[j:]
        total += score
    return [(start, end, after - before) for start, end, before, after in found]


def _segments(hits: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a token sequence of which only ``hits`` have scores of their own: the
    tokens between two hits are one item, so the work follows the hits. Ends are token positions."""
    items: list[float] = []
    for i, score in enumerate(scores.tolist()):
        items.append(other * float(hits[i] - hits[i - 1] - 1) if i else 0.0)
        items.append(score)
    return [(int(hits[a // 2]), int(hits[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(items)]


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, rows, starts, ends in _words(batch.column("text")):
                size = last - first
                counts = np.bincount(rows, minlength=size)
                begin = np.cumsum(counts) - counts
                best, passages = np.zeros(size), [[] for _ in range(size)]
                surprise, sums = np.zeros(size), [[] for _ in range(size)]
                at = _places(model.tokens, hashes)
                hits = np.flatnonzero(at < len(model.tokens))
                for row in np.unique(rows[hits]).tolist():
                    mine = hits[np.searchsorted(rows[hits], row): np.searchsorted(rows[hits], row, side="right")]
                    segments = _segments(mine, model.scores[at[mine]], model.other)
                    sums[row] = [s for _, _, s in segments]
                    best[row] = max(sums[row])
                    for a, b, s in segments:
                        chance = model.scale * counts[row] * math.exp(-model.decay * s)
                        if chance <= SIGNIFICANT:
                            # every significant passage adds its surprise
                            surprise[row] -= math.log(max(chance, 1e-300))
                            passages[row].append(
                                {"start": int(starts[a]), "end": int(ends[b - 1]), "score": s, "chance": chance}
                            )
                surprise = np.minimum(surprise, _TOP_SURPRISE)
                score = 1 / (1 + np.exp(-(model.intercept + model.slope * surprise)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, size), batch.column("toxic").slice(first, size),
                        batch.column("weight").slice(first, size),
                        pa.array(counts, pa.int64()), pa.array(best), pa.array(surprise), pa.array(score),
                        pa.array(passages, pa.list_(passage)), pa.array(sums, pa.list_(pa.float64())),
                    ],
                    names=["id", "toxic", "weight", "n_tokens", "best", "surprise", "score", "passages", "sums"],
                )

    return run


_SCORED = (
    "id long, toxic int, weight long, n_tokens long, best double, surprise double, score double, "
    "passages array<struct<start: long, end: long, score: double, chance: double>>, sums array<double>"
)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a third of the ids, by the crc32 of their text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _decay(scores: np.ndarray, shares: np.ndarray, other: float) -> float:
    """The positive root of sum(share * exp(root * score)) = 1 over all tokens."""
    rest = max(1.0 - float(shares.sum()), 1e-9)

    def excess(x: float) -> float:
        return float((shares * np.exp(x * scores)).sum()) + rest * math.exp(x * other) - 1

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    if not low and excess(high / 2**20) > 0:
        return 1.0  # the mean isn't negative: scores aren't of the kind, log-odds have root 1
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _platt(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on binned weights, slightly regularised.

    Surprise can't speak against a label: if the labels say so, no score follows from it, which is
    said in a warning, and all texts get the share of toxic ones.
    """
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (bad - (bad + good) * p) - 1e-3 * beta
        weight = (bad + good) * p * (1 - p)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + 1e-3 * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if beta[1] <= 0:
        warnings.warn("surprising passages are no likelier in toxic texts: every text gets one score", stacklevel=2)
        return _log_odds(bad.sum(), good.sum()), 0.0
    return float(beta[0]), float(beta[1])


def _log_odds(bad: float, good: float) -> float:
    base = (bad + 0.5) / (bad + good + 1) if bad + good else 0.5
    return math.log(base / (1 - base))


def _deviance_root(bad: Column, good: Column, share: float) -> Column:
    """How far from ``share`` a token's share of toxic texts is, as a normal deviate: the root of the
    binomial deviance, which holds for tokens that one label never has, too."""

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    n = bad + good
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (part(bad, n * share) + part(good, n * (1 - share)))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that aren't ``held_out``.

    Equal texts and near copies share the weight of one text (see ``weighted``), in token counts,
    class totals, the extreme-value scale and the calibration alike. Tokens get a score where so
    large a share of toxic texts isn't expected by chance. Only the labelled sample's token counts
    and band keys are shuffled; counts over the whole corpus are made for the scored tokens alone,
    one row per partition and token. The lexicon is at most the vocabulary of the sample, which
    ``TRAINING_ROWS`` bounds. With no toxic or no other text, or no telling token, the model gives
    every document the share of toxic labels.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))
    ).groupBy("id").agg(F.max("toxic").alias("toxic"))
    usable = staged(usable, "toxic-labels")
    share = min(1.0, TRAINING_ROWS / max(usable.count(), 1))
    if share < 1:
        draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20))
        usable = staged(usable.where(draw < int(share * (1 << 20))), "toxic-labels")
    texts = docs.join(small_enough(usable, 32), "id").where("text IS NOT NULL")
    chosen = staged(
        weighted(texts).groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("weight").alias("weight")), "toxic-texts"
    )
    sizes = {r["toxic"]: r["weight"] / WHOLE for r in chosen.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    n_bad, n_good = sizes.get(1, 0.0), sizes.get(0, 0.0)
    empty = np.zeros(0)
    blank = Model(empty.astype(np.uint64), empty, -1.0, intercept=_log_odds(n_bad, n_good))
    if not n_bad or not n_good:
        return blank
    sample = docs.join(small_enough(chosen, 32), "id")

    counts = staged(
        sample.mapInArrow(_text_counts, "token long, bad long, good long").groupBy("token")
        .agg((F.sum("bad") / WHOLE).alias("bad"), (F.sum("good") / WHOLE).alias("good"))
        .where(F.col("bad") >= LEAST_TEXTS),
        "toxic-counts",
    )
    least = NormalDist().inv_cdf(1 - min(CHANCE_TOKENS / max(counts.count(), 1), 0.5))
    # the prior draws both shares together, so a lesser factor can't become large enough
    rows = counts.where(F.col("bad") * n_good >= F.col("good") * n_bad * math.sqrt(LEAST_FACTOR)).where(
        _deviance_root(F.col("bad"), F.col("good"), n_bad / (n_bad + n_good)) >= least
    ).toPandas()
    if not len(rows):
        return blank
    rows["token"] = rows["token"].to_numpy().astype("i8").view("u8")
    rows = rows.sort_values("token")
    tokens = rows["token"].to_numpy().astype("u8")

    corpus = docs.select("text").mapInArrow(_corpus_counts(tokens), "token long, n long, texts long").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("texts").alias("texts")
    )
    corpus = {r["token"]: r for r in corpus.collect()}  # a row per token of the lexicon, and the total
    every = corpus.pop(None, None)
    total, n_texts = (float(every["n"]) or 1.0, every["texts"] or 1) if every else (1.0, 1)
    found = [corpus.get(t) for t in tokens.view("i8").tolist()]
    shares = np.array([r["n"] / total if r else 0.0 for r in found])
    # the prior has the corpus' share of texts with the token
    weight = PRIOR_SHARE * (n_bad + n_good)
    bad, good = rows["bad"].to_numpy(float), rows["good"].to_numpy(float)
    prior = weight * np.array([r["texts"] / n_texts if r else 0.0 for r in found]) + 0.01
    odds = np.log((bad + prior) / np.maximum(n_bad + weight - bad - prior, 0.5)) - np.log(
        (good + prior) / np.maximum(n_good + weight - good - prior, 0.5)
    )
    keep = odds >= math.log(LEAST_FACTOR)
    tokens, scores, shares = tokens[keep], odds[keep], shares[keep]
    if not len(tokens):
        return blank
    mass_bad = min(float((shares * np.exp(scores)).sum()), 0.5)
    other = math.log((1 - mass_bad) / (1 - min(float(shares.sum()), 0.4)))
    other = min(other, -1e-3)
    model = Model(tokens, scores, other, _decay(scores, shares, other))

    # chance segments of texts that aren't toxic give the scale: their scaled best is exponential
    found = staged(
        sample.mapInArrow(_score(model), _SCORED).select("toxic", "weight", "n_tokens", "best", "sums"), "toxic-best"
    )
    fitted = found.where("toxic = 0 AND n_tokens > 0").agg(
        F.sum("weight").alias("n"),
        F.sum(F.col("weight") * F.col("n_tokens") * F.exp(-model.decay * F.col("best"))).alias("s"),
    ).first()
    scale = float(fitted["n"] / fitted["s"]) if fitted["s"] else 1.0

    chances = F.transform("sums", lambda s: F.greatest(scale * F.col("n_tokens") * F.exp(s * -model.decay), F.lit(1e-300)))
    surprise = F.least(
        F.aggregate(
            chances,
            F.lit(0.0), lambda so_far, c: so_far - F.when(c <= SIGNIFICANT, F.log(c)).otherwise(0.0),
        ),
        F.lit(_TOP_SURPRISE),
    )
    bins = found.groupBy(F.round(surprise, 1).alias("x")).agg(
        (F.sum(F.col("toxic") * F.col("weight")) / WHOLE).alias("bad"), (F.sum("weight") / WHOLE).alias("n")
    ).orderBy("x").toPandas()
    bad_n = bins["bad"].to_numpy(float)
    intercept, slope = _platt(bins["x"].to_numpy(float), bad_n, bins["n"].to_numpy(float) - bad_n)
    return Model(tokens, scores, other, model.decay, scale, intercept, slope)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, n_tokens, best, surprise, passages.

    passages lists every significant segment with its byte range in the lower-cased UTF-8 text, its
    score and how many as good are expected by chance. Texts without tokens, null ones too, have no
    segment and get the score of no surprise. Ids may repeat or be null; other columns are not
    looked at; an empty table gives no row.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("long").alias("weight"),
    )
    scored = rows.mapInArrow(_score(model), _SCORED)
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_tokens", "best", "surprise", "passages",
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the model doesn't predict as toxic; no shuffle."""
    at = docs.columns.index(text_col)
    scoring = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blank = pa.nulls(batch.num_rows, pa.int64())
            plain = pa.RecordBatch.from_arrays([blank, batch.column(at), blank, blank], names=["id", "text", "toxic", "weight"])
            found = [b.column("score").to_numpy() for b in scoring(iter([plain]))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
