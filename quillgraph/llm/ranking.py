"""A quality classifier by Bradley-Terry ranking of preference pairs.

A document labelled good is preferred to one labelled bad. The model gives each text a
strength, linear in features of the whole text, and the probability that text i is preferred
to text j is the logistic function of the difference of their strengths, so its loss is the
logistic loss on differences of features. Strengths are fitted on all labelled rows: they are dealt to blocks,
tasks draw pairs in each block and sum the loss's derivatives, and the driver takes Newton steps with the sums.
Rows of the rarer label go to several blocks where they are too few for one each.

A quantile of the strengths of all labelled rows is the threshold (a rank within 1 in ACCURACY of them): by default the share of labelled rows that are
bad. A score is the logistic function of the strength, moved so that the threshold gets
``CUT``, with the slope of a logistic fit of the labels.

Features are medians away: each count or ratio is put on a scale by the median and the
spread of the labelled rows, and enters as it is and as its distance, as texts can be bad in
either direction. Scores need one pass over the texts, no shuffle and no id.

Defined results: null and empty texts are scored as texts without words; a null doc_id isn't
held out and has no label; labels that contradict each other for one doc_id, and null ones,
count for nothing; a labelled doc_id of several rows counts once; without rows of both labels
every text has the share of good labels as its score (0.5 without any); an empty table gives
no rows; other columns of the input are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.quality import FUNCTION_WORDS, count_block, hashed
from quillgraph.llm.tables import stored
from quillgraph.llm.textops import CHUNK_BYTES, slices

#: Labelled rows of the more frequent label in a block, rows of the other that it has at least, pairs for each row, pairs in all at least.
BLOCK, PARTNERS, EACH = 16_384, 1024, 10
PAIRS = 200_000
ACCURACY, BINS = 100_000, 4096
CUT = 0.3
#: Most that a feature may stand away from its median, in spreads.
FAR = 6.0


def feature_block(texts: pa.Array, function_words: np.ndarray) -> np.ndarray:
    """A row of features for each text of a block."""
    counts = [c.astype(np.float64) for c in count_block(texts, function_words)]
    words, letters, symbols, dup_lines, repeated, lines, stopped, functional, distinct, digits, capitals = counts
    w, c, n = np.maximum(words, 1), np.maximum(letters, 1), np.maximum(lines, 1)
    ratios = [letters / w, symbols / w, functional / w, repeated / w, distinct / w, dup_lines / n, stopped / n, digits / c, capitals / c]
    return np.stack([np.log1p(words), np.log1p(lines), np.log1p(words / n), *[np.sqrt(r) for r in ratios]], axis=1)


WIDTH = 12


@dataclass(frozen=True)
class Ranker:
    """strength = weights . (z, |z|) for z = (features - centre) / spread, clipped; score from threshold and slope.
    Without weights every score is ``constant``."""

    weights: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    threshold: float = 0.0
    slope: float = 1.0
    constant: float = 0.5
    cut: float = CUT

    def strengths(self, features: np.ndarray) -> np.ndarray:
        return _scaled(features, np.array(self.centre), np.array(self.spread)) @ np.array(self.weights)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.constant)
        odds = self.slope * (self.strengths(features) - self.threshold) + np.log(self.cut / (1 - self.cut))
        # a strength at the threshold must not fall below the cut by rounding
        return np.where(odds >= np.log(self.cut / (1 - self.cut)), np.maximum(_logistic(odds), self.cut), np.minimum(_logistic(odds), np.nextafter(self.cut, 0)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _scaled(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((features - centre) / spread, -FAR, FAR)
    return np.concatenate([z, np.abs(z)], axis=1)


def preference_pairs(quality: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of preferred and other rows: each row of the more frequent label about equally often, partners at random."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    return tuple(np.concatenate([rng.permutation(side) for _ in range(-(-pairs // len(side)))])[:pairs] for side in (good, bad))


def fit(features: np.ndarray, quality: np.ndarray, share: float | None = None, pairs: int = PAIRS, rounds: int = 400, ridge: float = 1e-3, cut: float = CUT, seed: int = 42) -> Ranker:
    """The ranker of labelled feature rows; share: the quantile of strengths below which texts are rejected."""
    if not len(quality):
        return Ranker(cut=cut)
    if quality.min() == quality.max():
        return Ranker(constant=float(quality.mean()), cut=cut)
    good = features[quality == 1]  # the usual text, whatever the share of bad ones
    centre = np.median(good, axis=0)
    low, high = np.quantile(good, [0.1, 0.9], axis=0)
    spread = np.maximum((high - low) / 2, 0.02)
    x = _scaled(features, centre, spread)
    preferred, other = preference_pairs(quality, pairs, seed)
    difference = x[preferred] - x[other]
    weights, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    for k in range(1, rounds + 1):  # Adam on the whole of the pairs
        gradient = ridge * weights - difference.T @ (1 - _logistic(difference @ weights)) / len(difference)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights = weights - 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    strength = x @ weights
    share = float((quality == 0).mean()) if share is None else share
    threshold = float(np.quantile(strength, share))
    slope = _slope(strength - threshold, quality, np.ones(len(quality)))
    return Ranker(tuple(weights.tolist()), tuple(centre.tolist()), tuple(spread.tolist()), threshold, slope, cut=cut)


def _slope(z: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    """The slope of P(good | strength) by Newton steps, for n rows of which ``good`` are good at each z."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * z + b)
        v = n * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * z * z).sum() + 1.0, (v * z).sum()], [(v * z).sum(), v.sum() + 1.0]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [((n * p - good) * z).sum() + (a - 1.0), (n * p - good).sum() + b])
        a = float(np.clip(a, 0.05, 20.0))
    return float(a)


def pair_sums(x: np.ndarray, quality: np.ndarray, weights: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Number of pairs, loss, its gradient and its second derivatives, summed over the pairs of a block of scaled features."""
    preferred, other = preference_pairs(quality, pairs, seed)
    difference = x[preferred] - x[other]
    odds = difference @ weights
    p = _logistic(odds)
    return np.concatenate([[len(odds), np.logaddexp(0, -odds).sum()], -difference.T @ (1 - p), (difference.T @ (difference * (p * (1 - p))[:, None])).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """The weights of least mean loss with a ridge; a step that doesn't lower it is halved."""
    weights, step, best, told = np.zeros(width), np.zeros(width), np.inf, None
    for _ in range(rounds):
        found = sums(weights + step)
        at = weights + step
        loss = found[1] / found[0] + ridge / 2 * at @ at
        if told is not None and not loss < best:
            step = step / 2
        else:
            arrived, weights, best, told = best - loss < 1e-7, at, loss, found
            if arrived:
                break
            gradient = told[2 : 2 + width] / told[0] + ridge * weights
            step = -np.linalg.solve(told[2 + width :].reshape(width, width) / told[0] + ridge * np.eye(width), gradient)
        if abs(step).max() < 1e-6:
            break
    return weights


def _dealt(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Blocks of rows (h, _features, _quality) as lists, in the order of h; every row is in a block, and every block has rows of both labels."""
    major = max(counts, key=lambda q: (counts[q], q))
    blocks = -(-counts[major] // BLOCK)
    copies = min(blocks, -(-PARTNERS * blocks // counts[1 - major]))
    home = F.pmod(F.col("h"), F.lit(blocks))
    places = F.when(F.col("_quality") == major, F.array(home)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(home + k, F.lit(blocks))))
    each = rows.select(F.explode(places).alias("block"), F.struct("h", "_quality", "_features").alias("r"))
    return stored(each.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("rows")).select("block", F.col("rows._quality").alias("quality"), F.flatten("rows._features").alias("features")), "blocks")


def fit_all(rows: DataFrame, share: float | None = None, cut: float = CUT, seed: int = 42) -> Ranker:
    """The ranker of labelled rows (h: a hash, _features, _quality) of any number."""
    counts = {r["_quality"]: r["count"] for r in rows.groupBy("_quality").count().collect()}
    known = sum(counts.values())
    if len(counts) < 2:
        return Ranker(constant=counts.get(1, 0) / known, cut=cut) if known else Ranker(cut=cut)
    limits = [F.percentile_approx(F.col("_features")[i], [0.1, 0.5, 0.9], ACCURACY).alias(f"f{i}") for i in range(WIDTH)]
    low, centre, high = np.array(rows.where("_quality = 1").agg(*limits).first()).T  # the usual text, whatever the share of bad ones
    spread = np.maximum((high - low) / 2, 0.02)
    blocks = _dealt(rows, counts)
    least = PAIRS // -(-max(counts.values()) // BLOCK)

    def sums(weights: np.ndarray) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, q, f in zip(batch.column("block").to_pylist(), batch.column("quality"), batch.column("features"), strict=True):
                    quality = q.values.to_numpy()
                    x = _scaled(f.values.to_numpy().reshape(-1, WIDTH), centre, spread)
                    both = (quality == 1).any() and (quality == 0).any()
                    found = pair_sums(x, quality, weights, max(EACH * len(quality), least), seed + block) if both else np.zeros(2 + len(weights) * (1 + len(weights)))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found.tolist()], pa.list_(pa.float64()))], names=["block", "sums"])

        # a row of 602 numbers for each block of over BLOCK rows
        return np.sum([r["sums"] for r in sorted(blocks.mapInArrow(of, "block bigint, sums array<double>").collect(), key=lambda r: r["block"])], axis=0)

    weights = newton(sums, 2 * WIDTH)
    ranker = Ranker(tuple(weights.tolist()), tuple(centre.tolist()), tuple(spread.tolist()), cut=cut)

    @F.arrow_udf("double")
    def strength(features: pa.Array) -> pa.Array:
        return pa.array(ranker.strengths(features.flatten().to_numpy().reshape(-1, WIDTH)))

    strengths = stored(rows.select("_quality", strength("_features").alias("s")), "strengths")
    place = (counts[0] / known if share is None else share) * (known - 1)
    below = int(min(place, known - 1))
    ranks = [(k + 0.5) / known for k in (below, min(below + 1, known - 1))]
    (one, two), first, last = strengths.agg(F.percentile_approx("s", ranks, ACCURACY), F.min("s"), F.max("s")).first()
    threshold = float(one + (two - one) * (place - below))
    width = max((last - first) / BINS, 1e-12)
    bins = sorted(tuple(r) for r in strengths.groupBy(F.floor((F.col("s") - first) / width).alias("bin")).agg(F.sum("_quality"), F.count("*")).collect())
    bin_, good, n = np.array(bins, dtype=np.float64).T
    return Ranker(ranker.weights, ranker.centre, ranker.spread, threshold, _slope(first + (bin_ + 0.5) * width - threshold, good, n), cut=cut)


def features(text: str = "text") -> Column:
    """The features of each whole text as an array."""
    known = hashed(FUNCTION_WORDS)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        flat = np.concatenate([np.zeros(0), *[feature_block(part, known).ravel() for _, part in slices(texts, CHUNK_BYTES)]])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32)), pa.array(flat))

    return of(F.col(text))


def score(ranker: Ranker, text: str = "text") -> Column:
    """The score of each whole text."""
    known = hashed(FUNCTION_WORDS)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *[ranker.scores(feature_block(part, known)) for _, part in slices(texts, CHUNK_BYTES)]]))

    return of(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int | None = None, share: float | None = None, cut: float = CUT) -> Ranker:
    """The ranker of all labelled rows that aren't held out. With ``sample``, of about that many by hash, fitted on the driver."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("_least"), F.max("quality").alias("_most"))
    own = own.where("_least = _most AND _least IN (0, 1)").select("doc_id", F.col("_least").cast("int").alias("_quality"))
    if sample is not None:  # a fraction of the 60-bit hashes; the sample is bounded by it, whatever the table's size
        own = own.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 4) < int(min(1.0, sample / max(own.count(), 1)) * 2**60))
    # features leave the text before rows are dealt; of repeated rows the one of least features, so that their number doesn't matter
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", features("text").alias("_features"))
    rows = known.join(own, "doc_id").groupBy("doc_id").agg(F.min(F.struct("_features", "_quality")).alias("r")).select(F.xxhash64("doc_id").alias("h"), "r._features", "r._quality")
    if sample is None:
        return fit_all(stored(rows, "labelled"), share, cut)
    found = sorted(rows.collect(), key=lambda r: r["h"])
    return fit(np.array([r["_features"] for r in found]).reshape(-1, WIDTH), np.array([r["_quality"] for r in found], dtype=np.int64), share, cut=cut)


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    own = docs.select("doc_id", held_out().alias("held_out"), score(ranker).alias("score"))
    return own.withColumn("predicted", F.when(F.col("score") >= ranker.cut, 1).otherwise(0))


def op11_pairwise_ranking(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels))
