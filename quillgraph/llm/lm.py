"""Language-model scores: unigram counts of the whole training corpus, and a log-bilinear
neural model trained in numpy with noise-contrastive estimation.

Counting: every task sums the hashes of its training tokens, Spark sums those; the
counts are a table, however many distinct tokens there are.

Model: every token that occurs sqrt(N) / LEAST_PART times or more among the N training tokens
(LEAST at least) is an outcome of its own and all rarer ones are one outcome, within which a
token has its smoothed unigram share; so probabilities over all tokens sum to 1. The outcomes
grow with the corpus. An outcome w after tokens u, v has the score r_w . (a_u + b_v) + bias_w.
Beyond ONE_CLASS outcomes, which stand by frequency, they are split into classes, ranges whose roots of
shares sum to about one: frequent outcomes have small classes, which makes the fewest scores a token.
A class has a vector and a bias too, and an outcome's probability is that of its class
among classes times its own among its class, both normalised exactly by matrix products.
Training is one pass over all training texts, dealt by hash to ROUNDS rounds. In a round every task trains
the shared start on its texts of that round, minibatch by minibatch, telling observed tokens from NOISE drawn
from the unigram distribution for each GROUP of tokens; Spark then averages the rows that tasks have touched,
weighted by touches, and the average is the start of the next round. There are TASKS tasks for each core, whatever
the corpus, so the rows to average don't grow with the number of files. Scores differ between
layouts by what is averaged: on 10,000 documents the held-out log10 a token is 0.35 above the base
from one file and 0.21 or more above it from 32.

Scoring: the most frequent tokens, HEAD_WORDS or those that the model knows if they are more,
are broadcast with their counts; rarer tokens of a text are joined to the table of counts.

Defined results: null is read as empty text, which is one end token; a null doc_id has the
remainder of an empty string, 0, and so is training; with no training tokens N and V are 0,
each base term is log10(1), and the model is its start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored
from quillgraph.llm.textops import SPACED_WORD, mix64, slices, words_of

LEAST, LEAST_PART = 5, 100
ONE_CLASS = 512
HEAD_WORDS = 1 << 18
WIDTH = 16
NOISE, GROUP = 24, 32
ROUNDS, TASKS = 4, 1
BATCH = 4096
BLOCK = 4_000_000
ROWS = 512
#: Multiplications of a product that BLAS libraries do on one thread.
ONE_THREAD = 1 << 18

END = int(mix64(np.array([1], np.uint64), 101)[0])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 1


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in slices(batch.column(0), BLOCK):
            _, _, words = words_of(part, SPACED_WORD, lower=True)
            values, n = np.unique(words.hashes, return_counts=True)
            values, n = np.append(values, np.uint64(END)), np.append(n, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, c) of every token of the column ``text``, ends of texts included."""
    return texts.select("text").mapInArrow(_count_batches, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent tokens: sorted hashes, their counts, and the outcome (0: none) of those that the model knows."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, model_words: int | None = None, least: float = 0) -> None:
        known = np.lexsort((hashes, -counts))
        known = np.concatenate([known[hashes[known] == np.uint64(END)], known[hashes[known] != np.uint64(END)]])
        known = known[(counts[known] >= least) | (hashes[known] == np.uint64(END))][:model_words]
        outcome = np.zeros(len(hashes), np.int32)
        outcome[known] = np.arange(1, len(known) + 1)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.outcome = hashes[order], counts[order], outcome[order]
        self.size = len(known) + 1
        self.outcome_counts = np.bincount(outcome[outcome > 0], weights=counts[outcome > 0], minlength=self.size) if len(hashes) else np.zeros(1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is rarer than the head."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def sequence(texts: pa.Array, head: Head) -> tuple[np.ndarray, ...]:
    """For a block of texts, each followed by its end: hashes, places in the head, outcomes, the two
    contexts before each token (size: start of text) and the bounds of the texts."""
    _, _, words = words_of(texts, SPACED_WORD, lower=True)
    bounds = words.bounds + np.arange(len(words.bounds))
    hashes = np.insert(words.hashes, words.bounds[1:], np.uint64(END))
    place = head.find(hashes)
    outcome = np.where(place >= 0, head.outcome[np.maximum(place, 0)], 0) if len(head.hashes) else np.zeros(len(hashes), np.int32)
    one, two = np.full(len(outcome), head.size, np.int32), np.full(len(outcome), head.size, np.int32)
    one[1:], two[2:] = outcome[:-1], outcome[:-2]
    first = bounds[:-1]
    one[first] = head.size
    two[first] = head.size
    second = first[np.diff(bounds) > 1] + 1
    two[second] = head.size
    return hashes, place, outcome, one, two, bounds


def _summed(index: np.ndarray, *grads: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct indices and the sums of the rows of each."""
    order = np.argsort(index)
    ordered = index.take(order)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered.take(first), *[np.add.reduceat(x.take(order, axis=0), first, axis=0) for x in grads]


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q @ r, piece by piece: small products stay on the thread that asks for them, while the BLAS library would deal a
    large one to threads of its own, which wait for the cores that other tasks use."""
    rows = max(1, ONE_THREAD // r.size)
    out = np.empty((len(q), r.shape[1]), q.dtype)
    whole = len(q) - len(q) % rows
    if whole:
        np.matmul(q[:whole].reshape(-1, rows, q.shape[1]), r, out=out[:whole].reshape(-1, rows, r.shape[1]))
    if whole < len(q):
        np.matmul(q[whole:], r, out=out[whole:])
    return out


class _Softmax:
    """Logarithms of the softmax over outcomes of q . r + bias."""

    def __init__(self, r: np.ndarray, bias: np.ndarray) -> None:
        self.weights = np.ascontiguousarray(np.concatenate([r.T, bias[None, :]]))
        self.ones = np.ones(len(bias), np.float32)
        self.longest, self.bias = float((r * r).sum(axis=1).max()), float(np.abs(bias).max())

    def log_p(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """for each row of q (its last column is 1) the log at its place."""
        scores = _products(q, self.weights)
        if math.sqrt(float((q * q).sum(axis=1).max()) * self.longest) + self.bias > 60:  # they may overflow, or vanish all
            scores -= scores.max(axis=1, keepdims=True)
        own = scores[np.arange(len(at)), at]
        return own - np.log(np.exp(scores, out=scores) @ self.ones)


class Model:
    """a, b: vectors of the last and the last but one context; r, bias: of the outcomes; class_r, class_bias: of the classes, which are ranges of outcomes."""

    NAMES = ("a", "b", "r", "bias", "class_r", "class_bias")

    def __init__(self, size: int, noise: np.ndarray, width: int = WIDTH, one_class: int = ONE_CLASS) -> None:
        rng = np.random.default_rng(12345)
        self.size, self.width = size, width
        self.noise = (noise + 0.5) / (noise + 0.5).sum()
        root = np.sqrt(self.noise)
        starts = np.flatnonzero(np.diff(np.floor(np.cumsum(root) - root), prepend=-1)) if size > one_class else np.zeros(1, np.int64)
        self.bounds = np.append(starts, size)
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        self.class_noise = np.add.reduceat(self.noise, self.bounds[:-1])
        self.a, self.b = (rng.normal(0, 0.05, (size + 1, width)).astype(np.float32) for _ in range(2))
        self.r = rng.normal(0, 0.05, (size, width)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.class_r = rng.normal(0, 0.05, (len(self.class_noise), width)).astype(np.float32)
        self.class_bias = np.log(self.class_noise).astype(np.float32)

    def matrix(self) -> np.ndarray:
        """A row of 3 * width + 1 numbers for each outcome, the start of text and each class."""
        own = np.zeros((self.size + 1 + len(self.class_bias), 3 * self.width + 1), np.float32)
        w, n = self.width, self.size
        own[: n + 1, :w], own[: n + 1, w : 2 * w] = self.a, self.b
        own[:n, 2 * w : 3 * w], own[:n, -1] = self.r, self.bias
        own[n + 1 :, 2 * w : 3 * w], own[n + 1 :, -1] = self.class_r, self.class_bias
        return own

    def load(self, own: np.ndarray) -> None:
        w, n = self.width, self.size
        parts = own[: n + 1, :w], own[: n + 1, w : 2 * w], own[:n, 2 * w : 3 * w], own[:n, -1], own[n + 1 :, 2 * w : 3 * w], own[n + 1 :, -1]
        for name, part in zip(self.NAMES, parts, strict=True):
            setattr(self, name, part.astype(np.float32, order="C"))

    def train(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray, state: dict, rate: float = 0.08) -> None:
        """One pass of noise-contrastive estimation with AdaGrad; noise is shared within a group of tokens.
        state["touched"] counts how often each row of the matrix has been used."""
        rng = state.setdefault("rng", np.random.default_rng(777))
        sums = {n: state.setdefault(n, np.full_like(getattr(self, n), 1e-2)) for n in self.NAMES}
        touched = state.setdefault("touched", np.zeros(self.size + 1 + len(self.class_bias)))
        levels = [("r", "bias", self.noise, 0)] + ([("class_r", "class_bias", self.class_noise, self.size + 1)] if len(self.class_bias) > 1 else [])
        levels = [(vectors, bias, np.cumsum(noise), np.log(noise * NOISE).astype(np.float32), row) for vectors, bias, noise, row in levels]

        def step(names: tuple[str, ...], index: np.ndarray, *grads: np.ndarray) -> None:
            at, *summed = _summed(index, *grads)
            for name, grad in zip(names, summed, strict=True):
                own = getattr(self, name)
                total = sums[name].take(at, axis=0) + grad * grad
                sums[name][at] = total
                own[at] = own.take(at, axis=0) - np.float32(rate) * grad / np.sqrt(total)

        used: list[np.ndarray] = []
        for at in range(0, len(outcome), BATCH):
            w, u, v = outcome[at : at + BATCH], one[at : at + BATCH], two[at : at + BATCH]
            q = self.a.take(u, axis=0) + self.b.take(v, axis=0)
            groups = -(-len(w) // GROUP)
            padded = np.zeros((groups * GROUP, self.width), np.float32)
            padded[: len(w)] = q
            padded = padded.reshape(groups, GROUP, self.width)
            real = (np.arange(groups * GROUP) < len(w)).reshape(groups, GROUP, 1)
            dq = np.zeros_like(q)
            steps = []
            for vectors, bias, share, log_noise, row in levels:
                own_r, own_bias = getattr(self, vectors), getattr(self, bias)
                target = self.class_of[w] if row else w
                drawn = np.searchsorted(share, rng.random((groups, NOISE))).clip(0, len(share) - 1).astype(np.int32)
                rw, rn = own_r.take(target, axis=0), own_r.take(drawn, axis=0)
                seen = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, rw) + own_bias[target] - log_noise[target]))) - 1
                false = 1 / (1 + np.exp(-(padded @ rn.transpose(0, 2, 1) + (own_bias[drawn] - log_noise[drawn])[:, None, :]))) * real
                dq += seen[:, None] * rw + (false @ rn).reshape(-1, self.width)[: len(w)]
                index = np.concatenate([target, drawn.ravel()])
                steps.append(((vectors, bias), index, np.concatenate([seen[:, None] * q, (false.transpose(0, 2, 1) @ padded).reshape(-1, self.width)]), np.concatenate([seen, false.sum(axis=1).ravel()])))
                used.append(row + index)
            for x in ((("a",), u, dq), (("b",), v, dq), *steps):
                step(*x)
        touched += np.bincount(np.concatenate([one, two, *used]), minlength=len(touched))

    def log_p(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The natural log of the probability of each outcome after its contexts."""
        out = np.empty(len(outcome), np.float32)
        classes = self.class_of[outcome]
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(len(self.bounds)))
        among_classes = _Softmax(self.class_r, self.class_bias) if len(self.class_bias) > 1 else None
        q = np.ones((ROWS, self.width + 1), np.float32)
        for k, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if ends[k] == ends[k + 1]:
                continue
            within = _Softmax(self.r[lo:hi], self.bias[lo:hi])
            for at in range(ends[k], ends[k + 1], ROWS):
                own = order[at : min(at + ROWS, ends[k + 1])]
                np.add(self.a.take(one[own], axis=0), self.b.take(two[own], axis=0), out=q[: len(own), : self.width])
                out[own] = within.log_p(q[: len(own)], outcome[own] - lo)
                if among_classes is not None:
                    out[own] += among_classes.log_p(q[: len(own)], classes[own])
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a model of one class: scores of outcomes by each context, bias in the first, and the log partition sum of every pair of contexts."""
        first, second = self.a @ self.r.T + self.bias, self.b @ self.r.T
        log_sum = np.empty((self.size + 1, self.size + 1), np.float32)
        for u in range(self.size + 1):
            scores = first[u] + second
            top = scores.max(axis=1, keepdims=True)
            log_sum[u] = (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[:, 0]
        return first, second, log_sum


def most_frequent(counts: DataFrame, most: int, always: float = math.inf) -> DataFrame:
    """The end token, the tokens that occur ``always`` times and the tokens of the most frequent classes of counts
    (a sixteenth of a doubling wide) that are ``most`` tokens together at most. The classes are counted first,
    of which there are under 1,024, so no task sorts the tokens."""
    step = F.floor(16 * F.log2(F.col("c")))
    classes = counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()
    least, room = 1024, most
    for row in sorted(classes, key=lambda r: -r["k"]):
        room -= row["n"]
        if room < 0:
            break
        least = row["k"]
    return counts.where((step >= least) | (F.col("c") >= always) | (F.col("h") == np.array(END, np.uint64).view(np.int64).item()))


def learn(texts: DataFrame, counts: DataFrame, model_words: int | None = None, head_words: int = HEAD_WORDS) -> tuple[Head, Model]:
    """The head of the counts and the model, trained on every text."""
    spark = texts.sparkSession
    total = counts.agg(F.sum("c")).first()[0] or 0
    least = max(LEAST, math.sqrt(total) / LEAST_PART)
    top = most_frequent(counts, head_words, least if model_words is None else math.inf).toArrow()
    head = Head(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.float64), model_words, least if model_words is None else 0)
    noise = head.outcome_counts.copy()
    noise[0] = total - noise[1:].sum()
    model = Model(head.size, noise)
    small = Head(head.hashes[head.outcome > 0], head.counts[head.outcome > 0])
    names = [f"x{k}" for k in range(3 * model.width + 1)]
    tasks = max(1, TASKS * spark.sparkContext.defaultParallelism)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((small, noise, model.matrix()))

        def trained(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, noise, begin = sent.value
            model = Model(own.size, noise)
            model.load(begin)
            state: dict = {}
            for batch in batches:
                for _, part in slices(batch.column(0), BLOCK):
                    _, _, outcome, one, two, _ = sequence(part, own)
                    model.train(outcome, one, two, state)
            if "touched" in state:
                weight, rows = state["touched"], model.matrix()
                state.clear()
                used = np.flatnonzero(weight)
                for at in range(0, len(used), ROWS):
                    i = used[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(weight[i]), *[pa.array(np.ascontiguousarray(x)) for x in rows[i].T]], names=["i", "w", *names])

        own_texts = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(ROUNDS)) == turn).select("text")
        rows = own_texts.coalesce(tasks).mapInArrow(trained, "i int, w double, " + ", ".join(f"{n} float" for n in names)).groupBy("i").agg(*[(F.sum(F.col(n) * F.col("w")) / F.sum("w")).cast("float").alias(n) for n in names]).toArrow()
        if rows.num_rows:
            matrix = model.matrix()
            at = rows.column("i").to_numpy()
            for k, n in enumerate(names):
                matrix[at, k] = rows.column(n).to_numpy()
            model.load(matrix)
        sent.destroy()
    return head, model


SCORED = "struct<n_tokens:bigint,n_known:bigint,base:double,model:double,rare:array<bigint>,n_other:bigint>"


def _scored(spark, head: Head, model: Model, text: str) -> Column:
    """For each text: tokens, those of the head, their sum of log10(c + 0.5), the model's log10 of
    the outcomes with log10(c + 0.5) of the head's other tokens, the rarer tokens, and how many tokens the model doesn't know."""
    sent = spark.sparkContext.broadcast((head, model))

    @F.arrow_udf(SCORED)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, model = sent.value
        weight = np.log10(own.counts + 0.5)
        for texts in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for _, part in slices(texts, BLOCK):
                hashes, place, outcome, one, two, bounds = sequence(part, own)
                known = place >= 0
                base = np.where(known, weight[np.maximum(place, 0)], 0.0) if len(weight) else np.zeros(len(place))
                log_p = model.log_p(outcome, one, two).astype(np.float64) / math.log(10)
                log_p += np.where(outcome == 0, base, 0.0)

                def by_text(x: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                    return np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else x[:0]

                for k, x in enumerate((np.diff(bounds), by_text(known.astype(np.int64)), by_text(base), by_text(log_p), hashes[~known], by_text((~known).astype(np.int64)))):
                    parts[k].append(x)
                parts.append([by_text((outcome == 0).astype(np.int64))])
            n, known, base, log_p, rare, n_rare = (np.concatenate(x) if x else np.zeros(0) for x in parts[:6])
            other = np.concatenate([x[0] for x in parts[6:]]) if len(parts) > 6 else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32))
            columns = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(log_p.astype(np.float64)), pa.ListArray.from_arrays(offsets, pa.array(rare.astype(np.uint64).view(np.int64))), pa.array(other.astype(np.int64))]
            yield pa.StructArray.from_arrays(columns, names=["n_tokens", "n_known", "base", "model", "rare", "n_other"])

    return score(F.col(text))


def scores(docs: DataFrame, model_words: int | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    own = docs.select("doc_id", "text", held_out().alias("held_out"))
    training = own.where("NOT held_out").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(token_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head, model = learn(training, counts, model_words, head_words)
    other_words = distinct - (model.size - 1)
    other = total - head.outcome_counts[1:].sum() + 0.5 * (other_words + 1)
    scored = stored(own.select("doc_id", "held_out", _scored(docs.sparkSession, head, model, "text").alias("s")).withColumn("id", F.monotonically_increasing_id()), "scored")

    # rarer tokens: once for each text, token and their number, joined to the counts
    rare = scored.select("id", F.explode("s.rare").alias("h")).groupBy("id", "h").agg(F.count("*").alias("n"))
    weighed = rare.join(counts, "h", "left").groupBy("id").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    out = scored.join(weighed, "id", "left")
    rare_score = F.coalesce("rare_score", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "s.n_tokens",
        (F.col("s.n_known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("s.base") + rare_score - F.col("s.n_tokens") * math.log10(total + 0.5 * (distinct + 1))).alias("base_score"),
        (F.col("s.model") + rare_score - F.col("s.n_other") * math.log10(other)).alias("score"),
    )


def op4_log_bilinear(docs: DataFrame) -> DataFrame:
    return scores(docs)
