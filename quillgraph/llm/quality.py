"""Quality rules by weak supervision.

Each rule looks at counts of one whole text and votes good (1), bad (-1) or
abstains (0). Nobody says which rules to trust: expectation-maximisation over the
counts of vote patterns estimates, for each rule, how often it is right on good texts
and on texts that are bad in one of a few ways (the families of the rules), and a
text's posterior probability of being good replaces an all-must-pass filter.

Spark counts the vote patterns over all rows. There are at most 3**len(RULES) of
them however many rows there are, and only those counts reach the driver, where
the estimate is made; a posterior is then a sum of log odds in plain columns.

Defined results: a null or empty text has no words and fails the base rules; an
empty table gives no rows and the prior accuracies; columns of the input that are
named like those added here are kept aside, as only ``text`` and ``doc_id`` are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored, whole_row
from quillgraph.llm.textops import CHUNK_BYTES, NOT_NEWLINE, SPACED_WORD, Words, byte_table, known_ids, mix64, runs, slices, span_hashes, sums, window_hashes, windows_within, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of the languages handled.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was with as be by this are or an at from "
    "de la le les et des en un une que pour dans qui du est au sur par pas "
    "der die und den von zu das mit sich ist ein eine nicht für auf im dem "
    "el los las por con para una se del al es su lo como más"
).split()

_SYMBOL = byte_table([(ord(c), ord(c)) for c in "#*$%&|<>"])
_DIGIT = byte_table([(0x30, 0x39)])
_UPPER = byte_table([(0x41, 0x5A)])
_STOP = byte_table([(ord(c), ord(c)) for c in ".!?\"':;)"])

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stopped_lines", "n_function_words", "n_distinct_words", "n_digits", "n_capitals")
FEATURE_TYPE = "struct<" + ",".join(f"{x}:bigint" for x in FEATURES) + ">"


def hashed(words: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array(sorted(set(words))))[2].hashes)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands elsewhere; the second array: where one stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    anywhere, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    anywhere[order[1:][same]] = True
    anywhere[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return anywhere, earlier


def _of_text(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix64(values ^ mix64(owner.astype(np.uint64), 7))


def count_block(texts: pa.Array, function_words: np.ndarray) -> list[np.ndarray]:
    """The counts of FEATURES for each text of a block."""
    data, offsets, words = words_of(texts)
    n = len(texts)
    owner = words.owners()
    symbols = sums(_SYMBOL[data], offsets)
    letters = sums(SPACED_WORD[data] & ((data & 0xC0) != 0x80), offsets)
    digits = sums(_DIGIT[data], offsets)
    capitals = sums(_UPPER[data], offsets)

    first, last = runs(data, offsets, NOT_NEWLINE)
    spoken = np.searchsorted(words.starts, last) > np.searchsorted(words.starts, first)
    first, last = first[spoken], last[spoken]
    of_line = np.searchsorted(offsets, first, side="right") - 1
    lines = np.bincount(of_line, minlength=n)
    _, earlier = _repeats(_of_text(span_hashes(data, first, last), of_line))
    dup_lines = np.bincount(of_line[earlier], minlength=n)
    end_word = np.searchsorted(words.starts, last) - 1
    stopped = np.bincount(of_line[_STOP[data[words.ends[end_word] - 1]]], minlength=n) if len(first) else np.zeros(n, np.int64)

    starts = windows_within(words.bounds, 3)
    covered = np.zeros(len(words.hashes) + 2, bool)
    if len(starts):
        again, _ = _repeats(_of_text(window_hashes(words.hashes, 3)[starts], owner[starts]))
        for k in range(3):
            covered[starts[again] + k] = True
    repeated = sums(covered[: len(words.hashes)], words.bounds)
    _, seen = _repeats(_of_text(words.hashes, owner))
    distinct = words.counts - sums(seen, words.bounds)
    functional = sums(known_ids(function_words, words.hashes) > 0, words.bounds)
    return [words.counts, letters, symbols, dup_lines, repeated, lines, stopped, functional, distinct, digits, capitals]


def counts(text: str = "text") -> Column:
    """A struct of the counts of FEATURES of the whole text."""
    known = hashed(FUNCTION_WORDS)

    @F.arrow_udf(FEATURE_TYPE)
    def count(texts: pa.Array) -> pa.Array:
        parts = [count_block(part, known) for _, part in slices(texts, CHUNK_BYTES)]
        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(len(FEATURES))]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(FEATURES))

    return count(F.col(text))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` does, else abstains; both are SQL over
    FEATURES. family: the way of being bad that it looks for."""

    name: str
    good: str
    bad: str
    family: str = "form"


#: Every ratio is guarded, so a text without words or lines makes no rule fail.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines", "repetition"),
    Rule("repeated_words", "10 * n_repeat_words < n_words", "100 * n_repeat_words > 30 * n_words", "repetition"),
    Rule("sentences", "10 * n_stopped_lines >= 7 * n_lines AND n_lines > 0", "10 * n_stopped_lines < 3 * n_lines"),
    Rule("function_words", "100 * n_function_words >= 8 * n_words AND n_words > 0", "100 * n_function_words < 2 * n_words"),
    Rule("variety", "n_words >= 50 AND 100 * n_distinct_words >= 35 * n_words", "n_words >= 50 AND 100 * n_distinct_words < 15 * n_words", "repetition"),
    Rule("digits", "100 * n_digits <= 3 * word_chars", "100 * n_digits > 20 * word_chars"),
    Rule("capitals", "100 * n_capitals <= 10 * word_chars", "100 * n_capitals > 30 * word_chars"),
)


#: Votes in the order in which an Accuracies table lists their probabilities.
VOTES = (1, -1, 0)


@dataclass(frozen=True)
class Accuracies:
    """Shares of the kinds of text, good ones first and then one kind for each family, and for
    each kind and rule the probabilities of VOTES."""

    shares: tuple[float, ...]
    tables: tuple[tuple[tuple[float, float, float], ...], ...]

    @property
    def prior(self) -> float:
        return self.shares[0]

    def right(self) -> list[float]:
        """How often each rule is right when it votes."""
        t, s = np.array(self.tables), np.array(self.shares)
        correct = s[0] * t[0, :, 0] + (s[1:, None] * t[1:, :, 1]).sum(axis=0)
        return list(correct / (s[:, None, None] * t[:, :, :2]).sum(axis=(0, 2)))


_GOOD, _BAD, _OTHER = (0.7, 0.03, 0.27), (0.3, 0.4, 0.3), (0.5, 0.1, 0.4)


def estimate(patterns: list[tuple[tuple[int, ...], int]], families: list[str], rounds: int = 300, tolerance: float = 1e-8) -> Accuracies:
    """Expectation-maximisation over (votes, count) patterns; families: of each rule.

    Texts without a bad vote start as good, others as bad in the ways whose rules say so. A bad
    vote is held to be no less likely on bad texts than on good ones, and a good
    vote no less on good ones, which settles which kind is which; a weak prior keeps a rule that
    never votes where it started. Abstaining is no evidence."""
    kinds = sorted(set(families))
    start = np.array([[_GOOD] * len(families), *[[_BAD if f == k else _OTHER for f in families] for k in kinds]])
    if not patterns:
        return Accuracies((0.8, *[0.2 / len(kinds)] * len(kinds)), _tuples(start))
    ordered = sorted(patterns)
    cast = np.array([v for v, _ in ordered], dtype=np.int8).reshape(len(ordered), len(families))
    n = np.array([c for _, c in ordered], dtype=np.float64)
    marks = np.stack([(cast == v).astype(float) for v in VOTES], axis=2)
    weak = max(1.0, 1e-3 * n.sum())
    against = np.stack([(cast[:, [f == k for f in families]] == -1).sum(axis=1) for k in kinds], axis=1)
    p = np.concatenate([np.where(against.sum(axis=1) == 0, 50.0, 0.5)[:, None], against + 0.05], axis=1)
    p /= p.sum(axis=1, keepdims=True)
    tables = start
    for _ in range(rounds):
        own = n[:, None] * p
        new = (np.einsum("ic,irv->crv", own, marks) + weak * start) / (own.sum(axis=0)[:, None, None] + weak)
        new[1:, :, 1] = np.maximum(new[1:, :, 1], new[0, :, 1])
        new[1:, :, 0] = np.minimum(new[1:, :, 0], new[0, :, 0])
        new[:, :, 2] = np.maximum(1e-6, 1 - new[:, :, 0] - new[:, :, 1])
        new /= new.sum(axis=2, keepdims=True)
        shares = np.maximum(own.sum(axis=0) / n.sum(), 0.01)
        shares = shares / shares.sum()
        moved = abs(new - tables).max()
        tables = new
        odds = np.log(shares) + np.einsum("irv,crv->ic", marks[:, :, :2], np.log(tables)[:, :, :2])
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if moved < tolerance:
            break
    return Accuracies(tuple(shares.tolist()), _tuples(tables))


def _tuples(tables: np.ndarray) -> tuple:
    return tuple(tuple(map(tuple, t)) for t in tables.tolist())


def votes(counts_column: str, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    import re

    def inside(sql: str) -> Column:
        return F.expr(re.sub(r"\b(" + "|".join(FEATURES) + r")\b", rf"{counts_column}.\1", sql))

    return [F.when(inside(r.good), 1).when(inside(r.bad), -1).otherwise(0) for r in rules]


def learn(counted: DataFrame, counts_column: str = "_counts", rules: tuple[Rule, ...] = RULES) -> Accuracies:
    names = [f"v{k}" for k in range(len(rules))]
    rows = counted.select(*[v.alias(x) for v, x in zip(votes(counts_column, rules), names, strict=True)]).groupBy(*names).count().collect()
    return estimate([(tuple(r[x] for x in names), r["count"]) for r in rows], [r.family for r in rules])


def posterior(accuracies: Accuracies, counts_column: str = "_counts", rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a text is good: one over the sum of the odds of each kind against good."""
    cast = votes(counts_column, rules)
    total = F.lit(1.0)
    for share, table in zip(accuracies.shares[1:], accuracies.tables[1:], strict=True):
        odds = F.lit(math.log(share / accuracies.shares[0]))
        for vote, good, bad in zip(cast, accuracies.tables[0], table, strict=True):
            odds = odds + F.when(vote == 1, math.log(bad[0] / good[0])).when(vote == -1, math.log(bad[1] / good[1])).otherwise(0.0)
        total = total + F.exp(odds)
    return 1 / total


def base_failed(counts_column: str = "_counts") -> Column:
    c = counts_column
    return F.expr(f"{c}.n_words < {MIN_WORDS} OR 100 * {c}.n_repeat_words > {MAX_REPEAT_PERCENT} * {c}.n_words")


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, the posterior ``quality`` and ``kept``, a row for each row of docs.

    The counts are stored once between the two passes; texts are read once."""
    counted = stored(docs.select("doc_id", counts("text").alias("_counts")), "quality")
    quality = posterior(learn(counted))
    failed = base_failed()
    return counted.select("doc_id", *[F.col(f"_counts.{x}").alias(x) for x in FEATURES], failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))


def kept(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text passes, with the columns of docs only. Rows are stored with
    their counts, so texts are counted once and no join on ids that may repeat is needed."""
    marked = stored(docs.select(whole_row(docs).alias("_row"), counts("text").alias("_counts")), "counted")
    return marked.where(~base_failed() & (posterior(learn(marked)) >= threshold)).select("_row.*")


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
