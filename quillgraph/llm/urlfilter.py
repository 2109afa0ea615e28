"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Rules are columns: the longest that fits wins. URLs that no rule judges are compared under
two variable-order Markov models of characters, one of accepted and one of rejected
URLs: a context's counts are mixed with those of the next shorter one (Witten-Bell
smoothing, down to a uniform distribution over bytes), so long contexts count where they
were seen often. The difference of log-likelihoods, divided by the length, is
calibrated on labelled URLs that the models haven't seen.

The models count the characters of all distinct labelled URLs with an even hash, in tasks; those with an odd one calibrate, all
of them, as counts of ratios rounded to a thousandth. URLs are labelled by the rules, so the models learn what the rules' URLs look like. What reaches
the driver and is broadcast is the model: of each order the CONTEXTS most frequent contexts at most, by powers of two of their
counts; a text's character after another context has the probability that the next shorter one gives.

Defined results: a null url, or one without ``://``, has empty host and path and fits no
rule; an empty url has ratio 0; without labelled URLs of both kinds every ratio is 0, and
what no rule judges is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored
from quillgraph.llm.textops import block_of, mix64, slices

ORDER = 5
CONTEXTS = 1 << 16
#: Bytes of URLs whose contexts are held at once.
BLOCK = 500_000


@dataclass(frozen=True)
class Rule:
    """A rule for a host and its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    rest = F.expr(f"substring({url}, nullif(locate('://', {url}), 0) + 3)")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    rest = F.expr(f"substring({url}, nullif(locate('://', {url}), 0) + 3)")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits as a struct of name and verdict, else null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)) & F.col(path).startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


class Markov:
    """Counts of characters (UTF-8 bytes) after contexts of 0 to ORDER characters, keyed by hash."""

    def __init__(self, urls: list[str], order: int = ORDER) -> None:
        self.order, self.sampled = order, len(urls)
        self.tables = []
        for context, keys, counts in self.counted(pa.array(urls, pa.string()), order):
            owners, of = np.unique(context, return_inverse=True) if len(context) else (context, context.astype(np.int64))
            total = np.bincount(of, counts, len(owners))
            kinds = np.bincount(of, minlength=len(owners)).astype(np.float64)
            self.tables.append((keys, counts.astype(np.float64), owners, total, kinds))

    @classmethod
    def of_tables(cls, tables: list[tuple[np.ndarray, ...]], sampled: int) -> Markov:
        """The model of ``sampled`` URLs whose counts are known: for each order keys, counts, owners, total and kinds as above, keys and owners ascending."""
        found = cls([], -1)
        found.order, found.sampled, found.tables = len(tables) - 1, sampled, tables
        return found

    @classmethod
    def counted(cls, urls: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For contexts of 0 to ``order`` characters: the context of each distinct pair of it and a character, the pair, how often it stands."""
        data, start = cls._bytes(urls)
        for length in range(order + 1):
            context = cls._contexts(data, start, length)
            keys, first, counts = np.unique(mix64(context ^ (data.astype(np.uint64) + np.uint64(1)), 53), return_index=True, return_counts=True)
            yield context[first], keys, counts

    @staticmethod
    def _bytes(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and for each how many of its own url stand before it (at most 255 matter)."""
        data, offsets = block_of(urls)
        return data, np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))

    @staticmethod
    def _contexts(data: np.ndarray, before: np.ndarray, length: int) -> np.ndarray:
        """A hash of the last ``length`` bytes before each byte; where a url has begun, of fewer and the start."""
        out = np.full(len(data), np.uint64(length + 1))
        for back in range(1, length + 1):
            shifted = np.zeros(len(data), np.uint64)
            shifted[back:] = data[:-back].astype(np.uint64) + np.uint64(1)
            shifted[before < back] = 0
            out = mix64(out ^ shifted, 59)
        return out

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_likelihoods(self, urls: pa.Array) -> np.ndarray:
        """log likelihood of each url."""
        data, before = self._bytes(urls)
        p = np.full(len(data), 1 / 256)
        for length, (keys, counts, owners, total, kinds) in enumerate(self.tables):
            context = self._contexts(data, before, length)
            n = self._look(owners, total, context)
            t = self._look(owners, kinds, context)
            c = self._look(keys, counts, mix64(context ^ (data.astype(np.uint64) + np.uint64(1)), 53))
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        _, offsets = block_of(urls)
        sums = np.concatenate([[0.0], np.cumsum(np.log(p))])
        return sums[offsets[1:]] - sums[offsets[:-1]]


@dataclass
class Ratio:
    """Models of accepted and rejected URLs, and a calibration of their ratio to a probability."""

    accepted: Markov
    rejected: Markov
    slope: float
    offset: float

    def ratios(self, urls: pa.Array) -> np.ndarray:
        """Length-normalised difference of log-likelihoods, in nats a byte; positive for accepted."""
        _, offsets = block_of(urls)
        return (self.accepted.log_likelihoods(urls) - self.rejected.log_likelihoods(urls)) / np.maximum(np.diff(offsets), 1)

    def probability(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ratio + self.offset, -500, 500)))


def _calibrated(ratio: np.ndarray, accepted: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """slope and offset of a logistic fit, both classes weighted alike, by Newton's method with a weak prior; counts: how often each row stands."""
    x = np.stack([ratio, np.ones_like(ratio)], axis=1)
    counts = np.ones(len(ratio)) if counts is None else counts
    weight = counts * np.where(accepted, 0.5 / max(1, counts[accepted].sum()), 0.5 / max(1, counts[~accepted].sum()))
    beta, prior = np.array([1.0, 0.0]), np.diag([1e-4, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - accepted)) + prior @ (beta - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + prior, gradient)
        beta = beta - np.clip(step, -10, 10)
        if abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def fit(accepted: list[str], rejected: list[str], order: int = ORDER) -> Ratio | None:
    """A ratio from labelled URLs: of each kind even places train and odd ones calibrate; None if a kind is missing."""
    if not accepted or not rejected:
        return None
    found = Ratio(Markov(accepted[::2], order), Markov(rejected[::2], order), 1.0, 0.0)
    good, bad = found.ratios(pa.array(accepted[1::2], pa.string())), found.ratios(pa.array(rejected[1::2], pa.string()))
    if len(good) and len(bad):
        found.slope, found.offset = _calibrated(np.concatenate([good, bad]), np.concatenate([np.ones(len(good), bool), np.zeros(len(bad), bool)]))
    return found


def hash_limit(own: DataFrame, sample: int, bits: int = 16) -> int | None:
    """A limit of hashes (``h``) below which at most ``sample`` rows lie, and at least half as many if there are; null: all fit.

    Counts by ranges of the first bits, then, inside the range in which the sample ends, by ranges of the next bits,
    so a table of any size has a sample. Each count has at most 2**bits rows."""
    low, shift, room = -(1 << 63), 64, sample
    while shift > 0:
        shift = max(0, shift - bits)
        part = F.shiftright("h", shift)
        inside = own if shift + bits >= 64 else own.where((F.col("h") >= low) & (F.col("h") <= low + (1 << (shift + bits)) - 1))
        sizes = sorted((r["part"], r["n"]) for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        for k, n in sizes:
            if n > room:
                low = k << shift
                break
            room -= n
        else:
            return None if shift + bits >= 64 else low + (1 << (shift + bits))
        if 2 * room <= sample:
            break
    return low


def _counts(urls: DataFrame, order: int) -> DataFrame:
    """verdict, length, context, gram, n: how often each character stands after each context in ``url`` (and ``verdict``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for verdict in ("allow", "block"):
                own = batch.column("url").filter(pc.equal(batch.column("verdict"), verdict))
                for _, part in slices(own, BLOCK):
                    for length, (context, grams, n) in enumerate(Markov.counted(part, order)):
                        yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(n), pa.string()), pa.array(np.full(len(n), length, np.int32)), pa.array(context.view(np.int64)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["verdict", "length", "context", "gram", "n"])

    found = urls.select("verdict", "url").mapInArrow(count, "verdict string, length int, context bigint, gram bigint, n bigint")
    return found.groupBy("verdict", "length", "context", "gram").agg(F.sum("n").alias("n"))


def _models(urls: DataFrame, sizes: dict[str, int], order: int, most: int) -> list[Markov]:
    """The models of accepted and of rejected URLs, from all of ``urls``; ``most`` contexts of each order."""
    grams = stored(_counts(urls, order), "grams")
    contexts = stored(grams.groupBy("verdict", "length", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).withColumn("level", F.floor(F.log2("total")).cast("int")), "contexts")
    room, least = {}, {}
    for r in sorted(contexts.groupBy("verdict", "length", "level").count().collect(), key=lambda r: -r["level"]):
        of = r["verdict"], r["length"]
        room[of] = room.get(of, most) - r["count"]
        if room[of] >= 0:
            least[of] = r["level"]
    frequent = F.lit(False)
    for (verdict, length), level in least.items():
        frequent |= (F.col("verdict") == verdict) & (F.col("length") == length) & (F.col("level") >= level)
    kept = contexts.where(frequent)
    owners, pairs = kept.toArrow(), grams.join(kept.select("verdict", "length", "context"), ["verdict", "length", "context"], "left_semi").toArrow()
    found = []
    for verdict in ("allow", "block"):
        tables = []
        for length in range(order + 1):
            (of, total, kinds), (keys, n) = ([t.column(c).to_numpy() for c in names] for t, names in ((x.filter((pc.field("verdict") == verdict) & (pc.field("length") == length)), names) for x, names in ((owners, ("context", "total", "kinds")), (pairs, ("gram", "n")))))
            of, keys = of.view(np.uint64), keys.view(np.uint64)
            one, two = np.argsort(keys), np.argsort(of)
            tables.append((keys[one], n[one].astype(np.float64), of[two], total[two].astype(np.float64), kinds[two].astype(np.float64)))
        found.append(Markov.of_tables(tables, sizes[verdict]))
    return found


def learn(judged: DataFrame, sample: int | None = None, order: int = ORDER, most: int = CONTEXTS) -> Ratio | None:
    """A ratio from all distinct ``url`` with a ``verdict`` (allow, block or null). With ``sample``, from so many of each kind at most,
    those of least hash, fitted on the driver."""
    own = judged.where("verdict IN ('allow', 'block') AND url IS NOT NULL").select("verdict", "url").distinct().withColumn("h", F.xxhash64("url"))
    if sample is not None:
        kinds = []
        for verdict in ("allow", "block"):
            kind = own.where(F.col("verdict") == verdict)
            limit = hash_limit(kind, sample)
            rows = (kind if limit is None else kind.where(F.col("h") < limit)).select("h", "url").toArrow()
            kinds.append([url for _, url in sorted(zip(rows.column("h").to_pylist(), rows.column("url").to_pylist(), strict=True))])
        return fit(*kinds, order)
    own = stored(own, "urls")
    sizes = {(r["verdict"], r["odd"]): r["count"] for r in own.groupBy("verdict", (F.col("h").bitwiseAND(1) == 1).alias("odd")).count().collect()}
    if {verdict for verdict, _ in sizes} != {"allow", "block"}:
        return None
    train = F.col("h").bitwiseAND(1) == 0
    for verdict in ("allow", "block"):  # a kind of few URLs may have none with an even hash
        if (verdict, False) not in sizes:
            sizes[verdict, False] = sizes.pop((verdict, True))
            train |= F.col("verdict") == verdict
    found = Ratio(*_models(own.where(train), {v: sizes[v, False] for v in ("allow", "block")}, order, most), 1.0, 0.0)
    rest = own.where(~train).select("verdict", F.round(ratio_of(own.sparkSession, found).ratio, 3).alias("ratio")).groupBy("verdict", "ratio").count().toArrow()
    accepted = np.array([v == "allow" for v in rest.column("verdict").to_pylist()], bool)
    if accepted.any() and not accepted.all():
        by = np.argsort(rest.column("ratio").to_numpy(), kind="stable")
        found.slope, found.offset = _calibrated(rest.column("ratio").to_numpy()[by], accepted[by], rest.column("count").to_numpy()[by].astype(np.float64))
    return found


def ratio_of(spark, model: Ratio | None, url: str = "url") -> Column:
    """A struct of the ratio and the calibrated probability that a URL is one of the accepted."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<ratio:double,probability:double>")
    def ratios(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for urls in batches:
            parts = [own.ratios(p) if own else np.zeros(len(p)) for _, p in slices(urls, BLOCK)]
            ratio = np.concatenate([np.zeros(0), *parts])
            probability = own.probability(ratio) if own else np.full(len(ratio), 0.5)
            yield pa.StructArray.from_arrays([pa.array(ratio), pa.array(probability)], names=["ratio", "probability"])

    return ratios(F.col(url))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with _host, _path, _rule, _ratio, _probability and _verdict."""
    placed = pages.withColumns({"_host": host_of(), "_path": path_of()}).withColumn("_rule", rule_of("_host", "_path", rules))
    model = learn(placed.select("url", F.col("_rule.verdict").alias("verdict")), sample)
    scored = placed.withColumn("_r", ratio_of(pages.sparkSession, model))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_r.probability") >= threshold, "allow").otherwise("block"))
    return scored.withColumns({"_verdict": verdict, "_ratio": F.col("_r.ratio"), "_probability": F.col("_r.probability")})


def op8_url_ratio(pages: DataFrame) -> DataFrame:
    found = judged(pages.select("page_id", "url"))
    return found.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_ratio").alias("ratio"), F.col("_probability").alias("probability"))
