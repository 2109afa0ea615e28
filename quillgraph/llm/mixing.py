"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell. Fitting starts with ``budget`` of each
cell's tokens and rakes the cells in turn to the target shares of each marginal, never
beyond the tokens that a cell has, until a sweep moves no cell by more than TOLERANCE of it, or for SWEEPS
sweeps, which bound the work; ``residuals`` tells how far each marginal then is from its target. A
cell's fitted tokens over its own are the probability with which its documents are
sampled, so no document is taken twice, a value with too few tokens is kept whole, and the
expected tokens have the target shares where there are enough. The draw is a hash of the
doc_id, so a run can be repeated.

A target spec names its values; whatever it doesn't name counts as OTHER. So there are at
most (sources + 1) * (languages + 1) * (topics + 1) cells, however many documents there
are, and only they reach the driver and are broadcast.

Defined results: a null or unnamed source, language or topic is OTHER; a null text has no
tokens and its cell's probability; targets of values that no token has are left out and
the rest scaled to 1; cells without tokens have probability 1; rows that repeat a doc_id
get the same draw; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import whole_row

OTHER = "other"
SWEEPS, TOLERANCE = 25, 1e-13
BUDGET = 0.8


def _even(names: list[str], rest: float) -> dict[str, float]:
    return {n: (1 - rest) / len(names) for n in names} | {OTHER: rest}


@dataclass(frozen=True)
class Targets:
    """Shares of the tokens; each dict sums to 1, OTHER included."""

    source: dict[str, float] = field(default_factory=lambda: _even([f"src{k}" for k in range(20)], 0.05))
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.52, "fr": 0.16, "de": 0.16, "es": 0.11, OTHER: 0.05})
    topic: dict[str, float] = field(default_factory=lambda: {"article": 0.72, "note": 0.2, "table": 0.05, OTHER: 0.03})


AXES = ("source", "lang", "topic")

#: What stands for a topic where a table has none: the form of the text.
TOPIC = "CASE WHEN text LIKE '% | %' THEN 'table' WHEN length(text) - length(replace(text, '\n', '')) >= 8 THEN 'article' ELSE 'note' END"


def fit(tokens: np.ndarray, targets: list[dict[str, float]], names: list[list[str]], sweeps: int = SWEEPS, budget: float = BUDGET) -> np.ndarray:
    """budget of the tokens, raked to the target shares of each axis, no cell beyond its tokens; names: the values along each axis."""
    fitted = tokens * budget
    total = fitted.sum()
    for _ in range(sweeps if total else 0):
        before = fitted
        for axis, (target, own) in enumerate(zip(targets, names, strict=True)):
            others = tuple(k for k in range(fitted.ndim) if k != axis)
            have = fitted.sum(axis=others)
            want = np.array([target.get(n, 0.0) for n in own]) * (tokens.sum(axis=others) > 0)
            factor = np.divide(want / want.sum() * total, have, out=np.zeros_like(have), where=have > 0)
            fitted = np.minimum(tokens, fitted * factor.reshape([-1 if k == axis else 1 for k in range(fitted.ndim)]))
        if (np.abs(fitted - before) <= TOLERANCE * before).all():
            break
    return fitted


def residuals(fitted: np.ndarray, targets: list[dict[str, float]], names: list[list[str]]) -> list[dict[str, float]]:
    """For each axis, by value, the fitted share of tokens less the target share."""
    out = []
    for axis, (target, own) in enumerate(zip(targets, names, strict=True)):
        have = fitted.sum(axis=tuple(k for k in range(fitted.ndim) if k != axis)) / max(fitted.sum(), 1e-300)
        out.append({n: float(h - target.get(n, 0.0)) for n, h in zip(own, have, strict=True)})
    return out


def _named(column: str, target: dict[str, float]) -> Column:
    value = F.col(column).cast("string")
    return F.when(value.isin(sorted(set(target) - {OTHER})), value).otherwise(F.lit(OTHER))


def draw(seed: int) -> Column:
    """A number from 0 to 1 (exclusive) from the doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def mixed(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None, seed: int = 7, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _probability and _kept."""
    targets = targets or Targets()
    spec = [targets.source, targets.lang, targets.topic]
    names = [sorted({*t, OTHER}) for t in spec]
    marked = docs.withColumn("_topic", topic if topic is not None else F.expr(TOPIC))
    marked = marked.withColumns({"_source": _named("source", spec[0]), "_lang": _named("lang", spec[1]), "_topic": _named("_topic", spec[2])})
    marked = marked.withColumn("_tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint"))
    cells = marked.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")).collect()
    tokens = np.zeros([len(n) for n in names])
    for row in cells:
        tokens[tuple(names[k].index(row[k]) for k in range(3))] = row["n"]
    fitted = fit(tokens, spec, names, sweeps, budget)
    rows = [(s, la, t, float(fitted[i, j, k] / tokens[i, j, k]) if tokens[i, j, k] else 1.0) for i, s in enumerate(names[0]) for j, la in enumerate(names[1]) for k, t in enumerate(names[2])]
    table = docs.sparkSession.createDataFrame(rows, "_source string, _lang string, _topic string, _probability double")
    out = marked.join(F.broadcast(table), ["_source", "_lang", "_topic"])
    return out.withColumn("_kept", draw(seed) < F.col("_probability"))


def op7_ipf_mixing(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source", "lang"), targets).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_probability", 9).alias("probability"), F.col("_kept").alias("kept")
    )


def sampled(docs: DataFrame, targets: Targets | None = None, seed: int = 7) -> DataFrame:
    """The sampled rows, with the columns of docs and ``mix_probability``."""
    packed = docs.select(whole_row(docs).alias("_row"), "doc_id", "text", "source", "lang")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "mix_probability"]
    return mixed(packed, targets, seed=seed).where("_kept").select(*kept, F.col("_probability").alias("mix_probability"))


def _oracle(sweeps: int = SWEEPS) -> str:
    """The same fitting, a step for each axis and sweep."""
    t = Targets()
    parts = []
    for axis in AXES:
        named = ", ".join(f"'{n}'" for n in getattr(t, axis) if n != OTHER)
        value = TOPIC if axis == "topic" else axis
        parts.append(f"CASE WHEN ({value}) IN ({named}) THEN ({value}) ELSE '{OTHER}' END AS {axis}")
    steps = [f"d AS MATERIALIZED (SELECT doc_id, {', '.join(parts)}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)"]
    for axis in AXES:
        values = ", ".join(f"('{n}', {w!r}::DOUBLE)" for n, w in getattr(t, axis).items())
        steps.append(f"want_{axis} AS (SELECT v.{axis}, w / sum(w) OVER () AS want FROM (VALUES {values}) v({axis}, w) WHERE v.{axis} IN (SELECT {axis} FROM d WHERE n_tokens > 0))")
    steps.append(f"c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS own, {BUDGET}::DOUBLE * sum(sum(n_tokens)) OVER () AS total FROM d GROUP BY ALL)")
    steps.append(f"f0 AS MATERIALIZED (SELECT *, own * {BUDGET}::DOUBLE AS f FROM c WHERE own > 0)")
    n = 0
    for _ in range(sweeps):
        for axis in AXES:
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT source, lang, topic, own, total, least(own, f * want * total / sum(f) OVER (PARTITION BY {axis})) AS f FROM f{n} JOIN want_{axis} USING ({axis}))")
            n += 1
    return f"""WITH {", ".join(steps)},
p AS (SELECT source, lang, topic, f / own AS p FROM f{n})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 1.0), 9) AS probability,
       ('0x' || substr(md5('7:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


ORACLE = _oracle()
