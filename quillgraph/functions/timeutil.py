"""Ages and decays at a given ``as_of``; nothing here reads the clock."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HALF_LIVES = {"rule": 365.0, "decision": 180.0, "architecture": 180.0, "pattern": 180.0, "task": 30.0, "incident": 30.0, "bug": 30.0, "default": 60.0}
RECENCY_DAYS = 30.0
EDGE_TTL_DAYS = 30
HOP_PENALTY = 0.5


def rounded(value: Column, digits: int = 3) -> Column:
    """Half up, with a nudge of 5e-10, so that sums that are equal but for their last bits round alike."""
    return F.round(value + 5e-10, digits)


def parsed(text: Column | str) -> Column:
    """An ISO-8601 string as a timestamp; null if it isn't one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(column)


def age_days(stamp: Column, as_of: str | Column) -> Column:
    """Days from the stamp to as_of, 0 for later stamps, null for null."""
    now = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    days = (F.unix_micros(now) - F.unix_micros(stamp.cast("timestamp"))) / 86_400_000_000.0
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0.0)))


def age_stamp(*stamps: Column | str) -> Column:
    """The first stamp that is there, of columns in order of trust; strings that aren't times count as missing."""
    return F.coalesce(*[F.try_to_timestamp(F.col(s).cast("string")) if isinstance(s, str) else s.cast("timestamp") for s in stamps])


def recency(stamp: Column, as_of: str | Column) -> Column:
    return F.coalesce(F.exp(-age_days(stamp, as_of) / RECENCY_DAYS), F.lit(0.0))


def half_life(kind: Column, overrides: Mapping[str, float] | None = None) -> Column:
    table = {**HALF_LIVES, **(overrides or {})}
    return weighted(kind, table, table["default"])


def weighted(value: Column, table: Mapping[str, float], other: float) -> Column:
    """The number of a name, else ``other``; one flat CASE."""
    cases = [(n, w) for n, w in table.items() if w != other]
    if not cases:
        return F.lit(float(other))
    out = F.when(value == cases[0][0], F.lit(float(cases[0][1])))
    for name, weight in cases[1:]:
        out = out.when(value == name, F.lit(float(weight)))
    return out.otherwise(F.lit(float(other)))


def freshness(kind: Column, stamp: Column, as_of: str | Column, overrides: Mapping[str, float] | None = None) -> Column:
    """0.5 ** (age / half-life of the kind); 1 without a stamp or for a half-life of 0 or less."""
    days = half_life(kind, overrides)
    factor = F.pow(F.lit(0.5), age_days(stamp, as_of) / F.greatest(days, F.lit(1e-9)))
    return F.when(stamp.isNull() | (days <= 0), F.lit(1.0)).otherwise(factor)


def hop_penalized(score: Column, hop: int | Column, penalty: float = HOP_PENALTY) -> Column:
    if penalty <= 0:
        return score
    beyond = F.greatest((F.lit(hop) if isinstance(hop, int) else hop) - 1, F.lit(0))
    return score * F.pow(F.lit(float(penalty)), beyond)


def edge_alive(kind: Column, created: Column, as_of: str | Column, ttl_days: float = EDGE_TTL_DAYS) -> Column:
    """Explicit edges live on; inferred ones for ttl_days, or for ever without a stamp or with a ttl of 0 or less."""
    if ttl_days <= 0:
        return F.lit(True)
    return (kind != "inferred") | created.isNull() | (age_days(created, as_of) <= float(ttl_days))
