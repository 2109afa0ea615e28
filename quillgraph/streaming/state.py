"""Streams with state by key: records folded as they arrive, and inferred edges that expire.

State lives in Spark's state store under the query's checkpoint, so a restart goes on where it stopped. Keys are dealt by
hash; a key's state is a few numbers however many changes it has had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.timeutil import EDGE_TTL_DAYS
from quillgraph.operators.relations import KEY

HELD = "id string, ordinal bigint, version int"
EDGE_STATE = "source string, target string, type string, state string, created_at timestamp"


def held_stream(changes: DataFrame) -> DataFrame:
    """id, ordinal, version of each id whenever a batch changes what it holds: what ``lifecycle.folded`` gives of all changes so
    far (id, ordinal, edited), if ordinals grow from batch to batch. A stale write changes nothing and gives no row.

    changes may be a stream or, in tests, a table."""

    def fold(key: tuple[str], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        edited, ordinal, version = state.get if state.exists else (None, None, 0)
        before = version
        rows = pd.concat(list(frames)).sort_values("ordinal", kind="stable")
        for nth, stamp in zip(rows["ordinal"], rows["micros"], strict=True):
            stamp = None if pd.isna(stamp) else int(stamp)
            if stamp is None or edited is None or stamp >= edited:
                edited, ordinal, version = stamp, int(nth), version + 1
        state.update((edited, ordinal, version))
        if version > before:
            yield pd.DataFrame({"id": [key[0]], "ordinal": [ordinal], "version": [version]})

    own = changes.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), F.unix_micros(F.col("edited").cast("timestamp")).alias("micros"))
    return own.groupBy("id").applyInPandasWithState(fold, HELD, "edited bigint, ordinal bigint, version int", "update", "NoTimeout")


def edge_life(edges: DataFrame, ttl_days: float = EDGE_TTL_DAYS, late: str = "1 day") -> DataFrame:
    """source, target, type, state (alive or expired), created_at: an inferred edge (created_at) when it is made or made again, and
    once when the stream's time has passed its time to live. Explicit edges, and those without a time, only come alive.

    The time of the stream is the watermark of created_at, so a batch that runs again expires the same edges. Edges older
    than the watermark (``late``) are dropped."""
    ttl = int(ttl_days * 86_400_000)

    def live(key: tuple[str, str, str], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def row(kind: str, millis: int | None) -> pd.DataFrame:
            stamp = pd.Timestamp(millis, unit="ms") if millis is not None else pd.NaT
            return pd.DataFrame({"source": [key[0]], "target": [key[1]], "type": [key[2]], "state": [kind], "created_at": pd.Series([stamp], dtype="datetime64[ns]")})

        if state.hasTimedOut:
            (millis,) = state.get
            state.remove()
            yield row("expired", millis)
            return
        rows = pd.concat(list(frames))
        newest = rows["millis"].max()
        if (rows["kind"] != "inferred").any() or pd.isna(newest) or ttl <= 0:
            if state.exists:
                state.remove()
            yield row("alive", None if pd.isna(newest) else int(newest))
            return
        newest = max(int(newest), state.get[0] if state.exists else int(newest))
        if newest + ttl <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row("expired", newest)
            return
        state.update((newest,))
        state.setTimeoutTimestamp(newest + ttl)
        yield row("alive", newest)

    own = edges.withWatermark("created_at", late).select(*KEY, "kind", "created_at", F.unix_millis("created_at").alias("millis"))
    return own.groupBy(*KEY).applyInPandasWithState(live, EDGE_STATE, "millis bigint", "update", "EventTimeTimeout")
