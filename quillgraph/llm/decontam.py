"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents as a task reads them, up to ``CHUNK_BYTES`` of
text. Its words become symbols of the benchmark's vocabulary, anything else a
separator; stretches shorter than the shortest phrase cannot hold one and are left
out of the index. Every benchmark window of 13 words (or a whole shorter item) is
searched backward through wavelet-tree ranks, its occurrences are located by sampled
suffix positions and merged to removal spans. Documents never leave their rows:
there is no shuffle, and the work per byte doesn't depend on how many documents or
copies share a passage.

The benchmark's windows are handed out in blocks of at most ``BLOCK_WORDS`` words; a
larger benchmark makes more blocks, each searched in the same pass over the text.

Defined results: null and wordless texts have no words, no hits, and are not
contaminated; an empty benchmark hits nothing; items without words have no window;
repeated items count once by item_id, and an item whose id is null hits but isn't listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.fmindex import FMIndex
from quillgraph.llm.tables import whole_row
from quillgraph.llm.textops import ALNUM_WORD, CHUNK_BYTES, known_ids, slices, words_of

WINDOW = 13
BLOCK_WORDS = 500_000
KEPT = 4
HIT = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


class Phrases:
    """The distinct windows of a block of items, as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        _, _, words = words_of(texts, ALNUM_WORD, lower=True)
        self.vocabulary = np.unique(words.hashes)
        symbols = known_ids(self.vocabulary, words.hashes)
        of: dict[bytes, set[str]] = {}
        by_length: dict[int, dict[bytes, None]] = {}
        for k, (item, _) in enumerate(items):
            own = symbols[words.bounds[k] : words.bounds[k + 1]]
            width = min(window, len(own))
            for at in range(len(own) - width + 1 if width else 0):
                key = own[at : at + width].tobytes()
                by_length.setdefault(width, {})[key] = None
                listed = of.setdefault(key, set())
                if item is not None:
                    listed.add(item)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []  # phrases of a length, their first number
        self.items: list[list[str]] = []
        for width in sorted(by_length):
            keys = list(by_length[width])
            self.groups.append((np.frombuffer(b"".join(keys), np.int64).reshape(-1, width), len(self.items)))
            self.items += [sorted(of[k]) for k in keys]
        self.shortest = min(by_length, default=0)


def _stretches(symbols: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word number of each place): runs of known words within a text of at
    least ``shortest`` words, a separator after each."""
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = symbols > 0
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(symbols)))
    good = known[first] & (length >= shortest)
    first, length = first[good], length[good]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.cumsum(length + 1) - (length + 1)
    total = int(begin[-1] + length[-1] + 1)
    place = np.arange(total) - np.repeat(begin, length + 1) + np.repeat(first, length + 1)
    sequence = symbols[np.minimum(place, len(symbols) - 1)].copy()
    sequence[begin + length] = 0
    return sequence, place


def find(phrases: Phrases, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged spans of words, items) of each text of a shard."""
    _, _, words = words_of(texts, ALNUM_WORD, lower=True)
    counts, owner = words.counts, words.owners()
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(c), [], []) for c in counts]
    if not phrases.groups:
        return out
    sequence, place = _stretches(known_ids(phrases.vocabulary, words.hashes), owner, phrases.shortest)
    if not len(sequence):
        return out
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    step = np.zeros(len(words.hashes) + 1, np.int64)
    seen = []
    for group, first_number in phrases.groups:
        low, high = index.search(group)
        hits = high - low
        found = np.flatnonzero(hits)
        if not len(found):
            continue
        rows = np.repeat(low[found] - (np.cumsum(hits[found]) - hits[found]), hits[found]) + np.arange(hits[found].sum())
        at = place[index.locate(rows)]
        np.add.at(step, at, 1)
        np.add.at(step, at + group.shape[1], -1)
        seen.append(np.unique(np.stack([owner[at], np.repeat(found + first_number, hits[found])]), axis=1))
    if not seen:
        return out
    covered = np.cumsum(step)[:-1] > 0
    fresh = covered.copy()
    fresh[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    first, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    base = words.bounds[owner[first]]
    for text, a, b in zip(owner[first].tolist(), (first - base).tolist(), (end - base).tolist(), strict=True):
        out[text][1].append((a, b))
    for text, number in np.concatenate(seen, axis=1).T.tolist():
        out[text][2].extend(phrases.items[number])
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def _hit_array(rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.Array:
    def offsets(sizes: list[int]) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    spans = np.array([x for r in rows for x in r[1]], dtype=np.int64).reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["start", "end"])
    return pa.StructArray.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.ListArray.from_arrays(offsets([len(r[1]) for r in rows]), pairs),
            pa.ListArray.from_arrays(offsets([len(r[2]) for r in rows]), pa.array([x for r in rows for x in r[2]], pa.string())),
        ],
        names=["n_words", "spans", "items"],
    )


_PREPARED: dict[tuple[str, int], Phrases] = {}


def _prepared(sent, window: int) -> Phrases:
    """The phrases of a broadcast, made once in a worker, which keeps those of the last few blocks for its next tasks."""
    name, items = sent.value
    if (name, window) not in _PREPARED:
        while len(_PREPARED) >= KEPT:
            _PREPARED.pop(next(iter(_PREPARED)))
        _PREPARED[name, window] = Phrases(items, window)
    return _PREPARED[name, window]


def _finder(spark: SparkSession, items: list[tuple[str | None, str | None]], window: int) -> Callable[[str], Column]:
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

    @F.arrow_udf(HIT)
    def hits(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        phrases = _prepared(sent, window)
        for texts in parts:
            yield _hit_array([row for _, part in slices(texts, CHUNK_BYTES) for row in find(phrases, part)])

    return hits


def _united(first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    for a, b in zip(first.to_pylist(), second.to_pylist(), strict=True):
        merged: list[list[int]] = []
        for start, end in sorted((s["start"], s["end"]) for s in a["spans"] + b["spans"]):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        rows.append((a["n_words"], [tuple(x) for x in merged], sorted({*a["items"], *b["items"]})))
    return _hit_array(rows)


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list]:
    """The items, streamed to the driver a partition at a time, in lists of about ``limit`` words."""
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        words += 1 + len(row[1] or "") // 4
        if words >= limit:
            yield block
            block, words = [], 0
    if block:
        yield block


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "_hits", window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct of the words, merged removal spans (in words, end exclusive) and items of each text."""
    out, first = docs, True
    for block in blocks(benchmark, limit):
        found = _finder(docs.sparkSession, block, window)(F.col("text"))
        out = out.withColumn(name, found if first else F.arrow_udf(_united, HIT)(F.col(name), found))
        first = False
    return out if not first else out.withColumn(name, _finder(docs.sparkSession, [], window)(F.col("text")))


def n_hit(name: str = "_hits") -> Column:
    return F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])


def contaminated(name: str = "_hits") -> Column:
    return (n_hit(name) > 0) & (20 * n_hit(name) >= F.col(f"{name}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    return with_hits(docs.select(whole_row(docs).alias("_row"), "text"), benchmark).where(~contaminated()).select("_row.*")


def op6_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = with_hits(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS k
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, k)) AS r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
