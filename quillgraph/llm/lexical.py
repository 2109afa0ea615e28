"""Ranked lexical search for many items at once by a threshold-seeded join.

Documents are scanned once. A filter of fixed size (``FILTER_BITS``, broadcast) holds the
items' terms, so only postings that may matter leave the scan; its false hits meet no item.
For each term the ``TOP`` postings of most impact are kept as seeds, a number that doesn't grow with the documents.
The TOP-th impact of any one term is a lower bound of an item's TOP-th score, and so is the TOP-th best score among the
``TRIED * TOP`` documents for which the item's seeds add up to most.

An item's terms are ordered by falling largest impact. From the place on where all that
follows can't reach the bound together, terms are left out: a document that has only those isn't among the best. The
other terms meet the postings of all documents, the items in blocks; where a document's sum and all that
the left-out terms could add reach the bound, the document is a candidate, and its exact score
counts the left-out terms too. Scores under the bound go. Nothing is cut by number, so the result is exact.

A term that every document has is one posting of each document's row, which stays where it is. Terms are told apart by 64-bit hashes.

Defined results: null texts and texts without a term are no documents; an item without terms,
or an empty table on either side, gives no rows; equal scores rank by ascending doc_id, null ones
last; repeated rows of docs are documents of their own, and repeated rows of
items have a ranking each; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored
from quillgraph.llm.textops import ALNUM_WORD, CHUNK_BYTES, mix64, slices, words_of

TOP = 50
TRIED = 8
FILTER_BITS = 22
PROBES = 3
#: Pairs of an item and a term that are sent to the workers at once, and sums that one worker holds at once.
BLOCK_TERMS, CELLS = 500_000, 1_000_000
TERMS = "struct<n:bigint,terms:array<bigint>,tf:array<bigint>>"


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(mix64(hashes, 31 + k) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for k in range(PROBES)]


def counted(text: str = "text", wanted: np.ndarray | None = None) -> Column:
    """How many terms each whole text has, and its distinct terms (those in the filter ``wanted``, if given) with their numbers."""

    @F.arrow_udf(TERMS)
    def count(texts: pa.Array) -> pa.Array:
        n, terms, times, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, part in slices(texts, CHUNK_BYTES):
            _, _, words = words_of(part, ALNUM_WORD, lower=True)
            hashes, owner = words.hashes, words.owners()
            if wanted is not None:
                near = np.logical_and.reduce([wanted[p] for p in _places(hashes)])
                hashes, owner = hashes[near], owner[near]
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, np.int64)
            n.append(words.counts)
            terms.append(hashes[first])
            times.append(np.diff(np.append(first, len(hashes))))
            sizes.append(np.bincount(owner[first], minlength=len(part)))
        bounds = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).view(np.int64))) for x in (terms, times)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), *lists], names=["n", "terms", "tf"])

    return count(F.col(text))


def term_filter(terms: DataFrame) -> np.ndarray:
    """A filter of fixed size that lets all of ``terms`` (term) pass. At most 2**FILTER_BITS / 32 rows come to the driver."""

    @F.arrow_udf("array<bigint>")
    def places(found: pa.Array) -> pa.Array:
        at = np.stack(_places(found.to_numpy().view(np.uint64)), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, PROBES, dtype=np.int32)), pa.array(at.ravel()))

    each = terms.select(F.explode(places("term")).alias("p"))
    rows = each.groupBy(F.expr("p div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("bits")).collect()
    out = np.zeros(2**FILTER_BITS, bool)
    for r in rows:
        for k in range(32):
            out[r["word"] * 32 + k] = r["bits"] >> k & 1
    return out


class _Terms:
    """(item number, term, weight) by sorted term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        order = np.lexsort((item, term))
        self.terms, first = np.unique(term[order], return_index=True)
        self.begin = np.append(first, len(order))
        self.item, self.w = item[order], w[order].astype(np.float64)

    def sums(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, items: int, cells: int, only: np.ndarray | None = None) -> np.ndarray:
        """What postings (owner: the document's number) add to each cell, a document and an item; only: the cells that count.
        Sums are of whole numbers below 2**53, so they are exact."""
        if not len(self.terms) or not len(term):
            return np.zeros(cells)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        at, owner, impact = at[hit], owner[hit], impact[hit]
        many = self.begin[at + 1] - self.begin[at]
        posting = np.repeat(self.begin[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cell, impact = np.repeat(owner, many) * items + self.item[posting], np.repeat(impact, many)
        if only is not None:
            kept = only[cell]
            cell, impact, posting = cell[kept], impact[kept], posting[kept]
        return np.bincount(cell, weights=self.w[posting] * impact, minlength=cells)


class Block:
    """Terms of some items, leading ones and those left out; what the sum over leading ones has to reach, and the score itself."""

    def __init__(self, item: np.ndarray, term: np.ndarray, w: np.ndarray, leading: np.ndarray, need: np.ndarray, bound: np.ndarray) -> None:
        self.items, which = np.unique(item, return_inverse=True)
        self.leading, self.others = (_Terms(which[part], term[part], w[part]) for part in (leading, ~leading))
        self.need, self.bound = np.zeros(len(self.items)), np.zeros(len(self.items))
        self.need[which], self.bound[which] = np.maximum(need, 1), bound

    def reached(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of the documents whose score reaches the item's bound. Only candidates, whose leading terms
        reach what is needed, are scored by the terms left out."""
        n = len(self.items)
        some = self.leading.sums(owner, term, impact, n, docs * n)
        candidates = (some.reshape(docs, n) >= self.need).ravel()
        score = some + self.others.sums(owner, term, impact, n, docs * n, candidates)
        place = np.flatnonzero(candidates & (score.reshape(docs, n) >= self.bound).ravel())
        return self.items[place % n], place // n, score[place].astype(np.int64)


def _best(found: DataFrame, ordered: DataFrame, n: int, total: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, row, doc_id, score) of the documents whose score reaches the item's bound.

    The items meet all documents in blocks of about ``block_terms`` terms, one block after another, so what is sent
    to the workers is bounded; within a block a document's sums are made where its row is, and only what reaches the bound leaves it."""
    spark = found.sparkSession
    blocks = max(1, math.ceil(ordered.count() / block_terms))
    schema = "item bigint, row bigint, doc_id bigint, score bigint"
    out = None
    for k in range(blocks):
        own = ordered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "term", "w", F.col("rest") >= F.col("bound"), "need", "bound").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Block(*(c.to_numpy() for c in own.columns)))

        def meet(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            step = max(1, CELLS // len(block.items))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    sizes = part.column("terms").value_lengths().to_numpy()
                    owner = np.repeat(np.arange(part.num_rows), sizes)
                    tf, term = (part.column(c).flatten().to_numpy() for c in ("tf", "terms"))
                    m = 50 + (50 * part.column("n").to_numpy() * n) // total
                    item, doc, score = block.reached(owner, term, 10**9 * tf // (1000 * tf + 20 * m[owner]), part.num_rows)
                    doc = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(item), part.column("row").take(doc), part.column("doc_id").take(doc).cast(pa.int64()), pa.array(score)], names=["item", "row", "doc_id", "score"])

        scores = stored(found.select("row", "doc_id", "n", "terms", "tf").mapInArrow(meet, schema), "best")
        sent.destroy()
        out = scores if out is None else out.union(scores)
    return spark.createDataFrame([], schema) if out is None else out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents (doc_id, text) of each item (item_id, text)."""
    asked = stored(items.select("item_id", counted("text").alias("c")).withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", F.explode("c.terms").alias("term")), "asked")
    wanted = term_filter(asked.select("term").distinct())
    found = docs.select("doc_id", counted("text", wanted).alias("c")).where("c.n > 0").select(F.monotonically_increasing_id().alias("row"), "doc_id", "c.*")
    found = stored(found, "found")
    size = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n, total = size["n"], size["l"] or 1

    impact = F.expr(f"(1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {n}) div {total}))")
    each = found.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
    postings = each.select("row", "doc_id", "term", impact.alias("impact"))
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    seeds = stored(postings.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("term", "row", "impact", "place"), "seeds")
    stats = postings.groupBy("term").agg(F.count("*").alias("df")).join(seeds.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == top, F.col("impact"))).alias("kth")), "term")
    stats = stats.withColumn("w", F.floor(1000 * F.log((F.lit(float(2 * n)) + 2) / (2 * F.col("df") + 1))).cast("bigint"))
    weighted = stored(asked.join(stats.select("term", "w", "most", "kth"), "term").select("item", "item_id", "term", "w", (F.col("w") * F.col("most")).alias("most"), (F.col("w") * F.coalesce("kth", F.lit(0))).alias("kth")), "weighted")

    def scores(pairs: DataFrame) -> DataFrame:
        """The scores of pairs (item, row) from all terms of both."""
        whole = pairs.join(found, "row").select("item", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("item", "row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
        both = whole.select("item", "row", "doc_id", "term", impact.alias("impact")).join(weighted.select("item", "item_id", "term", "w"), ["item", "term"])
        return both.groupBy("item", "row").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("impact")).alias("score"))

    # lower bounds of each item's last score: of one term alone, and of the seeds that add up to most
    sums = weighted.select("item", "term", "w").join(seeds, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("least"))
    tried = sums.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("least"), "row"))).where(F.col("place") <= TRIED * top).select("item", "row")
    kth = scores(tried).withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") == top).select("item", "score")
    bounds = weighted.groupBy("item").agg(F.max("kth").alias("single")).join(kth, "item", "left").select("item", F.greatest("single", F.coalesce("score", F.lit(0)), F.lit(1)).alias("bound"))

    # terms in order of what they can give at most; those of the end can't reach the bound together
    falling = Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = weighted.withColumn("rest", F.sum("most").over(falling)).join(bounds, "item")
    left_out = F.max(F.when(F.col("rest") < F.col("bound"), F.col("rest"))).over(Window.partitionBy("item"))
    ordered = stored(ordered.withColumn("need", F.col("bound") - F.coalesce(left_out, F.lit(0))), "ordered")
    best_of = _best(found, ordered, n, total).join(asked.select("item", "item_id").distinct(), "item")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best_of.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_threshold_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The contract's formula over all pairs of an item and a document that share a term. Rows of benchmark are numbered, as their ids may repeat.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
own AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
size AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM own GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY term, n_docs),
b AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
asked AS (SELECT DISTINCT item, item_id, unnest(t) AS term FROM b),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
