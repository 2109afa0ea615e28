"""Substring dedup over paragraphs.

Two kinds of paragraph are compared across documents.

``paragraph``: a line of at least MIN_WORDS words. MinHash over the set of its 5-word
shingles makes BANDS keys of ROWS minima, tuned for high recall at similarity 0.8
(1 - (1 - 0.8**4)**14 = 0.9994); paragraphs that share a key are joined, exact Jaccard
similarity verifies them, and components of the links are the clusters. One
paragraph of a cluster stays.

``passage``: a sliding paragraph of MIN_WORDS words, wherever it starts, so that a passage
inside different lines is found too. Each sliding paragraph has one MinHash, the least
hash of its 16-word shingles; neighbours mostly share it, so only those minima travel.
Where a minimum stands in several texts, the sliding paragraphs around it are compared
whole, by the hash of all their words. Every repeat of MIN_WORDS words or more is found.
Overlapping repeats of a text that one other text keeps merge to spans, and spans of different keepers may
overlap; the text of least number that has a passage keeps it.

A text that occurs several times is one text here; its further copies are removed whole.

Defined results: null and short texts have no paragraphs and no rows; repeated rows are
copies of one text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.neardup import SHINGLE, SIMILARITY, classes, labels_with, of_nodes, shingles_needed, sketch_with
from quillgraph.llm.tables import stored, text_key
from quillgraph.llm.textops import CHUNK_BYTES, mix64, slices, window_hashes, windows_within, words_of

MIN_WORDS = 51
ROWS, BANDS = 4, 14
ANCHOR = 16
HOT, HOT_HASHES = 2000, 100_000


def _distinct_shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the set of shingles of each text, ascending."""
    _, _, words = words_of(texts)
    starts = windows_within(words.bounds, width)
    values, owner = window_hashes(words.hashes, width)[starts], words.owners()[starts]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def band_block(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    values, bounds = _distinct_shingles(texts)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes > 0)
    keys = np.zeros((len(full), BANDS), np.uint64)
    scratch = np.empty_like(values)
    with np.errstate(over="ignore"):
        for band in range(BANDS if len(full) else 0):
            key = np.full(len(full), mix64(np.array([band], np.uint64), 31)[0])
            for row in range(ROWS):
                salt = mix64(np.array([band * ROWS + row], np.uint64), 37)[0]
                hashed = values ^ salt
                hashed *= salt | np.uint64(1)
                np.right_shift(hashed, np.uint64(32), out=scratch)
                hashed ^= scratch
                hashed *= np.uint64(0xD6E8FEB86659FD93)
                key = mix64(key ^ np.minimum.reduceat(hashed, bounds[full]), 41)
            keys[:, band] = key
    out = [np.zeros(0, np.uint64)] * len(sizes)
    for text, row in zip(full, keys, strict=True):
        out[text] = row
    return sizes, out


def bands(text: str = "text") -> Column:
    return sketch_with(band_block, text)


def shingles(text: str = "text") -> Column:
    return labels_with(_distinct_shingles, text)


def jaccard_of(first: str, second: str) -> Column:
    """Exact Jaccard similarity of the sets of 5-word shingles."""

    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for at, part in slices(a, CHUNK_BYTES):
            one, of_one = _distinct_shingles(part)
            for k, other in slices(b.slice(at, len(part)), CHUNK_BYTES):
                two, of_two = _distinct_shingles(other)
                for i in range(len(other)):
                    x, y = one[of_one[k + i] : of_one[k + i + 1]], two[of_two[i] : of_two[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out[at + k + i] = both / max(1, len(x) + len(y) - both)
        return pa.array(out)

    return similar(F.col(first), F.col(second))


def anchors(text: str = "text", width: int = MIN_WORDS) -> Column:
    """For each text its number of words and the (hash, place) of every least 16-word
    shingle of a sliding paragraph; of equal ones in a paragraph the last."""
    span = width - ANCHOR + 1

    def block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        _, _, words = words_of(texts)
        hashes = window_hashes(words.hashes, ANCHOR)
        starts = windows_within(words.bounds, width)
        if not len(starts):
            return words.counts, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        # sliding minimum over ``span`` shingles, by doubling; ties to the later place
        n = len(hashes)
        value, place = hashes.copy(), np.arange(n)
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            later = value[step:] <= value[:-step]
            value = np.where(later, value[step:], value[:-step])
            place = np.where(later, place[step:], place[:-step])
            reach += step
        chosen = np.unique(place[starts])
        owner = np.searchsorted(words.bounds, chosen, side="right") - 1
        return words.counts, hashes[chosen], chosen - words.bounds[owner], np.bincount(owner, minlength=len(texts))

    @F.arrow_udf("struct<n_words:bigint,hashes:array<bigint>,places:array<int>>")
    def anchors_of(texts: pa.Array) -> pa.Array:
        parts = [block(p) for _, p in slices(texts, CHUNK_BYTES)] or [block(pa.array([], pa.string()))]
        counts, hashes, places, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes.view(np.int64), places.astype(np.int32))]
        return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), *lists], names=["n_words", "hashes", "places"])

    return anchors_of(F.col(text))


def sliding(text: str = "text", places: str = "places", width: int = MIN_WORDS) -> Column:
    """(start, hash, other) of the whole sliding paragraphs that hold the 16-word shingle at one of the places:
    two hashes of all their words, 128 bits together."""
    back = width - ANCHOR

    @F.arrow_udf("array<struct<start:int,hash:bigint,other:bigint>>")
    def paragraphs_of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        starts_out, hashes_out, others_out, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
        for at, part in slices(texts, CHUNK_BYTES):
            _, _, words = words_of(part)
            whole, other = window_hashes(words.hashes, width), window_hashes(mix64(words.hashes, 43), width)
            for k, near in enumerate(wanted.slice(at, len(part)).to_pylist()):
                first, n = int(words.bounds[k]), int(words.counts[k])
                mark = np.zeros(n + 1, np.int64)
                p = np.array(near, np.int64)
                np.add.at(mark, np.clip(p - back, 0, n), 1)
                np.add.at(mark, np.clip(p + 1, 0, n), -1)
                own = np.flatnonzero(np.cumsum(mark)[: max(0, n - width + 1)] > 0)
                starts_out.append(own.astype(np.int32))
                hashes_out.append(whole[first + own])
                others_out.append(other[first + own])
                sizes.append(len(own))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(starts_out)), *[pa.array(np.concatenate(x).view(np.int64)) for x in (hashes_out, others_out)]], names=["start", "hash", "other"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)

    return paragraphs_of(F.col(text), F.col(places))


def _spans(windows: str = "windows", width: int = MIN_WORDS) -> Column:
    """Merged spans of (start, keeper, removed) windows, those of each keeper apart."""

    @F.arrow_udf("array<struct<start:bigint,end:bigint,class_id:bigint,removed:boolean>>")
    def merge(rows: pa.Array) -> pa.Array:
        sizes = np.diff(rows.offsets.to_numpy())
        flat = rows.flatten()
        owner = np.repeat(np.arange(len(rows)), sizes)
        start, keeper = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "keeper"))
        removed = flat.field("removed").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((start, keeper, removed, owner))
        owner, start, keeper, removed = owner[order], start[order], keeper[order], removed[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (keeper[1:] != keeper[:-1]) | (start[1:] > start[:-1] + width)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(owner))[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(start[last] + width), pa.array(keeper[first]), pa.array(removed[first])], names=["start", "end", "class_id", "removed"])
        offsets = np.searchsorted(owner[first], np.arange(len(rows) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)

    return merge(F.col(windows))


def _with_keepers(windows: DataFrame, shared: DataFrame) -> DataFrame:
    """windows with the keeper of their hash. Hashes of over HOT windows would each be one task's work, so they are broadcast;
    there are at most windows / HOT of them. Where that is more than HOT_HASHES, Spark's own splitting of large partitions is left to do."""
    keys = ["hash", "other"]
    hot = shared.where(F.col("n") > HOT).drop("n")
    if not 0 < hot.count() <= HOT_HASHES:
        return windows.join(shared.drop("n"), keys)
    marked = windows.join(F.broadcast(hot), keys, "left")
    others = marked.where("keeper IS NULL").drop("keeper").join(shared.where(F.col("n") <= HOT).drop("n"), keys)
    return marked.where("keeper IS NOT NULL").unionByName(others)


def passages(docs: DataFrame, width: int = MIN_WORDS) -> DataFrame:
    """key, doc_id (the text's least), copies, n_words and spans of repeated passages, a row
    for each text that repeats one or is itself repeated."""
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", text_key().alias("key"))
    found = keyed.select("doc_id", "key", anchors("text", width).alias("a")).where(f"a.n_words >= {width}")
    nodes = found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("a.n_words").alias("n_words"), F.first("a.hashes").alias("hashes"), F.first("a.places").alias("places"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    minima = nodes.select("id", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("id", F.col("a.hashes").alias("h"), F.col("a.places").alias("place"))
    several = minima.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    near = minima.join(several, "h", "left_semi").groupBy("id").agg(F.collect_list("place").alias("places"))
    near = stored(near.join(nodes.select("id", "key", F.col("doc_id").alias("least")), "id"), "near")
    texts = of_nodes(keyed, near)
    windows = stored(texts.select("id", F.explode(sliding("text", "places", width)).alias("w")).select("id", "w.start", "w.hash", "w.other"), "windows")
    shared = windows.groupBy("hash", "other").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")).where("keeper < last")
    hit = _with_keepers(windows, stored(shared.drop("last"), "shared")).groupBy("id").agg(F.collect_list(F.struct("start", "keeper", (F.col("id") != F.col("keeper")).alias("removed"))).alias("windows"))
    spans = hit.select("id", _spans("windows", width).alias("spans"))
    return nodes.select("id", "key", "doc_id", "copies", "n_words").join(spans, "id", "left").where("spans IS NOT NULL OR copies > 1")


def paragraphs(docs: DataFrame, width: int = MIN_WORDS) -> DataFrame:
    """doc_id, place (of the line), text of every line of at least ``width`` words."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return lines.where(F.length("text") >= 2 * width - 1).where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= width)


def op10_paragraph_minhash(docs: DataFrame) -> DataFrame:
    """A row for each repeated paragraph or passage of a document, the kept ones too.

    kind, doc_id, place (of the line, or the first word), n_words of a passage or
    characters of a paragraph, class_id (the least doc_id of a paragraph's cluster, of a
    passage's keeper, of a copy's original) and removed."""
    found = stored(passages(docs), "passages")
    keepers = found.select(F.col("id").alias("class_id"), F.col("doc_id").alias("keeper"))
    spans = found.where("spans IS NOT NULL").select("key", F.inline("spans")).join(keepers, "class_id").select("key", F.struct(F.lit("passage").alias("kind"), F.col("start").alias("place"), (F.col("end") - F.col("start")).alias("size"), F.col("keeper").alias("class_id"), "removed").alias("s"))
    own = docs.where("text IS NOT NULL").select("doc_id", text_key().alias("key"))
    repeated = own.join(spans, "key").select("s.kind", "doc_id", "s.place", "s.size", "s.class_id", "s.removed")
    whole = own.join(found.where("copies > 1").select("key", F.col("doc_id").alias("first"), "n_words"), "key").select(F.lit("copy").alias("kind"), "doc_id", F.lit(0).cast("bigint").alias("place"), F.col("n_words").alias("size"), F.col("first").alias("class_id"), (F.col("doc_id") != F.col("first")).alias("removed"))

    lines = stored(paragraphs(docs).withColumn("key", text_key()), "lines")
    clusters = classes(lines, SIMILARITY, bands, jaccard_of, shingles, shingles_needed(), keyed=True).where("class_size > 1").select("key", "class_id", "chosen", F.col("doc_id").alias("first"))
    near = lines.select("doc_id", "place", F.length("text").alias("size"), "key").join(clusters, "key")
    near = near.select(F.lit("paragraph").alias("kind"), "doc_id", F.col("place").cast("bigint").alias("place"), F.col("size").cast("bigint").alias("size"), "class_id", (~F.col("chosen") | (F.col("doc_id") != F.col("first"))).alias("removed"))
    return repeated.union(whole).union(near)
