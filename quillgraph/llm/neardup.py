"""Near duplicates by Order MinHash and banded alignment.

A text is the sequence of its 5-word shingles, each labelled with how often it stood
before (a shorter text is one shingle). One sketch takes the LENGTH least labelled
shingles under one hash and keeps them in text order; COUNT sketches make COUNT keys.
Texts that share a key are candidates: equal shingles aren't enough, they must come in
the same order. One edited word takes five shingles away, which is much for a short text,
so those get SHORT_COUNT more keys of SHORT_LENGTH shingles.

A candidate pair is verified by aligning its words in a band. Similarity is edit similarity,
1 - d / max(n, m) for d words inserted, deleted or replaced between texts of n and m words.
At similarity s no matched words lie further apart than (1 - s) * max(n, m) places, so the
band of the alignment is that wide at most; it starts narrow and is widened on failure.

Byte-equal texts become one node first, however many copies there are. Within a key,
nodes are compared with the one that meets most others, and not with each other. Of what
that leaves in different classes, all texts that share a key with other classes are
compared too: under keys that one class nearly has to itself the few others with all, under other keys where an
exact prefix filter over the rarer words of texts that keys connect lets them, as texts of similarity s have s * max(n, m) labelled words in common. Before that, the texts of a key whose
classes differ are compared with one of its largest class, another one for each key, so that
large groups of near copies have become one class. So a link between classes is missed
only where similar texts share no key: with edits spread evenly, at similarity 0.8 for about one pair
in ten, at 0.85 for one in a hundred, at 0.9 for hardly any, fewer if edits stand together (README has measured figures).
Nothing but counts reaches the driver.

Defined results: a null text is a class of its own; texts without words are linked only
to byte-equal ones; repeated rows belong to one class; a class is named by its least doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.components import components
from quillgraph.llm.tables import stored, text_key, whole_row
from quillgraph.llm.textops import CHUNK_BYTES, mix64, slices, window_hashes, windows_within, words_of

SHINGLE = 5
SIMILARITY = 0.8
LENGTH, COUNT = 2, 60
SHORT_LENGTH, SHORT_COUNT, SHORT = 1, 12, 24
#: Texts that one task compares with the same other text before that one's rows are split.
SPLIT = 2000
FEW = 8
#: So many earlier labels go with a text to a meeting.
EARLIER = 8
#: Labels are counted in 2**COUNT_BITS buckets; counts only choose the order of labels, which any order serves.
COUNT_BITS = 21
SKETCH = "struct<n:bigint,keys:array<bigint>>"

SketchOf = Callable[[str], Column]
SimilarityOf = Callable[[str, str], Column]
NeedOf = Callable[[Column, Column], Column]

_LEAST = np.uint64(2**64 - 1)


def labelled_shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(labels, bounds): the occurrence-labelled shingles of each text, in order, all distinct within it."""
    _, _, words = words_of(texts)
    counts, bounds = words.counts, words.bounds
    starts = windows_within(bounds, width)
    values, owner = window_hashes(words.hashes, width)[starts], words.owners()[starts]
    for text in np.flatnonzero((counts > 0) & (counts < width)):  # one shingle, of all the words
        whole = mix64(window_hashes(words.hashes[bounds[text] : bounds[text + 1]], int(counts[text])), 11)
        at = np.searchsorted(owner, text)
        values, owner = np.insert(values, at, whole), np.insert(owner, at, text)
    key = mix64(values ^ mix64(owner.astype(np.uint64), 13))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else key
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = nth
    with np.errstate(over="ignore"):
        labels = mix64(values + occurrence * np.uint64(0x9E3779B97F4A7C15), 17)
    return labels, np.searchsorted(owner, np.arange(len(texts) + 1))


def _ordered_minima(labels: np.ndarray, bounds: np.ndarray, length: int, count: int, seed: int) -> np.ndarray:
    """count keys for each text, of its ``length`` least labels in text order; every text has that many."""
    begin, sizes = bounds[:-1], np.diff(bounds)
    keys = np.zeros((len(sizes), count), np.uint64)
    if not len(sizes):
        return keys
    scratch = np.empty_like(labels)
    with np.errstate(over="ignore"):
        for k in range(count):
            salt = mix64(np.array([seed * 1000 + k], np.uint64), 19)[0]
            value = labels ^ salt
            value *= salt | np.uint64(1)
            np.right_shift(value, np.uint64(32), out=scratch)
            value ^= scratch
            value *= np.uint64(0xD6E8FEB86659FD93)
            places = np.zeros((len(sizes), length), np.int64)
            for nth in range(length):
                least = np.minimum.reduceat(value, begin)
                at = np.flatnonzero(value == np.repeat(least, sizes))
                places[:, nth] = at
                value[at] = _LEAST
            places.sort(axis=1)
            key = np.full(len(sizes), salt)
            for nth in range(length):
                key = mix64(key ^ labels[places[:, nth]], 23)
            keys[:, k] = key
    return keys


def _part(labels: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)
    return labels[np.repeat(chosen, sizes)], np.concatenate([[0], np.cumsum(sizes[chosen])])


def sketch_block(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(shingles, keys) of each text of a block."""
    labels, bounds = labelled_shingles(texts)
    sizes = np.diff(bounds)
    keys: list[list[np.ndarray]] = [[] for _ in sizes]
    for chosen, length, count, seed in ((sizes >= LENGTH, LENGTH, COUNT, 1), ((sizes >= SHORT_LENGTH) & (sizes <= SHORT), SHORT_LENGTH, SHORT_COUNT, 2)):
        for text, row in zip(np.flatnonzero(chosen), _ordered_minima(*_part(labels, bounds, chosen), length, count, seed), strict=True):
            keys[text].append(row)
    for text in np.flatnonzero((sizes > 0) & (sizes < LENGTH)):  # here only equal sequences are that similar
        keys[text].append(mix64(window_hashes(labels[bounds[text] : bounds[text + 1]], int(sizes[text])), 29))
    return sizes, [np.concatenate(k) if k else np.zeros(0, np.uint64) for k in keys]


def sketch_with(block: Callable[[pa.Array], tuple[np.ndarray, list[np.ndarray]]], text: str) -> Column:
    """A struct of the size and the keys of each text, as ``block`` gives them."""

    @F.arrow_udf(SKETCH)
    def sketches(texts: pa.Array) -> pa.Array:
        sizes, keys = [np.zeros(0, np.int64)], []
        for _, part in slices(texts, CHUNK_BYTES):
            n, k = block(part)
            sizes.append(n)
            keys += k
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["n", "keys"])

    return sketches(F.col(text))


def sketch(text: str = "text") -> Column:
    return sketch_with(sketch_block, text)


def _in_band(a: list[int], b: list[int], band: int) -> int:
    """The edit distance of two sequences, the first no shorter, if it is at most ``band``; else more than that.

    The alignment goes along the diagonals -band to band. The differences between the costs of
    neighbouring cells of a column are bits of two numbers, so a step works on the whole band at once."""
    width = 2 * band + 1
    full, low, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full ^ ((1 << band) - 1), 0  # where the cost grows by one to the next row, or falls
    cost, start, most = band, -band, 2 * band + len(b) - len(a)
    for j, x in enumerate(b):
        same = places.get(x, 0)
        same = (same >> start if start >= 0 else same << -start) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (full ^ (level | up)), level & up
        if j < len(a) - band:  # down the lowest diagonal to the last row
            cost += not level & low
            if cost > most:
                return band + 1
        else:  # then along the last row
            cost += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        level >>= 1
        up, down = right_down | (full ^ (level | right_up)), level & right_up
        start += 1
    return cost


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences of numbers if it is at most ``most``; else more than that."""
    if len(a) < len(b):
        a, b = b, a
    shorter = len(b)
    if len(a) - shorter > most:
        return most + 1
    unequal = np.flatnonzero(a[:shorter] != b)
    begin = int(unequal[0]) if len(unequal) else shorter
    a, b = a[begin:], b[begin:]
    unequal = np.flatnonzero(a[len(a) - len(b) :] != b)
    end = len(b) - 1 - int(unequal[-1]) if len(unequal) else len(b)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(b):
        return len(a)
    _, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    least = len(a) - int(np.minimum(np.bincount(which[: len(a)], minlength=which.max() + 1), np.bincount(which[len(a) :], minlength=which.max() + 1)).sum())
    if least > most:  # there are too few equal words, in whatever order
        return most + 1
    one, two = which[: len(a)].tolist(), which[len(a) :].tolist()
    band = max(least, 8)
    while True:
        band = min(band, most, len(a))
        found = _in_band(one, two, band)
        if found <= band or band in (most, len(a)):
            return found
        band *= 4


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Edit similarity of two sequences of word hashes by alignment in the band that ``similarity`` allows; 0 below it."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    found = edit_distance(a, b, most) if longer and most else most + (not np.array_equal(a, b))
    return 1 - found / longer if longer and found <= most else 0.0


def labels_with(block: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], text: str) -> Column:
    """An array of the labels of each text, as ``block`` gives them with bounds."""

    @F.arrow_udf("array<bigint>")
    def labels(texts: pa.Array) -> pa.Array:
        parts = [block(part) for _, part in slices(texts, CHUNK_BYTES)]
        flat = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in parts]]).view(np.int64)
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(b) for _, b in parts]])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))

    return labels(F.col(text))


def labels_of(text: str = "text") -> Column:
    """The occurrence-labelled words of each text."""
    return labels_with(lambda texts: labelled_shingles(texts, 1), text)


def similarity_of(first: str, second: str) -> Column:
    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for at, part in slices(a, CHUNK_BYTES):
            _, _, one = words_of(part)
            for k, other in slices(b.slice(at, len(part)), CHUNK_BYTES):
                _, _, two = words_of(other)
                for i in range(len(other)):
                    x, y = (w.hashes[w.bounds[n] : w.bounds[n + 1]] for w, n in ((one, k + i), (two, i)))
                    out[at + k + i] = aligned(x, y)
        return pa.array(out)

    return similar(F.col(first), F.col(second))


def words_needed(similarity: float = SIMILARITY) -> NeedOf:
    """How many labelled words texts of n and m words have in common at least if they are that similar."""
    return lambda n, m: similarity * F.greatest(n, m)


def shingles_needed(similarity: float = SIMILARITY) -> NeedOf:
    """How many shingles sets of n and m have in common at least if their Jaccard similarity is that."""
    return lambda n, m: similarity / (1 + similarity) * (n + m)


def _verified(pairs: DataFrame, texts: DataFrame, similar: SimilarityOf, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are that similar. A b of many pairs has its text copied for each
    SPLIT of them, so that no task gets all of its rows."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    salted = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    # texts have no bound, so they are never broadcast, however few there are
    with_a = salted.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    copies = parts.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text_b")
    return stored(with_a.join(copies.hint("merge"), ["b", "part"]).where(similar("text_a", "text_b") >= similarity).select("a", "b"), name)


def _in_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes so far."""
    for end in ("a", "b"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        pairs = pairs.join(root, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_a != _b").drop("_a", "_b")


def _of_several_classes(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """k, id and root of the texts of keys that texts of several classes have; largest: the class of the most texts
    (in all) among those of the key, pivot: a text of it; first: the least text of the key; few: whether the largest class has
    half of the texts or more and at most FEW texts are of others. All of these are found while the classes of a key are
    counted, so the rows of keys meet them in one join."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    rooted = shared.join(roots.withColumnRenamed("node", "id").join(sizes, "root"), "id", "left").select("k", "id", F.coalesce("root", "id").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    each = rooted.groupBy("k", "root").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(F.struct("size", F.xxhash64("id", "k").alias("h"), "id")).alias("top"))
    several = each.groupBy("k").agg(F.count("*").alias("roots"), F.sum("n").alias("c"), F.min("first").alias("first"), F.max(F.struct("top.size", "root", "top.id", "n")).alias("top")).where("roots > 1")
    others = F.col("c") - F.col("top.n")
    known = several.select("k", F.col("top.root").alias("largest"), F.col("top.id").alias("pivot"), "first", ((others <= FEW) & (2 * others <= F.col("c"))).alias("few"))
    return rooted.join(known, "k").select("k", "id", "root", "largest", "pivot", "first", "few")


def _with_few_others(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different classes under the keys with ``few`` texts of other classes than the largest, each of
    these with all. So a key makes at most FEW pairs for each of its texts."""
    own = keys.where("few")
    one = own.where("root != largest").select("k", F.col("id").alias("x"), F.col("root").alias("rx"))
    pairs = one.join(own.select("k", F.col("id").alias("y"), F.col("root").alias("ry")), "k").where("rx != ry")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _hung(roots: DataFrame) -> DataFrame:
    """The classes so far as links, one for each node that isn't a root: with more links they give the same classes as all links from the start."""
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _bucket(labels: np.ndarray) -> np.ndarray:
    return (labels.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _label_counts(left: DataFrame) -> np.ndarray:
    """About how many texts of ``left`` (labels) have a label: counts by buckets of labels, a table of a fixed size whatever the
    number of texts. Tasks count whole batches, so few rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(_bucket(batch.column("labels").flatten().to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    counted = left.select("labels").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).select(F.col("bucket").cast("int").alias("bucket"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int32)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def _first_labels(spark, counts: np.ndarray, similarity: float) -> Column:
    """The labels of each text that come first when they are ordered by ``counts``; as many as similar texts need one in common among."""
    sent = spark.sparkContext.broadcast(counts)

    @F.arrow_udf("array<bigint>")
    def first(labels: pa.Array) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(labels.value_lengths().fill_null(0).to_numpy())])
        flat = labels.flatten().to_numpy()
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = flat[np.lexsort((flat, sent.value[_bucket(flat)], owner))]
        chosen = np.minimum(sizes, np.floor((1 - similarity) * sizes + 1e-9).astype(np.int64) + 1)
        places = np.repeat(bounds[:-1] - (np.cumsum(chosen) - chosen), chosen) + np.arange(chosen.sum())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen)]).astype(np.int32)), pa.array(flat[places]))

    return first(F.col("labels"))


def _meetings(left: DataFrame, similarity: float, needed: NeedOf) -> DataFrame:
    """Pairs (a, b) of texts of different classes and one group that can be that similar; some pairs more than once.

    left: id, root, g0 (the group), labels. Labels are put in one order for all texts, frequent ones last. Two texts of n and m labels need
    some in common, ``needed(n, m)``, which is at least similarity * n and at least similarity * m; so
    the first common label has that many but one after it in both, which leaves few places for it and, among many near
    copies of one text, mostly labels that no other text has. Only the labels in those places leave their text. Texts meet under their group and a label together. Their sizes are similar too, so a meeting is split by
    a logarithm of the size; a text goes to its own part and both next to it. Exact: no such pair of that similarity is lost.

    Texts with a passage in common have many such labels in common, but need to meet under the first of these only: a text brings the EARLIER
    labels before this one, and two that have one of these in common have met under it, where fewer places were gone."""
    firsts = left.select("id", "root", "g0", F.size("labels").alias("n"), _first_labels(left.sparkSession, _label_counts(left), similarity).alias("firsts"))
    hashed = firsts.select("id", "root", "n", F.transform("firsts", lambda x: F.xxhash64("g0", x)).alias("hs"))
    each = hashed.select("id", "root", "n", "hs", F.posexplode("hs").alias("place", "h"))
    each = each.select("id", "root", "n", "place", "h", F.slice("hs", F.greatest(F.col("place") - EARLIER, F.lit(0)) + 1, F.least("place", F.lit(EARLIER))).alias("earlier")).repartition("h")
    several = each.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    sized = each.join(several, "h").withColumn("g", F.floor(F.log(F.col("n")) / -np.log(similarity)).cast("int"))
    first = stored(sized.select("h", "g", "id", "root", "n", "place", "earlier"), "rare")
    # the class that most texts of a meeting are in needn't meet itself; two texts of other classes meet once
    main = first.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.col("count")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("h", "main")
    one = first.join(main, "h").where("root != main").select("h", F.explode(F.array(*[F.col("g") + k for k in (-1, 0, 1)])).alias("g"), F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("earlier").alias("ex"), "main")
    two = first.select("h", "g", F.col("id").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("earlier").alias("ey"))
    need = needed(F.col("nx"), F.col("ny")) - 1e-9
    once = ((F.col("ry") == F.col("main")) | (F.col("x") < F.col("y"))) & ~F.arrays_overlap("ex", "ey")
    found = one.join(two, ["h", "g"]).where((F.col("rx") != F.col("ry")) & (F.col("nx") - F.col("px") >= need) & (F.col("ny") - F.col("py") >= need) & once)
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def of_nodes(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (doc_id, text, key) that stand for the nodes of ids (key, id, least: a doc_id), one for each."""
    own = keyed.join(ids.hint("merge"), (keyed.key == ids.key) & keyed.doc_id.eqNullSafe(ids.least)).drop(keyed.key)
    return own.dropDuplicates(["id"])


def classes(docs: DataFrame, similarity: float = SIMILARITY, sketched_by: SketchOf = sketch, similar: SimilarityOf = similarity_of, labels_by: SketchOf = labels_of, needed: NeedOf | None = None, keyed: bool = False) -> DataFrame:
    """Classes of texts under a sketch, whose equal keys make candidates, and a similarity, which
    verifies them; labels_by gives distinct labels, of which texts that similar have ``needed`` in common; keyed: docs has text_key as ``key``. A row for each distinct text that isn't null: key, id, doc_id (its least), copies,
    root (an id), class_id (the least doc_id of the class), class_size, chosen (true for one text of each class)."""
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", (F.col("key") if keyed else text_key()).alias("key"))
    sketched = keyed.select("doc_id", "key", sketched_by("text").alias("s"))
    nodes = sketched.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("s.n").alias("n"), F.first("s.keys").alias("keys"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    # dealt by key once: the counts and the join both find them so
    members = nodes.select("id", F.explode("keys").alias("k")).repartition("k")
    buckets = members.groupBy("k").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("c")).where("first < last").select("k", "c")
    shared = stored(members.join(buckets, "k"), "shared")  # only keys that several texts have
    # the text that meets most others stands for each key: of copies of one text, that text
    met = shared.groupBy("id").agg(F.sum("c").alias("met"))
    pivots = shared.join(met, "id").groupBy("k").agg(F.max_by("id", F.least("met", F.lit(2**40)) * 2**20 + F.col("id") % 2**20).alias("b"))
    pairs = stored(shared.join(pivots, "k").where("id != b").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("keys")), "pairs")
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(nodes.join(involved, "id", "left_semi").select("key", "id", F.col("doc_id").alias("least")), "ids")
    texts = stored(of_nodes(keyed, ids).select("id", "text"), "texts")

    # each text with the one that it shares most keys with
    most = pairs.groupBy("a").agg(F.max_by("b", F.col("keys") * 1_000_003 - F.col("b") % 1_000_003).alias("b"))
    links = _verified(most, texts, similar, similarity, "links")
    roots = components(links, "roots")
    # then with the others that stand for its keys, and with a text of the largest class that each key has
    rest = _in_classes(pairs.join(most, ["a", "b"], "left_anti").select("a", "b"), roots)
    largest = _of_several_classes(shared, roots).where("root != largest").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    rest = stored(rest.union(largest.join(most, ["a", "b"], "left_anti")).distinct(), "rest")
    if not rest.isEmpty():
        roots = components(_hung(roots).union(_verified(rest, texts, similar, similarity, "links")), "roots")
    done = pairs.select("a", "b").union(rest)
    # and all texts that still share keys with texts of other classes, by the rare labels that similar ones must share
    keys = stored(_of_several_classes(shared, roots).select("k", "id", "root", "largest", "first", "few"), "keys")
    pairs, keys = _with_few_others(keys), keys.where("NOT few")
    # texts that keys connect are a group; those of different groups share no key
    groups = components(keys.select(F.col("id").alias("a"), F.col("first").alias("b")), "groups").select(F.col("node").alias("id"), F.col("root").alias("g0"))
    own = keys.groupBy("id").agg(F.max("root").alias("root")).join(groups, "id")
    left = stored(texts.join(own.hint("merge"), "id").select("id", "root", "g0", labels_by("text").alias("labels")), "left")
    rare = _meetings(left, similarity, needed or words_needed(similarity))
    open_ = stored(pairs.union(rare).distinct().join(done, ["a", "b"], "left_anti"), "open")
    if not open_.isEmpty():
        roots = components(_hung(roots).union(_verified(open_, texts, similar, similarity, "links")), "roots")

    rooted = nodes.drop("keys", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).getField("id").alias("chosen_id"))
    return stored(rooted.join(named, "root").select("key", "id", "doc_id", "copies", "root", "class_id", "class_size", (F.col("id") == F.col("chosen_id")).alias("chosen")), "classes")


def op9_order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size for every row of docs."""
    found = classes(docs).select("key", "class_id", "class_size")
    own = docs.select("doc_id", text_key().alias("key"))
    return own.join(found, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of least doc_id, and every row whose text is null.

    Only keys and ids are grouped; whole rows are dealt once, by them, to meet the chosen ones."""
    chosen = classes(docs).where("chosen").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    rows = docs.where("text IS NOT NULL").select(text_key().alias("_k"), F.col("doc_id").alias("_d"), whole_row(docs).alias("_row"))
    one = rows.join(chosen.hint("merge"), (F.col("_k") == F.col("_key")) & F.col("_d").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["_k", "_d"])
    return one.select("_row.*").unionByName(docs.where("text IS NULL"))
