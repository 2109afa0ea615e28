"""Alignment of two tokenizers by byte-owner arrays.

Both tokenizations of a text cover the same bytes. ``np.repeat`` of token numbers over
their byte lengths says which token of A and which of B owns each byte; consecutive distinct
pairs of owners are the links, and places where both owners change at once cut the
tokens into groups. All of it runs over blocks of whole texts at once.

Encoding costs most, so a text is cut before blanks where neither tokenizer can join
what stands on both sides, and each distinct piece is encoded by the libraries once, as
long as a worker remembers it (``REMEMBERED`` pieces). Whether B's vocabulary allows that cut is read from
its file; one that doesn't gets whole texts.

How many documents hold a pair of linked ids is counted over all documents. A task first
counts within blocks of its own documents (``BLOCK_PAIRS`` pairs or one text), so what
is shuffled is one row for each pair of a block, however often it stands there; the corpus-wide counts go back to
the blocks, not to documents. A pair that every document has is one row a block. The most frequent partner of each A
id is broadcast: it has no more rows than A's vocabulary.

Defined results: null and empty texts, and texts whose tokens' bytes aren't a space and the
text (a sign that stands for another, as U+2581), have no tokens: zeros and ''. Every row
of docs has a row, also repeated ones, each counted as a document; an empty table gives no
rows; ties for an A id's most frequent partner all count; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored
from quillgraph.llm.textops import CHUNK_BYTES, block_of, slices, span_hashes, sums

BLOCK_PAIRS = 1 << 21
REMEMBERED = 400_000
#: Longer pieces are encoded each time.
LONG_PIECE = 256
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ROW = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>, held boolean"


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of the tokens of one tokenizer, by id, and an encoder of many texts without special tokens.

    encode takes texts that begin with a blank, and gives lists of ids that cover it too."""

    def __init__(self, tokens: list[bytes], encode, cut: bool) -> None:
        self.bytes = pa.array(tokens, pa.large_binary())
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.encode, self.cut = encode, cut

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return block_of(self.bytes.take(pa.array(ids)))[0]


def byte_level(path: str) -> Vocabulary:
    """The vocabulary of a byte-level .json: its own pattern never joins what stands before a blank to what follows it."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_padding()
    model.no_truncation()
    of = _byte_level()
    words = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
    special = {i: t.content for i, t in model.get_added_tokens_decoder().items()}
    tokens = [special[i].encode() if i in special else bytes(of[c] for c in words.get(i, "")) for i in range(max(words) + 1)]
    return Vocabulary(tokens, lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)], True)


def pieces(path: str) -> Vocabulary:
    """The vocabulary of a .model whose encoder adds the first blank itself. Texts may be cut before a blank if no piece has one after something else."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = "▁"
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(blank, " ").encode() for i, n in enumerate(names)]
    cut = not any(blank in n.lstrip(blank) for n in names)
    return Vocabulary(tokens, lambda texts: model.encode([t[1:] for t in texts], num_threads=1), cut)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of blanks between a letter or sign (ASCII, or of two bytes up to U+07FF) and something that is neither blank nor control."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    before, two_before, after = data[1:-2], data[:-3], data[3:]
    solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (two_before >= 0xC3) & (two_before <= 0xDF))
    return np.flatnonzero((data[2:-1] == 0x20) & solid & (after > 0x20) & (after != 0x7F)) + 2


def _spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of the counts, one after another."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Memory:
    """Tokens of remembered pieces under sorted hashes."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.parts = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in range(2)]

    def extended(self, keys: np.ndarray, ids: list[list[list[int]]]) -> Memory:
        """This memory with more pieces; keys are new and ascend."""
        out = Memory()
        out.keys = np.concatenate([self.keys, keys])
        order = np.argsort(out.keys, kind="stable")
        out.keys = out.keys[order]
        out.parts = []
        for (flat, bounds), new in zip(self.parts, ids, strict=True):
            counts = np.concatenate([np.diff(bounds), [len(i) for i in new]]).astype(np.int64)
            begin = np.cumsum(counts) - counts
            flat = np.concatenate([flat, np.array([t for i in new for t in i], dtype=np.int32)])
            out.parts.append((flat[_spread(begin[order], counts[order])], np.concatenate([[0], np.cumsum(counts[order])])))
        return out


class Aligner:
    """Two vocabularies, and what a worker remembers of them."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.a, self.b = a, b
        self.memory = Memory()
        size = max(len(a.lengths), len(b.lengths))
        self.size = size
        self.numbers = pa.array([f"{i}{s}" for s in ",|;" for i in range(size)], pa.large_string())

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) under A and under B of texts that each begin with a blank."""
        starts = np.union1d(offsets[:-1], cuts(data)) if self.a.cut and self.b.cut else offsets[:-1]
        ends = np.append(starts[1:], offsets[-1])
        hashes = span_hashes(data, starts, ends)
        known, first = np.unique(hashes, return_index=True)
        if len(self.memory.keys) > REMEMBERED:
            self.memory = Memory()
        at = np.searchsorted(self.memory.keys, known)
        fresh = np.ones(len(known), bool)
        inside = at < len(self.memory.keys)
        fresh[inside] = self.memory.keys[at[inside]] != known[inside]
        texts = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in first[fresh]]
        memory = self.memory.extended(known[fresh], [self.a.encode(texts), self.b.encode(texts)])
        where = np.searchsorted(memory.keys, hashes)
        out = []
        of_text = np.searchsorted(starts, offsets)
        for flat, bounds in memory.parts:
            counts = np.diff(bounds)[where]
            out.append((flat[_spread(bounds[where], counts)].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])[of_text]))
        if not (ends - starts > LONG_PIECE).any():
            self.memory = memory
        return out

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """n_a, n_b, n_groups, n_links, sha256 of the groups, and the distinct pairs of ids with how often each is linked, of each text."""
        n = len(texts)
        data, offsets = block_of(texts)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        sizes = np.diff(offsets)[filled] + 1
        ends = np.cumsum(sizes)
        spaced = np.full(int(sizes.sum()), 0x20, np.uint8)
        body = np.ones(len(spaced), bool)
        body[ends - sizes] = False
        spaced[body] = data  # empty texts have no bytes
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        (a, a_of), (b, b_of) = self.tokens(spaced, bounds) if len(filled) else [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2
        same = (sums(self.a.lengths[a], a_of) == sizes) & (sums(self.b.lengths[b], b_of) == sizes)
        for again in (True, False):  # by length first, so that bytes stand under each other
            if not same.all():
                a, a_of = _of_texts(a, a_of, same)
                b, b_of = _of_texts(b, b_of, same)
                spaced, bounds = _of_texts(spaced, bounds, same)
                filled = filled[same]
            if again:
                wrong = (self.a.joined(a) != spaced) | (self.b.joined(b) != spaced)
                same = sums(wrong, bounds) == 0
        out: dict[str, np.ndarray | list] = {name: np.zeros(n, np.int64) for name in COUNTS}
        out["sha"] = [""] * n
        out["pairs"], out["times"], out["bounds"] = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if not len(filled):
            return out
        owner_a = np.repeat(np.arange(len(a)), self.a.lengths[a])
        owner_b = np.repeat(np.arange(len(b)), self.b.lengths[b])
        change_a, change_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change_a | change_b) + 1])
        link_a, link_b = owner_a[starts], owner_b[starts]
        group = np.concatenate([[0], np.cumsum(change_a & change_b)])[starts]  # other texts begin with a cut
        of_link = np.searchsorted(bounds, starts, side="right") - 1
        links = np.bincount(of_link, minlength=len(filled))
        first_group = group[np.concatenate([[0], np.cumsum(links)[:-1]])]
        n_groups = int(group[-1]) + 1
        out["n_a"][filled], out["n_b"][filled], out["n_links"][filled] = np.diff(a_of), np.diff(b_of), links
        out["n_groups"][filled] = np.diff(np.append(first_group, n_groups))

        # the groups as text: each token's number and the sign after it, in the order of output
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[link_a], group_b[link_b] = group, group
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        begin = np.cumsum(in_a + in_b) - (in_a + in_b)
        items = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        items[_spread(begin, in_a)] = a + np.where(last_a, self.size, 0)
        items[_spread(begin + in_a, in_b)] = b + np.where(last_b, 2 * self.size, 0)
        digits, places = block_of(self.numbers.take(pa.array(items)))
        edges = np.append(begin[first_group], len(items))
        for k, text in enumerate(filled):
            out["sha"][text] = hashlib.sha256(digits[places[edges[k]] : places[edges[k + 1]] - 1]).hexdigest()

        span = len(self.a.lengths) * len(self.b.lengths)
        keys, times = np.unique(of_link * span + a[link_a] * len(self.b.lengths) + b[link_b], return_counts=True)
        out["pairs"], out["times"] = keys % span, times
        out["bounds"] = np.concatenate([[0], np.cumsum(np.bincount(filled[keys // span], minlength=n))])
        return out


def _of_texts(values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    return values[np.repeat(chosen, counts)], np.concatenate([[0], np.cumsum(counts[chosen])])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker, so that pieces are remembered from task to task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(byte_level(path_a), pieces(path_b))
    return _ALIGNERS[path_a, path_b]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def links(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """A row for each document, with its counts and its distinct pairs, and one (held) for each
    block of documents, with the block's distinct pairs and how many of its documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(path_a, path_b)
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        waiting: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            pairs, held = np.unique(np.concatenate(waiting), return_counts=True)
            none = pa.array([0], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), none, none, none, none, pa.array([""]), _lists(pairs, np.array([0, len(pairs)])), _lists(held, np.array([0, len(held)])), pa.array([True])], names=names)

        for batch in batches:
            for at, part in slices(batch.column("text"), CHUNK_BYTES):
                found = model.align(part)
                ids = batch.column("doc_id").slice(at, len(part)).cast(pa.int64())
                bounds = found["bounds"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), ids, *[pa.array(found[c]) for c in COUNTS], pa.array(found["sha"], pa.string()), _lists(found["pairs"], bounds), _lists(found["times"], bounds), pa.array(np.zeros(len(part), bool))], names=names)
                waiting.append(found["pairs"])
                if sum(map(len, waiting)) >= block_pairs:
                    yield summed()
                    waiting.clear()
                    block += 1
        if waiting:
            yield summed()

    names = [c.split(" ")[0] for c in ROW.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def _judged(docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of a block, from the corpus-wide counts of its pairs."""
    order = np.argsort(known.column("pair").to_numpy())
    pair, held, best = (known.column(c).to_numpy()[order] for c in ("pair", "held", "best"))
    lists = docs.column("pairs").combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int64()))
    own = lists.flatten().to_numpy()
    times = (docs.column("times").combine_chunks() if docs.num_rows else lists).flatten().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    at = np.searchsorted(pair, own)
    n_best, count_sum = sums(times * best[at], bounds), sums(times * held[at], bounds)
    return pa.table({"doc_id": docs.column("doc_id"), **{c: docs.column(c) for c in COUNTS}, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": docs.column("groups_sha256")})


def aligned(docs: DataFrame, path_a: str, path_b: str, width_b: int, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; width_b: the size of B's vocabulary."""
    found = stored(links(docs, path_a, path_b, block_pairs), "links")
    held = found.where("held").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    held = held.repartition("pair")  # dealt once: the counts and the join both find it so
    total = held.groupBy("pair").agg(F.sum("n").alias("held"))
    a = F.expr(f"pair div {width_b}")
    most = total.groupBy(a.alias("a")).agg(F.max("held").alias("most"))
    marked = total.join(F.broadcast(most), a == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).cast("bigint").alias("best"))
    known = held.select("block", "pair").join(marked, "pair").select(F.col("block").alias("of"), "pair", "held", "best")
    own = found.where("NOT held").select("block", "doc_id", *COUNTS, "groups_sha256", "pairs", "times")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_judged, schema)


def op12_byte_owners(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return aligned(docs, path_a, path_b, len(pieces(path_b).lengths))
