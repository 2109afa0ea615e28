"""Token counts as the tokenizer's library gives them, also for huge documents.

A text of up to CHUNK characters is the sum of its words between white spaces, each distinct
word of a task encoded once by the library. A longer one is encoded in chunks
that overlap, with offsets, and neighbouring chunks are spliced at a stable common
boundary: a stable place where a token starts in both chunks, both giving the same tokens
from there to the last stable place that they share. Places are stable that the tokenizer's own splits
prove so: after ASCII white space, which they drop; before a digit after an ASCII letter or digit, as every digit stands
alone; between an ASCII letter or digit, or a kana or Han letter, and a punctuation mark that is in no special string and
begins no contraction, as letters and other characters are split. No merge, normaliser or special string reaches over such a
place. Where the overlap has none it is widened, at last to the whole of the chunks before, and the next
chunk is as long as that, so the count is exact whatever the text is, in time that is the
text's length times a logarithm; memory is bounded by the distance between two stable places.

All this holds for tokenizers whose file says that they split so, which is looked up in it; with others
each text is encoded whole by the library.

Defined results: null is read as empty text and has no tokens.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textops import known_ids, slices, sums, words_of

VOCABULARY = "word_bpe_49k.json"
CHUNK = 32_768
OVERLAP = 256
LIMIT = 2048
BATCH_BYTES = 2_000_000
CACHE = 1 << 20
#: Fixed value: the splits that stable places are proven from.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_MARKS = r"""0-9;,(){}=.:/+*&"_\-"""
_LETTERS, _STOPS = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff", "。，、！？；："
_STABLE = re.compile(rf"(?<=[ \t\n\r])|(?<=[A-Za-z0-9])(?=[{_MARKS}])|(?<=[{_LETTERS}])(?=[{_STOPS}])|(?<=[{_STOPS}])(?=[{_LETTERS}])")


def tokenizer(path: str):
    """The library's tokenizer of a file, with its default handling of special strings, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Chunk:
    """Tokens of text[begin:end], with offsets in the text."""

    def __init__(self, encode, text: str, begin: int, end: int) -> None:
        self.begin, self.end = begin, end
        done = encode(text[begin:end], add_special_tokens=False)
        self.ids = done.ids
        self.starts = [begin + a for a, _ in done.offsets]

    def at(self, place: int) -> int:
        """How many tokens start before the place."""
        return bisect_left(self.starts, place)


def boundary(text: str, left: Chunk, right: Chunk) -> int | None:
    """The first stable common place in the overlap of two chunks."""
    places = [m.start() for m in _STABLE.finditer(text, right.begin + 1, left.end)]
    if not places:
        return None
    last = places[-1]
    to_a, to_b = left.at(last), right.at(last)
    for place in places:
        a, b = left.at(place), right.at(place)
        if left.starts[a : a + 1] == right.starts[b : b + 1] == [place] and left.ids[a:to_a] == right.ids[b:to_b] and left.starts[a:to_a] == right.starts[b:to_b]:
            return place
    return None


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, chunk by chunk."""
    left = Chunk(encode, text, 0, min(chunk, len(text)))
    total, counted = 0, 0  # tokens before the place ``counted`` are in total
    while left.end < len(text):
        end, back = min(left.end + max(chunk, left.end - left.begin) - overlap, len(text)), overlap
        while True:
            begin = max(counted, left.end - back)
            if begin > counted and _STABLE.search(text, begin + 1, left.end) is None:
                back *= 8
                continue
            right = Chunk(encode, text, begin, end)
            if begin == counted:  # as wide as it can be: the right chunk replaces the left one
                break
            place = boundary(text, left, right)
            if place is not None:
                total += left.at(place) - left.at(counted)
                counted = place
                break
            back *= 8
        left = right
    return total + len(left.ids) - left.at(counted)


def splits_proven(path: str) -> bool:
    """Whether the file says that the tokenizer splits a text as the stable places need it: white space is
    dropped, digits stand alone, letters and other characters are apart; and no special string has a stable place in it."""
    with open(path) as f:
        own = json.load(f)
    parts = own.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    splits = [p for p in parts if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and p.get("pattern", {}).get("Regex") == SPLIT]
    normal = own.get("normalizer") or {}
    kinds = {n.get("type") for n in normal.get("normalizers", [normal]) if n}
    special = [t["content"] for t in own.get("added_tokens", [])]
    return len(splits) == 1 and kinds <= {"NFC", "Replace", "Lowercase"} and not any(_STABLE.search(t, 1) or re.match(rf"[{_MARKS}{_STOPS}]", t) or t[-1:].isalnum() for t in special)


class WordSizes:
    """Tokens of texts as sums over their words; the sizes of words seen are kept, up to CACHE of them."""

    def __init__(self, model) -> None:
        self.model = model
        self.hashes, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def totals(self, texts: pa.Array) -> np.ndarray:
        data, _, words = words_of(texts)
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = known_ids(self.hashes, distinct)
        size = np.where(at > 0, np.append(self.sizes, 0)[at - 1], 0)
        fresh = np.flatnonzero(at == 0)
        if len(fresh):
            raw = data.tobytes()
            starts, ends = words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist()
            size[fresh] = [len(e) for e in self.model.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts, ends, strict=True)], add_special_tokens=False)]
            if len(self.hashes) + len(fresh) > CACHE:
                self.hashes, self.sizes = distinct, size
            else:
                both = np.concatenate([self.hashes, distinct[fresh]])
                order = np.argsort(both)
                self.hashes, self.sizes = both[order], np.concatenate([self.sizes, size[fresh]])[order]
        return sums(size[which], words.bounds)


def counts(path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The number of tokens of the whole text under the tokenizer of a file."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, proven = tokenizer(path), splits_proven(path)
        sizes = WordSizes(model)
        for texts in batches:
            out = [np.zeros(0, np.int64)]
            for _, part in slices(texts, BATCH_BYTES):
                if not proven:
                    whole = model.encode_batch_fast([t or "" for t in part.to_pylist()], add_special_tokens=False)
                    out.append(np.array([len(e) for e in whole], np.int64))
                    continue
                long = pc.greater(pc.utf8_length(part), chunk).fill_null(False)
                total = sizes.totals(pc.if_else(long, "", part))
                for k in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                    total[k] = count_long(model.encode, part[k].as_py(), chunk, overlap)
                out.append(total)
            yield pa.array(np.concatenate(out))

    return count(F.col(text))


def op5_token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), counts(str(path), "text").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
