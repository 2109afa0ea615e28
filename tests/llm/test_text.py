"""The vectorised text work against re and plain Python."""

import os
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import textops as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\x1caAbZ09-#é😀\u0301", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    data, _, words = tx.words_of(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[bytes(data[words.starts[k] : words.ends[k]]).decode() for k in range(a, b)] for a, b in zip(words.bounds, words.bounds[1:])]
    assert got == want
    flat = [w for ws in want for w in ws]
    same = {}
    assert all(same.setdefault(w, h) == h for w, h in zip(flat, words.hashes.tolist())) and len(set(same.values())) == len(same)
    starts = tx.windows_within(words.bounds, 3)
    assert [int(s) for s in starts] == [int(b) + k for b, ws in zip(words.bounds, want) for k in range(len(ws) - 2)]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lower_words(texts):
    data, _, words = tx.words_of(pa.array(texts, pa.string()), tx.ALNUM_WORD, lower=True)
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    want = [w for t in lower for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
    assert [bytes(data[a:b]).decode() for a, b in zip(words.starts, words.ends)] == want


def test_long_words_hash_alike_wherever_they_stand():
    long = "x" * (3 * tx.PIECE + 17)
    _, _, words = tx.words_of(pa.array([f"a {long} b", long, long[:-1]]))
    assert words.hashes[1] == words.hashes[3] != words.hashes[4]


def test_slices_cover_everything():
    texts = pa.array(["a" * n for n in (5, 0, 100, 3, 3, 3)] + [None])
    parts = list(tx.slices(texts, 6))
    assert [t for _, p in parts for t in p.to_pylist()] == texts.to_pylist() and [a for a, _ in parts][0] == 0
    assert list(tx.slices(pa.array([], pa.string()))) == []
    sliced = tx.words_of(texts.slice(2, 2))[2]
    assert sliced.counts.tolist() == [1, 1]


def test_known_ids():
    v = np.array([3, 5, 9], np.uint64)
    assert tx.known_ids(v, np.array([9, 4, 3, 10], np.uint64)).tolist() == [3, 0, 1, 0]
    assert tx.known_ids(v[:0], v).tolist() == [0, 0, 0]


def test_stored_tables_can_be_dropped(spark):
    from quillgraph.llm import tables

    df = tables.stored(spark.range(3).toDF("n"), "x")
    place = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(place) and tables.shared_folder(spark) in place
    tables.drop_stored(spark)
    assert not os.path.exists(place)
