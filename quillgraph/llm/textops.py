"""Vectorised work on whole Arrow string columns: words, hashes, windows.

An Arrow string column is one byte buffer and an offset per text. Everything
here runs over that buffer with numpy, so no Python object exists per word.
Byte buffers are taken in blocks of at most ``CHUNK_BYTES`` of whole texts; a
single longer text is one block of its own, and its hashes are still computed in
pieces of ``PIECE`` bytes, so beside one byte per byte only words cost memory.

Words are told apart by 64-bit hashes: a polynomial over the bytes modulo 2**64,
finished by a mixing step and the word's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
PIECE = 1 << 17

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_LOW_BITS = 16


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    step = base & (2**64 - 1)
    with np.errstate(over="ignore"):
        while len(out) < count:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step & (2**64 - 1)
    return out[:count]


_POW = _powers(_P, PIECE)
_INV_LOW = _powers(_P_INV, 1 << _LOW_BITS)
_CODES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=True)
        z += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of the (first, last) ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of a word in ``[^\x20\x09-\x0D]+``; bytes of other characters than ASCII are word bytes.
SPACED_WORD = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of a word in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM_WORD = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
NOT_NEWLINE = ~byte_table([(0x0A, 0x0A)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """The words of a block of texts. starts, ends: byte offsets in the block;
    hashes: 64 bits each; bounds[i]:bounds[i+1] are the words of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def block_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of at most ``limit`` bytes, or of one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = block_of(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, texts.slice(at, end - at)
        at = end
    give_back()


def give_back() -> None:
    """Hands memory that blocks have freed back to the system: a worker lives for many tasks, and
    allocators otherwise keep the most that any of them used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes in ``table``; a run ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    edge[offsets[-1]] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts and ends ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    carry, scale = np.uint64(0), 1
    total = np.zeros(PIECE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(data), PIECE):
            part = data[first : first + PIECE]
            values = _CODES[part]
            values *= _POW[: len(part)]
            values *= np.uint64(scale)
            np.cumsum(values, out=total[1 : len(part) + 1])
            total[0] = 0
            a, b = np.searchsorted(starts, [first, first + len(part)], side="left")
            at_start[a:b] = total[starts[a:b] - first] + carry
            a, b = np.searchsorted(ends, [first + 1, first + len(part) + 1], side="left")
            at_end[a:b] = total[ends[a:b] - first] + carry
            carry += total[len(part)]
            scale = scale * pow(_P, len(part), 1 << 64) & (2**64 - 1)
        high = _powers(pow(_P_INV, 1 << _LOW_BITS, 1 << 64), int(starts[-1] >> _LOW_BITS) + 1)
        unit = _INV_LOW[starts & ((1 << _LOW_BITS) - 1)] * high[starts >> _LOW_BITS]
        return mix64((at_end - at_start) * unit + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words_of(texts: pa.Array, table: np.ndarray = SPACED_WORD, lower: bool = False) -> tuple[np.ndarray, np.ndarray, Words]:
    """(bytes, text offsets, words) of a string array."""
    data, offsets = block_of(texts)
    if lower:
        data = lower_ascii(data)
    starts, ends = runs(data, offsets, table)
    return data, offsets, Words(starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values; one per start, fewer by width-1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(_P)
            out += hashes[k : k + n]
    return mix64(out)


def windows_within(bounds: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie within one text."""
    n = int(bounds[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    room = np.ones(n, dtype=bool)
    for back in range(1, width):  # a start this far before a text's end crosses it
        at = bounds[1:-1] - back
        room[at[(at >= 0) & (at < n)]] = False
    # empty and short texts: a start belongs to its own text only if the window ends there
    starts = np.flatnonzero(room)
    return starts


def known_ids(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 + index of each hash in the sorted vocabulary; 0 if it isn't there."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
