"""Vectorised text kernel: from an Arrow string column to word hashes.

One Arrow batch is cut into chunks of a bounded number of bytes and every step
(lower-casing, word boundaries, word hashes, n-gram hashes) is a numpy pass over
the bytes of a chunk, so no Python object is made for a word.  A chunk always
holds whole documents; word hashes are made BLOCK bytes at a time, so a document
longer than a chunk costs a few bytes of memory for each of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20
BLOCK = 1 << 18


def _return_memory() -> None:
    """Arrays of 4 MB and more go back to the system when they are freed: a worker lives through many stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD of glibc
    except (AttributeError, OSError):
        pass


_return_memory()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the two word classes; both are ASCII, so bytes of multi-byte characters are word bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Bytes of a span that the table tells by their place; longer spans are hashed one by one.
_PLACES = 64
#: A random number for each place and byte, drawn from a fixed seed so that every task has the same.
_TABLE = np.frombuffer(hashlib.shake_256(b"words of a text").digest(_PLACES * 256 * 8), U64)
END_WORD = U64(0x1F83D9ABFB41BD6B)
START_WORD = U64(0x5BE0CD19137E2179)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (in order, apart), BLOCK bytes of text at a time.

    Tabulation: the sum of a random number for each byte at its place.  Unlike a polynomial modulo a power of two it has
    no texts that collide by their structure.  Longer spans are hashed by BLAKE2b.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + BLOCK, "right")), i + 1)
        size = ends[i:j] - starts[i:j]
        short = size <= _PLACES
        some, size = starts[i:j][short], size[short]
        if len(some):
            span = data[lo : some[-1] + size[-1]]
            # The place within its span: bytes counted from the latest start; what lies between spans is never summed.
            place = np.arange(len(span), dtype=np.int32)
            from_ = np.zeros(len(span), np.int32)
            from_[some[size > 0] - lo] = place[some[size > 0] - lo]
            place -= np.maximum.accumulate(from_)
            np.minimum(place, _PLACES - 1, out=place)
            place <<= 8
            place |= span
            sums = np.zeros(len(span) + 1, U64)
            np.cumsum(_TABLE[place], out=sums[1:])
            out[i:j][short] = sums[some + size - lo] - sums[some - lo]
        for k in (i + np.flatnonzero(~short)).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
        i = j
    return mix(out)


@dataclass
class Words:
    """The words of a chunk: byte spans, 64-bit hashes and words per document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and the total."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def string_column(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets from 0) of each chunk of whole documents."""
    col = string_column(col)
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Words of the lower-cased (A-Z) documents; a document border ends a word."""
    low = LOWER[data]
    inside = ~separators[low]
    n = len(low)
    border = offsets[(offsets > 0) & (offsets < n)]
    edge = np.zeros(n + 1, bool)
    edge[:n] = inside
    edge[1:n] &= ~inside[: n - 1]
    edge[border] |= inside[border]
    starts = np.flatnonzero(edge[:n])
    edge[:] = False
    edge[1:] = inside
    edge[1:n] &= ~inside[1:]
    edge[border] |= inside[border - 1]
    ends = np.flatnonzero(edge)
    hashes = span_hashes(low, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(starts, ends, hashes, counts)


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and how many each document has.

    A document with fewer words, but not none, has its whole sequence as one.
    """
    n, first = len(w.hashes), w.first
    power = [U64(pow(0xD6E8FEB86659FD93, t + 1, 1 << 64)) for t in range(k)]
    total = max(n - k + 1, 0)
    rolled = np.zeros(total, U64)
    for t in range(k):
        rolled += w.hashes[t : t + total] * power[t]
    counts = np.maximum(w.counts - k + 1, 0)
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, first[:-1], (counts > 0).astype(np.int32))
    np.add.at(keep, first[:-1] + counts, -(counts > 0).astype(np.int32))
    rolled = rolled[np.cumsum(keep[:total]) > 0] if total else rolled
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.zeros(len(short), U64)
        for t in range(k - 1):
            has = w.counts[short] > t
            whole[has] += w.hashes[first[short[has]] + t] * power[t]
        whole ^= w.counts[short].astype(U64)
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        rolled = np.insert(rolled, at, whole)
        counts = counts.copy()
        counts[short] = 1
    return mix(rolled), counts


def text_hashes(w: list[str]) -> np.ndarray:
    """Hashes of given words, as words() makes them."""
    data = [x.encode() for x in w]
    flat = np.frombuffer(b" ".join(data), np.uint8)
    out = words(flat, np.array([0, len(flat)]), SPACE)
    if len(out.hashes) != len(w):
        raise ValueError("a word holds white space or is empty")
    return out.hashes


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
