"""Operator 8, benchmark decontamination: a prefix-filtered set join on word shingles.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window) and is sought as the set of its word shingles.  A pass over the whole
corpus counts the benchmark's shingles; a window's shingles are ordered by that
rarity.  Full containment makes the necessary prefix one shingle long, so a
window is indexed by its rarest shingle alone, and a document's shingles are
joined with that index.  A match gives the only place where the window can
start; the bounds of the document (length, position) are applied to it and the
window's words are compared one by one.  Every word within an occurrence is hit.

The benchmark is read in blocks of at most BLOCK_WORDS words, each broadcast on
its own; a task holds one block's index at a time.  The driver holds all of them
while it builds, about 100 bytes for a word of the benchmark: this is the bound of
the method as it is, and it grows with the benchmark, never with the corpus.
Documents never move: there is no shuffle of the corpus and a passage that every
document holds meets no other in a task.  Words are told by 64-bit hashes; each
word of a window is compared, so a false hit needs a collision in place.

Cases: null, empty and word-free texts have no words and no hits; null, empty and
word-free items have no windows; repeated item ids count once; windows shared by
items count for each; an empty benchmark hits nothing; repeated document rows give
equal results, a row each; a very long text is one chunk and read whole; windows of
equal rarity are indexed by their first shingle; ids of items may be texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import kernel as K
from .common import table

U64 = np.uint64
WINDOW = 8
SHINGLE = 3
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Distinct windows of some items: words (w, window), lengths, and the items of each."""

    words: np.ndarray
    lengths: np.ndarray
    #: The items' lower-cased bytes, where their words lie, and each window's first word among them.
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    items: list[list]
    #: (shingle length, sorted prefix shingles, first of each one's windows, windows, offsets within)
    index: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Index:
    """Broadcast blocks, and the type of item ids."""

    blocks: list[Broadcast]
    item_type: DataType


def _shingles(hashes: np.ndarray, q: int) -> np.ndarray:
    """Rolling shingles of q words at every place, also over borders of documents."""
    total = max(len(hashes) - q + 1, 0)
    out = np.zeros(total, U64)
    for t in range(q):
        out += hashes[t : t + total] * U64(pow(0xC2B2AE3D27D4EB4F, t + 1, 1 << 64))
    return K.mix(out)


def make_block(items: list[tuple], window: int) -> Block:
    seen: dict[bytes, int] = {}
    words, lengths, owners, first = [], [], [], []
    data, offsets = _joined([t for _, t in items])
    w = K.words(data, offsets, K.NON_ALNUM)
    data = K.LOWER[data]
    spelt = [data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    for (item, _), lo, n in zip(items, w.first, w.counts):
        for at in range(lo, lo + max(n - window, 0) + 1) if n else ():
            own = w.hashes[at : at + min(n, window)]
            k = seen.setdefault(b" ".join(spelt[at : at + len(own)]), len(words))
            if k == len(words):
                first.append(at)
                words.append(np.pad(own, (0, window - len(own))))
                lengths.append(len(own))
                owners.append([])
            if item not in owners[k]:
                owners[k].append(item)
    return Block(np.stack(words) if words else np.zeros((0, window), U64), np.array(lengths, np.int64), data, w.starts, w.ends, np.array(first, np.int64), owners, [])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def _places(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By shingle length: the windows that have it, and their shingles (windows, places)."""
    for q in range(1, SHINGLE + 1):
        own = np.flatnonzero(np.minimum(block.lengths, SHINGLE) == q)
        for n in np.unique(block.lengths[own]):
            some = own[block.lengths[own] == n]
            flat = _shingles(block.words[some, :n].ravel(), q)
            yield q, some, flat[(np.arange(len(some)) * n)[:, None] + np.arange(n - q + 1)]


def _counter(blocks: list[Broadcast]):
    """Occurrences of the benchmark's shingles in the documents, as (block, place among its sorted shingles, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, block in enumerate(blocks):
                wanted = block.value
                sums.setdefault(b, np.zeros(sum(len(k) for _, k in wanted), np.int64))
                for _, _, data, offsets in K.chunks(batch.column(0)):
                    hashes = K.words(data, offsets, K.NON_ALNUM).hashes
                    start = 0
                    for q, keys in wanted:
                        at = _members(keys, _shingles(hashes, q))[1]
                        sums[b][start : start + len(keys)] += np.bincount(at, minlength=len(keys))
                        start += len(keys)
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)
        for b, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["block", "at", "n"])

    return run


def _members(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values, and in the sorted keys, where values hold a key."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(values & U64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, values[some]), len(keys) - 1)
    hit = keys[at] == values[some]
    return some[hit], at[hit]


def build(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> Index:
    """Broadcast blocks of windows, each indexed by its rarest shingle in docs.  Item ids may be of any type that can be sorted."""
    item_type = benchmark.schema[item_col].dataType
    spark = docs.sparkSession
    sc = spark.sparkContext
    blocks: list[Block] = []
    held: list[tuple] = []
    words = 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    for r in rows.toLocalIterator():
        held.append((r["item"], r["text"]))
        words += len(r["text"]) // 2 + 1
        if words >= BLOCK_WORDS:
            blocks.append(make_block(held, window))
            held, words = [], 0
    if held:
        blocks.append(make_block(held, window))
    blocks = [b for b in blocks if len(b.words)]
    if not blocks:
        return Index([], item_type)
    places = [list(_places(b)) for b in blocks]
    wanted = [[(q, np.unique(np.concatenate([s.ravel() for p, _, s in own if p == q]))) for q in sorted({p for p, _, _ in own})] for own in places]
    counted = docs.select(text_col).mapInArrow(_counter([sc.broadcast(w) for w in wanted]), "block int, at long, n long").groupBy("block", "at").agg(F.sum("n").alias("n"))
    counts = [np.zeros(sum(len(k) for _, k in w), np.int64) for w in wanted]
    for r in counted.toLocalIterator():
        counts[r["block"]][r["at"]] = r["n"]
    for block, own, keys, n in zip(blocks, places, wanted, counts):
        start = 0
        for q, sorted_keys in keys:
            rarity = n[start : start + len(sorted_keys)]
            start += len(sorted_keys)
            windows = np.concatenate([some for p, some, _ in own if p == q])
            offset, prefix = [], []
            for p, _, shingles in own:
                if p == q:
                    rarest = np.argmin(rarity[np.searchsorted(sorted_keys, shingles)], axis=1)
                    offset.append(rarest)
                    prefix.append(shingles[np.arange(len(shingles)), rarest])
            prefix, offset = np.concatenate(prefix), np.concatenate(offset)
            order = np.argsort(prefix, kind="stable")
            heads, first = np.unique(prefix[order], return_index=True)
            block.index.append((q, heads, np.append(first, len(order)), windows[order], offset[order]))
    return Index([sc.broadcast(b) for b in blocks], item_type)


def _spelt_alike(block: Block, window: np.ndarray, w: K.Words, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows' words have the very bytes of the words from start on."""
    size = block.lengths[window]
    ends = np.cumsum(size)
    nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    theirs, own = np.repeat(block.first[window], size) + nth, np.repeat(start, size) + nth
    long, n = block.ends[theirs] - block.starts[theirs], w.ends[own] - w.starts[own]
    alike = long == n
    n = np.where(alike, n, 0)
    until = np.cumsum(n)
    byte = np.arange(int(until[-1]) if len(until) else 0) - np.repeat(until - n, n)
    unlike = block.data[np.repeat(block.starts[theirs], n) + byte] != K.LOWER[data[np.repeat(w.starts[own], n) + byte]]
    alike &= np.diff(np.concatenate([[0], np.cumsum(unlike)])[np.concatenate([[0], until])]) == 0
    return np.diff(np.concatenate([[0], np.cumsum(~alike)])[np.concatenate([[0], ends])]) == 0


def occurrences(block: Block, w: K.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word where it starts) of every verified occurrence in a chunk's documents, whose bytes are data."""
    first = w.first
    found_windows, found_starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, heads, firsts, windows, offsets in block.index:
        at, head = _members(heads, _shingles(w.hashes, q))
        several = firsts[head + 1] - firsts[head]
        at = np.repeat(at, several)
        entry = np.repeat(firsts[head], several) + np.arange(len(at)) - np.repeat(np.cumsum(several) - several, several)
        window, start = windows[entry], at - offsets[entry]
        length = block.lengths[window]
        inside = (start >= 0) & (start + length <= len(w.hashes))
        window, start, length = window[inside], start[inside], length[inside]
        doc = np.searchsorted(first, start, "right") - 1
        inside = start + length <= first[doc + 1]
        window, start, length = window[inside], start[inside], length[inside]
        same = np.ones(len(window), bool)
        for t in range(block.words.shape[1]):
            has = length > t
            same[has] &= w.hashes[start[has] + t] == block.words[window[has], t]
        window, start = window[same], start[same]
        same = _spelt_alike(block, window, w, data, start)
        found_windows.append(window[same])
        found_starts.append(start[same])
    return np.concatenate(found_windows), np.concatenate(found_starts)


def contamination(docs: DataFrame, index: Index, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns of docs, n_words, n_hit, and items, the sorted ids of the items that occur."""
    k, blocks, of_items = len(carry), index.blocks, to_arrow_type(index.item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = [], [], []
            spans = list(K.chunks(batch.column(k)))
            marks = []
            for b, shared in enumerate(blocks or [None]):
                block = shared.value if shared is not None else None
                for c, (lo, hi, data, offsets) in enumerate(spans):
                    w = K.words(data, offsets, K.NON_ALNUM)
                    if not b:
                        marks.append((np.zeros(len(w.hashes) + 1, np.int32), w.first, [set() for _ in range(lo, hi)]))
                    if block is None:
                        continue
                    border, first, own = marks[c]
                    window, start = occurrences(block, w, data)
                    np.add.at(border, start, 1)
                    np.add.at(border, start + block.lengths[window], -1)
                    doc = np.searchsorted(first, start, "right") - 1
                    for d, x in set(zip(doc.tolist(), window.tolist())):
                        own[d].update(block.items[x])
                if len(blocks) > 1:
                    shared.__dict__.pop("_value", None)
            for border, first, own in marks:
                hit = np.concatenate([[0], np.cumsum(np.cumsum(border[:-1]) > 0)])[first]
                n_words.append(np.diff(first))
                n_hit.append(np.diff(hit))
                items += [sorted(x) for x in own]
            new = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_words, n_hit)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new, pa.array(items, pa.list_(of_items))], names=[*batch.schema.names[:k], "n_words", "n_hit", "items"])

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + f", n_words long, n_hit long, items array<{index.item_type.simpleString()}>"
    return docs.select(*carry, F.col(text_col).alias("text_")).mapInArrow(run, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = contamination(docs, build(docs, table(spark, sf_dir, "benchmark")))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON win.x = p.x AND win.n = p.n),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
