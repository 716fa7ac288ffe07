"""Operator 1, LM scoring: a log-frequency Bloom filter of bigram counts.

Training counts every token and every bigram of the training documents, texts
whole.  Each task pre-aggregates what it has read and sends one sorted block of
(key, count) per hash bucket, so a very frequent word costs one entry a block.
A reducer merges a bucket's blocks.  Of the bigrams it keeps a Bloom filter: a
bigram with count c is quantised to the level q = 1 + floor(log2 c) and entered
under (bigram, 1) .. (bigram, q).  Scoring probes level 1, 2, .. until a probe
fails, which gives back q, never too small and rarely too large.

The filter is a list of per-bucket segments; their number grows with the corpus and
an entry has the same bits at every size.  Token counts are exact and dealt into the
same buckets.  A model of at most ``max_broadcast_bytes`` is broadcast in groups of
at most GROUP_BYTES, of which a task holds one at a time.  Of a larger one nothing
goes to the driver: each block of documents sends its distinct tokens and bigrams to
ranges of buckets, one row a range of about RANGE_BYTES of the model, is answered in
passes over many blocks' rows as they stream by the range's segments, and is put
together again by block.  Both ways give the same scores.

Model: P(w|h) = (1-u) * min(2**(q-1), c(h), c(w)) / c(h) + u * (c(w)+1)/(N+V+1),
where u, the mass of unseen bigrams, is the Good-Turing estimate (bigrams seen
once over all bigram tokens) of the training data, held within [0.05, 0.98].  The
lower end of a level stands for its counts, so false positives of the filter apart
the probabilities of a context sum to at most 1; what quantising rounds off is
not dealt out again.

Cases: a null or empty text is its end token alone; a null id counts as the
empty text when folds are made; repeated rows give one result each; a very long
text is one chunk and counts whole; ties do not arise, as counts have no order; an
empty training set gives N = 0, V = 0 and the add-one base of an empty model; an
empty table to score gives an empty result.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import fold, forget, keep, partitions, table

U64 = np.uint64
GROUP_BYTES = 8 << 20
BROADCAST_BYTES = 256 << 20
SCORED_BYTES = 4 << 20
ASKED_BYTES = 8 << 20
RANGE_BYTES = 1 << 20
ANSWERED_KEYS = 1_000_000
FLUSH_TOKENS = 1_500_000
MERGED_ENTRIES = 1_000_000
LOW40 = U64((1 << 40) - 1)
MAX_LEVEL = 48
UNSEEN = (0.05, 0.98)


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with one end a document, whether a token is a document's first, and tokens per document."""
    w = K.words(data, offsets, K.SPACE)
    docs = len(w.counts)
    n = w.counts + 1
    last = np.cumsum(n) - 1
    tokens = np.empty(len(w.hashes) + docs, U64)
    is_end = np.zeros(len(tokens), bool)
    is_end[last] = True
    tokens[is_end] = K.END_WORD
    tokens[~is_end] = w.hashes
    first = np.zeros(len(tokens), bool)
    first[last - n + 1] = True
    return tokens, first, n


def bigram_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = K.START_WORD
    return K.mix(before * U64(0xD6E8FEB86659FD93) + tokens)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U64(32)) * U64(buckets) >> U64(32)


def probes(keys: np.ndarray, level: int, m: int, k: int) -> Iterator[np.ndarray]:
    h = K.mix(keys + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = K.mix(h) | U64(1)
    for _ in range(k):
        yield (h >> U64(32)) * U64(m) >> U64(32)
        h = h + step


def hash_functions(bits_per_entry: float) -> int:
    return max(1, min(8, round(0.69 * bits_per_entry)))


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_per_entry: float) -> tuple[np.ndarray, int, int]:
    """(packed bits, number of bits, hash functions) of one segment."""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    entries = int(levels.sum())
    m = max(64, int(entries * bits_per_entry) + 1)
    if m >> 32:
        raise OverflowError("a segment has places for 2**32 bits; train with more partitions")
    k = hash_functions(bits_per_entry)
    bits = np.zeros(m, bool)
    level = 1
    while len(keys):
        for at in probes(keys, level, m, k):
            bits[at] = True
        level += 1
        more = levels >= level
        keys, levels = keys[more], levels[more]
    return np.packbits(bits, bitorder="little"), m, k


def probe_filter(bits: np.ndarray, m: np.ndarray | int, k: int, keys: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """The level found for each key; 0: absent.  m and base: the size of the key's segment and where it begins, in bits."""
    out = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    sizes, bases = (np.broadcast_to(np.asarray(x, U64), len(keys)) for x in (m, base))
    for level in range(1, MAX_LEVEL):
        at_level, size, begin = keys[alive], sizes[alive], bases[alive]
        for i in range(k):
            h = K.mix(at_level + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            if i:
                h = h + (K.mix(h) | U64(1)) * U64(i)
            at = ((h >> U64(32)) * size >> U64(32)) + begin
            hit = (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0
            alive, at_level, size, begin = alive[hit], at_level[hit], size[hit], begin[hit]
            if not len(alive):
                return out
        out[alive] = level
    return out


class Segments:
    """Filter segments of neighbouring buckets laid end to end, so that one pass probes all of them."""

    def __init__(self, rows: list, first: int | None = None, past: int | None = None):
        self.first, self.past, self.k = rows[0]["bucket"] if first is None else first, rows[-1]["bucket"] + 1 if past is None else past, rows[0]["k"]
        sizes = [len(r["payload"]) for r in rows]
        self.bits = np.frombuffer(b"".join(r["payload"] for r in rows), np.uint8)
        self.m, self.base = np.ones(self.past - self.first, U64), np.zeros(self.past - self.first, U64)
        own = np.array([r["bucket"] - self.first for r in rows])
        self.m[own], self.base[own] = [r["m"] for r in rows], 8 * (np.cumsum(sizes) - sizes)
        self.empty = np.ones(self.past - self.first, bool)
        self.empty[own] = False

    def levels(self, pairs: np.ndarray, cuts: np.ndarray, out: np.ndarray) -> None:
        """Writes the levels of those pairs that are in these buckets; cuts: where each bucket's pairs begin."""
        own = slice(cuts[self.first], cuts[self.past])
        bucket = np.repeat(np.arange(self.past - self.first), np.diff(cuts[self.first : self.past + 1]))
        out[own] = self.found(pairs[own] & LOW40, bucket)

    def found(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The levels of keys; bucket: of each, counted from the first."""
        return np.where(self.empty[bucket], 0, probe_filter(self.bits, self.m[bucket], self.k, keys, self.base[bucket]))


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


_BLOCK = pa.schema([("bucket", pa.int32()), ("ngram", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART = pa.schema([("bucket", pa.int32()), ("ngram", pa.int8()), ("n", pa.int64()), ("total", pa.int64()), ("once", pa.int64()), ("m", pa.int64()), ("k", pa.int32()), ("payload", pa.binary())])
_BLOCK_DDL = "bucket int, ngram tinyint, keys binary, counts binary"
_PART_DDL = "bucket int, ngram tinyint, n long, total long, once long, m long, k int, payload binary"


def _narrow(keys: np.ndarray) -> np.ndarray:
    """The lower 40 bits of each key, as 5 bytes."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view(U64).ravel()


def _count_blocks(buckets: int):
    def flush(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        out: dict[str, list] = {"bucket": [], "ngram": [], "keys": [], "counts": []}
        for order, parts in ((1, tokens), (2, pairs)):
            keys, counts = _counted(np.concatenate(parts))
            cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo < hi:
                    raw = keys[lo:hi]
                    raw = raw.tobytes() if order == 1 else _narrow(raw).tobytes()
                    out["bucket"].append(b)
                    out["ngram"].append(order)
                    out["keys"].append(raw)
                    out["counts"].append(counts[lo:hi].astype(np.uint32).tobytes())
        return K.rows(_BLOCK, **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                t, first, _ = token_stream(data, offsets)
                tokens.append(t)
                pairs.append(bigram_keys(t, first))
                held += len(t)
                if held >= FLUSH_TOKENS:
                    yield flush(tokens, pairs)
                    tokens, pairs, held = [], [], 0
        if held:
            yield flush(tokens, pairs)

    return run


def _entries(part: pa.Table, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for raw, counts in zip(part["keys"], part["counts"]):
        raw = np.frombuffer(raw.as_buffer(), np.uint8)
        yield raw.view(U64) if order == 1 else _wide(raw), np.frombuffer(counts.as_buffer(), np.uint32)


def _merged(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sorted blocks, taken in as many at a time as hold MERGED_ENTRIES more than what is there."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    held, waiting = [], 0

    def fold_in():
        return _counted(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c.astype(np.int64) for _, c in held)]))

    for k, c in blocks:
        held.append((k, c))
        waiting += len(k)
        if waiting >= MERGED_ENTRIES + len(keys):
            (keys, counts), held, waiting = fold_in(), [], 0
    return fold_in() if held else (keys, counts)


def _merge_bucket(bits_per_entry: float):
    def run(block: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _PART}
        for order in (1, 2):
            part = block.filter(pa.compute.equal(block["ngram"], order))
            if not part.num_rows:
                continue
            keys, counts = _merged(_entries(part, order))
            m = k = 0
            if order == 1:
                payload = keys.tobytes() + counts.tobytes()
            else:
                bits, m, k = build_filter(keys, counts, bits_per_entry)
                payload = bits.tobytes()
            for name, v in (("bucket", block["bucket"][0].as_py()), ("ngram", order), ("n", len(keys)), ("total", int(counts.sum())), ("once", int((counts == 1).sum())), ("m", m), ("k", k), ("payload", payload)):
                out[name].append(v)
        return pa.Table.from_batches([K.rows(_PART, **out)])

    return run


@dataclass
class Model:
    parts: DataFrame
    buckets: int
    tokens: int
    types: int
    documents: int
    unseen: float
    bytes: int = 0


def train(docs: DataFrame, text_col: str = "text", bits_per_entry: float = 7.2) -> Model:
    """Counts the documents of docs; the parts are stored in the shared folder."""
    p = partitions(docs, 16 << 20)
    # Several buckets a partition even out what hashing deals to each; with many partitions two do.
    buckets = max(2 * p, min(8 * p, 4096))
    blocks = docs.select(F.col(text_col)).mapInArrow(_count_blocks(buckets), _BLOCK_DDL)
    parts = keep(blocks.repartition(p, "bucket").groupBy("bucket").applyInArrow(_merge_bucket(bits_per_entry), _PART_DDL))
    sums = {r["ngram"]: r for r in parts.groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("once").alias("once"), F.sum(F.octet_length("payload")).alias("bytes")).collect()}
    if not sums:
        return Model(parts, buckets, 0, 0, 0, UNSEEN[1])
    one, two = sums[1], sums[2]
    ends = parts.where((F.col("ngram") == 1) & (F.col("bucket") == int(bucket_of(np.array([K.END_WORD]), buckets)[0]))).collect()
    keys, counts = _vocabulary([(r["payload"], r["n"]) for r in ends])
    return Model(parts, buckets, one["total"], one["n"], int(counts[np.searchsorted(keys, K.END_WORD)]), min(max(two["once"] / two["total"], UNSEEN[0]), UNSEEN[1]), one["bytes"] + two["bytes"])


def _vocabulary(payloads: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of bucket parts that come in bucket order."""
    if not payloads:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([np.frombuffer(p, U64, n) for p, n in payloads]), np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in payloads])


def _groups(parts: DataFrame, order: int) -> Iterator[list]:
    """Rows of one n-gram order in bucket order, fetched group by group."""
    sizes = parts.where(F.col("ngram") == order).select("bucket", F.octet_length("payload").alias("size")).orderBy("bucket").collect()
    group: list[int] = []
    held = 0
    cuts = []
    for r in sizes:
        if group and held + r["size"] > GROUP_BYTES:
            cuts.append(group)
            group, held = [], 0
        group.append(r["bucket"])
        held += r["size"]
    cuts += [group] if group else []
    for c in cuts:
        yield parts.where((F.col("ngram") == order) & F.col("bucket").between(c[0], c[-1])).orderBy("bucket").collect()


def _held(blocks: list[Broadcast]) -> Iterator:
    """The values of broadcast groups, one in memory at a time if there are more."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


_SCORED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_DDL = "n_tokens long, n_known long, base_score double, score double"


class Asked:
    """What a chunk of documents asks of the model: its distinct tokens and bigrams, sorted, which is by bucket."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int):
        tokens, self.first, self.counts = token_stream(data, offsets)
        self.types, self.type = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair = np.unique(bigram_keys(tokens, self.first), return_inverse=True)
        self.cuts = [np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1)) for keys in (self.types, self.pairs)]

    def scores(self, seen: np.ndarray, level: np.ndarray, model: tuple) -> list[np.ndarray]:
        """The columns of _SCORED from the counts of the types and the levels of the pairs."""
        n, v, documents, unseen = model
        c = seen[self.type]
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[self.first] = documents
        about = np.floor(np.exp2(level[self.pair].astype(np.float64) - 1))
        about = np.minimum(np.minimum(about, context), c)
        single = (c + 1) / (n + v + 1)
        p = np.where(context > 0, (1 - unseen) * about / np.maximum(context, 1) + unseen * single, single)
        starts = np.cumsum(self.counts) - self.counts
        return [self.counts, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(single), starts), np.add.reduceat(np.log10(p), starts)]


def _known(types: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(types), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, types), len(keys) - 1)
        hit = keys[at] == types
        out[hit] = counts[at[hit]]
    return out


def _with_scores(carried: pa.RecordBatch, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*carried.columns, *(pa.array(x, f.type) for x, f in zip(columns, _SCORED))], names=[*carried.schema.names, *_SCORED.names])


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """carry columns of docs, n_tokens, n_known, base_score and score of each text."""
    fields = [docs.schema[c] for c in carry]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {_SCORED_DDL}"
    text = docs.select(*carry, F.col(text_col).alias("text_"))
    numbers = (model.tokens, model.types, model.documents, model.unseen)
    return (_by_broadcast if model.bytes <= max_broadcast_bytes else _by_bucket)(text, model, len(fields), numbers, ddl)


def _by_broadcast(text: DataFrame, model: Model, k: int, numbers: tuple, ddl: str) -> DataFrame:
    sc = text.sparkSession.sparkContext
    vocabulary = [sc.broadcast(_vocabulary([(r["payload"], r["n"]) for r in g])) for g in _groups(model.parts, 1)]
    filters = [sc.broadcast(Segments(g)) for g in _groups(model.parts, 2)]
    buckets = model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(k), SCORED_BYTES):
                asked = Asked(data, offsets, buckets)
                seen = np.zeros(len(asked.types), np.int64)
                for keys, known in _held(vocabulary):
                    seen = np.maximum(seen, _known(asked.types, keys, known))
                level = np.zeros(len(asked.pairs), np.uint8)
                for group in _held(filters):
                    group.levels(asked.pairs, asked.cuts[1], level)
                yield _with_scores(batch.slice(lo, hi - lo).select(range(k)), asked.scores(seen, level, numbers))

    return text.mapInArrow(run, ddl)


#: Rows of a range, in this order: counts of tokens (x), filter segments (x, m, k), what blocks ask (x: tokens, y: bigrams a bucket, z: bigrams), documents of blocks (x).
COUNTS, SEGMENT, ASKS, DOCUMENTS = range(4)
_ASK = pa.schema([("range", pa.int32()), ("kind", pa.int8()), ("id", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_ASK_DDL = "range int, kind tinyint, id long, x binary, y binary, z binary"
_ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("x", pa.binary()), ("z", pa.binary())])
_ANSWER_DDL = "block long, range int, x binary, z binary"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in data; ends: where each begins, in bytes, and the last ends."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    col = col.cast(pa.large_binary())
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]


def _blocks(batches: Iterator[pa.RecordBatch], k: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about limit bytes of text, whatever the size of the batches."""
    held, size = [], 0
    for batch in batches:
        for lo, hi, data, _ in K.chunks(batch.column(k), limit):
            held.append(batch.slice(lo, hi - lo))
            size += len(data)
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _asked(block: pa.RecordBatch, k: int, buckets: int) -> Asked:
    ((_, _, data, offsets),) = K.chunks(block.column(k), 1 << 62)
    return Asked(data, offsets, buckets)


class _Range:
    """The part of the model in a range of buckets."""

    def __init__(self, first: int, past: int, counts: list[bytes], segments: list[dict]):
        self.width = past - first
        self.vocabulary = _vocabulary([(x, len(x) // 16) for x in counts])
        self.segments = Segments(segments, first, past) if segments else None

    def answers(self, types: np.ndarray, per_bucket: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of types and levels of pairs; per_bucket: pairs of each bucket, one block after the other."""
        bucket = np.repeat(np.arange(len(per_bucket)) % self.width, per_bucket)
        levels = self.segments.found(pairs, bucket) if self.segments else np.zeros(len(pairs), np.uint8)
        return _known(types, *self.vocabulary), levels.astype(np.uint8)


def _answer(edges: np.ndarray):
    """Over rows sorted by range and kind, answers those that ask and hands on documents; edges: the first bucket of each range."""

    def asks(rows: pa.RecordBatch, of: _Range) -> Iterator[pa.RecordBatch]:
        (types, t), (per_bucket, b), (pairs, p) = (_flat(rows[c]) for c in ("x", "y", "z"))
        per_bucket = per_bucket[b[0] : b[-1]].view(np.uint32).reshape(rows.num_rows, of.width)
        lo = 0
        while lo < rows.num_rows:
            hi = max(lo + 1, int(np.searchsorted(t // 8 + p // 5, t[lo] // 8 + p[lo] // 5 + ANSWERED_KEYS, "right")) - 1)
            known, levels = of.answers(types[t[lo] : t[hi]].view(U64), per_bucket[lo:hi].ravel(), _wide(pairs[p[lo] : p[hi]]))
            part = rows.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part["id"], part["range"], _binary(known.view(np.uint8), t[lo : hi + 1] - t[lo]), _binary(levels, (p[lo : hi + 1] - p[lo]) // 5)], schema=_ANSWER)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, segments, model = -1, [], [], None
        for batch in batches:
            group = batch["range"].to_numpy().astype(np.int64) * 4 + batch["kind"].to_numpy()
            cuts = [0, *(1 + np.flatnonzero(group[1:] != group[:-1])).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                rows, (r, kind) = batch.slice(lo, hi - lo), divmod(int(group[lo]), 4)
                if r != at:
                    at, counts, segments, model = r, [], [], None
                if kind == COUNTS:
                    counts += rows["x"].to_pylist()
                elif kind == SEGMENT:
                    segments += [{"bucket": b, "m": m, "k": n, "payload": x} for b, m, n, x in zip(*(rows[c].to_pylist() for c in ("id", "m", "k", "x")))]
                elif kind == ASKS:
                    model = model or _Range(int(edges[r]), int(edges[r + 1]), counts, segments)
                    yield from asks(rows, model)
                else:
                    for i in range(rows.num_rows):
                        yield pa.RecordBatch.from_arrays([rows["id"][i : i + 1], pa.array([-1], pa.int32()), rows["x"][i : i + 1], pa.nulls(1, pa.binary())], schema=_ANSWER)

    return run


def _by_bucket(text: DataFrame, model: Model, k: int, numbers: tuple, ddl: str) -> DataFrame:
    """Blocks of documents ask the ranges of buckets.  A block's documents take the same way, so that no text is read or put into blocks twice.

    A task that is run again must make the same blocks: what has no fixed order of rows is stored first.
    """
    if "Exchange" in text._jdf.queryExecution().executedPlan().toString():
        text = keep(text)
    buckets, ranges = model.buckets, max(1, min(model.buckets, -(-model.bytes // RANGE_BYTES)))
    edges = -(-np.arange(ranges + 1) * buckets // ranges)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, block in enumerate(_blocks(batches, k, ASKED_BYTES)):
            asked = _asked(block, k, buckets)
            t, p = (cuts[edges] for cuts in asked.cuts)
            own = (np.diff(t) > 0) | (np.diff(p) > 0)
            per_bucket = _binary(np.diff(asked.cuts[1]).astype(np.uint32).view(np.uint8), 4 * edges)
            columns = [pa.array(np.arange(ranges, dtype=np.int32)), pa.array(np.full(ranges, ASKS, np.int8)), pa.array(np.full(ranges, task + n)), _binary(asked.types.view(np.uint8), 8 * t), per_bucket, _binary(_narrow(asked.pairs), 5 * p)]
            yield pa.RecordBatch.from_arrays(columns, schema=_ASK).filter(pa.array(own))
            yield K.rows(_ASK, range=[int(K.mix(np.array([task + n], U64))[0]) % ranges], kind=[DOCUMENTS], id=[task + n], x=[_packed(block)], y=[None], z=[None])

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("range")
        block = _unpacked(rows["x"][0].as_buffer())
        seen, level = (np.frombuffer(b"".join(rows[c][1:].to_pylist()), t) for c, t in (("x", np.int64), ("z", np.uint8)))
        return pa.Table.from_batches([_with_scores(block.select(range(k)), _asked(block, k, buckets).scores(seen, level, numbers))])

    # The blocks that training shuffled are needed no more; without collect() Python's DataFrames would hold on to them.
    # Py4J tells the JVM what Python has let go in a thread that may sleep for a second in between.
    gc.collect()
    time.sleep(2)
    forget(text.sparkSession)
    p = partitions(text, 16 << 20)
    of_model = model.parts.select(
        F.expr(f"int(bigint(bucket) * {ranges} div {buckets})").alias("range"), F.when(F.col("ngram") == 1, COUNTS).otherwise(SEGMENT).cast("tinyint").alias("kind"), F.col("bucket").cast("long").alias("id"),
        F.col("payload").alias("x"), F.lit(None).cast("binary").alias("y"), F.lit(None).cast("binary").alias("z"), "m", "k",
    )
    asks = text.mapInArrow(ask, _ASK_DDL).select("*", F.lit(None).cast("long").alias("m"), F.lit(None).cast("int").alias("k"))
    answers = of_model.unionAll(asks).repartition(p, "range").sortWithinPartitions("range", "kind", "id").mapInArrow(_answer(edges), _ANSWER_DDL)
    return answers.repartition(p, "block").groupBy("block").applyInArrow(finish, ddl)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    scored = score(docs, model, carry=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
