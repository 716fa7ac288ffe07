"""Operator 4, n-gram Jaccard join: universe partition and pigeonhole.

A document's set holds its distinct shingles of five words.  Sets link when their
Jaccard similarity is at least 3/4, that is when they differ in at most
(|R| + |S|) / 7 shingles.  Sizes fall into bands so that a set's smaller partners
lie in its own band or the one below.  For a band the universe of shingles is cut
by hash into segments (the shingles themselves in bands up to SINGLE); a set's
part in a segment is a signature.  A set indexes the signatures of its own band
and probes, in its own band and the one below, as many segments as the two may
differ in, plus one: some probed segment of two linked sets is equal.

Which segments a set probes is its choice, and it takes the cheapest: a list of
the corpus's most frequent shingles, of bounded length, prices a segment by its
rarest shingle, so passages that many documents hold are left out wherever the
others suffice (the list changes costs, never results).  Empty segments cannot be
probed; a set left with too few pays double for some, probing also the
neighbourhood of the part with one shingle (then two, ..) deleted.

Equal sets share one node.  Reducers find the nodes of equal signatures.  First each
node is compared with the one node that its signatures name most often, which
joins large groups of near copies.  What is left are signatures whose nodes are in
several components.  Those with one centre are a family and go to a task with their
sets, a large family as pairs of blocks of at most TASK_BYTES.  The task compares
the probes of every signature with those holders that are not yet in their
component, and joins components as it finds links, so it sends on at most one link
for each component it got, never the pairs.  A histogram of a set's shingles over
CELLS cells rules pairs out before that: the sum of its differences never exceeds
the number of differing shingles.  Each comparison left counts the true intersection
of the shingle hashes.

A signature whose rarest shingle is held by more than HOT documents is dealt out:
its holders over as many shares as keep each near HOT, its probes to all of them.

Cases: sets of documents with fewer than five words hold the whole sequence; null
and word-free texts have no set and are their own component; null ids are rows
of one unknown document, whose component is null unless it links; repeated
rows and rows of one id link with each other only through equal or similar texts,
or through the id that they share; a very long text costs its distinct shingles;
ties (of centres, of prices) go to the smaller hash and never change links; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import keep, partitions, release, table
from .components import components

U64 = np.uint64
SHINGLE = 5
SINGLE = 128
SEGMENTS = 0.36
FREQUENT = 65_536
BLOCK_DOCS = 4_096
#: Records a block before it is sent on: enough for each bucket, few enough that no row of it is large.
BLOCK_RECORDS = (250_000, 1_000_000)
BROADCAST_ROWS = 400_000
CELLS, FINE_CELLS = 128, 512
TURNS = 2
TASK_BYTES = 16 << 20
HOT = 65_536
LOW48 = U64((1 << 48) - 1)


def band_limits(largest: int) -> np.ndarray:
    """Largest size of each band."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, 4 * out[-1] // 3))
    return np.array(out, np.int64)


LIMITS = band_limits(1 << 40)


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted within it: (flat, number per document)."""
    flat, counts = K.ngrams(K.words(data, offsets, K.SPACE), SHINGLE)
    ends = np.cumsum(counts)
    sets = [np.unique(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
    return np.concatenate(sets) if sets else flat, np.array([len(s) for s in sets], np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def nodes_of(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set."""
    s = _sums(K.mix(flat + U64(0x632BE59BD9B4E019)), counts)
    return (K.mix(s + counts.astype(U64)) >> U64(1)).astype(np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Histograms of the sets, (sets, cells); counts over 255 stand at 255, which only lowers differences."""
    of = np.repeat(np.arange(len(counts)), counts)
    cell = (K.mix(flat) % U64(cells)).astype(np.int64)
    return np.minimum(np.bincount(of * cells + cell, minlength=len(counts) * cells), 255).astype(np.uint8).reshape(-1, cells)


_DOC = "kind int, id long, digest long, node long, n long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document, its node and size; kind 1: (shingle, times) of a task's frequent shingles."""
    pending: list[np.ndarray] = []
    docs = 0

    def frequent() -> pa.RecordBatch:
        shingles, n = np.unique(np.concatenate(pending), return_counts=True)
        often = n >= max(4, docs // 1000)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(int(often.sum()), np.int32)), pa.nulls(int(often.sum()), pa.int64()), pa.nulls(int(often.sum()), pa.int64()), pa.array(shingles[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["kind", "id", "digest", "node", "n"])

    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            flat, counts = chunk_sets(data, offsets)
            nodes = nodes_of(flat, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(nodes), pa.array(counts)], names=["kind", "id", "digest", "node", "n"])
            pending.append(flat)
            docs += hi - lo
            if sum(map(len, pending)) >= BLOCK_RECORDS[1]:
                yield frequent()
                pending, docs = [], 0
    if pending:
        yield frequent()


class Signer:
    """Records of a chunk's sets: signature, set (place in the chunk), whether it probes."""

    def __init__(self, keys: np.ndarray, prices: np.ndarray, hot: int = HOT):
        self.keys, self.prices, self.hot = keys, prices, hot
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def price(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat), np.int64)
        some = np.flatnonzero(self.maybe[(flat & U64((1 << 20) - 1)).astype(np.int64)])
        if len(some) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, flat[some]), len(self.keys) - 1)
            hit = self.keys[at] == flat[some]
            out[some[hit]] = self.prices[at[hit]]
        return out

    def records(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(counts)), counts)
        price, band = self.price(flat), np.searchsorted(LIMITS, counts)
        own = self._role(flat, counts, of, price, band, True)
        below = counts > 1
        keep_ = below[of]
        other = self._role(flat[keep_], np.where(below, counts, 0), of[keep_], price[keep_], np.maximum(band - 1, 0), False)
        return tuple(np.concatenate(x) for x in zip(own, other))

    def _role(self, flat, counts, of, price, band, index: bool):
        """index: all segments are indexed; else the probed ones alone are recorded."""
        limit = LIMITS[band]
        may_differ = (np.minimum(limit, counts) + counts) // 7
        segments = np.where(limit <= SINGLE, 0, np.ceil(SEGMENTS * limit).astype(np.int64))
        m = segments[of]
        segment = np.where(m > 0, ((flat >> U64(32)) * m.astype(U64) >> U64(32)).astype(np.int64), -1)
        n = len(flat)
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
        first = np.ones(n, bool)
        first[1:] = (of[1:] != of[:-1]) | (m[1:] == 0) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(first)
        doc, seg, size = of[at], segment[at], np.diff(np.append(at, n))
        mixed = K.mix(flat)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mixed, dtype=U64)])
        salt = band[doc].astype(U64) * U64(0x8CB92BA72F3D8DD7) + seg.astype(U64) * U64(0xAEF17502108EF2D9)
        sums = total[at + size] - total[at]
        signature = K.mix(sums + salt)
        cost = np.minimum.reduceat(price, at)
        order = np.lexsort((cost, doc))
        held = np.bincount(doc, minlength=len(counts))
        begin = np.cumsum(held) - held
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - begin[doc[order]]
        probe = rank <= may_differ[doc]
        more_sig, more_doc = [], []
        for d in np.flatnonzero((held <= may_differ) & (counts > 0)):
            own = slice(begin[d], begin[d] + held[d])
            parts = [mixed[a : a + s] for a, s in zip(at[own], size[own])]
            for x in self._deleted(parts, salt[own], int(may_differ[d])):
                more_sig.append(x)
                more_doc.append(d)
        used = np.ones(len(at), bool) if index else probe
        signature, doc, probe, cost, first_of = signature[used], doc[used], probe[used], cost[used], flat[at[begin[doc[used]]]]
        extra = np.array(more_sig, U64)
        signature, doc, probe = self._shares(signature, doc, probe, -(-cost // self.hot), first_of)
        return np.concatenate([signature, extra]), np.concatenate([doc, np.array(more_doc, np.int64)]), np.concatenate([probe, np.ones(len(extra), bool)])

    @staticmethod
    def _shares(signature: np.ndarray, doc: np.ndarray, probe: np.ndarray, shares: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A signature of several shares becomes one of them by the set's name, or all if it is probed; only there it is a holder's."""
        shares = np.maximum(shares, 1)
        own = (K.mix(name) % shares.astype(U64)).astype(np.int64)
        times = np.where(probe, shares, 1)
        of = np.repeat(np.arange(len(signature)), times)
        share = np.where(probe[of], np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times), own[of])
        salted = np.where(share > 0, K.mix(signature[of] + share.astype(U64)), signature[of])
        return salted, doc[of], probe[of]

    @staticmethod
    def _deleted(parts: list[np.ndarray], salts: np.ndarray, may_differ: int) -> list[np.uint64]:
        """Signatures with up to `depth` shingles deleted, the depth being what makes the pigeonhole hold.

        Of the differences at most half are shingles that only the smaller set has; one of
        these spoils a segment, while depth + 1 of the larger set's own are needed, or as
        many as the segment holds.
        """
        for depth in range(1, 64):
            price = sorted((min(len(p), depth + 1) for p in parts), reverse=True)
            half = may_differ // 2
            if sum(price[half:]) + min(half, len(price)) > may_differ:
                break
        else:
            raise RuntimeError("a set's shingles crowd into too few segments")
        out = []
        for p, salt in zip(parts, salts):
            total = p.sum(dtype=U64)
            for k in range(1, min(depth, len(p) - 1) + 1):
                for gone in combinations(p, k):
                    out.append(K.mix(np.array([total]) - np.array(gone, U64).sum(dtype=U64, keepdims=True) + salt)[0])
        return out


_RECORD_DDL = "bucket int, sigs binary, sets binary, base long"


def _sign(buckets: int, frequent: Broadcast):
    """Blocks of records by bucket of the signature; bucket -1: the nodes and sizes of a block's sets."""

    full = min(max(BLOCK_RECORDS[0], 500 * buckets), BLOCK_RECORDS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(*frequent.value)
        task, block = TaskContext.get().partitionId(), 0
        sigs, sets, nodes, sizes, cells, held, records = [], [], [], [], [], 0, 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            base = (task << 16 | block) << 15
            s, d = np.concatenate(sigs), np.concatenate(sets)
            order = np.argsort(s)
            s, d = s[order], d[order]
            cuts = np.searchsorted((s >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))
            raw = s.view(np.uint8).reshape(-1, 8)[:, :6]
            some = np.flatnonzero(np.diff(cuts))
            out = [[-1, *some.tolist()], [np.concatenate(nodes).tobytes(), *(raw[cuts[b] : cuts[b + 1]].tobytes() for b in some)], [np.concatenate(sizes).tobytes() + np.concatenate(cells).tobytes(), *(d[cuts[b] : cuts[b + 1]].tobytes() for b in some)], [base] * (len(some) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["bucket", "sigs", "sets", "base"])

        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                flat, counts = chunk_sets(data, offsets)
                names = nodes_of(flat, counts)
                # Copies within a block are one set; across blocks they meet in the reducers and share a node.
                new = np.zeros(len(names), bool)
                for i, (x, n) in enumerate(zip(names.tolist(), counts.tolist())):
                    if n and x not in seen:
                        seen.add(x)
                        new[i] = True
                flat, counts, names = flat[np.repeat(new, counts)], counts[new], names[new]
                for lo in range(0, len(counts), BLOCK_DOCS):
                    c = counts[lo : lo + BLOCK_DOCS]
                    at = int(counts[:lo].sum())
                    s, d, probe = signer.records(flat[at : at + int(c.sum())], c)
                    if held + len(c) > 2 * BLOCK_DOCS:
                        yield flush()
                        block += 1
                        sigs, sets, nodes, sizes, cells, held, records = [], [], [], [], [], 0, 0
                    sigs.append(s)
                    cells.append(sketches(flat[at : at + int(c.sum())], c))
                    sets.append((d + held << 1 | probe).astype(np.uint16))
                    nodes.append(names[lo : lo + BLOCK_DOCS])
                    sizes.append(c)
                    held += len(c)
                    records += len(s)
                    if records >= full:
                        yield flush()
                        block += 1
                        sigs, sets, nodes, sizes, cells, held, records = [], [], [], [], [], 0, 0
                        seen.clear()
        if held:
            yield flush()

    return run


def _meet(block: pa.Table) -> pa.Table:
    """Distinct groups of sets that share a signature one of them probes, with the number of such signatures."""
    sig_parts, set_parts = [], []
    for sigs, sets, base in zip(block["sigs"].to_pylist(), block["sets"].to_pylist(), block["base"].to_pylist()):
        sig_parts.append(np.frombuffer(sigs, np.uint8).reshape(-1, 6))
        set_parts.append(np.frombuffer(sets, np.uint16).astype(np.int64) + (base << 1))
    raw = np.concatenate(sig_parts)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    s, d = wide.view(U64).ravel(), np.concatenate(set_parts)
    order = np.lexsort((d, s))
    s, d = s[order], d[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(at, len(s)))
    probes = np.add.reduceat(d & 1, at)
    groups: dict[bytes, int] = {}
    for a, n in zip(*(x[(size > 1) & (probes > 0)].tolist() for x in (at, size))):
        own = d[a : a + n].tobytes()
        groups[own] = groups.get(own, 0) + 1
    return pa.table({"members": pa.array(list(groups), pa.binary()), "times": pa.array(list(groups.values()), pa.int64())})


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a member: group, place, probe."""
    for batch in batches:
        for g, members, times in zip(*(c.to_pylist() for c in batch.columns)):
            d = np.frombuffer(members, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), g)), pa.array(d >> 1), pa.array((d & 1) > 0), pa.array(np.full(len(d), times))], names=["g", "place", "probe", "times"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nodes, sizes, base in zip(*(c.to_pylist() for c in batch.columns)):
            names = np.frombuffer(nodes, np.int64)
            k = len(names)
            drawn = [sizes[8 * k + i * CELLS : 8 * k + (i + 1) * CELLS] for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(k)), pa.array(names), pa.array(np.frombuffer(sizes, np.int64, k)), pa.array(drawn, pa.binary())], names=["place", "node", "n", "cells"])


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches and sizes may be similar."""
    least = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1)
    return (7 * least <= na + nb) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))


def _drawn(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 75 * (len(x) + len(y) - common)


class Family:
    """Nodes of one task, with the signatures that they share, as pairs of places to look at."""

    def __init__(self, members: pa.Table, nodes: pa.Table):
        """nodes: node, its block, n and root, each node once; of two blocks only pairs between them are looked at."""
        self.names, self.block, self.n = (nodes[c].to_numpy() for c in ("node", "block", "n"))
        self.across = len(self.block) > 0 and self.block.min() != self.block.max()
        self.component = np.unique(nodes["root"].to_numpy(), return_inverse=True)[1]
        g, at, probe = members["g"].to_numpy(), np.searchsorted(self.names, members["node"].to_numpy()), members["probe"].to_numpy(zero_copy_only=False)
        order = np.argsort(g, kind="stable")
        g, self.at, self.probe = g[order], at[order], probe[order]
        self.starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(g))
        # Of two members in different components at least one is outside the group's largest.
        self.outside: dict[int, list[int]] = {}
        for k, (lo, hi) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            own = self.component[self.at[lo:hi]]
            largest = np.bincount(own).argmax() if hi - lo > 2 else own[0]
            for i in np.flatnonzero(own != largest):
                self.outside.setdefault(int(self.at[lo + i]), []).append(k)

    def near(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each node outside with those it may link with by probe, size and sketch, nearest first; components are read anew for every node."""
        n, component = self.n, self.component
        for i, groups in self.outside.items():
            parts = []
            for k in groups:
                own, asks = self.at[self.starts[k] : self.ends[k]], self.probe[self.starts[k] : self.ends[k]]
                mine = asks[own == i].any()
                # The larger of the two is the one that probes.
                parts.append(own[(component[own] != component[i]) & (((n[own] >= n[i]) & asks) | ((n[own] <= n[i]) & mine))])
            others = np.unique(np.concatenate(parts))
            others = others[(4 * np.minimum(n[others], n[i]) >= 3 * np.maximum(n[others], n[i])) & ((self.block[others] != self.block[i]) | (not self.across))]
            differ = [np.abs(cells[others[lo : lo + 4096]].astype(np.int16) - cells[i].astype(np.int16)).sum(axis=1) for lo in range(0, len(others), 4096)]
            differ = np.concatenate(differ) if differ else np.zeros(0, np.int64)
            some = 7 * differ <= n[others] + n[i]
            yield i, others[some][np.argsort(differ[some], kind="stable")]


def _once(nodes: pa.Table) -> pa.Table:
    """Sorted by node, each once."""
    return nodes.take(pa.array(np.unique(nodes["node"].to_numpy(), return_index=True)[1]))


def _cross(members: pa.Table, nodes: pa.Table) -> pa.Table:
    """Links between components, at most one for each that is joined."""
    nodes = _once(nodes)
    family = Family(members, nodes)
    held, component = [np.frombuffer(x.as_buffer(), U64) for x in nodes["held"]], family.component
    cells = [sketches(np.concatenate(held[i : i + 1024]), family.n[i : i + 1024], FINE_CELLS) for i in range(0, len(held), 1024)]
    found: list[tuple[int, int]] = []
    for i, others in family.near(np.concatenate(cells) if cells else np.zeros((0, FINE_CELLS), np.uint8)):
        for j in others.tolist():
            if component[j] != component[i] and _linked(held[i], held[j]):
                component[component == component[j]] = component[i]
                found.append((family.names[i], family.names[j]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            good = pa.array(_near(_drawn(batch.column(2)), _drawn(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def _sets(node: int, carried: int):
    """held, the set of the row's node, beside the carried columns; of equal rows that a task meets, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(carried)):
                flat, counts = chunk_sets(data, offsets)
                names, cuts, part = nodes_of(flat, counts).tolist(), np.cumsum(counts).tolist(), batch.slice(lo, hi - lo)
                new = []
                for i, row in enumerate(zip(*(c.to_pylist() for c in part.columns[:carried]))):
                    # A digest may stand for other texts too.
                    if row[node] == names[i] and row not in seen:
                        seen.add(row)
                        new.append(i)
                held = pa.array([flat[cuts[i] - int(counts[i]) : cuts[i]].tobytes() for i in new], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(new, pa.int64())) for c in part.columns[:carried]), held], names=[*part.schema.names[:carried], "held"])

    return run


def _verify(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    held = {k: np.frombuffer(v, U64) for k, v in zip(sets["node"].to_pylist(), sets["held"].to_pylist())}
    good = [_linked(held[x], held[y]) for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())]
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component): one row a document; component is the smallest id reachable by links."""
    found = rooted(docs, id_col, text_col)
    labelled = found.where("n > 0")
    smallest = labelled.groupBy("root").agg(F.min("id").alias("component"))
    return labelled.join(smallest, "root").select("id", "n", "component").unionAll(found.where("n = 0").select("id", "n", F.col("id").alias("component")))


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n, root): one row a document, with a digest of its text; rows of one root are linked, null ids too, and a blank text has none."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    p = partitions(docs)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias("digest"))
    described = keep(text.mapInArrow(_describe, _DOC))
    rows = described.where("kind = 0").select("id", "digest", "node", "n")
    frequent = described.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).collect()  # bounded; prices only
    keys = np.array([r["node"] for r in frequent], np.int64).view(U64)
    order = np.argsort(keys)
    prices = sc.broadcast((keys[order], np.array([r["n"] for r in frequent], np.int64)[order], HOT))
    records = text.select("text").mapInArrow(_sign(2 * p, prices), _RECORD_DDL)
    # The names of a block's sets have a bucket of their own per block, so that no task gets them all.
    deal = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.col("base") / (1 << 15), F.lit(2 * p)).cast("int"))
    met = keep(records.withColumn("bucket", deal).repartition(p, "bucket").groupBy("bucket").applyInArrow(_meet_or_name, "members binary, times long, sizes binary, base long"))
    places = keep(met.where("base >= 0").select("members", "sizes", "base").mapInArrow(_opened, "place long, node long, n long, cells binary"))
    groups = met.where("base < 0").groupBy("members").agg(F.sum("times").alias("times"))
    groups = groups.select(F.xxhash64("members").alias("g"), "members", "times")
    members = groups.mapInArrow(_exploded, "g long, place long, probe boolean, times long").join(places.select("place", "node", "n"), "place")
    # Copies from several blocks are one node of a group.
    members = keep(members.groupBy("g", "node").agg(F.max("n").alias("n"), F.max("probe").alias("probe"), F.max("times").alias("times")))
    drawn = keep(places.select("node", "n", "cells").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    release(met, places)

    # First: each node with the node of another component that its groups name most often; once more from other centres.
    of = lambda end: drawn.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("cells").alias(f"c_{end}"))
    first = roots = None
    for turn in range(TURNS):
        rooted = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        centre = rooted.groupBy("g").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("c")).select("g", F.col("c.node").alias("centre"), F.col("c.root").alias("its"))
        votes = rooted.join(centre, "g").where("root <> its").groupBy("node", "centre").agg(F.sum("times").alias("times"))
        named = votes.groupBy("node").agg(F.max_by("centre", F.struct("times", "centre")).alias("b")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        likely = named.join(of("a"), "a").join(of("b"), "b").select("a", "b", "c_a", "c_b", "n_a", "n_b").mapInArrow(_screen, "a long, b long")
        found = _verified(rows, text, drawn.select("node", "n"), likely)
        first = found if first is None else first.unionAll(found)
        roots = components(first)

    # Then: the probes of each group with its members of other components.
    rooted = members.join(roots, "node", "left").select("g", "node", "probe", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("g").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("g")
    # Groups of one family mostly have one centre: together, they find a pair once and send a set once.
    rooted = keep(rooted.join(several, "g", "left_semi").join(centre.select("g", "centre"), "g"))
    family = keep(rooted.select("centre", "node", "root").distinct().join(drawn.select("node", "n"), "node"))
    release(members, drawn)
    large = keep(family.groupBy("centre").agg(F.ceil(F.sum(8 * F.col("n")) / TASK_BYTES).cast("int").alias("blocks")).where("blocks > 1"))
    count, key = large.count(), ["centre", "low", "high"]

    def dealt(df: DataFrame) -> DataFrame:
        """A row for every task: a family's own, or each pair of blocks that the node's block is of."""
        blocks = F.coalesce("blocks", F.lit(1))
        placed = df.join(_checked(large, count), "centre", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        placed = placed.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        return placed.select(*df.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    # Both sides of a cogroup need columns of their own.
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).repartition(p, *key).groupBy(*key)
    crossed = own(dealt(rooted.select("centre", "g", "node", "probe"))).cogroup(own(_with_sets(rows, text, dealt(family)))).applyInArrow(_cross, "a long, b long")
    links = first.unionAll(keep(crossed))
    release(rooted, family, large)
    shared = rows.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("k")).where("a <> b").select("id")
    # Rows of one id are one document: their texts link through it.
    through = rows.where("n > 0").join(shared, "id").groupBy("id").agg(F.min("node").alias("a"), F.collect_set("node").alias("s")).select("a", F.explode("s").alias("b")).where("a <> b")
    roots = components(links.unionAll(through))
    linked = rows.where("n > 0").join(roots, "node", "left").select("id", "digest", "n", F.coalesce("root", "node").alias("root"))
    return linked.unionAll(rows.where("n = 0").select("id", "digest", "n", F.lit(None).cast("long").alias("root")))


def _meet_or_name(block: pa.Table) -> pa.Table:
    if block["bucket"][0].as_py() < 0:
        return pa.table({"members": block["sigs"], "times": pa.nulls(block.num_rows, pa.int64()), "sizes": block["sets"], "base": block["base"]})
    out = _meet(block)
    return pa.table({"members": out["members"], "times": out["times"], "sizes": pa.nulls(out.num_rows, pa.binary()), "base": pa.array(np.full(out.num_rows, -1), pa.int64())})


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its rows (of a few numbers each) are at most BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _with_sets(rows: DataFrame, text: DataFrame, routes: DataFrame) -> DataFrame:
    """routes (node and where it goes) with held, the set of the node, made anew from one text that has it: no set moves before it has its route."""
    one = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("of")
    holders = rows.join(routes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(one)
    named = keep(routes.join(holders, "node").select(*routes.columns, F.coalesce("of.id", F.lit(0)).alias("id_"), F.col("of.unnamed").alias("unnamed_"), F.col("of.digest").alias("digest_")))
    same = (F.coalesce("id", F.lit(0)) == F.col("id_")) & (F.col("id").isNull() == F.col("unnamed_")) & (F.col("digest") == F.col("digest_"))
    wanted = text.where("text is not null").join(_checked(named, named.count()), same).select(*routes.columns, "text")
    ddl = ", ".join(f"{c} {t}" for c, t in routes.dtypes)
    return wanted.mapInArrow(_sets(routes.columns.index("node"), len(routes.columns)), f"{ddl}, held binary")


def _verified(rows: DataFrame, text: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose sets are similar; sizes: node, n."""
    pairs = keep(pairs)
    if pairs.isEmpty():
        return pairs
    # Pairs that hang together go to one task, and a set goes there once; a large family is cut into blocks of nodes.
    whole = components(pairs)
    blocks = whole.join(sizes, "node").groupBy("root").agg(F.ceil(F.sum(8 * F.col("n")) / TASK_BYTES).alias("blocks"))
    placed = keep(whole.join(blocks, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")))
    end = lambda c: placed.select(F.col("node").alias(c), "root", F.col("block").alias(f"block_{c}"))
    asked = keep(pairs.join(end("a"), "a").join(end("b").drop("root"), "b").select("a", "b", "root", "block_a", "block_b"))
    key = ["root", "block_a", "block_b"]
    routes = asked.select(*key, F.explode(F.array("a", "b")).alias("node")).distinct()
    p = partitions(text)
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).repartition(p, *key).groupBy(*key)
    good = keep(own(_with_sets(rows, text, routes)).cogroup(own(asked)).applyInArrow(_verify, "a long, b long"))
    release(pairs, whole, placed, asked)
    return good


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
