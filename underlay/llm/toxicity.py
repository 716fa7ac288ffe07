"""Operator 2, toxicity: class-conditional Kneser-Ney models compared per word.

Two bigram models, one of texts labelled toxic and one of the others, share
their backoff.  Both go from bigrams to words with one weight (distinct followers
of the context over its count) and from words to one shared lower order, the
Kneser-Ney continuation counts of both classes together: in how many distinct
contexts a word stands, absolutely discounted, the discount dealt out to all words.
A class departs from the shared estimate only where its own counts do.  They are
numbers of training documents that hold a word or bigram, so a text that repeats
itself or is one of many copies adds one; of what a class has beyond its expected
share, one and ``SPREAD`` standard deviations are discounted, and the rest turns into
a factor of the shared estimate, after which each class's words sum to one again.
Rare expressions have no such excess: for them both classes back off to the same
shared counts, and they do not vote.

A text's evidence is one number: log P_toxic - log P_ordinary of its bigrams, each
distinct one once, over the root of their number, which is how the spread of such
a sum grows with length.  A logistic curve of that
number, fitted on documents kept out of the counts, is the score.

Training uses a bounded sample: of each class the ``max_documents`` distinct
texts of smallest hash, every fifth of them for the curve.  The counts of so many
texts bound what the driver gathers and broadcasts.  Scoring reads every text.

Cases: null and empty texts, and texts without words, are scored by the curve at
evidence 0; equal texts, repeated rows too, get equal scores, a row each, and train
as one; a very long text is scored whole; ties of the sample's hash go to the smaller
id; an empty document table gives an empty result; label rows with a null id or label, or with labels that contradict
each other, do not train; without labels of both classes every score is the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import fold, keep, partitions, stored, table

U64 = np.uint64
MAX_DOCUMENTS = 8_000
FLUSH_WORDS = 1_000_000


@dataclass
class Model:
    """Of the expressions that at least two documents hold: sorted keys and their counts."""

    words: np.ndarray
    word: np.ndarray  # (2, V) P_c(w)
    unknown: np.ndarray  # (2,) P_c of any other word
    contexts: np.ndarray
    context: np.ndarray  # (H,) weight of the backoff
    pairs: np.ndarray
    pair: np.ndarray  # (2, B) P_c(w|h) above the backoff
    curve: np.ndarray
    prior: float


def _pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return K.mix(before * U64(0xA24BAED4963EE407) + tokens)


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams of each document: second word, word before it (or the start mark), and their number per document."""
    w = K.words(data, offsets, K.NON_ALNUM)
    before = np.empty_like(w.hashes)
    before[1:] = w.hashes[:-1]
    before[w.first[:-1][w.counts > 0]] = K.START_WORD
    of = np.repeat(np.arange(len(w.counts)), w.counts)
    at = _first_of_each(_pair(before, w.hashes), of)
    return w.hashes[at], before[at], np.bincount(of[at], minlength=len(w.counts))


def _first_of_each(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each (document, key) stands first, in order."""
    return np.sort(np.unique(K.mix(keys + of.astype(U64) * U64(0x9FB21C651E98DF25)), return_index=True)[1])


_BLOCK = pa.schema([("bucket", pa.int32()), ("toxic", pa.int32()), ("before", pa.binary()), ("word", pa.binary()), ("n", pa.binary())])
NO_WORD = U64(0)


def _distinct(before: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(words):
        return before, words, n
    key = _pair(before, words)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return before[order[at]], words[order[at]], np.add.reduceat(n[order], at)


def _count(buckets: int):
    """Blocks of document counts; a word's own count has no word before it."""

    def flush(toxic: int, parts: list) -> pa.RecordBatch:
        before, words = (np.concatenate(x) for x in zip(*parts))
        before, words, n = _distinct(before, words, np.ones(len(words), np.int64))
        bucket = (np.where(before == NO_WORD, words, before) >> U64(40)) % U64(buckets)
        out: dict[str, list] = {f.name: [] for f in _BLOCK}
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                for name, v in zip(out, (b, toxic, before[own].tobytes(), words[own].tobytes(), n[own].astype(np.int64).tobytes())):
                    out[name].append(v)
        return K.rows(_BLOCK, **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        held = [0, 0]
        for batch in batches:
            label = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                words, before, counts = _stream(data, offsets)
                doc = np.repeat(np.arange(hi - lo), counts)
                at = _first_of_each(words, doc)
                words, before, doc = np.concatenate([words, words[at]]), np.concatenate([before, np.full(len(at), NO_WORD)]), np.concatenate([doc, doc[at]])
                of = label[lo:hi][doc]
                for c in (0, 1):
                    parts[c].append((before[of == c], words[of == c]))
                    held[c] += int((of == c).sum())
                    if held[c] >= FLUSH_WORDS:
                        yield flush(c, parts[c])
                        parts[c].clear()
                        held[c] = 0
        for c in (0, 1):
            if held[c]:
                yield flush(c, parts[c])

    return run


_PART = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("of", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("types", pa.binary())])
SPREAD = 3.0


def _merge(block: pa.Table) -> pa.Table:
    """Of one bucket: words, bigrams and contexts that two documents hold, with the counts of both classes; and in how many of its contexts each word stands."""
    toxic = np.asarray(block["toxic"].to_pylist())
    raw = [[np.frombuffer(x, dtype) for x in block[c].to_pylist()] for c, dtype in (("before", U64), ("word", U64), ("n", np.int64))]
    sides = []
    for c in (0, 1):
        at = np.flatnonzero(toxic == c)
        sides.append([np.concatenate([x[i] for i in at]) if len(at) else np.zeros(0, t) for x, t in zip(raw, (U64, U64, np.int64))])
    before, word = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
    keys, some, which = np.unique(_pair(before, word), return_index=True, return_inverse=True)
    cut = len(sides[0][0])
    both = np.stack([np.bincount(which[:cut], sides[0][2], len(keys)), np.bincount(which[cut:], sides[1][2], len(keys))])
    before, word = before[some], word[some]
    out: dict[str, list] = {f.name: [] for f in _PART}

    def add(kind: str, key: np.ndarray, of: np.ndarray, n: np.ndarray, types: np.ndarray) -> None:
        twice = n.sum(axis=0) > 1
        for name, v in zip(out, (kind, key[twice].tobytes(), of[twice].tobytes(), *(x[twice].astype(np.float64).tobytes() for x in (*n, types)))):
            out[name].append(v)
        out["kind"].append("rest")
        for name, v in zip(list(out)[1:], (np.zeros(1, U64), np.zeros(1, U64), *(np.array([float(x)]) for x in (*n[:, ~twice].sum(axis=1), (~twice).sum())))):
            out[name].append(v.tobytes())
        if kind != "word":
            for name in out:
                out[name].pop()

    own = before == NO_WORD
    follower, contexts = np.unique(word[~own], return_counts=True)
    out["kind"].append("reach")
    for name, v in zip(list(out)[1:], (follower.tobytes(), b"", contexts.astype(np.uint32).tobytes(), b"", b"")):
        out[name].append(v)
    add("word", word[own], word[own], both[:, own], np.ones(int(own.sum())))
    add("pair", keys[~own], before[~own], both[:, ~own], np.ones(int((~own).sum())))
    h, at = np.unique(before[~own], return_inverse=True)
    add("context", h, h, np.stack([np.bincount(at, both[c, ~own], len(h)) for c in (0, 1)]), np.bincount(at, minlength=len(h)))
    return pa.Table.from_batches([K.rows(_PART, **out)])


def _excess(n: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """What class 1 has of n (2, ..) beyond its share of both, less the discount; class 0 lacks as much."""
    total = n.sum(axis=0)
    x = n[1] - total * share
    return np.sign(x) * np.maximum(np.abs(x) - 1 - SPREAD * np.sqrt(total * share * (1 - share)), 0)


def _gathered(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, what they belong to, counts (2, n) and types; a key comes from one bucket only."""
    parts = [[np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)] for c, t in (("key", U64), ("of", U64), ("a", float), ("b", float), ("types", float))]
    key, of, a, b, types = (np.concatenate(x) for x in parts)
    order = np.argsort(key)
    return key[order], of[order], np.stack([a, b])[:, order], types[order]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _features(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), evidence / np.sqrt(np.maximum(n, 1))], axis=1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the buckets' words and contexts."""
    for batch in batches:
        for key, n in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)), pa.array(np.frombuffer(n, np.uint32).astype(np.int64))], names=["word", "n"])


_REACH_DDL = "words long, contexts long, once long, twice long, keys binary, counts binary"


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a task's words: their sums, and those that stand in two contexts or more."""
    parts = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches if b.num_rows]
    if parts:
        words, n = (np.concatenate(x) for x in zip(*parts))
        several = n > 1
        row = [len(n), int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), words[several].tobytes(), n[several].astype(np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 4 + [pa.binary()] * 2)], names=[c.split()[0] for c in _REACH_DDL.split(", ")])


def _shared(reach: list, words: np.ndarray) -> tuple[np.ndarray, float]:
    """Shared lower-order probabilities of words, and that of a word that is not known."""
    known, total, once, twice = (sum(r[c] for r in reach) for c in ("words", "contexts", "once", "twice"))
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    rest = discount * known / max(total, 1) / (known + 1)
    keys, counts = (np.concatenate([np.frombuffer(r[c], t) for r in reach] or [np.zeros(0, t)]) for c, t in (("keys", U64), ("counts", np.uint32)))
    order = np.argsort(keys)
    at, several = _found(keys[order], words)
    contexts = np.ones(len(words))
    contexts[several] = counts[order][at[several]]
    return np.maximum(contexts - discount, 0) / max(total, 1) + rest, rest


def _share_factor(excess: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """(2, n): what each class makes of a shared estimate, given toxic's excess over what each expects."""
    return np.maximum(1 + np.stack([-excess, excess]) / np.maximum(expected, 1e-12), 1e-3)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps with halving."""
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (b[1:] ** 2).sum() / 2)

    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, gradient)
        t = 1.0
        while loss(beta - t * step) > loss(beta) and t > 1e-6:
            t /= 2
        beta = beta - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return beta


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over distinct bigrams of log P_toxic - log P_ordinary, and their number, per document."""
    words, before, counts = _stream(data, offsets)
    if not len(words) or not len(model.words):
        return np.zeros(len(counts)), counts
    types, which = np.unique(words, return_inverse=True)
    at, known = _found(model.words, types)
    p = np.where(known, model.word[:, at], model.unknown[:, None])[:, which]
    contexts, which = np.unique(before, return_inverse=True)
    at, known = _found(model.contexts, contexts)
    backoff = (np.where(known, model.context[at], 1.0) if len(model.contexts) else np.ones(len(contexts)))[which]
    at, known = _found(model.pairs, _pair(before, words))
    p = backoff * p
    p[:, known] += model.pair[:, at[known]]
    ratio = np.concatenate([[0.0], np.cumsum(np.log(p[1]) - np.log(p[0]))])
    ends = np.cumsum(counts)
    return ratio[ends] - ratio[ends - counts], counts


def _scorer(model: Model, carried: int, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model if isinstance(model, Model) else model.value
        for batch in batches:
            parts = [evidence(m, d, o) for _, _, d, o in K.chunks(batch.column(carried))]
            if not parts:
                continue
            e, n = (np.concatenate(x) for x in zip(*parts))
            new = [pa.array(e), pa.array(n, pa.int64())]
            if not raw:
                p = np.full(len(n), m.prior) if not len(m.curve) else 1 / (1 + np.exp(-np.clip(_features(e, n) @ m.curve, -40, 40)))
                new = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *new], names=[*batch.schema.names[:carried], *(("evidence", "n") if raw else ("score", "predicted"))])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_documents: int = MAX_DOCUMENTS) -> Model:
    """docs holds the documents that may train; labels their classes."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("toxic"), F.max(label_col).alias("most")).where("toxic = most").select("id", F.col("toxic").cast("int").alias("toxic"))
    # Copies would teach their words many times over: of equal texts the smallest id stands for all.
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of"))
    marked = keep(hashed.join(marks, "id").groupBy("of", "toxic").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    shares = {r["toxic"]: r for r in marked.groupBy("toxic").agg(F.sum("copies").alias("all"), F.count("*").alias("distinct")).collect()}
    total = sum(r["all"] for r in shares.values())
    prior = shares[1]["all"] / total if 1 in shares else 0.0
    none = np.zeros(0, U64)
    empty = Model(none, np.zeros((2, 0)), np.ones(2), none, np.zeros(0), none, np.zeros((2, 0)), np.zeros(0), prior)
    if len(shares) < 2:
        return empty
    picked = None
    for c in (0, 1):
        part = marked.where(F.col("toxic") == c).select("id", "toxic", "of").orderBy("of", "id").limit(max_documents)
        picked = part if picked is None else picked.unionByName(part)
    picked = keep(picked.select("id", "toxic", "of", (F.pmod("of", F.lit(5)) == 0).alias("curve")))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("of", F.xxhash64("text"))
    # A row for each picked text, however often an id repeats it, and however many other texts the id has.
    texts = texts.join(F.broadcast(picked), ["id", "of"]).groupBy("id", "of", "toxic", "curve").agg(F.min("text").alias("text"))  # at most 2 * max_documents rows
    texts = stored(texts, "training")
    p = partitions(docs, 256 << 20)
    blocks = texts.where("not curve").select("toxic", "text").mapInArrow(_count(4 * p), "bucket int, toxic int, before binary, word binary, n binary")
    counted = keep(blocks.repartition(p, "bucket").groupBy("bucket").applyInArrow(_merge, "kind string, key binary, of binary, a binary, b binary, types binary"))
    reach = counted.where("kind = 'reach'").select("key", "a").mapInArrow(_contexts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_reached, _REACH_DDL).collect()
    rows: dict[str, list] = {"pair": [], "context": [], "word": [], "rest": []}
    for r in counted.where("kind <> 'reach'").collect():
        rows[r["kind"]].append(r)
    words, _, n, _ = _gathered(rows["word"])
    contexts, _, h, followers = _gathered(rows["context"])
    pairs, of, m, _ = _gathered(rows["pair"])
    totals = n.sum(axis=1) + _gathered(rows["rest"])[2].sum(axis=1)
    share = totals[1] / totals.sum()
    x = _excess(n, share)
    factor = _share_factor(x, totals[:, None] * n.sum(axis=0) / totals.sum())
    lower, rest = _shared(reach, words)
    # Each class's words, the unchanged ones and any other word included, sum to one.
    whole = 1 + ((factor - 1) * lower).sum(axis=1)
    word = factor * lower / whole[:, None]
    total = h.sum(axis=0)
    at, _ = _found(contexts, of)
    # A context holds its bigrams' counts, so each bigram that two documents hold has its context among the kept.
    share = h[1, at] / total[at]
    x = _excess(m, share)
    above = np.maximum(m.sum(axis=0) - 1, 0) / total[at]
    pair = np.maximum(above + np.stack([-x, x]) / np.maximum(h[:, at], 1), above * 1e-3)
    model = Model(words, word, rest / whole, contexts, followers / total, pairs, pair, np.zeros(0), prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = texts.where("curve").select("toxic", "text").mapInArrow(_scorer(shared, 1, True), "toxic int, evidence double, n long").collect()
    if {r["toxic"] for r in held} == {0, 1}:
        y = np.array([r["toxic"] for r in held], float)
        share = np.array([shares[c]["distinct"] / max((y == c).sum(), 1) for c in (0, 1)])
        weight = share[y.astype(int)]
        model.curve = _fit(_features(np.array([r["evidence"] for r in held]), np.array([r["n"] for r in held])), y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """carry columns of docs, score and predicted (1 from 0.5 on) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", score double, predicted int"
    return docs.select(*carry, F.col(text_col).alias("text_")).mapInArrow(_scorer(shared, len(carry), False), ddl)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score(docs, model, ("doc_id", "held_out"))
