import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from underlay.llm import kernel as K
from underlay.llm import lm_scoring as L
from underlay.llm.common import fold


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def test_base_counts_against_brute_force(docs, texts):
    model = L.train(docs.where(fold(F.col("doc_id"), 7) != 2))
    got = L.score(docs, model).collect()
    counts, n_docs = Counter(), 0
    for i, t in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(tokens(t))
            n_docs += 1
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types, model.documents) == (n, v, n_docs)
    want = sorted((len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for w in (tokens(t) for _, t in texts))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_filter_gives_back_levels():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 20_000).astype(np.uint64)
    keys, counts = np.unique(keys), None
    counts = np.random.default_rng(2).integers(1, 300, len(keys))
    bits, m, k = L.build_filter(keys, counts, 10)
    found = L.probe_filter(bits, m, k, keys)
    true = 1 + np.floor(np.log2(counts)).astype(int)
    assert (found >= true).all() and (found == true).mean() > 0.97
    others = np.setdiff1d(np.random.default_rng(3).integers(0, 1 << 40, 20_000).astype(np.uint64), keys)
    assert (L.probe_filter(bits, m, k, others) > 0).mean() < 0.05
    assert not L.probe_filter(bits, m, k, keys[:0]).size


def test_segments_laid_end_to_end_answer_like_each(docs):
    model = L.train(docs)
    rows = model.parts.where("ngram = 2").orderBy("bucket").collect()
    pairs = np.unique(np.random.default_rng(8).integers(0, 1 << 63, 5000).astype(np.uint64))
    cuts = np.searchsorted(L.bucket_of(pairs, model.buckets), np.arange(model.buckets + 1))
    for some in (rows, rows[1:], rows[::3]):
        got, want = np.zeros(len(pairs), np.uint8), np.zeros(len(pairs), np.uint8)
        L.Segments(some).levels(pairs, cuts, got)
        for r in some:
            own = slice(cuts[r.bucket], cuts[r.bucket + 1])
            want[own] = L.probe_filter(np.frombuffer(r.payload, np.uint8), r.m, r.k, pairs[own] & L.LOW40)
        assert (got == want).all()


def test_score_against_brute_force(docs, texts):
    """With so many bits that the filter has no false positives."""
    got = L.score(docs, L.train(docs, bits_per_entry=60)).collect()
    one, two = Counter(), Counter()
    for _, t in texts:
        w = tokens(t)
        one.update(w)
        two.update(zip(["start", *w], w))
    n, v, c = sum(one.values()), len(one), lambda h: len(texts) if h == "start" else one[h]
    unseen = min(max(sum(x == 1 for x in two.values()) / n, 0.05), 0.98)

    def p(h, w):
        level = 2 ** (two[h, w].bit_length() - 1) if two[h, w] else 0
        return (1 - unseen) * level / c(h) + unseen * (one[w] + 1) / (n + v + 1)

    want = sorted(round(sum(math.log10(p(h, w)) for h, w in zip(["start", *tokens(t)], tokens(t))), 6) for _, t in texts)
    assert sorted(round(r.score, 6) for r in got) == pytest.approx(want, abs=2e-6)
    followers = Counter()
    for h, w in two:
        followers[h] += p(h, w)
    assert all(x < 1 + 1e-9 for x in followers.values())


def test_merging_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [L._counted(rng.integers(0, 900, 400).astype(np.uint64)) for _ in range(30)]
    monkeypatch.setattr(L, "MERGED_ENTRIES", 500)
    keys, counts = L._merged(iter(blocks))
    want = Counter()
    for k, c in blocks:
        want.update(dict(zip(k.tolist(), c.tolist())))
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def test_both_ways_to_the_model_agree(docs, none):
    model = L.train(docs.where("doc_id % 3 <> 0"))
    carry = ("doc_id", "text", "n_chars")
    assert sorted(map(str, L.score(docs, model, carry=carry, max_broadcast_bytes=0).collect())) == sorted(map(str, L.score(docs, model, carry=carry).collect()))
    assert L.score(none, model, max_broadcast_bytes=0).count() == 0


def test_blocks_ask_ranges_of_buckets(docs, monkeypatch):
    """A block asks with a row a range of the model, not with two a bucket; neither ranges, blocks nor passes change a score."""
    real, made = type(docs).mapInArrow, []
    with monkeypatch.context() as m:
        m.setattr(L, "partitions", lambda *_: 32)
        model = L.train(docs.where("doc_id % 3 <> 0"))
    carry = ("doc_id", "text")
    want = sorted(map(str, L.score(docs, model, carry=carry).collect()))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert model.buckets == 256 and sorted(map(str, L.score(docs, model, carry=carry, max_broadcast_bytes=0).collect())) == want
    assert made[0].count() <= 5 * 2
    for name, size in (("RANGE_BYTES", 3000), ("ASKED_BYTES", 2000), ("ANSWERED_KEYS", 50), ("RANGE_BYTES", 1)):
        monkeypatch.setattr(L, name, size)
        made.clear()
        assert sorted(map(str, L.score(docs, model, carry=carry, max_broadcast_bytes=0).collect())) == want
    # Documents go with all ranges, not with the first ones of each task.
    at = [r.range for r in made[0].where(F.col("kind") == L.DOCUMENTS).collect()]
    assert len(set(at)) > 0.5 * min(len(at), model.buckets)


def test_groups_of_segments_change_nothing(docs, monkeypatch):
    model = L.train(docs)
    whole = {tuple(r) for r in L.score(docs, model).collect()}
    monkeypatch.setattr(L, "GROUP_BYTES", 2000)
    assert {tuple(r) for r in L.score(docs, model).collect()} == whole


def test_model_beats_its_base_on_seen_text(docs):
    model = L.train(docs)
    r = L.score(docs, model).agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_empty_tables(docs, none):
    model = L.train(none)
    assert model.tokens == 0 and L.score(none, model).count() == 0
    got = L.score(docs, model).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in got)


def test_word_hashes_are_those_of_single_words():
    w = ["alpha", "beta", "é", "x" * 1000]
    h = K.text_hashes(w)
    assert len(set(h.tolist())) == 4 and (K.text_hashes(w[::-1])[::-1] == h).all()
