import random
import re

import numpy as np
import pytest

from underlay.llm import jaccard_join as J
from underlay.llm.components import components

from .conftest import prose


def shingles(t, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0]
            if x and y and (same or 100 * len(x & y) >= 75 * len(x | y)):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1 if i is None else i, len(s), -1 if (c := (least.get(find(k)) if s else i)) is None else c) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted((-1 if r.id is None else r.id, r.n, -1 if r.component is None else r.component) for r in df.collect())


def test_against_brute_force(docs, texts):
    assert got(J.join(docs)) == brute(texts)


@pytest.mark.parametrize("small", [False, True])
def test_chains_passages_and_sizes_at_the_threshold(spark, monkeypatch, small):
    """small: signatures of more than three documents are dealt out, and families cut into blocks of a few sets."""
    if small:
        monkeypatch.setattr(J, "HOT", 3)
        monkeypatch.setattr(J, "TASK_BYTES", 6_000)
    rng = random.Random(8)
    rows, n = [], 0

    def put(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for size in (1, 2, 5, 6, 7, 8, 9, 11, 20, 60, 135, 150, 180, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for keep in sorted({size, *(max(1, round(size * f)) for f in (0.7, 0.74, 0.76, 0.8, 0.9))}):
            put(base[:keep])
        for edits in (1, 2, 4, 8):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            put(near)
    drift = prose(rng, 160).split()
    for _ in range(25):
        drift = list(drift)
        drift[rng.randrange(160)] = f"d{rng.randrange(10**6)}"
        put(drift)
    passage = [f"p{i}" for i in range(60)]
    for _ in range(40):
        put([f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 150))] + passage)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(J.join(df)) == brute(rows)


def test_deletions_where_segments_are_few():
    """Sets of shingles that fall into few segments still share a signature with a set that differs as much as is allowed."""
    rng = np.random.default_rng(3)
    signer = J.Signer(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for trial in range(30):
        large = np.sort(rng.integers(0, 9 << 60, 150, dtype=np.uint64))  # nine of sixteen parts of the universe
        small = np.sort(rng.choice(large, 150 - trial % 38, replace=False))
        (s1, _, p1), (s2, _, p2) = (signer.records(x, np.array([len(x)])) for x in (large, small))
        assert set(s1[p1].tolist()) & set(s2.tolist()) or 4 * len(small) < 3 * len(large)


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("underlay.llm.components.LOCAL_LINKS", local)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        if a != b:
            assert roots[a] == roots[b]
    assert roots[8] != roots[1] and roots[259] == 100
    assert all(roots[r] == r <= n for n, r in roots.items())


def test_empty(none):
    assert J.join(none).count() == 0


@pytest.mark.parametrize("size", [1, 3, 4, 128, 129, 1000])
def test_partners_lie_in_two_bands(size):
    band = lambda n: int(np.searchsorted(J.LIMITS, n))
    assert band(size) - band(-(-3 * size // 4)) <= 1
