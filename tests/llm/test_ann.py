import numpy as np
from pyspark.sql import functions as F

from underlay.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score double, d int"


def rows(n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)).astype(np.float32)
    v[n // 2 :: 3] = v[0]  # many copies
    return [(i, x.tolist(), 0.5, 1) for i, x in enumerate(v)]


def brute(data, queries, k):
    ids = np.array([r[0] for r in data])
    v = np.array([r[1] for r in data], np.float64)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    out = {}
    for i, x in queries:
        q = np.array(x, np.float64)
        c = u @ (q / np.sqrt(q @ q))
        c[ids == i] = -9
        out[i] = [(int(ids[j]), round(float(c[j]), 9)) for j in np.lexsort((ids, -np.round(c, 12)))[:k] if c[j] > -9]
    return out


def collect(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return got


def test_recall_and_ties(spark, monkeypatch):
    data = rows(900, 32, 1)
    v = spark.createDataFrame(data, SCHEMA)
    want = brute(data, [(i, x) for i, x, _, _ in data if i % 50 == 0], 5)
    got = collect(A.nearest(v, v.where(F.col("vec_id") % 50 == 0)))
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) > 0.97
    assert got[0] == want[0]  # copies: ties go to the smaller ids
    monkeypatch.setattr(A, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(A, "BLOCK_VECTORS", 100)
    assert collect(A.nearest(v, v.where(F.col("vec_id") % 50 == 0))) == got


def test_vectors_that_take_no_part(spark):
    bad = [(0, [1.0, 0.0], 0.0, 0), (1, None, 0.0, 0), (2, [], 0.0, 0), (3, [0.0, 0.0], 0.0, 0), (4, [float("nan"), 1.0], 0.0, 0), (5, [float("inf"), 1.0], 0.0, 0), (6, [None, 1.0], 0.0, 0), (7, [2.0, 0.0], 0.0, 0), (8, [0.0, -3.0], 0.0, 0), (9, [1.0, 1.0, 1.0], 0.0, 0), (None, [1.0, 0.0], 0.0, 0), (50, [3.0], 0.0, 0)]
    v = spark.createDataFrame(bad, SCHEMA)
    assert collect(A.nearest(v, v.where("vec_id in (0, 1, 3, 50)"))) == {0: [(7, 1.0), (8, 0.0)]}
    assert A.nearest(v.where("false"), v.where("false")).count() == 0


def test_estimates_stay_within_the_bound():
    rng = np.random.default_rng(2)
    u, q = (A.unit(rng.standard_normal((2000, 64))) for _ in range(2))
    turn = A.rotation(64)
    bits, scalar = A.encode(u, turn)
    signs = np.unpackbits(bits, axis=1, count=64) * 2.0 - 1
    estimate = ((q @ turn) * signs / 8).sum(axis=1) / scalar
    error = A.EPSILON * np.sqrt(1 - scalar**2) / scalar / np.sqrt(63)
    assert (np.abs(estimate - (u * q).sum(axis=1)) <= error).mean() > 0.99


def test_popcounts_are_inner_products():
    """Within the stated bound of the unpacked codes' products, for any number of dimensions."""
    rng = np.random.default_rng(3)
    for d in (1, 3, 8, 63, 64, 65, 200):
        u = A.unit(rng.standard_normal((50, d)))
        turn = A.rotation(d)
        bits, scalar = A.encode(u, turn)
        codes = A.packed(bits)
        signs = np.where(u @ turn > 0, 1, -1) / np.sqrt(d)
        assert np.allclose((signs * (u @ turn)).sum(axis=1), scalar)
        for q in A.unit(rng.standard_normal((5, d))) @ turn:
            got, bound = A.products(codes, np.bitwise_count(codes).sum(axis=0, dtype=np.int64), q)
            assert (np.abs(got - signs @ q) <= bound + 1e-9).all() and bound < 0.1
