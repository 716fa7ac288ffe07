"""Interval joins against all pairs; keys that every row shares; runs."""

import random

from pyspark.sql import functions as F

from underlay.operators import intervals as I


def test_against_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.choice(["a", "b", None]), (lo := rng.choice([rng.randint(-40, 40), rng.randint(-(10**12), 10**12), None])), None if lo is None else lo + rng.choice([-3, 0, 1, 2, 5, 17, 64, 10**6]), i) for i in range(n)]
    left, right = make(300), make(300)
    left += left[:5]
    a, b = spark.createDataFrame(left, "k string, lo long, hi long, i int"), spark.createDataFrame(right, "k string, from long, to long, i int")
    got = sorted((r.left.i, r.right.i) for r in I.overlapping(a, b, ["k"], their_bounds=("from", "to")).collect())
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and max(x[1], y[1]) < min(x[2], y[2]))
    assert got == want and len(want) > 100


def test_the_nodes_of_an_interval(spark):
    df = spark.createDataFrame([(lo, lo + n) for lo in range(-33, 34) for n in range(1, 40)], "lo long, hi long").withColumn("nodes", I._nodes(6))
    for r in df.collect():
        held = sorted(x for n in r.nodes for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert held == list(range(r.lo, r.hi)) and len(r.nodes) <= 2 * (r.hi - r.lo).bit_length()


def test_one_key_for_all_makes_no_rows_but_results(spark):
    """50,000 short intervals of one key a side: rows of the join's sides and results, never pairs of the key."""
    a = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 3).alias("hi"))
    b = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 10 + 2).alias("lo"), (F.col("id") * 10 + 4).alias("hi"))
    assert I.overlapping(a, b, ["k"]).count() == 50_000
    plan = I.overlapping(a, b, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, ") == 2 and plan.count("level") and "Cartesian" not in plan


def test_runs(spark):
    rows = [("a", 1, 3), ("a", 3, 4), ("a", 6, 9), ("a", 7, 8), ("a", 8, 12), ("a", 12, 12), ("b", 3, 5), (None, 1, 2), (None, 2, 3), ("a", None, 4)]
    got = sorted(str(tuple(r)) for r in I.merged(spark.createDataFrame(rows, "m string, lo long, hi long"), ["m"]).collect())
    assert got == sorted(str(x) for x in [("a", 1, 4), ("a", 6, 12), ("b", 3, 5), (None, 1, 3)])
    assert I.merged(spark.createDataFrame([], "m string, lo long, hi long"), ["m"]).count() == 0


def test_runs_of_repeated_intervals(spark):
    """Rows with equal bounds, many times over and in many tasks: the first of them alone opens a run."""
    rng = random.Random(8)
    rows = [("k", (lo := 7 * rng.randint(0, 400)), lo + rng.choice([3, 7, 12])) for _ in range(300)] * 20
    days = sorted({d for _, lo, hi in rows for d in range(lo, hi + 1)})
    got = sorted((r.lo, r.hi) for r in I.merged(spark.createDataFrame(rows, "m string, lo long, hi long").repartition(16), ["m"]).collect())
    want = []
    for lo, hi in sorted({(lo, hi) for _, lo, hi in rows}):
        if want and lo <= want[-1][1]:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    assert got == [tuple(x) for x in want] and sum(hi - lo + 1 for lo, hi in got) == len(days)
