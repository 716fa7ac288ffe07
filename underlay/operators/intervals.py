"""Interval x interval joins, and runs that touch merged into one.

Intervals are half-open, of whole numbers.  Two meet where one's start lies in the
other, so the join is two joins of points with intervals.  An interval is cut into the
fewest aligned nodes (a level, and a number of nodes of 2**level each), two at most for
each level; a point is in one node of every level.  Node and level are an equi-key that
no interval shares with a point outside it: every matched row is a result, so neither
a common key nor a long interval makes rows that are thrown away.

Intervals without extent and null bounds meet nothing; repeated rows are rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(rows: DataFrame) -> int:
    """The highest level of a node of these intervals (lo, hi)."""
    longest = rows.agg(F.max(F.col("hi") - F.col("lo")).alias("n")).first()["n"]
    return max(int(longest or 1).bit_length() - 1, 0)


def _nodes(highest: int) -> Column:
    """The aligned nodes of [lo, hi), as structs of level and node."""
    found = []
    for level in range(highest + 1):
        # What is left of the interval at this level, in nodes: odd ends are nodes of their own, the rest goes a level up.
        first, past = -F.shiftright(-F.col("lo"), level), F.shiftright(F.col("hi"), level)
        odd = F.pmod(first, F.lit(2)) == 1
        node = lambda x, level=level: F.struct(F.lit(level).alias("level"), x.alias("node"))
        found.append(F.when((first < past) & odd, node(first)))
        found.append(F.when((F.pmod(past, F.lit(2)) == 1) & (past - 1 >= first + odd.cast("int")), node(past - 1)))
    return F.array_compact(F.array(*found))


def _stabbed(points: DataFrame, intervals: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (p, i) of points (on, at, p) and intervals (on, lo, hi, i) that hold them."""
    highest = _levels(intervals)
    ways = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("at", level).alias("node")) for level in range(highest + 1)))
    left = points.select(*on, "p", F.inline(ways))
    right = intervals.where("lo < hi").select(*on, "i", F.inline(_nodes(highest)))
    return left.join(right, [*on, "level", "node"]).select("p", "i")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], bounds: tuple[str, str] = ("lo", "hi"), their_bounds: tuple[str, str] = ("lo", "hi")) -> DataFrame:
    """Pairs of intervals with equal keys that share a number, each once: structs `left` and `right` of their rows.

    Keys that are null meet nothing.
    """

    def named(df: DataFrame, b: tuple[str, str], name: str) -> DataFrame:
        lo, hi = (df[c].cast("long") for c in b)
        return df.select(*(df[k].alias(f"key{n}") for n, k in enumerate(on)), lo.alias("lo"), hi.alias("hi"), F.struct(*(df[c] for c in df.columns)).alias(name)).where("lo < hi")

    keys = [f"key{n}" for n in range(len(on))]
    a, b = named(left, bounds, "left"), named(right, their_bounds, "right")
    point = lambda df, name: df.select(*keys, F.col("lo").alias("at"), F.col(name).alias("p"))
    box = lambda df, lo, name: df.select(*keys, lo.alias("lo"), "hi", F.col(name).alias("i"))
    starts_in = _stabbed(point(a, "left"), box(b, F.col("lo"), "right"), keys).select(F.col("p").alias("left"), F.col("i").alias("right"))
    holds = _stabbed(point(b, "right"), box(a, F.col("lo") + 1, "left"), keys).select(F.col("i").alias("left"), F.col("p").alias("right"))
    return starts_in.unionAll(holds)


def merged(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """by, lo, hi of the runs that intervals with equal by make where they overlap or touch.  Empty ones are left out."""
    some = rows.where(F.col(lo) < F.col(hi)).select(*by, F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int")
    return some.withColumn("opens", opens).withColumn("run", F.sum("opens").over(so_far)).groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
