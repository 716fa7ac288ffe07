"""Connected components of a table of links.

Up to LOCAL_LINKS links, counted first, one task joins them by union-find; more
are worked on everywhere by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


LOCAL_LINKS = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a bounded number of links; every root is its component's smallest node."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        while (jump := least[least]) is not least and (jump != least).any():
            least = jump
        new = least[root]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _star(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the component's smallest node.

    A node's neighbours are only ever reduced to their minimum, partly before the
    shuffle, and looked up again by a join that the adaptive skew join splits, so
    a node linked with a third of all others is no task of its own.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= LOCAL_LINKS:
        return keep(edges.coalesce(1).mapInArrow(_united, "node long, root long"))
    mark = None
    while mark != (mark := _mark(edges)):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to u's smallest.
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large)
        # Small star: u and its neighbours below go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return keep(nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
