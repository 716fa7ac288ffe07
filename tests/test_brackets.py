"""Controls and brackets in blocks: any size of block gives what a stack over the whole text gives."""

import random

import pytest
from pyspark.sql import functions as F

from underlay.functions import text as T
from underlay.operators import brackets

UNIT = "file_id string, inside string, unit_no long, page int, text string"


def stacked(text):
    """(pos, line, nth, cp, open) of each control, by two stacks and Python's lines."""
    found, stacks, line, nth = {}, ([], []), 0, 0
    for pos, c in enumerate(text):
        cp = ord(c)
        if cp in T.BIDI:
            found[pos] = [pos, line, nth, cp, False]
            nth += 1
            for stack, openers, closer in zip(stacks, (T.EMBEDDINGS, T.ISOLATES), (T.POP, T.POP_ISOLATE)):
                if cp in openers:
                    stack.append(pos)
                elif cp == closer and stack:
                    stack.pop()
        if cp in T.LINE_ENDS and not (c == "\r" and text[pos + 1 : pos + 2] == "\n"):
            line, nth = line + 1, 0
    for pos in (p for stack in stacks for p in stack):
        found[pos][4] = True
    return [tuple(x) for x in found.values()]


@pytest.mark.parametrize("block", [1, 2, 7, brackets.BLOCK])
def test_blocks_of_any_size(spark, block):
    draw = random.Random(block)
    signs = ["a", "\U0001f600", "\n", "\r", "\r\n", " ", *map(chr, T.BIDI), *map(chr, (T.POP, T.POP_ISOLATE) * 2)]
    texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(60)] + ["", "plain", "‮" * 9, "‬" * 9 + "‮", "‮" + "a" * 30 + "\n" * 5]
    units = spark.createDataFrame([(str(i), "", i % 3, None, t) for i, t in enumerate(texts)] + [("none", "", 0, None, None)], UNIT)
    got = {}
    for r in brackets.controls(units, block).collect():
        got.setdefault(int(r.file_id), []).append((r.pos, r.line, r.nth, r.cp, r.open))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, t in enumerate(texts) if (x := stacked(t))}


def test_no_units(spark):
    assert brackets.controls(spark.createDataFrame([], UNIT)).count() == 0


def test_one_text_is_the_work_of_many_tasks(spark):
    """Two million controls in one text: half of the openers are closed at the very end, and tasks share the rows."""
    half = 500_000
    text = "‮⁦" * half + "ab\n" * 10 + "‬⁩" * (half // 2)
    found = brackets.controls(spark.createDataFrame([("f", "", 0, None, text)], UNIT))
    r = found.agg(F.count("*").alias("n"), F.sum(F.col("open").cast("int")).alias("open"), F.max(F.when(F.col("open"), F.col("pos"))).alias("last"), F.max("line").alias("line"), F.max("nth").alias("nth")).first()
    assert (r.n, r.open, r.last, r.line, r.nth) == (3 * half, half, half - 1, 10, 2 * half - 1)
    # Spark may join small partitions; how the blocks are dealt out shows without that.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 3 * half * 0.75
