"""Bidirectional control characters and which of them stay open, in blocks of a text.

Openers and closers are brackets.  Their depth is a running sum that never falls below
zero, and an opener stays open if no later depth is lower than its own.  A block of a
text comes down to a few numbers for that: by how much it changes the sum, and how low
the sum falls in it.  From those of earlier blocks follows the depth at which a block
begins, from those of later ones how low the depth still falls.  So the blocks of one
text are the work of many tasks, and only a row a block meets in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = ("file_id", "inside", "unit_no")
#: Characters of a block; a carriage return takes its line feed with it.
BLOCK = 1 << 16
_PART = (*UNIT, "block")
CONTROL = T.char_class(T.BIDI)
_ENDS = T.char_class(x for x in T.LINE_ENDS if x != 0x0D)
#: The place after a line end; a carriage return before a line feed is half of one.
AFTER_END = rf"(?<={_ENDS}|\r(?!\n))"
#: The two kinds of brackets, which do not see each other.
_KINDS = (("e", T.EMBEDDINGS, T.POP), ("i", T.ISOLATES, T.POP_ISOLATE))


def cut(body: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of a pattern, and the matches."""
    return F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))


def _blocks(units: DataFrame, size: int) -> DataFrame:
    """A row a block of the texts with a control: what lies before each control and after the last (cp null), as lengths alone."""
    some = units.where(F.col("text").rlike(CONTROL)).select(*UNIT, F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{size}}}(?:(?<=\r)\n)?"), F.lit(0))).alias("block", "part"))
    gaps, hits = cut(F.col("part"), CONTROL)
    shape = F.zip_with(gaps, hits, lambda g, c: F.struct(F.length(g).alias("gap"), (F.size(F.split(g, AFTER_END, -1)) - 1).alias("ends"), F.ascii(c).alias("cp")))
    return some.select(*_PART, shape.alias("shape"))


def _within(blocks: DataFrame) -> DataFrame:
    """Places and sums of a block's controls as if the text began with it; the windows deal the blocks out."""
    rows = blocks.select(*_PART, F.posexplode("shape").alias("k", "c")).select(*_PART, "k", "c.*")
    so_far = Window.partitionBy(*_PART).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"pos": F.sum("gap").over(so_far) + F.col("k"), "line": F.sum("ends").over(so_far)})
    for name, openers, closer in _KINDS:
        placed = placed.withColumn(f"s_{name}", F.sum(F.when(F.col("cp").isin(*openers), 1).when(F.col("cp") == closer, -1).otherwise(0)).over(so_far))
    return placed.withColumn("nth", F.col("k") - F.min("k").over(Window.partitionBy(*_PART, "line")))


def _entries(within: DataFrame) -> DataFrame:
    """A row a block: what holds where it begins (pos, line, nth, depths), and the lowest depth of any later block."""
    hit = F.col("cp").isNotNull()
    last = F.max(F.when(hit, F.struct("line", "nth")))
    sums = [x for name, *_ in _KINDS for x in (F.max_by(f"s_{name}", "k").alias(f"sum_{name}"), F.min(F.when(hit, F.col(f"s_{name}"))).alias(f"low_{name}"))]
    whole = within.groupBy(*_PART).agg(F.count("cp").alias("n"), (F.sum("gap") + F.count("cp")).alias("size"), F.sum("ends").alias("ends"), last.alias("last"), *sums)
    by_unit = Window.partitionBy(*UNIT)
    # Later blocks are the earlier ones of the opposite order: Spark runs over a frame that grows once, and over one that shrinks anew for each row.
    before, after = (by_unit.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("block"), F.desc("block")))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    df = whole.withColumns({"pos_0": total("size"), "line_0": total("ends"), "n_0": total("n")} | {f"sum0_{name}": total(f"sum_{name}") for name, *_ in _KINDS})
    on_last = F.when(F.col("last.line") == F.col("ends"), F.col("last.nth") + 1).otherwise(0)
    steps = {"gone": F.when(F.col("ends") > 0, F.col("n_0") + F.col("n") - on_last)}
    df = df.withColumns(steps | {f"least_{name}": F.least(F.lit(0), F.col(f"sum0_{name}") + F.col(f"low_{name}")) for name, *_ in _KINDS})
    depths = {f"depth_{name}": F.col(f"sum0_{name}") - F.coalesce(F.min(f"least_{name}").over(before), F.lit(0)) for name, *_ in _KINDS}
    df = df.withColumns({"nth_0": F.col("n_0") - F.coalesce(F.max("gone").over(before), F.lit(0))} | depths)
    # A block without controls has no depth of its own that could be lower.
    lowest = {f"later_{name}": F.min(F.when(F.col(f"low_{name}").isNotNull(), F.greatest(F.lit(0), F.col(f"depth_{name}") + F.col(f"low_{name}")))).over(after) for name, *_ in _KINDS}
    return df.withColumns(lowest).select(*_PART, "pos_0", "line_0", "nth_0", *depths, *lowest)


def controls(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each control character: pos in the unit, line, nth in its line (all from 0), cp, and `open`: an opener that nothing closes.

    units(file_id, inside, unit_no, text), a row a unit; null texts have none.  block: characters that one task holds of a text.
    """
    within = _within(_blocks(units, block))
    # Merged where the blocks lie and as they are sorted; a broadcast of the controls would bring a text's blocks together again.
    df = within.where("cp is not null").join(_entries(within).hint("merge"), list(_PART))
    part = Window.partitionBy(*_PART)
    so_far, later = part.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), part.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    is_open = F.lit(False)
    for name, openers, _ in _KINDS:
        running = F.col(f"depth_{name}") + F.col(f"s_{name}")
        df = df.withColumn(f"d_{name}", running - F.least(F.lit(0), F.min(running).over(so_far)))
        lowest = F.coalesce(F.least(F.min(f"d_{name}").over(later), F.col(f"later_{name}")), F.col(f"d_{name}"))
        is_open = is_open | (F.col("cp").isin(*openers) & (lowest >= F.col(f"d_{name}")))
    nth = F.col("nth") + F.when(F.col("line") == 0, F.col("nth_0")).otherwise(0)
    return df.select(*UNIT, (F.col("pos") + F.col("pos_0")).cast("int").alias("pos"), (F.col("line") + F.col("line_0")).cast("int").alias("line"), nth.cast("int").alias("nth"), "cp", is_open.alias("open"))
