"""Values of a file sought in its text, where the text lies.

A file's values become one automaton, and each unit of its text runs through it once, in
the task that reads it.  The values come to the units: as a broadcast while they are
small by count, in a join that Spark may split for skew beyond that.  What a unit gives
are numbers of values and places, no text.

The text of a file is its units in order, joined by line feeds.  A value with line feeds
can begin in a unit and end in a later one.  Its parts then lie at the end of a unit, in
whole units and at the start of one, and all of them point to the same place where the
value begins in the file's text; so parts are counted by that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import KEY

#: Bytes of values that are broadcast at most, and bytes of a file's values that make one automaton.
BROADCAST_BYTES, AUTOMATON_BYTES = 32 << 20, 1 << 20
_PARTS = "file_id string, inside string, unit_no long, chunk int, value int, part string, at long"


def chunks(values: DataFrame) -> DataFrame:
    """values(file_id, inside, low), distinct, as rows of at most about AUTOMATON_BYTES: chunk, and an array `of` of values in order."""
    sized = values.groupBy(*KEY).agg(F.ceil(F.sum(F.octet_length("low") + 16) / AUTOMATON_BYTES).cast("int").alias("n"))
    dealt = values.join(sized, list(KEY)).withColumn("chunk", F.pmod(F.xxhash64("low"), F.col("n")).cast("int"))
    return dealt.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_set("low")).alias("of"))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part: 'in' (the value lies in the unit), or a part that a border cuts: 'tail', 'whole', 'head', at: where the value begins, counted from the unit's start."""
    import ahocorasick

    last, automaton, crossing = None, None, []
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    for batch in batches:
        out: list[tuple] = []
        for key, inside, unit, text, chunk, of in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (key, inside, chunk) != last:
                last, automaton = (key, inside, chunk), ahocorasick.Automaton()
                for i, value in enumerate(of):
                    automaton.add_word(value, i)
                automaton.make_automaton()
                crossing = [(i, v) for i, v in enumerate(of) if "\n" in v]
            out += [(key, inside, unit, chunk, i, "in", 0) for i in {i for _, i in automaton.iter(text)}]
            for i, value in crossing:
                out += [(key, inside, unit, chunk, i, part, at) for part, at in _cut_parts(value, text)]
        columns = zip(*out) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _cut_parts(value: str, text: str) -> Iterator[tuple[str, int]]:
    """The ways in which a unit holds a part of a value that borders cut at line feeds: up to one, between two, or from one on."""
    cut = value.find("\n")
    while cut >= 0:
        if text.endswith(value[:cut]):
            yield "tail", len(text) - cut
        if text.startswith(value[cut + 1 :]):
            yield "head", -(cut + 1)
        end = cut + 1 + len(text)
        if value[end : end + 1] == "\n" and value.startswith(text, cut + 1):
            yield "whole", -(cut + 1)
        cut = value.find("\n", cut + 1)


def present(values: DataFrame, units: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(file_id, inside, low): the values that their file's text holds.

    values(file_id, inside, low): repeated rows count once; empty and null values are not sought.  units(file_id,
    inside, unit_no, text): a unit's number is its own; null texts are none.  Both are compared in lower case, values as
    they are given.  most: bytes of values that may be broadcast.
    """
    chunked = chunks(values.where("low <> ''").select(*KEY, "low").distinct())
    size = values.agg(F.coalesce(F.sum(F.octet_length("low") + F.octet_length("file_id") + F.octet_length("inside") + 64), F.lit(0))).first()[0]
    side = F.broadcast(chunked) if size <= most else chunked.hint("merge")
    lowered = units.where("text is not null").select(*KEY, F.col("unit_no").cast("long").alias("unit_no"), F.lower("text").alias("text"))
    parts = lowered.join(side, list(KEY)).select(*KEY, "unit_no", "text", "chunk", "of").mapInArrow(_run, _PARTS)
    inner = parts.where("part = 'in'").select(*KEY, "chunk", "value").distinct()
    found = inner.unionByName(_across(parts.where("part <> 'in'"), lowered)) if _cuts(values) else inner
    named = chunked.select(*KEY, "chunk", F.posexplode("of").alias("value", "low"))
    return found.distinct().join(named, [*KEY, "chunk", "value"]).select(*KEY, "low")


def _cuts(values: DataFrame) -> bool:
    """Whether any value has a line feed, so that a border can cut it; without one nothing has to be read for that."""
    return not values.where(F.contains("low", F.lit("\n"))).isEmpty()


def _across(parts: DataFrame, lowered: DataFrame) -> DataFrame:
    """Values whose parts fill consecutive units: one end, one start, and all units between whole, for one and the same place in the file's text."""
    in_order = Window.partitionBy(*KEY).orderBy("unit_no")
    thin = lowered.select(*KEY, "unit_no", (F.length("text") + 1).cast("long").alias("wide")).join(parts.select(*KEY).distinct(), list(KEY), "left_semi")
    starts = thin.withColumns({"nth": F.row_number().over(in_order), "start": F.sum("wide").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("wide")})
    placed = parts.join(starts, [*KEY, "unit_no"]).withColumn("at", F.col("at") + F.col("start"))
    at = lambda part: F.max(F.when(F.col("part") == part, F.col("nth")))
    # A place begins in one unit and ends in one, and a unit's start leaves it one part of the value.
    met = placed.groupBy(*KEY, "chunk", "value", "at").agg(at("tail").alias("tail"), at("head").alias("head"), F.sum((F.col("part") == "whole").cast("int")).alias("whole"))
    return met.where("head = tail + whole + 1").select(*KEY, "chunk", "value").distinct()
