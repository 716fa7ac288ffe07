"""The one shape of every detector's result, and its order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT, CIRCUMSTANTIAL, SELF_REPORTED = "direct", "circumstantial", "self-reported"
KEY = ("file_id", "inside")
COLUMNS = ("file_id", "inside", "emit_phase", "emit_seq", "detector", "basis", "summary", "human_sees", "machine_reads", "page", "line", "column", "codepoints", "decoded")
#: Phases in which a file's findings are emitted; ties of position keep this order.
PHASES = {"characters": 1, "page": 2, "revisions": 3, "sheets": 4, "slides": 5, "word": 6, "thumbnail": 7, "ocr": 8, "earlier": 9, "attached": 10, "inside": 11, "metadata": 12}


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def findings(df: DataFrame, phase: str, detector: str, basis, summary, machine_reads, human_sees="", seq=0, page=None, line=None, column=None, codepoints=None, decoded=None) -> DataFrame:
    """df's rows as findings; arguments are columns or plain values."""
    points = _lit(codepoints) if codepoints is not None else F.expr("cast(array() as array<string>)")
    return df.select(
        "file_id", "inside", F.lit(PHASES[phase]).alias("emit_phase"), _lit(seq).cast("long").alias("emit_seq"), F.lit(detector).alias("detector"), _lit(basis).alias("basis"),
        _lit(summary).alias("summary"), _lit(human_sees).alias("human_sees"), _lit(machine_reads).alias("machine_reads"),
        _lit(page).cast("int").alias("page"), _lit(line).cast("int").alias("line"), _lit(column).cast("int").alias("column"), points.alias("codepoints"), _lit(decoded).cast("string").alias("decoded"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings; no detector outranks or hides another."""
    return reduce(DataFrame.unionByName, parts)


def order() -> list[Column]:
    """Position within the file, missing coordinates first; then the order of emission."""
    zero = F.lit(0)
    return [F.col("file_id"), F.coalesce("page", zero), F.coalesce("line", zero), F.coalesce("column", zero), F.col("emit_phase"), F.col("emit_seq"), F.col("detector")]


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*order())
