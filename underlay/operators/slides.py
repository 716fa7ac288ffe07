"""Detectors 17 and 18: slides a show skips, and notes it never shows.

Input: slides(file_id, inside, number, text, notes, hidden, title).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import DIRECT, findings


def hidden_slides(slides: DataFrame) -> DataFrame:
    """A hidden slide's notes are hidden with it and quoted with it."""
    part = lambda c: F.when(~T.blank(F.col(c)), F.col(c))
    df = slides.where("hidden").withColumn("carried", F.concat_ws("  ", part("text"), part("notes"))).where("carried <> ''")
    named = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(' ("'), "title", F.lit('")'))).otherwise("")
    summary = F.concat(F.lit("slide "), F.col("number").cast("string"), named, F.lit(" is marked hidden and skipped in a show; the file still holds its "), T.characters(F.col("carried")))
    return findings(df, "slides", "hidden-slide", DIRECT, summary, F.col("carried"), seq=F.col("number"))


def speaker_notes(slides: DataFrame) -> DataFrame:
    df = slides.where(~F.col("hidden") & ~T.blank(F.col("notes")))
    summary = F.concat(F.lit("slide "), F.col("number").cast("string"), F.lit(" has a speaker note, which is in the file and on no screen"))
    return findings(df, "slides", "speaker-notes", DIRECT, summary, F.col("notes"), seq=F.col("number") + (1 << 32))


def visible_text(slides: DataFrame) -> DataFrame:
    """units of a deck: its shown slides that are not blank, the slide's number as the page."""
    shown = slides.where(~F.col("hidden") & ~T.blank(F.col("text")))
    return shown.select("file_id", "inside", F.col("number").alias("unit_no"), F.col("number").alias("page"), "text")


def detect(slides: DataFrame) -> list[DataFrame]:
    return [hidden_slides(slides), speaker_notes(slides)]
