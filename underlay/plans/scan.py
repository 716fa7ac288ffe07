"""Scan and survey: files to records to findings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, metadata
from ..sources.casefiles import Records
from ..sources.walk import case_files
from . import detectors


def findings_of(r: Records, ocr: DataFrame | None = None, previews: DataFrame | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """The chosen detectors (all, if none are named) over the record tables that they need; what is inside a carried package keeps its name in `inside`.

    ocr: words read off rendered pages; previews: words read off previews, held against those of ocr.
    """
    outside = {name: df for name, df in (("ocr", ocr), ("previews", previews)) if df is not None}
    special = {"laid": r.laid, "unread": lambda: r["files"].where("text_unread")}
    return detectors.found(detectors.chosen(only, outside), lambda name: special[name]() if name in special else r[name], outside)


def remarks_of(r: Records, unread: DataFrame | None = None) -> DataFrame:
    """remarks(file_id, inside, phase, seq, text): what the readers, the page detectors and the metadata have to say beside findings; and on pages left unread."""
    said = [r["remarks"], geometry.page_remarks(r.laid(), r["annotations"]), metadata.claims(r["meta_fields"]), *([] if unread is None else [unread])]
    parts = [df.select("file_id", "inside", F.lit(phase).alias("phase"), "seq", "text") for phase, df in enumerate(said)]
    return reduce(DataFrame.unionByName, parts)


def scan(spark: SparkSession, address: str, stored_at: str, ocr: DataFrame | None = None, previews: DataFrame | None = None, only: Iterable[str] | None = None) -> tuple[Records, DataFrame]:
    records = Records(case_files(spark, address), stored_at)
    return records, findings_of(records, ocr, previews, only)
