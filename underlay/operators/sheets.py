"""Detectors 12 to 16: what a workbook holds and does not show.

Input: sheets(file_id, inside, sheet_no, name, hidden), cells(.., sheet_no, cell_no, row, col, text),
hidden_axis(.., sheet_no, axis, idx) with axis row, column or filter, and
cell_changes(.., seq, sheet, row, col, previous, author, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import CIRCUMSTANTIAL, DIRECT, findings

SHEET = ("file_id", "inside", "sheet_no")
SEPARATOR = " | "


def _values(order: list[str]) -> list[Column]:
    """Texts of a group in order, and how many."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return [F.array_join(F.transform(listed, lambda c: c["text"]), SEPARATOR).alias("values"), F.count("*").alias("n")]


def hidden_sheets(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    held = cells.where(~T.blank(F.col("text"))).join(sheets.where("hidden is not null and hidden <> ''"), list(SHEET))
    df = held.groupBy(*SHEET, "name", "hidden").agg(*_values(["cell_no"]))
    how = F.when(F.col("hidden") == "very hidden", "very hidden, which the application itself cannot undo").otherwise("hidden")
    summary = F.concat(F.lit('sheet "'), "name", F.lit('" is marked '), how, F.lit(", and the file still holds its "), T.plural(F.col("n"), "value"))
    return findings(df, "sheets", "hidden-sheet", DIRECT, summary, F.col("values"), seq=F.col("sheet_no"))


def islands(axis: DataFrame) -> DataFrame:
    """Maximal runs of consecutive indices: axis with the run's first and last index."""
    one = axis.select(*SHEET, "idx").distinct()
    run = one.withColumn("g", F.col("idx") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("idx")))
    ends = Window.partitionBy(*SHEET, "g")
    return run.select(*SHEET, "idx", F.min("idx").over(ends).alias("first"), F.max("idx").over(ends).alias("last"))


def _axis(sheets: DataFrame, cells: DataFrame, axis: DataFrame, place: str, detector: str, noun: str, number: int, name=lambda c: c.cast("string"), basis: str = DIRECT, how: str = "hidden") -> DataFrame:
    shown = sheets.where("hidden is null or hidden = ''").select(*SHEET, "name")
    held = cells.where(~T.blank(F.col("text"))).withColumn("idx", F.col(place))
    df = islands(axis).join(shown, list(SHEET)).join(held, [*SHEET, "idx"]).groupBy(*SHEET, "name", "first", "last").agg(*_values(["idx", "cell_no"]))
    first, last = F.col("first"), F.col("last")
    where = F.when(first == last, F.concat(F.lit(f"{noun} "), name(first), F.lit(" of sheet "))).otherwise(F.concat(F.lit(f"{noun}s "), name(first), F.lit(" to "), name(last), F.lit(" of sheet ")))
    verb = F.when(first == last, "is").otherwise("are")
    summary = F.concat(where, F.lit('"'), "name", F.lit('" '), verb, F.lit(f" {how}, and the file still holds "), T.plural(F.col("n"), "value"), F.lit(" there"))
    seq = F.lit(number).cast("long") * (1 << 48) + F.col("sheet_no").cast("long") * (1 << 24) + first
    return findings(df, "sheets", detector, basis, summary, F.col("values"), seq=seq)


def hidden_rows(sheets: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    return _axis(sheets, cells, axis.where("axis = 'row'"), "row", "hidden-rows", "row", 1)


def hidden_columns(sheets: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    return _axis(sheets, cells, axis.where("axis = 'column'"), "col", "hidden-columns", "column", 2, T.column_name)


def filtered_rows(sheets: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    key = [*SHEET, "idx"]
    held_back = axis.where("axis = 'filter'").join(axis.where("axis = 'row'").select(*key), key, "left_anti")
    return _axis(sheets, cells, held_back, "row", "filtered-rows", "row", 3, basis=CIRCUMSTANTIAL, how="held back by a filter that the file does not show")


def changed_cells(sheets: DataFrame, cells: DataFrame, changes: DataFrame) -> DataFrame:
    """The current value is that of the first matching cell, in order of sheets and cells."""
    named = cells.join(sheets.select(*SHEET, F.col("name").alias("sheet")), list(SHEET))
    place = ["file_id", "inside", "sheet", "row", "col"]
    now = named.groupBy(*place).agg(F.min_by("text", F.struct("sheet_no", "cell_no")).alias("now"))
    df = changes.where(~T.blank(F.col("previous"))).join(now, place, "left")
    who = F.when(F.coalesce("author", F.lit("")) != "", F.col("author")).otherwise("somebody the file does not name")
    when = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit(" on "), "date")).otherwise(", at a time the file does not give")
    summary = F.concat(F.lit("cell "), T.column_name(F.col("col")), F.col("row").cast("string"), F.lit(' of sheet "'), "sheet", F.lit('" was changed by '), who, when, F.lit("; the file still holds the earlier value"))
    return findings(df, "sheets", "changed-cell", DIRECT, summary, F.col("previous"), F.coalesce("now", F.lit("")), seq=F.lit(4).cast("long") * (1 << 48) + F.col("seq"))


def visible_text(sheets: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    """(file_id, inside, sheet_no, text): cells joined by tabs, rows by line feeds, without what is hidden or filtered."""
    shown = cells.join(sheets.where("hidden is null or hidden = ''").select(*SHEET), list(SHEET), "left_semi")
    rows = axis.where("axis in ('row', 'filter')").select(*SHEET, F.col("idx").alias("row"))
    columns = axis.where("axis = 'column'").select(*SHEET, F.col("idx").alias("col"))
    shown = shown.join(rows, [*SHEET, "row"], "left_anti").join(columns, [*SHEET, "col"], "left_anti")

    def joined(order: str, separator: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda c: c["text"]), separator)

    return shown.groupBy(*SHEET, "row").agg(joined("cell_no", "\t").alias("text")).groupBy(*SHEET).agg(joined("row", "\n").alias("text"))


def detect(sheets: DataFrame, cells: DataFrame, axis: DataFrame, changes: DataFrame) -> list[DataFrame]:
    return [hidden_sheets(sheets, cells), hidden_rows(sheets, cells, axis), hidden_columns(sheets, cells, axis), filtered_rows(sheets, cells, axis), changed_cells(sheets, cells, changes)]
