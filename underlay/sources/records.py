"""The record tables that files turn into, and the sink that parsers fill."""

from __future__ import annotations

from collections import defaultdict

_AT = "file_id string, inside string, "
SCHEMAS = {
    "files": _AT + "kind string, searched boolean, text_unread boolean, refusal string, sha256 string, length long",
    "remarks": _AT + "seq long, text string",
    "units": _AT + "unit_no long, page int, text string",
    "sheets": _AT + "sheet_no long, name string, hidden string",
    "cells": _AT + "sheet_no long, cell_no long, row long, col long, text string",
    "hidden_axis": _AT + "sheet_no long, axis string, idx long",
    "cell_changes": _AT + "seq long, sheet string, row long, col long, previous string, author string, date string",
    "slides": _AT + "number long, text string, notes string, hidden boolean, title string",
    "revisions": _AT + "seq long, kind string, text string, author string, date string, part string",
    "comments": _AT + "seq long, text string, author string, date string, initials string",
    "word_hidden": _AT + "seq long, part string, text string",
    "attachments": _AT + "att_no long, name string, size long, text string, part string, description string",
    "earlier": _AT + "number long, ends_at long, pages long, text string",
    "meta_fields": _AT + "seq long, name string, value string, part string, role string, container string",
    "meta_history": _AT + "seq long, action string, software string, `when` string, changed string, instance string",
    "images": _AT + "w long, h long, tw long, th long",
    "pages": _AT + "page int, bx0 double, by0 double, bx1 double, by1 double",
    "shapes": _AT + "page int, shape_no long, kind string, x0 double, y0 double, x1 double, y1 double, r double, g double, b double, alpha double, ord long",
    "glyphs": _AT + "page int, run_no long, glyph_no long, ch string, x0 double, y0 double, x1 double, y1 double, ox double, oy double, dx double, dy double, size double, mode int, alpha double, "
    "fr double, fg double, fb double, sr double, sg double, sb double, cx0 double, cy0 double, cx1 double, cy1 double, ord long, widths_estimated boolean",
    "carried": _AT + "name string, length long, content binary",
    "annotations": _AT + "page int, seq long, subtype string, contents string, author string, has_appearance boolean",
}


class Refused(Exception):
    """A file that cannot be read; the reason becomes its row."""


class Sink:
    """Rows of one file, by record table.  Counters number rows in order of the document."""

    def __init__(self, inside: str = ""):
        self.inside = inside
        self.rows: dict[str, list[dict]] = defaultdict(list)
        self.kind = ""
        self.text_unread = False
        #: Packages carried inside, to be read one level down: (name, bytes).
        self.carried: list[tuple[str, bytes]] = []

    def add(self, record: str, **fields) -> None:
        self.rows[record].append(fields)

    def count(self, record: str) -> int:
        return len(self.rows[record])

    def unit(self, text: str, page: int | None = None) -> None:
        if text.strip():
            self.add("units", unit_no=self.count("units"), page=page, text=text)

    def remark(self, text: str) -> None:
        self.add("remarks", seq=self.count("remarks"), text=text)

    def change(self, kind: str, text: str, author: str | None, date: str | None, part: str) -> None:
        self.add("revisions", seq=self.count("revisions"), kind=kind, text=text, author=author or None, date=date or None, part=part)

    def cell_change(self, sheet: str, row: int, col: int, previous: str, author: str | None, date: str | None, part: str) -> None:
        self.add("cell_changes", seq=self.count("cell_changes"), sheet=sheet, row=row, col=col, previous=previous, author=author, date=date)
        self.change("cell-change", "", author, date, part)

    def comment(self, text: str, author: str | None, date: str | None = None, initials: str | None = None) -> None:
        self.add("comments", seq=self.count("comments"), text=text, author=author or None, date=date or None, initials=initials or None)

    def field(self, name: str, value: str | None, part: str, role: str, container: str) -> None:
        if value and value.strip():
            self.add("meta_fields", seq=self.count("meta_fields"), name=name, value=value.strip(), part=part, role=role, container=container)
