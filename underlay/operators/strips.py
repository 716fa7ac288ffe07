"""Rows of a page as passes read them: one row a glyph, or one row a strip of glyphs.

A strip is a row of glyphs that differ in their character and place alone: `ch` holds a character of each, the other columns are
those of the first, and step_run, step_glyph, step_x and step_y say how run_no, glyph_no and the places go on.  What holds for all
of a strip (mode, paint, order) is worked out by Spark once a strip; the glyphs themselves are arrays, made in the task that looks
at them, some pages at a time.  Readings of a page are one row too: each of their columns (r_*) is an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ("file_id", "inside", "page")
STEPS = {"step_run": "run_no", "step_glyph": "glyph_no", "step_x": ("x0", "x1", "ox"), "step_y": ("y0", "y1", "oy")}
#: What places the glyphs of a strip, beside their boxes.
PLACES = ("glyph_no", "ox", "oy", "dx", "dy", "angle")
#: Glyphs that are worked on at a time, beyond which only the pages already begun go.
GLYPHS = 1 << 18
_STEP_OF = {c: step for step, of in STEPS.items() for c in ((of,) if isinstance(of, str) else of)}
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def in_strips(rows: DataFrame) -> bool:
    return "step_run" in rows.columns


def places(rows: DataFrame) -> dict[str, Column]:
    """The columns that a pass needs to make glyphs of strips, set for rows that are no glyphs too."""
    return {c: F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)) for c in (*PLACES, *STEPS)}


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array's texts, none null, and where each begins and the last ends."""
    text = _one(text).cast(pa.large_string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def joined(text: pa.Array) -> str:
    return _bytes_of(text)[0].tobytes().decode()


def white(text: str) -> np.ndarray:
    """Whether each character is white space."""
    return _WHITE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(_WHITE) - 1)]


def changes(table: pa.Table) -> np.ndarray:
    """For each row after the first, whether its page is another."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in PAGE:
        out |= pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)).to_numpy() if len(out) else False
    return out


class Rows:
    """Rows of whole pages, one a glyph, along lines (n: places on them); shapes lie beside them."""

    def __init__(self, table: pa.Table):
        self.table, self._held = table, {}
        self.page = np.concatenate([[0], np.cumsum(changes(table))])
        self.side = table["side"].to_numpy()
        self.line = np.cumsum(table["n"].to_numpy() == 1)

    def all_of(self, name: str) -> np.ndarray:
        if name not in self._held:
            self._held[name] = self.table[name].to_numpy()
        return self._held[name]

    def of(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.all_of(name)[at]

    def texts(self, at: np.ndarray) -> pa.Array:
        ch = _one(self.table["ch"])
        return pc.fill_null(ch if len(at) == len(ch) else ch.take(pa.array(at)), "")

    def blank(self, at: np.ndarray) -> np.ndarray:
        """Whether glyphs are white space alone."""
        return np.array([not t.strip() for t in self.texts(at).to_pylist()], bool)

    def keys(self, at: np.ndarray) -> dict[str, pa.ChunkedArray]:
        return {c: self.table[c].take(pa.array(at)) for c in PAGE}


class Strips(Rows):
    """The glyphs of strips of whole pages as such rows."""

    def __init__(self, table: pa.Table):
        self.table, self._held = table, {}
        of_page = np.concatenate([[0], np.cumsum(changes(table))])
        beside = table["side"].to_numpy()
        data, begin = _bytes_of(pc.fill_null(_one(table["ch"]), ""))
        # A character begins at each byte that goes on none; what is beside glyphs has one text, however long, or none.
        starts = (data & 0xC0) != 0x80
        if beside.any():
            starts &= ~np.repeat(beside, np.diff(begin))
            starts[begin[:-1][beside & (np.diff(begin) > 0)]] = True
        upto = np.append(0, np.cumsum(starts))
        many = upto[begin[1:]] - upto[begin[:-1]]
        bare = beside & (many == 0)
        cut = np.flatnonzero(starts)
        if bare.any():
            at = np.concatenate([cut, begin[:-1][bare]])
            many = many + bare
            row = np.concatenate([np.repeat(np.arange(len(many)), many - bare), np.flatnonzero(bare)])
            order = np.argsort(row, kind="stable")
            cut, self.row = at[order], row[order]
        else:
            self.row = np.repeat(np.arange(len(many)), many)
        self.nth = np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)
        self.ch = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(cut, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        self.page, self.side = of_page[self.row], beside[self.row]
        every = slice(None)
        dx, dy, angle = (self.of(c, every) for c in ("dx", "dy", "angle"))
        ox, oy, run, glyph = (self.of(c, every) for c in ("ox", "oy", "run_no", "glyph_no"))
        across, along = np.rint(-ox * dy + oy * dx), ox * dx + oy * dy
        before, same = np.zeros(max(len(run) - 1, 0), bool), (self.page[1:] == self.page[:-1]) & ~self.side[1:] & ~self.side[:-1]
        changed = ~same
        for c in (angle, across):
            before |= same & ~changed & (c[1:] < c[:-1])
            changed |= c[1:] != c[:-1]
        opens, even = changed.copy(), ~changed
        for c in (along, run, glyph):
            before |= even & (c[1:] < c[:-1])
            even &= c[1:] == c[:-1]
        self.across, self.along = across, along
        if before.any():
            # Strips that lie between each other's glyphs.
            order = np.lexsort((glyph, run, along, across, angle, ~self.side, self.page))
            self.row, self.nth, self.ch = self.row[order], self.nth[order], self.ch.take(pa.array(order))
            self.page, self.side, self.across, self.along = self.page[order], self.side[order], across[order], along[order]
            angle = angle[order]
            opens = (self.page[1:] != self.page[:-1]) | self.side[:-1] | (angle[1:] != angle[:-1]) | (self.across[1:] != self.across[:-1])
        self.line = np.append(0, np.cumsum(opens)) if len(self.row) else np.zeros(0, np.int64)

    def _own(self, name: str) -> np.ndarray:
        if name not in self._held:
            self._held[name] = self.table[name].to_numpy()
        return self._held[name]

    def all_of(self, name: str) -> np.ndarray:
        return self.of(name, slice(None))

    def of(self, name: str, at: np.ndarray | slice) -> np.ndarray:
        if name in ("across", "along"):
            return getattr(self, name)[at]
        row = self.row[at]
        first = self._own(name)[row]
        step = self._own(_STEP_OF[name]) if name in _STEP_OF else None
        return first if step is None or not step.any() else first + self.nth[at] * step[row]

    def texts(self, at: np.ndarray) -> pa.Array:
        return (self.ch if len(at) == len(self.ch) else self.ch.take(pa.array(at))).cast(pa.string())

    def blank(self, at: np.ndarray) -> np.ndarray:
        return white(joined(self.texts(at)))

    def keys(self, at: np.ndarray) -> dict[str, pa.ChunkedArray]:
        row = pa.array(self.row[at])
        return {c: self.table[c].take(row) for c in PAGE}


def pages_of(table: pa.Table) -> Iterator[pa.Table]:
    """Whole pages of strips, some GLYPHS at a time."""
    begins = np.append(0, np.flatnonzero(changes(table)) + 1)
    size = np.add.reduceat(pc.fill_null(pc.binary_length(_one(table["ch"])), 0).to_numpy(zero_copy_only=False), begins) if table.num_rows else begins
    if "r_text" in table.column_names:
        size = size + np.add.reduceat(pc.fill_null(pc.list_value_length(_one(table["r_text"])), 0).to_numpy(zero_copy_only=False), begins)
    part = np.cumsum(size) // GLYPHS
    for some in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(part)) + 1):
        first, past = begins[some[0]], begins[some[-1] + 1] if some[-1] + 1 < len(begins) else table.num_rows
        yield table.slice(first, past - first).combine_chunks()
