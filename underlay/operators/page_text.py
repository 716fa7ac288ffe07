"""What the detectors of text on a page find of it, in one pass: whichever of them are wanted read the same rows.

Rows are glyphs along lines and, beside them (side), the opaque shapes of their page.  A task reads them once, works on whole
pages, and gives each detector's spans of text as one row a span; a glyph crosses to it once, not once for each detector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import page_join as J
from . import strips as S

COVERED, UNDER_IMAGE, INVISIBLE, LOW_CONTRAST, OFF_PAGE = "covered-text", "text-under-image", "invisible-text", "low-contrast-text", "off-page-text"
#: Codes of `why` beside render modes that paint nothing: painted, painted at no opacity, at little.
SEEN, CLEAR, FAINT = 1 << 30, (1 << 30) + 1, (1 << 30) + 2
#: Of each span, beside its page: rank (its place among the detector's on the page), text, and what the detectors say of it.
SPAN = {
    "detector": "string", "rank": "long", "text": "string", "rest": "string", "estimated": "boolean", "kind": "string", "r": "double", "g": "double", "b": "double",
    "ink_r": "double", "ink_g": "double", "ink_b": "double", "why": "int", "alpha": "double", "worst": "double", "paper": "boolean", "remains": "boolean",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class _Columns(J.Boxes):
    """Boxes whose other columns are arrays by name."""

    def column(self, name: str) -> np.ndarray:
        return self.table[name]


class _Glyphs:
    """Some of a table's glyphs: their lines, their places on them (nth, from 1), and their text as one."""

    def __init__(self, at: np.ndarray, line: np.ndarray, ch: pa.Array):
        self.at, self.line = at, line[at]
        starts = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.starts, number = starts, np.cumsum(np.diff(self.line, prepend=-1) != 0) - 1
        self.first, self.last = starts[number], np.append(starts[1:], len(at))[number] - 1
        self.nth, self.number = np.arange(1, len(at) + 1) - self.first, number
        self.ch = ch if len(at) == len(ch) else ch.take(pa.array(at))
        size = pc.utf8_length(self.ch).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.text = J._joined(self.ch, np.zeros(1, np.int64))[0].as_py() if len(at) else ""
        inked = np.append(0, np.cumsum(~S.white(self.text)))
        self.blank = inked[self.end] == inked[self.start]

    def __len__(self) -> int:
        return len(self.at)

    def said(self, lo: np.ndarray, hi: np.ndarray) -> list[str]:
        """The texts from glyphs lo to glyphs hi."""
        return [self.text[a:b] for a, b in zip(self.start[lo].tolist(), self.end[hi].tolist())]

    def any(self, flag: np.ndarray) -> np.ndarray:
        """Whether the flag is set anywhere on each glyph's line."""
        return np.logical_or.reduceat(flag, self.starts)[self.number]

    def runs(self, i: np.ndarray, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in i, sorted, of the first and the last of each run of neighbours on a line (with the same j)."""
        opens = np.ones(len(i), bool)
        opens[1:] = (i[1:] != i[:-1] + 1) | (self.line[i[1:]] != self.line[i[:-1]])
        if j is not None:
            opens[1:] |= j[1:] != j[:-1]
        heads = np.flatnonzero(opens)
        return heads, np.append(heads[1:], len(i))[: len(heads)] - 1


def _within(f: np.ufunc, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return f.reduceat(np.append(values, values[-1:]), np.stack([lo, hi + 1], 1).ravel())[::2]


def _ranked(page: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by page and what follows, and each row's place on its page in that order."""
    order = np.lexsort((*reversed(by), page))
    p = page[order]
    return order, np.arange(1, len(p) + 1) - np.searchsorted(p, p, "left")


def found(rows: DataFrame, wanted: tuple[str, ...], coverage: float, contrast: float, gap_share: float) -> DataFrame:
    """PAGE and SPAN of the spans of the wanted detectors; rows as geometry.spans makes them, with n, their place on their line."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [*((c, names[c]) for c in J.PAGE), *SPAN.items()]

    def spans(rows: S.Rows) -> Iterator[pa.Table]:
        page, side = rows.page, rows.side
        g, s = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(g):
            return
        of: Callable[[str], np.ndarray] = lambda name: rows.of(name, g)
        line, ch = rows.line[g], rows.texts(g)

        def out(detector: str, at: np.ndarray, rank: np.ndarray, text: list[str], **more) -> pa.Table:
            """at: of each span, a glyph on its page, among all."""
            own = {"detector": pa.array([detector] * len(at), pa.string()), "rank": pa.array(rank, pa.int64()), "text": pa.array(text, pa.string())}
            own |= {c: pa.array(v, _ARROW[SPAN[c]], from_pandas=True) for c, v in more.items()}
            return pa.table(rows.keys(g[at]) | {c: own[c] if c in own else pa.nulls(len(at), _ARROW[t]) for c, t in SPAN.items()})

        if {COVERED, UNDER_IMAGE, LOW_CONTRAST} & set(wanted):
            a = _Glyphs(np.flatnonzero(of("painted")), line, ch)
            at = g[a.at]
            boxes, shapes, image = _glyph_boxes(rows, at), lambda some: _shape_boxes(rows, some), _pictures(rows, s)
            for detector, pictures in ((COVERED, False), (UNDER_IMAGE, True)):
                if detector not in wanted or not len(a) or not len(s):
                    continue
                some = s[image == pictures]
                x0, y0, x1, y1, bx0, by0, bx1, by1 = (rows.of(c, some) for c in (*J._OWN, "bx0", "by0", "bx1", "by1"))
                wide, high = bx1 - bx0, by1 - by0
                whole = (x1 - x0 >= wide * J.PAGE_SIZED) & (y1 - y0 >= high * J.PAGE_SIZED)
                some = some[~np.isnan(wide) & ~np.isnan(high) & ~whole]
                i, j = J.pairs(J.covered_later(coverage))(boxes, shapes(some))
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                heads, tails = a.runs(i, j)
                # Blank glyphs at the ends of a span are padding of the bar.
                places, n = np.arange(len(a)), len(a)
                after = np.minimum.accumulate(np.where(a.blank, n, places)[::-1])[::-1]
                before = np.maximum.accumulate(np.where(a.blank, -1, places))
                lo, hi, over = after[i[heads]], before[i[tails]], some[j[heads]]
                keep = lo <= hi
                lo, hi, over = lo[keep], hi[keep], over[keep]
                if not len(lo):
                    continue
                top, left = _within(np.maximum, boxes.y1, lo, hi), _within(np.minimum, boxes.x0, lo, hi)
                order, rank = _ranked(boxes.page[lo], -top, left, rows.of("run_no", over), -a.line[lo], lo)
                lo, hi, over = lo[order], hi[order], over[order]
                ends = zip(a.start[a.first[lo]].tolist(), a.start[lo].tolist(), a.end[hi].tolist(), a.end[a.last[lo]].tolist())
                colours = {c: rows.of(f"i_{c}", over) for c in "rgb"}
                rest = [a.text[w:x] + a.text[y:z] for w, x, y, z in ends]
                yield out(detector, a.at[lo], rank, a.said(lo, hi), rest=rest, estimated=a.any(rows.of("widths_estimated", at))[lo], kind=["image" if pictures else "fill"] * len(lo), **colours)
            if LOW_CONTRAST in wanted and len(a):
                _, j = J.topmost(coverage)(boxes, shapes(s))
                gaps = []
                for c in "rgb":
                    under = np.ones(len(a))
                    if len(s):
                        known = np.where(image, np.nan, rows.of(f"i_{c}", s))
                        under = np.where(j < 0, 1.0, known[j])
                    gaps.append(np.abs(rows.of(f"i_{c}", at) - under))
                gap = np.maximum.reduce(gaps)
                i = np.flatnonzero(gap <= contrast)
                if len(i):
                    heads, tails = a.runs(i)
                    lo, hi = i[heads], i[tails]
                    text = a.said(lo, hi)
                    keep = np.array([bool(t.strip()) for t in text])
                    worst = _within(np.maximum, gap, lo, hi)
                    order, rank = _ranked(boxes.page[lo][keep], -a.line[lo][keep], lo[keep])
                    places = np.flatnonzero(keep)[order]
                    lo, paper = lo[places], j[lo[places]] < 0
                    more = {f"ink_{c}": rows.of(f"i_{c}", at[lo]) for c in "rgb"}
                    more |= {c: np.where(paper, 1.0, rows.of(f"i_{c}", s)[j[lo]] if len(s) else 1.0) for c in "rgb"}
                    yield out(LOW_CONTRAST, a.at[lo], rank, [text[k] for k in places.tolist()], worst=worst[places], paper=paper, **more)
        if INVISIBLE in wanted:
            why = of("why")
            a = _Glyphs(np.flatnonzero(why != SEEN), line, ch)
            if len(a):
                why = why[a.at]
                # By line and reason.
                order = np.lexsort((why, a.line))
                why, x0, x1, size = why[order], of("x0")[a.at][order], of("x1")[a.at][order], of("size")[a.at][order]
                opens = np.ones(len(order), bool)
                opens[1:] = (why[1:] != why[:-1]) | (np.diff(a.line[order]) != 0)
                apart = np.zeros(len(order), bool)
                apart[1:] = ~opens[1:] & (x0[1:] - x1[:-1] > size[1:] * gap_share) & ~a.blank[order][:-1]
                spaced = pc.binary_join_element_wise(pc.if_else(pa.array(apart), " ", ""), a.ch.take(pa.array(order)), "")
                heads = np.flatnonzero(opens)
                text = J._joined(spaced, heads).to_pylist()
                keep = np.array([bool(t.strip()) for t in text])
                first = order[heads]
                ranked, rank = _ranked(page[g[a.at[first]]][keep], -a.line[first][keep], first[keep])
                places = np.flatnonzero(keep)[ranked]
                yield out(INVISIBLE, a.at[first[places]], rank, [text[k] for k in places.tolist()], why=why[heads[places]], alpha=of("alpha")[a.at[first[places]]])
        if OFF_PAGE in wanted:
            every = _Glyphs(np.arange(len(g)), line, ch)
            runs, number = of("run_no"), page[g]
            order = np.lexsort((runs, number)) if ((np.diff(number) == 0) & (np.diff(runs) < 0)).any() else np.arange(len(g))
            opens = np.flatnonzero(np.append(True, (np.diff(runs[order]) != 0) | (np.diff(number[order]) != 0)))
            solid = np.empty(len(g), bool)
            # Runs of blanks alone do not count.
            solid[order] = np.repeat(np.logical_or.reduceat(~every.blank[order], opens), np.diff(np.append(opens, len(g))))
            a = _Glyphs(np.flatnonzero(solid & ~np.isnan(of("bx0"))), line, ch)
            if len(a):
                own = {c: of(c)[a.at] for c in ("x0", "y0", "x1", "y1", "bx0", "by0", "bx1", "by1", "cx0", "cy0", "cx1", "cy1")}
                free = np.isnan(own["cx0"])
                seen = {c: np.where(free, own[f"b{c}"], f(own[f"b{c}"], own[f"c{c}"])) for c, f in (("x0", np.fmax), ("y0", np.fmax), ("x1", np.fmin), ("y1", np.fmin))}
                off = (np.minimum(own["x1"], seen["x1"]) - np.maximum(own["x0"], seen["x0"]) <= 0) | (np.minimum(own["y1"], seen["y1"]) - np.maximum(own["y0"], seen["y0"]) <= 0)
                remains = a.any(~off & ~a.blank)
                i = np.flatnonzero(off)
                if len(i):
                    heads, tails = a.runs(i)
                    lo, hi = i[heads], i[tails]
                    text = a.said(lo, hi)
                    keep = np.array([bool(t.strip()) for t in text])
                    order, rank = _ranked(page[g[a.at[lo]]][keep], -a.line[lo][keep], lo[keep])
                    places = np.flatnonzero(keep)[order]
                    yield out(OFF_PAGE, a.at[lo[places]], rank, [text[k] for k in places.tolist()], remains=remains[lo[places]])

    strips = S.in_strips(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in J._rows(batches, strips):
            for part in spans(pages):
                yield from part.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in fields))


def _glyph_boxes(rows: S.Rows, at: np.ndarray) -> _Columns:
    return _Columns(rows.page[at], *(rows.of(c, at) for c in J._OWN), {"ord": rows.of("ord", at)})


def _shape_boxes(rows: S.Rows, at: np.ndarray) -> _Columns:
    return _Columns(rows.page[at], *(rows.of(c, at) for c in J._OWN), {"s_ord": rows.of("ord", at), "shape_no": rows.of("run_no", at)})


def _pictures(rows: S.Rows, at: np.ndarray) -> np.ndarray:
    return pc.equal(rows.texts(at), "image").to_numpy(zero_copy_only=False) if len(at) else np.zeros(0, bool)


def unclear(rows: DataFrame, coverage: float) -> DataFrame:
    """PAGE and n: the glyphs of a page, blanks apart, that lie on a picture or on a shape of unstated colour; rows as for LOW_CONTRAST."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    strips = S.in_strips(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in J._rows(batches, strips):
            g, s = np.flatnonzero(~pages.side & pages.all_of("painted")), np.flatnonzero(pages.side)
            if not len(g) or not len(s):
                continue
            unknown = _pictures(pages, s) | np.isnan(pages.of("i_r", s))
            _, j = J.topmost(coverage)(_glyph_boxes(pages, g), _shape_boxes(pages, s))
            on = g[(j >= 0) & unknown[j]]
            on = on[~pages.blank(on)]
            first, n = np.unique(pages.page[on], return_index=True, return_counts=True)[1:]
            yield from pa.table(pages.keys(on[first]) | {"n": pa.array(n, pa.int64())}).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join(f"`{c}` {names[c]}" for c in J.PAGE) + ", n long")
