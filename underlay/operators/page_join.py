"""Joins of two sets of boxes on the same page, as one sorted pass.

The rows of both sides lie together, dealt out by page and sorted by it (`side` is true
for the right ones).  A task reads its rows in batches and works on all whole pages that
it holds, so pages are many to a batch, and no row is copied for each tile it is in.
Left boxes are taken in blocks that lie close together; a block meets the right boxes
that reach its own bounds.  What is held is a batch and one page: a page is part of one
file, which one task has parsed whole.  Lines, words and runs of pairs end with their page
too, so they are gathered in the same pass, and what leaves it is found text, not glyphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import strips as S
from .strips import PAGE, _one
from .strips import changes as _changes

BLOCK, CHUNK, SLICE = 512, 64, 2048
#: Fixed value: the share of a page's width and height from which on a shape is a background.
PAGE_SIZED = 0.9


@dataclass
class Boxes:
    """Boxes of several pages, by page: page numbers of their own, corners, and the rows' other columns."""

    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    table: pa.Table

    def __len__(self) -> int:
        return len(self.page)

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def area(self, at: np.ndarray | slice) -> np.ndarray:
        return np.maximum(self.x1[at] - self.x0[at], 0.0) * np.maximum(self.y1[at] - self.y0[at], 0.0)


Pick = Callable[[Boxes, Boxes], tuple[np.ndarray, np.ndarray]]
#: PAGE of the rows at some places.
Keys = Callable[[np.ndarray], dict]
#: What text.letters() goes by.
Known = tuple[frozenset[str], dict[int, str]]


def join(rows: DataFrame, left: list[str], right: list[str], pick: Pick, reads: tuple[str, ...] = ()) -> DataFrame:
    """PAGE, left columns and right columns of the pairs that pick finds; a right place of -1 is no partner (nulls).

    rows: laid out, with side and the columns named; reads names what else pick looks at.
    """
    names = list(dict.fromkeys([*PAGE, *left, *right]))
    wanted = list(dict.fromkeys([*PAGE, "side", *left, *_OWN, *right, *_THEIRS, *reads]))
    types = {f.name: f.dataType.simpleString() for f in rows.select(*wanted).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            a, b = _sides(table)
            if not len(a):
                continue
            i, j = pick(a, b)
            found = {c: a.table[c].take(pa.array(i)) for c in dict.fromkeys([*PAGE, *left])}
            places = pa.array(j, mask=j < 0)
            found |= {c: b.table[c].take(places) for c in right}
            yield from pa.table(found).combine_chunks().to_batches(max_chunksize=10_000)

    return rows.select(*wanted).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


_OWN, _THEIRS = ("x0", "y0", "x1", "y1"), ("s_x0", "s_y0", "s_x1", "s_y1")


def _sides(table: pa.Table, own: tuple[str, ...] = _OWN, theirs: tuple[str, ...] = _THEIRS) -> tuple[Boxes, Boxes]:
    page = np.concatenate([[0], np.cumsum(_changes(table))])
    side = table["side"].to_numpy()
    return tuple(_boxes(table.filter(pa.array(s)), page[s], names) for s, names in ((~side, own), (side, theirs)))


def _taken(column: pa.ChunkedArray, places: np.ndarray) -> pa.Array:
    return _one(column.take(pa.array(places)))


def _joined(texts: pa.Array, first: np.ndarray, between: str = "") -> pa.Array:
    """The texts of each stretch (by its first place) as one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(texts)), pa.int32()), pc.fill_null(texts.cast(pa.string()), "")), between)


def _lines(a: Boxes, *more: str) -> tuple[np.ndarray, np.ndarray]:
    """Of rows along lines: the number of each row's line (and of what more columns tell apart on it), and each line's first place."""
    starts = np.ones(len(a), bool)
    starts[1:] = False
    for c in (a.page, *(a.column(name) for name in ("angle", "across", *more))):
        starts[1:] |= c[1:] != c[:-1]
    return np.cumsum(starts) - 1, np.flatnonzero(starts)


def lines(rows: DataFrame) -> DataFrame:
    """PAGE, angle, across and text of the lines of rows that lie along them, or of strips."""
    strips = S.in_strips(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _rows(batches, strips):
            first = np.flatnonzero(np.diff(pages.line, prepend=-1))
            found = pages.keys(first) | {c: pa.array(pages.of(c, first).astype(np.int64)) for c in ("angle", "across")}
            found["text"] = _joined(pages.texts(np.arange(len(pages.line))), first)
            yield from pa.table(found | {"angle": found["angle"].cast(pa.int32())}).combine_chunks().to_batches(max_chunksize=10_000)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    wanted = ("side", "ch", "run_no", *S.PLACES, *S.STEPS) if strips else ("side", "angle", "across", "ch", "n")
    return rows.select(*PAGE, *wanted).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in PAGE) + ", angle int, across long, text string")


def _words(pages: S.Strips, gap: float) -> tuple[Boxes, np.ndarray]:
    """Words of strips' glyphs, across drawing operations, in reading order: boxes with text and word_no, and the place of each one's
    first glyph.  A word ends at a blank, and where the next glyph is a share of its size away."""
    g = np.flatnonzero(~pages.side)
    page, line, along, text = pages.page[g], pages.line[g], pages.along[g], pages.texts(g)
    x0, y0, x1, y1, dx, dy, size = (pages.of(c, g) for c in (*_OWN, "dx", "dy", "size"))
    end = along + (np.abs((x1 - x0) * dx) + np.abs((y1 - y0) * dy))
    apart = S.white(S.joined(text))
    inked = np.flatnonzero(~apart)
    apart[1:] |= (line[1:] != line[:-1]) | (along[1:] - end[:-1] > size[1:] * gap)
    word = np.cumsum(apart)[inked]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    at = inked[first]
    said = _joined(text if len(inked) == len(g) else text.take(pa.array(inked)), first)
    box = [f.reduceat(c[inked], first) if len(first) else c[:0] for f, c in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    across, angle = pages.across[g[at]], pages.of("angle", g[at])
    same = page[at][1:] == page[at][:-1]
    if (same & ((angle[1:] != angle[:-1]) | (across[1:] != across[:-1]))).any():
        # Lines run down the page.
        down = np.lexsort((np.arange(len(first)), -across, -angle, page[at]))
        at, said, box = at[down], said.take(pa.array(down)), [c[down] for c in box]
    number = np.arange(1, len(at) + 1) - np.searchsorted(page[at], page[at], "left")
    return Boxes(page[at], *box, pa.table({"text": said, "word_no": pa.array(number, pa.int64())})), g[at]


def strip_words(rows: DataFrame, gap: float) -> DataFrame:
    """PAGE, word_no, text and box of the words of strips."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _rows(batches, True):
            a, at = _words(pages, gap)
            found = pages.keys(at) | {c: a.table[c] for c in ("word_no", "text")} | {c: pa.array(getattr(a, c)) for c in _OWN}
            yield from pa.table(found).combine_chunks().to_batches(max_chunksize=10_000)

    return rows.select(*PAGE, "side", "ch", "run_no", *S.PLACES, *S.STEPS, *_OWN, "size").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in PAGE), "word_no long, text string", *(f"{c} double" for c in _OWN)]))


def _readings(pages: S.Strips) -> tuple[Boxes, np.ndarray]:
    """The readings of pages (columns r_*, an array a row), and the place of the row of each."""
    at = np.flatnonzero(pages.side)
    some = pages.table.take(pa.array(pages.row[at]))
    many = pc.fill_null(pc.list_value_length(_one(some["r_text"])), 0).to_numpy(zero_copy_only=False)
    flat = {c: pc.list_flatten(_one(some[f"r_{c}"])) for c in ("word_no", "text", "conf", *_OWN)}
    place = np.repeat(at, many)
    return Boxes(pages.page[place], *(flat[c].to_numpy(zero_copy_only=False) for c in _OWN), pa.table({c: flat[c] for c in ("word_no", "text", "conf")})), place


def _keys(text: pa.ChunkedArray, known: Known) -> pa.Array:
    """The letters and digits of texts, each text that repeats worked out once."""
    told = pc.dictionary_encode(_one(pc.fill_null(text, "")))
    return pa.array([T.letters(t, *known) for t in told.dictionary.to_pylist()], pa.string()).take(told.indices)


def _some(a: Boxes, keep: np.ndarray) -> Boxes:
    return a if keep.all() else Boxes(a.page[keep], a.x0[keep], a.y0[keep], a.x1[keep], a.y1[keep], a.table.filter(pa.array(keep)))


def strips_unread(rows: DataFrame, least: int, gap: float) -> DataFrame:
    """unread() of strips and of readings that lie beside them."""

    def told(pages: S.Strips, known: Known) -> Iterator[pa.RecordBatch]:
        (a, at), (b, _) = _words(pages, gap), _readings(pages)
        a, b = (Boxes(c.page, c.x0, c.y0, c.x1, c.y1, c.table.append_column("key", _keys(c.table["text"], known))) for c in (a, b))
        keep = pc.not_equal(a.table["key"], "").to_numpy()
        return _unread(_some(a, keep), b, least, lambda some: pages.keys(at[keep][some]))

    return _beside_strips(rows, told, ", k long, `from` int, words string")


def strips_unfound(rows: DataFrame, least: int, gap: float, confident: float) -> DataFrame:
    """unfound() of strips and of the confident readings that lie beside them."""

    def told(pages: S.Strips, known: Known) -> Iterator[pa.RecordBatch]:
        b, place = _readings(pages)
        keep = (b.table["conf"].to_numpy() >= confident) & pc.not_equal(_keys(b.table["text"], known), "").to_numpy(zero_copy_only=False)
        return _unfound(_words(pages, gap)[0], _some(b, keep), least, lambda some: pages.keys(place[keep][some]))

    return _beside_strips(rows, told, ", k long, words string")


def _beside_strips(rows: DataFrame, told: Callable[[S.Strips, Known], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    letters, low = T.known_letters(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(letters), low
        for pages in _rows(batches, True):
            yield from told(pages, known)

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in PAGE) + ddl)


def words(rows: DataFrame) -> DataFrame:
    """Rows of glyphs, along lines and with the number of their word, as words in reading order (word_no, text, box); rows of the
    other side stay beside their page's words (run_no, ch and box, as word_no, text and box)."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join([*(f"{c} {types[c]}" for c in (*PAGE, "side")), "word_no long, text string", *(f"{c} double" for c in _OWN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            a, b = _sides(table, theirs=_OWN)
            parts, pages = [], []
            if len(a):
                _, first = _lines(a, "word")
                # Lines run down the page.
                down = np.lexsort((np.arange(len(first)), -a.column("across")[first], -a.column("angle")[first], a.page[first]))
                page = a.page[first][down]
                number = np.arange(1, len(page) + 1) - np.searchsorted(page, page, "left")
                found = {c: a.table[c].take(pa.array(first[down])) for c in (*PAGE, "side")} | {"word_no": pa.array(number, pa.int64()), "text": _joined(_one(a.table["ch"]), first).take(pa.array(down))}
                parts.append(pa.table(found | {c: pa.array(f.reduceat(getattr(a, c), first)[down]) for c, f in (("x0", np.minimum), ("y0", np.minimum), ("x1", np.maximum), ("y1", np.maximum))}))
                pages.append(page)
            if len(b):
                parts.append(pa.table({c: b.table[c] for c in (*PAGE, "side")} | {"word_no": b.table["run_no"].cast(pa.int64()), "text": b.table["ch"]} | {c: b.table[c] for c in _OWN}))
                pages.append(b.page)
            if parts:
                both = pa.concat_tables(parts)
                if len(parts) > 1:
                    both = both.take(pa.array(np.argsort(np.concatenate(pages), kind="stable")))
                yield from both.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.select(*PAGE, "side", "angle", "across", "word", "run_no", "ch", *_OWN).mapInArrow(run, ddl)


def unread(rows: DataFrame, least: int) -> DataFrame:
    """Of words (key: their letters and digits, none empty) and readings of their page (key): PAGE, k, from and words of runs of
    at least so many that no reading which touches them holds.  Pages without readings are silent."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            a, b = _sides(table, theirs=_OWN)
            yield from _unread(a, b, least, lambda some, a=a: {c: a.table[c].take(pa.array(some)) for c in PAGE})

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in PAGE) + ", k long, `from` int, words string")


def _unread(a: Boxes, b: Boxes, least: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    if not len(a) or not len(b):
        return
    i, j = pairs(touching)(a, b)
    order = np.lexsort((b.column("word_no")[j], i))
    i, j = i[order], j[order]
    near = np.full(len(a), "", object)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    near[i[starts]] = _joined(_taken(b.table["key"], j), starts).to_pylist()
    lost = np.flatnonzero(np.fromiter((k not in t for k, t in zip(a.table["key"].to_pylist(), near)), bool, len(a)) & np.isin(a.page, b.page))
    if not len(lost):
        return
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(lost) != 1) | (np.diff(a.page[lost]) != 0)]))
    k = np.diff(np.append(opens, len(lost)))
    long = k >= least
    head = lost[opens][long]
    found = keys(head) | {"k": pa.array(k[long], pa.int64()), "from": pa.array(head - np.searchsorted(a.page, a.page[head], "left") + 1, pa.int32())}
    yield from pa.table(found | {"words": _joined(_taken(a.table["text"], lost), opens, " ").filter(pa.array(long))}).combine_chunks().to_batches(max_chunksize=10_000)


def unfound(rows: DataFrame, least: int) -> DataFrame:
    """Of words with the readings of their page: PAGE, k and words of pages with at least so many readings that touch no word."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            a, b = _sides(table, theirs=_OWN)
            yield from _unfound(a, b, least, lambda some, b=b: {c: b.table[c].take(pa.array(some)) for c in PAGE})

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in PAGE) + ", k long, words string")


def _unfound(a: Boxes, b: Boxes, least: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    if not len(b):
        return
    on = np.zeros(len(b), bool)
    if len(a):
        on[pairs(touching)(a, b)[1]] = True
    lost = np.flatnonzero(~on)
    lost = lost[np.lexsort((b.column("word_no")[lost], b.page[lost]))]
    if not len(lost):
        return
    opens = np.flatnonzero(np.diff(b.page[lost], prepend=-1))
    k = np.diff(np.append(opens, len(lost)))
    long = k >= least
    found = keys(lost[opens][long]) | {"k": pa.array(k[long], pa.int64())}
    yield from pa.table(found | {"words": _joined(_taken(b.table["text"], lost), opens, " ").filter(pa.array(long))}).combine_chunks().to_batches(max_chunksize=10_000)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, cut where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            table = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            starts = np.flatnonzero(_changes(table))
        else:
            starts = np.flatnonzero(_changes(pa.Table.from_batches([batch]))) + 1
        if len(starts):
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rows(batches: Iterator[pa.RecordBatch], strips: bool) -> Iterator[S.Rows]:
    """A task's rows by whole pages, those of strips glyph by glyph."""
    for table in _whole_pages(batches):
        if strips:
            yield from map(S.Strips, S.pages_of(table))
        else:
            yield S.Rows(table)


def _boxes(table: pa.Table, page: np.ndarray, names: tuple[str, ...]) -> Boxes:
    return Boxes(page, *(table[c].to_numpy() for c in names), table)


def _blocks(a: Boxes, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Places of left boxes that lie close together."""
    order = np.lexsort((a.x0, a.y0, a.page))
    for k in range(0, len(order), size):
        yield order[k : k + size]


def _reaching(a: Boxes, some: np.ndarray, b: Boxes) -> np.ndarray:
    """Places of the right boxes (sorted by page) on a block's pages that reach the block's bounds."""
    lo, hi = np.searchsorted(b.page, a.page[some].min(), "left"), np.searchsorted(b.page, a.page[some].max(), "right")
    x0, y0, x1, y1 = (c[lo:hi] for c in (b.x0, b.y0, b.x1, b.y1))
    near = (np.maximum(x0, x1) >= np.minimum(a.x0[some], a.x1[some]).min()) & (np.minimum(x0, x1) <= np.maximum(a.x0[some], a.x1[some]).max())
    near &= (np.maximum(y0, y1) >= np.minimum(a.y0[some], a.y1[some]).min()) & (np.minimum(y0, y1) <= np.maximum(a.y0[some], a.y1[some]).max())
    return lo + np.flatnonzero(near)


def _overlap(a: Boxes, i: np.ndarray, b: Boxes, j: np.ndarray) -> np.ndarray:
    """Shared area of boxes i with boxes j, as a matrix."""
    width = np.minimum(a.x1[i][:, None], b.x1[j]) - np.maximum(a.x0[i][:, None], b.x0[j])
    height = np.minimum(a.y1[i][:, None], b.y1[j]) - np.maximum(a.y0[i][:, None], b.y0[j])
    return np.maximum(width, 0.0) * np.maximum(height, 0.0)


def pairs(test: Callable[[Boxes, np.ndarray, Boxes, np.ndarray], np.ndarray]) -> Pick:
    """All pairs of a page that pass the test (a matrix), which only boxes that touch can."""

    def pick(a: Boxes, b: Boxes) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Where right boxes are as many as left ones, a block meets about as many as it has: the smaller, the fewer tests.
        for some in _blocks(a, CHUNK if 8 * len(b) > len(a) else BLOCK) if len(b) else ():
            near = _reaching(a, some, b)
            for k in range(0, len(near), SLICE):
                j = near[k : k + SLICE]
                x, y = np.nonzero((a.page[some][:, None] == b.page[j]) & test(a, some, b, j))
                left.append(some[x])
                right.append(j[y])
        return np.concatenate(left), np.concatenate(right)

    return pick


def touching(a: Boxes, i: np.ndarray, b: Boxes, j: np.ndarray) -> np.ndarray:
    return (np.minimum(a.x1[i][:, None], b.x1[j]) > np.maximum(a.x0[i][:, None], b.x0[j])) & (np.minimum(a.y1[i][:, None], b.y1[j]) > np.maximum(a.y0[i][:, None], b.y0[j]))


def covered_later(share: float, order: str = "ord", their_order: str = "s_ord"):
    """Left boxes of which a right one, not painted before, covers the share; one without area is where its corner is."""

    def test(a: Boxes, i: np.ndarray, b: Boxes, j: np.ndarray) -> np.ndarray:
        area = a.area(i)
        x, y = a.x0[i][:, None], a.y0[i][:, None]
        corner = (x >= b.x0[j]) & (x <= b.x1[j]) & (y >= b.y0[j]) & (y <= b.y1[j])
        covered = np.where((area <= 0)[:, None], corner, _overlap(a, i, b, j) >= (area * share)[:, None])
        return covered & (a.column(order)[i][:, None] <= b.column(their_order)[j])

    return test


def topmost(share: float, order: str = "ord", their_order: str = "s_ord", number: str = "shape_no") -> Pick:
    """Each left box once, with the topmost right box painted before it that covers the share of it, or none.

    A sweep down the right boxes of a block, the latest first: a left box joins when the sweep is below it, and leaves
    with the first box that covers it, so a stack of boxes costs as many steps as it takes to cover, not its height.
    """

    def pick(a: Boxes, b: Boxes) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(len(a), -1, np.int64)
        if not len(b):
            return np.arange(len(a)), out
        down = np.lexsort((b.column(number), -b.column(their_order), b.page))
        b = type(b)(b.page[down], b.x0[down], b.y0[down], b.x1[down], b.y1[down], b.table)
        painted, theirs, area = a.column(order), b.column(their_order)[down], a.area(slice(None))
        for some in _blocks(a):
            near = _reaching(a, some, b)
            if (area[some] <= 0).any():
                # Of no area any share is covered, wherever the other box is.
                near = np.arange(*np.searchsorted(b.page, [a.page[some].min(), a.page[some].max() + 1]))
            left = some
            for k in range(0, len(near), CHUNK):
                j = near[k : k + CHUNK]
                left = left[a.page[left] >= b.page[j[0]]]
                if not len(left):
                    break
                on = left[(a.page[left] <= b.page[j[-1]]) & (painted[left] > theirs[j].min())]
                if not len(on):
                    continue
                hit = (a.page[on][:, None] == b.page[j]) & (theirs[j] < painted[on][:, None]) & (_overlap(a, on, b, j) >= (area[on] * share)[:, None])
                done = hit.any(axis=1)
                out[on[done]] = down[j[hit.argmax(axis=1)[done]]]
                left = left[out[left] < 0]
        return np.arange(len(a)), out

    return pick
