"""Detectors 1 to 7 and 21b: text on a page that the page does not show, and words on it that the file lacks.

Input: pages(file_id, inside, page, bx0, by0, bx1, by1), shapes(.., page, shape_no, kind, x0, y0, x1, y1,
r, g, b, alpha, ord) with the visible box, glyphs(.., page, run_no, glyph_no, ch, x0, y0, x1, y1, ox, oy,
dx, dy, size, mode, alpha, fr, fg, fb, sr, sg, sb, cx0, cy0, cx1, cy1, ord, widths_estimated),
annotations(.., page, seq, subtype, contents, author, has_appearance), and
ocr_words(.., page, word_no, text, x0, y0, x1, y1, conf).

lay() deals glyphs and shapes out by page, once, in the order of lines (glyphs that were
made of lines dealt out by page stay where they are); every detector reads that one table,
and its windows by line and page need no exchange and no sort of their own.  Boxes of a page meet in page_join.  Lines come from each glyph's angle and
distance across it; all grouping is by line and islands, never by drawing operation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import Bucketed, buckets_for
from . import page_join as J
from . import page_text as P
from . import strips as S
from .findings import CIRCUMSTANTIAL, DIRECT, findings

PAGE = ("file_id", "inside", "page")
LINE = (*PAGE, "angle", "across")
#: Thresholds of the detectors' definitions.
COVERAGE, CONTRAST, EXACT = 0.55, 0.08, 0.005
CLEAR, FAINT, OPAQUE = 0.01, 0.15, 0.999
WORD_GAP, JOIN_GAP = 0.20, 0.15
CONFIDENT, UNREAD_RUN, UNSEEN_WORDS = 60, 3, 2
PAINTING = (0, 1, 2, 4, 5, 6)
ORDER = (*LINE, "along", "run_no", "glyph_no")
NOTES = ("Text", "Highlight", "Underline", "StrikeOut", "Squiggly", "Square", "Circle", "Line", "Polygon", "PolyLine", "Ink", "Stamp", "Caret", "FileAttachment", "Sound", "Movie", "Redact")


def _painted() -> Column:
    return F.col("mode").isin(*PAINTING) & (F.col("alpha") > CLEAR)


def _dealt(rows: DataFrame) -> tuple[tuple[str, ...], int] | None:
    """The columns and the number of parts by which Spark plans rows dealt out, if each page's lie in one part: by the file, say,
    before they were made of its lines."""
    told = re.fullmatch(r"hashpartitioning\((.*), (\d+)\)", rows._jdf.queryExecution().sparkPlan().outputPartitioning().toString())
    by = tuple(re.findall(r"(\w+)#\d+", told[1])) if told else ()
    return (by, int(told[2])) if by and set(by) <= set(PAGE) else None


def _beside(rows: DataFrame, others: DataFrame) -> DataFrame:
    """others as the other side of rows, dealt out as those are: if they lie by page, they stay where they are."""
    at = _dealt(rows)
    if at and _dealt(others) != at:
        others = others.repartition(at[1], *at[0])
    # Columns of their own: a table's name before them hides from a union that both sides are dealt out alike.
    own = lambda df: df.withMetadata("file_id", {"laid": True}).withMetadata("inside", {"laid": True}).withMetadata("page", {"laid": True}) if at else df
    return own(rows).unionByName(own(others.withColumn("side", F.lit(True))), allowMissingColumns=True)


def _laid(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows dealt out by page, if they do not lie so, and sorted along lines; rows that are on no line come first.  With a number of
    parts, as adaptive plans split those of an exchange without one."""
    return (rows if not parts and _dealt(rows) else rows.repartition(parts or buckets_for(rows), *PAGE)).sortWithinPartitions(*ORDER)


def lay(glyphs: DataFrame, shapes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Glyphs with angle, across (the line) and along (the place on it), and rows of opaque shapes (side, shape_no, s_ columns), dealt out
    by page and sorted along lines; shapes come first.  Halves round to even.  Rows that lie by page already stay where they are."""
    angle = F.rint(F.degrees(F.atan2("dy", "dx"))).cast("int")
    across = F.rint(-F.col("ox") * F.col("dy") + F.col("oy") * F.col("dx")).cast("long")
    placed = glyphs.select("*", angle.alias("angle"), across.alias("across"), (F.col("ox") * F.col("dx") + F.col("oy") * F.col("dy")).alias("along"), F.lit(False).alias("side"))
    if shapes is not None:
        placed = _beside(placed, _shapes(shapes))
    return _laid(placed, parts)


def stored_layout(glyphs: DataFrame, shapes: DataFrame, path: str, buckets: int) -> Bucketed:
    """lay(), stored in buckets of pages: the one exchange of glyphs for all detectors that read it."""
    return Bucketed(lay(glyphs, shapes, buckets), buckets, PAGE, ORDER, path)


def _glyphs(laid: DataFrame) -> DataFrame:
    return laid.where(~F.col("side"))


def numbered(laid: DataFrame) -> DataFrame:
    """laid's rows with n, their place along the line."""
    return laid.withColumn("n", F.row_number().over(Window.partitionBy(*LINE).orderBy("along", "run_no", "glyph_no")))


def lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs with angle, across (the line) and n, their place along it."""
    return numbered(_glyphs(lay(glyphs)))


SHAPE = ("s_kind", "s_alpha", "s_ord", "s_x0", "s_y0", "s_x1", "s_y1", "s_r", "s_g", "s_b")


def line_texts(glyphs: DataFrame) -> DataFrame:
    """PAGE, angle, across and text of each line."""
    laid = _glyphs(lay(glyphs))
    return J.lines(laid if S.in_strips(laid) else numbered(laid))


def _shapes(shapes: DataFrame) -> DataFrame:
    return shapes.select(*PAGE, "shape_no", *(F.col(c.removeprefix("s_")).alias(c) for c in SHAPE)).where(F.col("s_alpha") >= OPAQUE)


def _blank_char() -> Column:
    return T.blank(F.col("ch"))


def _text(order: str = "n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "ch"))), lambda c: c["ch"]), "")


def _points(text: str) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: T.label(F.ascii(c)))


def spans(laid: DataFrame, pages: DataFrame | None, wanted: tuple[str, ...]) -> DataFrame:
    """What the wanted detectors find of laid, in one pass of it: PAGE and page_text.SPAN.  pages: for those that need a page's box."""
    rows = _for_pass(laid, wanted)
    if {P.COVERED, P.UNDER_IMAGE, P.OFF_PAGE} & set(wanted):
        # By page alone, and merged, the laid rows stay where and as they are.
        rows = rows.join(pages.select(*PAGE, "bx0", "by0", "bx1", "by1").hint("merge"), list(PAGE), "left" if {P.INVISIBLE, P.LOW_CONTRAST} & set(wanted) else "inner")
    return P.found(rows, wanted, COVERAGE, CONTRAST, JOIN_GAP)


def _for_pass(laid: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The rows, of glyphs or of strips, and the columns that the wanted detectors look at."""
    kinds = [k for k, of in (("fill", (P.COVERED, P.LOW_CONTRAST)), ("image", (P.UNDER_IMAGE, P.LOW_CONTRAST))) if set(of) & set(wanted)]
    glyph = ~F.col("side")
    why = F.when(~F.col("mode").isin(*PAINTING), F.col("mode")).when(F.col("alpha") <= CLEAR, P.CLEAR).when(F.col("alpha") <= FAINT, P.FAINT).otherwise(P.SEEN)
    needed = F.lit(False)
    for name in wanted:
        needed = needed | (F.lit(True) if name == P.OFF_PAGE else why != P.SEEN if name == P.INVISIBLE else F.coalesce(_painted(), F.lit(False)))
    rows = laid.where(F.when(F.col("side"), F.col("s_kind").isin(*kinds)).otherwise(needed) if kinds else glyph & needed)
    strips = S.in_strips(rows)
    rows = rows if strips else numbered(rows)
    # A shape's box, order, number, colour and kind stand in the columns of a glyph's own.
    either = lambda own, shape: F.when(F.col("side"), shape).otherwise(own) if kinds else own
    take = {"side": F.col("side")} | (S.places(rows) if strips else {"n": F.col("n")}) | {"ch": either(F.col("ch"), F.col("s_kind")), "run_no": either(F.col("run_no"), F.col("shape_no"))}
    take |= {c: either(F.col(c), F.col(f"s_{c}")) for c in ("x0", "y0", "x1", "y1")}
    if kinds:
        stroked = F.col("mode").isin(1, 5)
        take |= {"ord": either(F.col("ord"), F.col("s_ord")), "painted": F.coalesce(_painted(), F.lit(False)), "widths_estimated": F.coalesce("widths_estimated", F.lit(False))}
        take |= {f"i_{c}": either(F.when(stroked, F.col(f"s{c}")).otherwise(F.col(f"f{c}")), F.col(f"s_{c}")) for c in "rgb"}
    if P.INVISIBLE in wanted:
        take |= {"why": why.cast("int"), "size": F.col("size"), "alpha": F.col("alpha")}
    if P.OFF_PAGE in wanted:
        take |= {c: F.col(c) for c in ("cx0", "cy0", "cx1", "cy1")}
    return rows.select(*PAGE, *(c.alias(name) for name, c in take.items()))


def _told_under(image: Column) -> tuple[Column, Column]:
    """Summary of a span under a shape, and how it looks."""
    text, rest = F.col("text"), F.col("rest")
    light = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    block = F.when(image | light.isNull(), "▒").when(light < 0.25, "█").when(light > 0.85, " ").otherwise("▓")
    what = F.when(image, "an image").when(light.isNull(), "a shape of unstated colour").when(light < 0.25, "a black shape").when(light > 0.85, "a white shape").otherwise(F.concat(F.lit("a shape of luminance "), F.format_number(light, 2)))
    tail = F.when(T.blank(rest), "").otherwise(F.concat(F.lit('; the line goes on "'), T.squash(rest), F.lit('"')))
    guess = F.when(F.col("estimated"), "; the font states no widths, so the span's ends are estimates").otherwise("")
    scan = F.when(image, "; a scan over its text layer looks the same").otherwise("")
    return F.concat(T.characters(text), F.lit(" under "), what, scan, tail, guess), F.repeat(block, F.length(text))


def _told_invisible() -> tuple[Column, Column]:
    faint = F.col("why") == P.FAINT
    at = F.concat(F.lit(" painted at opacity "), F.col("alpha").cast("string"))
    said = F.when(faint, F.concat(at, F.lit(", which a reader may miss, and watermarks use"))).when(F.col("why") == P.CLEAR, F.concat(at, F.lit(", which leaves nothing on the page")))
    said = said.otherwise(F.concat(F.lit(" drawn in render mode "), F.col("why").cast("string"), F.lit(", which paints nothing")))
    return F.concat(T.characters(F.col("text")), said), F.when(faint, CIRCUMSTANTIAL).otherwise(DIRECT)


def _told_contrast() -> tuple[Column, Column]:
    exact = F.col("worst") <= EXACT
    ink, back = _hex(*(F.col(f"ink_{c}") for c in "rgb")), _hex(*(F.col(c) for c in "rgb"))
    by = F.when(exact, ", one colour").otherwise(F.concat(F.lit(", "), F.format_number("worst", 3), F.lit(" apart on the strongest channel")))
    where = F.when(F.col("paper"), "; the background is the paper").otherwise("; the background is a shape painted before")
    return F.concat(T.characters(F.col("text")), F.lit(" painted "), ink, F.lit(" on "), back, by, where), F.when(exact, DIRECT).otherwise(CIRCUMSTANTIAL)


def _told_off() -> tuple[Column, Column]:
    over = F.when(F.col("remains"), "; the rest of the line is on the page, so it may be an overflow").otherwise("")
    return F.concat(T.characters(F.col("text")), F.lit(" wholly outside the visible area"), over), F.when(F.col("remains"), CIRCUMSTANTIAL).otherwise(DIRECT)


#: Places of the detectors of a page in the order of emission.
_EMITTED = {P.COVERED: 0, P.UNDER_IMAGE: 1, P.INVISIBLE: 3, P.LOW_CONTRAST: 4, P.OFF_PAGE: 5}


def on_pages(laid: DataFrame, pages: DataFrame | None, *wanted: str) -> DataFrame:
    """Findings of the wanted detectors of text on pages, each glyph read once for all of them."""
    (under, looks), (unseen, how), (close, sure), (off, far) = _told_under(F.col("kind") == "image"), _told_invisible(), _told_contrast(), _told_off()
    told = {P.COVERED: (under, DIRECT), P.UNDER_IMAGE: (under, DIRECT), P.INVISIBLE: (unseen, how), P.LOW_CONTRAST: (close, sure), P.OFF_PAGE: (off, far)}
    is_ = lambda name: F.col("detector") == name
    pick = lambda of: F.coalesce(*(F.when(is_(w), of(w)) for w in wanted))
    summary, basis = pick(lambda w: told[w][0]), pick(lambda w: told[w][1])
    seen = F.when(is_(P.COVERED) | is_(P.UNDER_IMAGE), looks).otherwise("")
    seq = (pick(lambda w: F.lit(_EMITTED[w])).cast("long") * (1 << 40)) + F.col("rank")
    return findings(spans(laid, pages, wanted), "page", F.col("detector"), basis, summary, F.col("text"), seen, seq=seq, page=F.col("page"), codepoints=_points("text"))


def covered(laid: DataFrame, pages: DataFrame) -> DataFrame:
    return on_pages(laid, pages, P.COVERED)


def under_image(laid: DataFrame, pages: DataFrame) -> DataFrame:
    return on_pages(laid, pages, P.UNDER_IMAGE)


def covered_text(glyphs: DataFrame, shapes: DataFrame, pages: DataFrame) -> DataFrame:
    return covered(lay(glyphs, shapes), pages)


def text_under_image(glyphs: DataFrame, shapes: DataFrame, pages: DataFrame) -> DataFrame:
    return under_image(lay(glyphs, shapes), pages)


def _down_the_page() -> list[Column]:
    return [F.desc("angle"), F.desc("across")]


def annotation_comments(annotations: DataFrame) -> DataFrame:
    df = annotations.where(F.col("subtype").isin(*NOTES) & ~T.blank(F.col("contents")))
    who = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(" by "), "author")).otherwise("")
    summary = F.concat(F.lit("a /"), "subtype", F.lit(" annotation"), who, F.lit(", attached to the page and no part of it"))
    return findings(df, "page", "comment", DIRECT, summary, F.col("contents"), seq=(2 << 40) + F.col("seq"), page=F.col("page"))


def invisible_text(glyphs: DataFrame) -> DataFrame:
    return invisible(lay(glyphs))


def invisible(laid: DataFrame) -> DataFrame:
    """By line and reason; a gap in the line becomes a space."""
    if S.in_strips(laid):
        return on_pages(laid, None, P.INVISIBLE)
    why = F.when(~F.col("mode").isin(*PAINTING), F.concat(F.lit("mode-"), F.col("mode").cast("string"))).when(F.col("alpha") <= CLEAR, "clear").when(F.col("alpha") <= FAINT, "faint")
    some = numbered(_glyphs(laid).withColumn("why", why).where("why is not null"))
    key = [*LINE, "why"]
    along = Window.partitionBy(*key).orderBy("n")
    gap = (F.col("x0") - F.lag("x1").over(along) > F.col("size") * JOIN_GAP) & ~T.blank(F.lag("ch").over(along))
    spaced = some.withColumn("opening", F.coalesce(gap, F.lit(False))).withColumn("ch", F.when(F.col("opening"), F.concat(F.lit(" "), "ch")).otherwise(F.col("ch")))
    df = spaced.groupBy(*key).agg(_text().alias("text"), F.min_by("alpha", "n").alias("alpha"), F.min("n").alias("from")).where(~T.blank(F.col("text")))
    said = F.when(F.col("why") == "faint", F.concat(F.lit(" painted at opacity "), F.col("alpha").cast("string"), F.lit(", which a reader may miss, and watermarks use"))).when(F.col("why") == "clear", F.concat(F.lit(" painted at opacity "), F.col("alpha").cast("string"), F.lit(", which leaves nothing on the page")))
    said = said.otherwise(F.concat(F.lit(" drawn in render mode "), F.substring("why", 6, 9), F.lit(", which paints nothing")))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*_down_the_page(), "from")))
    basis = F.when(F.col("why") == "faint", CIRCUMSTANTIAL).otherwise(DIRECT)
    return findings(df, "page", "invisible-text", basis, F.concat(T.characters(F.col("text")), said), F.col("text"), seq=(3 << 40) + F.col("rank"), page=F.col("page"), codepoints=_points("text"))


def _on_backgrounds(laid: DataFrame) -> DataFrame:
    """Painted glyphs, numbered, and what may lie under them."""
    return numbered(laid.where(F.when(F.col("side"), F.col("s_kind").isin("fill", "image")).otherwise(_painted())))


def backgrounds(laid: DataFrame, *more: str) -> DataFrame:
    """Painted glyphs: their line, n, ch and more columns, with the topmost opaque shape painted before that covers them (null: paper)."""
    return J.join(_on_backgrounds(laid), [*LINE[3:], "n", "ch", *more], ["shape_no", "s_kind", "s_r", "s_g", "s_b"], J.topmost(COVERAGE), reads=("ord", "s_ord"))


def _hex(*rgb: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.rint(c * 255).cast("long")), 2, "0")) for c in rgb))


def low_contrast_text(glyphs: DataFrame, shapes: DataFrame) -> DataFrame:
    return low_contrast(lay(glyphs, shapes))


def low_contrast(laid: DataFrame) -> DataFrame:
    """Spans whose ink is close to what is under them; the colour of an image is not known."""
    return on_pages(laid, None, P.LOW_CONTRAST)


def off_page_text(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    return off_page(lay(glyphs), pages)


def off_page(laid: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans without any overlap with the page within the clip; runs of blanks alone do not count, unpainted ones do."""
    return on_pages(laid, pages, P.OFF_PAGE)


def words(glyphs: DataFrame, painted_only: bool = True) -> DataFrame:
    return words_of(lay(glyphs), painted_only)


def _in_words(laid: DataFrame, painted_only: bool) -> DataFrame:
    """Glyphs that are no blanks, with the number of their word on the line, and, beside them, the rows that are no glyphs."""
    set_ = laid.where(F.col("side") | _painted()) if painted_only else laid
    along = Window.partitionBy(*LINE).orderBy("along", "run_no", "glyph_no")
    extent = F.abs((F.col("x1") - F.col("x0")) * F.col("dx")) + F.abs((F.col("y1") - F.col("y0")) * F.col("dy"))
    ends = set_.withColumn("end", F.col("along") + extent)
    apart = _blank_char() | F.coalesce(F.col("along") - F.lag("end").over(along) > F.col("size") * WORD_GAP, F.lit(False))
    return ends.withColumn("word", F.sum(apart.cast("int")).over(along)).where(F.col("side") | ~_blank_char())


def words_of(laid: DataFrame, painted_only: bool = True) -> DataFrame:
    """Words of lines, across drawing operations: word_no in reading order, text and box."""
    if S.in_strips(laid):
        return J.strip_words(_glyphs(laid).where(_painted() if painted_only else F.lit(True)), WORD_GAP)
    return J.words(_in_words(_glyphs(laid), painted_only)).drop("side")


def _strips_and_readings(laid: DataFrame, readings: DataFrame, painted_only: bool) -> DataFrame:
    """The strips of a page, and beside them (side) its readings, a row a page (columns r_*)."""
    wanted = ("size", "ch", "run_no", "x0", "y0", "x1", "y1")
    strips = _glyphs(laid).where(_painted() if painted_only else F.lit(True)).select(*PAGE, "angle", "across", "along", "side", *wanted, *(c for c in (*S.PLACES, *S.STEPS) if c != "angle"))
    read = readings.select(*PAGE, *(F.col(c).alias(f"r_{c}") for c in ("word_no", "text", "x0", "y0", "x1", "y1", "conf")))
    both = _laid(_beside(strips, read))
    # Readings are one row, which stands for no glyph.
    own = {"run_no": F.coalesce("run_no", F.lit(0)), **S.places(both)}
    return both.select(*PAGE, "side", *(own.pop(c, F.col(c)).alias(c) for c in wanted), *(c.alias(name) for name, c in own.items()), *(c for c in read.columns if c.startswith("r_")))


def _words_and_readings(laid: DataFrame, readings: DataFrame, painted_only: bool) -> DataFrame:
    """The words of a page, and beside them (side) its readings, in one pass: neither leaves its task."""
    glyphs = _glyphs(laid).select(*ORDER, "side", "ch", "x0", "y0", "x1", "y1", "dx", "dy", "size", "mode", "alpha")
    read = readings.select(*PAGE, F.col("word_no").cast("long").alias("run_no"), F.col("text").alias("ch"), "x0", "y0", "x1", "y1")
    return J.words(_in_words(_laid(_beside(glyphs, read)), painted_only))


def unrendered_text(glyphs: DataFrame, ocr: DataFrame) -> DataFrame:
    return unrendered(lay(glyphs), ocr)


def unrendered(laid: DataFrame, ocr: DataFrame) -> DataFrame:
    """Runs of at least UNREAD_RUN words that no reading of the page near them holds; pages without any reading are silent."""
    if S.in_strips(laid):
        df = J.strips_unread(_strips_and_readings(laid, ocr, True), UNREAD_RUN, WORD_GAP)
        return _told_unrendered(df)
    read = ocr.withColumn("text", F.coalesce(T.alphanumeric(F.col("text")), F.lit("")))
    both = _words_and_readings(laid, read, True).withColumn("key", F.when(F.col("side"), F.col("text")).otherwise(T.alphanumeric(F.col("text"))))
    return _told_unrendered(J.unread(both.where(F.col("side") | (F.col("key") != "")), UNREAD_RUN))


def _told_unrendered(df: DataFrame) -> DataFrame:
    summary = F.concat(F.col("k").cast("string"), F.lit(" words in a row are in the file and were not read off a rendering of the page; a reader that fails looks the same"))
    return findings(df, "ocr", "unrendered-text", CIRCUMSTANTIAL, summary, F.col("words"), seq=F.col("page").cast("long") * (1 << 32) + F.col("from"), page=F.col("page"))


def unextractable_text(glyphs: DataFrame, ocr: DataFrame) -> DataFrame:
    return unextractable(lay(glyphs), ocr)


def unextractable(laid: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row a page with at least UNREAD_RUN confident readings that lie on no word of the file."""
    if S.in_strips(laid):
        df = J.strips_unfound(_strips_and_readings(laid, ocr, False), UNREAD_RUN, WORD_GAP, CONFIDENT)
    else:
        sure = ocr.where((F.col("conf") >= CONFIDENT) & (T.alphanumeric(F.col("text")) != ""))
        df = J.unfound(_words_and_readings(laid, sure, False), UNREAD_RUN)
    summary = F.concat(F.col("k").cast("string"), F.lit(" words were read off a rendering of the page with no text of the file under them; a scan without a text layer looks the same"))
    return findings(df, "ocr", "unextractable-text", CIRCUMSTANTIAL, summary, "", F.col("words"), seq=F.col("page").cast("long") * (1 << 32) + (1 << 31), page=F.col("page"))


def unseen_words(preview: DataFrame, picture: DataFrame) -> DataFrame:
    """Words (file_id, inside, word_no, text, conf) of a preview that the picture lacks, if there are UNSEEN_WORDS or more."""
    key = ["file_id", "inside", "key"]
    sure = lambda df: df.where(F.col("conf") >= CONFIDENT).withColumn("key", T.alphanumeric(F.col("text"))).where("key <> ''")
    lost = sure(preview).join(sure(picture).select(*key), key, "left_anti")
    df = lost.groupBy("file_id", "inside").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("words")).where(F.col("k") >= UNSEEN_WORDS)
    summary = F.concat(F.col("k").cast("string"), F.lit(" words can be read in the preview inside the file and not in the picture itself"))
    return findings(df, "thumbnail", "unrendered-text", CIRCUMSTANTIAL, summary, F.col("words"), seq=1)


def remarks(glyphs: DataFrame, shapes: DataFrame, annotations: DataFrame) -> DataFrame:
    return page_remarks(lay(glyphs, shapes), annotations)


def page_remarks(laid: DataFrame, annotations: DataFrame) -> DataFrame:
    """remarks(file_id, inside, seq, text): what could not be established of a page."""
    on = P.unclear(_for_pass(laid, (P.LOW_CONTRAST,)), COVERAGE)
    picture = on.select("file_id", "inside", (F.col("page") * 2 + 1).cast("long").alias("seq"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" has "), T.plural(F.col("n"), "character"), F.lit(" on a picture or a fill of unstated colour; whether they can be read was not established")).alias("text"))
    drawn = annotations.where("has_appearance and subtype <> 'Popup'").groupBy(*PAGE).agg(F.count("*").alias("n"))
    notes = drawn.select("file_id", "inside", (F.col("page") * 2).cast("long").alias("seq"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" annotation(s) with an appearance of their own, which was not interpreted")).alias("text"))
    return notes.unionByName(picture)

