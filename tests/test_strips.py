"""Strips: the same glyphs as row by row, the same findings, and passes that no row a glyph reaches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from underlay.functions import text as T
from underlay.operators import geometry as G
from underlay.operators import page_join as J
from underlay.operators import page_text as P
from underlay.operators import strips as S
from underlay.plans import carriers as C
from underlay.plans import registry
from underlay.sources.records import SCHEMAS

from .test_geometry import bar

SF = "/root/testdata/sf0.001"
DDL = ", step_run int, step_glyph int, step_x double, step_y double"


def strip(text, x=0.0, y=100.0, run=0, glyph=0, steps=(1, 0, 10.0, 0.0), size=10.0, direction=(1.0, 0.0), mode=0, alpha=1.0, fill=0.0, order=1, page=1):
    return ("f", "", page, run, glyph, text, x, y, x + 10, y + size, x, y, *direction, size, mode, alpha, fill, fill, fill, None, None, None, None, None, None, None, order, False, *steps)


def each(strips):
    """Rows of the glyphs that strips stand for."""
    out = []
    for r in strips:
        run, glyph, x, y = r[-4:]
        for k, c in enumerate(r[5]):
            at = [r[6] + k * x, r[7] + k * y, r[8] + k * x, r[9] + k * y, r[10] + k * x, r[11] + k * y]
            out.append((*r[:3], r[3] + k * run, r[4] + k * glyph, c, *at, *r[12:-4]))
    return out


@pytest.fixture
def both(spark):
    def make(rows):
        fields = SCHEMAS["glyphs"]
        plain = spark.createDataFrame(each(rows), fields)
        packed = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + DDL)
        return plain, packed

    return make


#: Lines that strips share, side by side, between each other's glyphs, up the page and down it, over two pages; characters of one to four bytes.
MIXED = [
    strip(" a bär, ", run=5), strip("fi　ﬁ🙂 ", x=80.0, run=13), strip("ace", y=200.0, run=30, steps=(1, 0, 20.0, 0.0)), strip("bdf", x=10.0, y=200.0, run=40, steps=(0, 1, 20.0, 0.0), fill=1.0),
    strip("up", x=50.0, y=300.0, run=50, direction=(0.0, 1.0), steps=(1, 0, 0.0, 10.0)), strip("slope", x=0.0, y=400.0, run=60, steps=(1, 0, 10.0, 3.0)), strip("hidden", y=500.0, run=70, mode=3),
    strip("faint ", y=500.0, x=60.0, run=80, alpha=0.1), strip("none", y=600.0, run=90, fill=1.0), strip("x y", x=585.0, y=700.0, run=100, steps=(0, 1, 10.0, 0.0)), strip("  ", x=700.0, y=100.0, run=110),
    strip("on a picture", y=97.0, run=200, order=20), strip("next page", page=2, y=100.0, run=1, order=20), strip("on", page=2, x=0.0, y=110.0, run=30, fill=1.0),
]
SHAPES = [bar(0, 75), bar(0, 95, kind="image", rgb=(None,) * 3, number=1, order=10), *(("f", "", 2, *r[3:]) for r in (bar(0, 95, number=2), bar(20, 60, rgb=(None,) * 3, number=3, order=10)))]


def _said(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name, plain", [("glyph_strips", "glyphs"), ("apart_strips", "apart_glyphs")])
def test_strips_hold_the_glyphs_of_the_table(spark, name, plain):
    """Every column of every glyph, as the SQL of the table has it."""
    packed, rows = C.load(spark, SF, name), C.load(spark, SF, plain)
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    types = dict(n.split() for n in names)

    def run(batches):
        for table in J._whole_pages(batches):
            for part in S.pages_of(table):
                glyphs = S.Strips(part)
                at = np.arange(len(glyphs.row))
                found = {c: pa.array(glyphs.of(c, at), from_pandas=True) for c in types if c not in (*S.PAGE, "ch")} | glyphs.keys(at) | {"ch": glyphs.texts(at)}
                yield from pa.table({c: found[c] for c in types}).cast(schema).combine_chunks().to_batches()

    schema = to_arrow_schema(rows.schema)
    made = G.lay(packed).withColumn("side", F.lit(False)).mapInArrow(run, ", ".join(names))
    assert rows.count() > 100_000 and made.exceptAll(rows).isEmpty() and rows.exceptAll(made).isEmpty()


def test_packed_readings_hold_the_readings_of_the_table(spark):
    packed, rows = C.load(spark, SF, "ocr_pages"), C.load(spark, SF, "ocr_words")
    each = packed.select("file_id", "inside", "page", F.inline(F.arrays_zip("word_no", "text", "x0", "y0", "x1", "y1", "conf")))
    assert each.exceptAll(rows).isEmpty() and rows.exceptAll(each).isEmpty()


def test_strips_are_found_as_their_glyphs_are(spark, both):
    (plain, packed), shapes = both(MIXED), spark.createDataFrame(SHAPES, SCHEMAS["shapes"])
    pages = spark.createDataFrame([("f", "", n, 0.0, 0.0, 600.0, 800.0) for n in (1, 2)], SCHEMAS["pages"])
    names = (P.COVERED, P.UNDER_IMAGE, P.INVISIBLE, P.LOW_CONTRAST, P.OFF_PAGE)
    found = _said(G.on_pages(G.lay(plain, shapes), pages, *names))
    assert {v for r in found for v in r} >= set(names) and found == _said(G.on_pages(G.lay(packed, shapes), pages, *names))
    for name in names:
        assert _said(G.on_pages(G.lay(plain, shapes), pages, name)) == _said(G.on_pages(G.lay(packed, shapes), pages, name))
    assert _said(G.line_texts(plain)) == _said(G.line_texts(packed))
    assert "abcdf" not in str(_said(G.line_texts(packed))) and "abcdef" in str(_said(G.line_texts(packed)))
    notes = spark.createDataFrame([], SCHEMAS["annotations"])
    assert len(_said(G.remarks(plain, shapes, notes))) == 2 and _said(G.remarks(plain, shapes, notes)) == _said(G.remarks(packed, shapes, notes))
    for painted in (True, False):
        columns = ("file_id", "page", "word_no", "text", "x0", "y0", "x1", "y1")
        assert _said(G.words(plain, painted).select(*columns)) == _said(G.words(packed, painted).select(*columns))


def test_readings_beside_strips_are_found_as_beside_glyphs(spark, both):
    rows = [strip(w, x=100.0 * k, y=y, run=100 * k + int(y)) for y in (100.0, 200.0) for k, w in enumerate(("One,", "twö", "—", "three", "four"))]
    plain, packed = both([*rows, strip("alone", page=2)])
    read = [("f", "", 1, n, t, x, y, x + 40, y + 10, conf) for n, (t, x, y, conf) in enumerate([("one", 0.0, 100.0, 90.0), ("TWÖ", 100.0, 100.0, 80.0), ("x", 300.0, 100.0, 90.0), ("far", 0.0, 700.0, 90.0), ("away", 50.0, 700.0, 60.0), ("?", 90.0, 700.0, 90.0), ("off", 150.0, 700.0, 61.0), ("low", 250.0, 700.0, 59.9), (None, 300.0, 700.0, 90.0)])]
    readings = spark.createDataFrame(read, "file_id string, inside string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    arrays = readings.orderBy("word_no").coalesce(1).groupBy("file_id", "inside", "page").agg(*(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")))), lambda s: s["v"]).cast(f"array<{readings.schema[c].dataType.simpleString()}>").alias(c) for c in ("word_no", "text", "x0", "y0", "x1", "y1", "conf")))
    unread, unfound = _said(G.unrendered_text(plain, readings)), _said(G.unextractable_text(plain, readings))
    assert "One, twö three four" in str(unread) and "far away off" in str(unfound)
    assert unread == _said(G.unrendered_text(packed, arrays)) and unfound == _said(G.unextractable_text(packed, arrays))


def test_letters_of_a_text_are_those_of_the_column(spark):
    """Of every character, and of texts whose case hangs on what stands beside it."""
    said = ["One,", "#", "", "a-b_c 9", "É;x", "Σας!", "ΟΔΟΣ", "­١", "\x7f~^", "İstanbul", "ﬁ Ⅷ ² 漢", *(chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF)]
    got, known = spark.createDataFrame([(t,) for t in said], "t string").select("t", T.alphanumeric(F.col("t")).alias("k")).collect(), T.known_letters(spark)
    letters = frozenset(known[0])
    assert not [(r.t, r.k) for r in got if r.k != T.letters(r.t, letters, known[1])][:9]


#: Queries whose passes work on strips.
PACKED = ["ocr_unextractable", "page_detectors", "ocr_unrendered", "pdf_words", "pdf_covered", "pdf_under_image", "pdf_low_contrast", "pdf_page_remarks", "pdf_lines", "pdf_off_page"]


@pytest.mark.parametrize("name", PACKED)
def test_no_row_a_glyph_reaches_the_pass(spark, name):
    """By the plan: strips come to the one pass, no window numbers their glyphs before it, and no row is made a letter."""
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan.split("MapInArrow")[1]
    assert plan.count("Generate inline(") == 1 and plan.count("sequence(") == 0
