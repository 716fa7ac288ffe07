"""Detectors on pages: one glyph an operation, thresholds, order of painting, silence."""

import pytest
from pyspark.sql import functions as F

from underlay.operators import geometry as G
from underlay.sources.records import SCHEMAS


def glyphs(text, x=0, y=100, step=10, size=10, order=1, start=0, page=1, direction=(1.0, 0.0), fill=(0.0, 0.0, 0.0), mode=0, alpha=1.0, clip=(None,) * 4):
    out = []
    for i, c in enumerate(text):
        dx, dy = direction
        ox, oy = x + dx * step * i, y + dy * step * i
        out.append(("f", "", page, start + i, 0, c, ox, oy, ox + step, oy + size, ox, oy, dx, dy, float(size), mode, alpha, *fill, None, None, None, *clip, order, False))
    return [tuple(float(v) if isinstance(v, int) and k in (*range(6, 15), *range(16, 27)) and not isinstance(v, bool) else v for k, v in enumerate(r)) for r in out]


def bar(x0, x1, y0=95, y1=115, order=9, kind="fill", rgb=(0.0, 0.0, 0.0), alpha=1.0, number=0):
    return ("f", "", 1, number, kind, float(x0), float(y0), float(x1), float(y1), *rgb, alpha, order)


@pytest.fixture
def table(spark):
    def make(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    return make


@pytest.fixture
def page(table):
    return table("pages", [("f", "", 1, 0.0, 0.0, 600.0, 800.0)])


def test_a_bar_over_single_glyph_operations_is_one_finding(table, page):
    got = G.covered_text(table("glyphs", glyphs("the secret word")), table("shapes", [bar(38, 102)]), page).collect()
    assert [(r.machine_reads, r.human_sees, r.basis) for r in got] == [("secret", "█" * 6, "direct")]


@pytest.mark.parametrize(("share", "fires"), [(1.0, True), (0.75, True), (0.551, True), (0.5, False), (0.25, False)])
def test_share_of_a_glyph(table, page, share, fires):
    got = G.covered_text(table("glyphs", glyphs("abc")), table("shapes", [bar(0, 30, 100, 100 + 10 * share)]), page)
    assert (got.count() == 1) == fires


def test_bars_that_hide_nothing(table, page):
    g = table("glyphs", glyphs("abc", order=5))
    for b in (bar(0, 30, order=4), bar(0, 30, alpha=0.5), bar(0, 600, 0, 800), bar(300, 330)):
        assert G.covered_text(g, table("shapes", [b]), page).count() == 0
    assert G.text_under_image(g, table("shapes", [bar(0, 30, kind="image", rgb=(None,) * 3)]), page).first().human_sees == "▒" * 3
    assert G.covered_text(table("glyphs", glyphs("   ")), table("shapes", [bar(0, 30)]), page).count() == 0


def test_two_bars_are_two_findings_and_rotated_text_is_one_line(table, page):
    two = G.covered_text(table("glyphs", glyphs("abcdef")), table("shapes", [bar(0, 30, number=0), bar(10, 60, number=1)]), page)
    assert sorted(r.machine_reads for r in two.collect()) == ["abc", "bcdef"]
    up = table("glyphs", glyphs("rotated", x=50, y=100, direction=(0.0, 1.0)))
    assert [r.machine_reads for r in G.covered_text(up, table("shapes", [bar(40, 70, 90, 200)]), page).collect()] == ["rotated"]


def test_invisible(table):
    g = table("glyphs", [*glyphs("hidden", mode=3), *glyphs("clear", y=200, alpha=0.0, start=50), *glyphs("faint", y=300, alpha=0.1, start=90), *glyphs("seen", y=400, start=120)])
    got = {r.machine_reads: r.basis for r in G.invisible_text(g).collect()}
    assert got == {"hidden": "direct", "clear": "direct", "faint": "circumstantial"}
    apart = table("glyphs", [*glyphs("ab", mode=3), *glyphs("cd", x=40, mode=3, start=9)])
    assert G.invisible_text(apart).first().machine_reads == "ab cd"


def test_contrast(table):
    white, near, grey = (1.0,) * 3, (0.97,) * 3, (0.88,) * 3
    g = table("glyphs", [*glyphs("white", fill=white), *glyphs("near", y=200, fill=near, start=20), *glyphs("grey", y=300, fill=grey, start=40), *glyphs("onbar", y=500, fill=(0.0,) * 3, order=9, start=60), *glyphs("pic", y=600, fill=white, order=9, start=80)])
    s = table("shapes", [bar(0, 100, 490, 520, order=3), bar(0, 100, 590, 620, order=3, kind="image", rgb=(None,) * 3, number=1)])
    assert {r.machine_reads: r.basis for r in G.low_contrast_text(g, s).collect()} == {"white": "direct", "near": "circumstantial", "onbar": "direct"}
    assert "3 characters" in G.remarks(g, s, table("annotations", [])).first().text


def test_off_page(table, page):
    g = table("glyphs", [*glyphs("out", x=700), *glyphs("half", x=575, y=200, start=20), *glyphs("clipped", y=300, start=40, clip=(0, 0, 30, 800))])
    assert {r.machine_reads: r.basis for r in G.off_page_text(g, page).collect()} == {"out": "direct", "f": "circumstantial", "pped": "circumstantial"}


def test_words_and_readings(table):
    g = table("glyphs", glyphs("one two three four", step=10))
    assert [r.text for r in G.words(g).orderBy("word_no").collect()] == ["one", "two", "three", "four"]
    ocr = lambda *rows: table_ocr(table, rows)
    assert G.unrendered_text(g, ocr()).count() == 0
    assert G.unrendered_text(g, ocr((0, "ONE,", 0, 30, 90.0), (1, "two", 40, 70, 90.0))).count() == 0  # two unread words
    assert G.unrendered_text(g, ocr((0, "one", 0, 30, 10.0))).first().machine_reads == "two three four"
    sure = [(i, f"w{i}", 300 + 40 * i, 330 + 40 * i, 60.0) for i in range(3)]
    assert G.unextractable_text(g, ocr(*sure)).first().human_sees == "w0 w1 w2"
    assert G.unextractable_text(g, ocr(*sure[:2], (2, "w2", 380, 410, 59.9))).count() == 0


def table_ocr(table, rows):
    from pyspark.sql import SparkSession

    ddl = "file_id string, inside string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double"
    return SparkSession.getActiveSession().createDataFrame([("f", "", 1, n, t, float(a), 100.0, float(b), 110.0, c) for n, t, a, b, c in rows], ddl)


def test_notes(table):
    rows = [("f", "", 1, i, kind, text, None, False) for i, (kind, text) in enumerate([("Text", "see me"), ("FreeText", "drawn"), ("Popup", "x"), ("Stamp", " ")])]
    assert [r.machine_reads for r in G.annotation_comments(table("annotations", rows)).collect()] == ["see me"]


def test_lines_round_half_to_even(table):
    g = table("glyphs", glyphs("ab", y=100)).withColumn("oy", F.when(F.col("run_no") == 0, 100.5).otherwise(99.5))
    assert {r.across for r in G.lines(g).collect()} == {100}


def test_letters_and_digits_of_any_script(spark):
    from underlay.functions import text as T

    said = ["One,", "#", "", "a-b_c 9", "É;x", "Σας!", "­١", "\x7f~^", None]
    df = spark.createDataFrame([(t,) for t in said], "t string").select(T.alphanumeric(F.col("t")).alias("k"), T._alphanumeric(F.col("t")).alias("w"))
    rows = df.collect()
    assert [r.k for r in rows] == [r.w for r in rows] and [r.k for r in rows[:5]] == ["one", "", "", "abc9", "éx"]


def test_glyphs_made_of_dealt_lines_are_not_exchanged(spark):
    """By the plan: lines are dealt out by file, and neither glyphs nor shapes nor readings made of them are dealt out again."""
    from underlay.plans import carriers as C

    g, s, o = (C.load(spark, "/root/testdata/sf0.001", t) for t in ("glyphs", "shapes", "ocr_words"))
    for df, sides in ((G.line_texts(g), 1), (G.backgrounds(G.lay(g, s)), 2), (G._words_and_readings(G.lay(g), o, True), 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(file_id") == sides


def test_page_detectors_read_each_glyph_once(spark, table):
    """By the plan: one pass over one layout for all five, and the findings of each alone."""
    from underlay.operators import page_text as P
    from underlay.plans import registry

    df = registry.queries()["page_detectors"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(file_id") == 3  # lines for glyphs, for shapes, for pages
    seen, white = (0.0, 0.0, 600.0, 800.0), (1.0,) * 3
    g = table("glyphs", [*glyphs(" a bar, fi "), *glyphs("ﬁrst", y=200, mode=3, start=20), *glyphs("none", y=300, fill=white, start=40), *glyphs("x y", x=585, y=400, start=60), *glyphs("  ", x=700, y=500, start=80)])
    s, p = table("shapes", [bar(0, 75), bar(0, 75, kind="image", rgb=(None,) * 3, number=1)]), table("pages", [("f", "", 1, *seen)])
    laid = G.lay(g, s)
    alone = [G.covered(laid, p), G.under_image(laid, p), G.invisible(laid), G.low_contrast(laid), G.off_page(laid, p)]
    each = sorted((r.detector, r.machine_reads, r.emit_seq) for df in alone for r in df.collect())
    assert sorted((r.detector, r.machine_reads, r.emit_seq) for r in G.on_pages(laid, p, P.COVERED, P.UNDER_IMAGE, P.INVISIBLE, P.LOW_CONTRAST, P.OFF_PAGE).collect()) == each
    assert [m for _, m, _ in each] == ["a bar,", "ﬁrst", "none", "y", "a bar,"]
