"""The derived tables hold the whole of the driver's: every character of a text, every row of a table."""

import pytest

from underlay.operators import characters
from underlay.plans import carriers as C
from underlay.plans import registry

TEXTS = {1: "one line", 2: "first\nsecond line\n\nlast " + "x" * 200 + " end", 4: "é\n" + "a b " * 50, 9: "\nafter an empty line", 10: "ten"}
EVENTS = [(i, i % 12, "click" if i % 2 else "view") for i in range(60)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 20) for i in range(1, 5)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(EVENTS, "event_id long, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return path


LINES = {f"{i}-{n}": line for i, t in TEXTS.items() for n, line in enumerate(t.split("\n"), 1)}


def test_every_character_is_a_glyph(spark, sf):
    want = sorted((f, i, ch) for f, line in LINES.items() for i, ch in enumerate(line, 1))
    assert sorted((r.file_id, r.run_no, r.ch) for r in C.load(spark, sf, "glyphs").collect()) == want
    assert sorted((r.file_id, r.word_no) for r in C.load(spark, sf, "ocr_words").collect()) == [(f, i) for f, i, _ in want]
    for name in ("shapes", "drawn_pages"):
        assert sorted(r.file_id for r in C.load(spark, sf, name).collect()) == sorted(LINES)


def test_lines_of_pages(spark, sf):
    assert {r.file_id: r.text for r in registry.queries()["pdf_lines"](spark, sf).collect()} == {f: x for f, x in LINES.items() if x}


@pytest.mark.parametrize("name, added", [("units_bidi", (C.RLO, C.PDF)), ("units_tags", (C.SECRET,)), ("units_mixed", (f"p{C.CYRILLIC_A}ypal ", "z "))])
def test_units_hold_whole_texts(spark, sf, name, added):
    for r in C.load(spark, sf, name).collect():
        text = r.text
        for a in added:
            text = text.replace(a, "")
        assert text == TEXTS[int(r.file_id)]


def test_notes_and_attachments_hold_whole_texts(spark, sf):
    assert {int(r.file_id): r.contents for r in C.load(spark, sf, "annotations").collect()} == {i: " " if i % 10 == 0 else t for i, t in TEXTS.items()}
    assert {r.att_no: r.text for r in C.load(spark, sf, "attachments").collect()} == {i: None if i % 3 == 0 else f"<p>{i}</p>" * 20 for i in range(1, 5)}


def test_tags_on_every_line(spark):
    """The detector against plain Python, with an injection on each line of a text."""
    rows = [(str(i), "", 0, None, "\n".join(x[:3] + C.SECRET + x[3:] for x in t.split("\n"))) for i, t in TEXTS.items()]
    units = spark.createDataFrame(rows, "file_id string, inside string, unit_no int, page int, text string")
    found = sorted((r.file_id, r.line, r.column, r.human_sees, r.decoded) for r in characters.tag_characters(units).collect())
    want = [(str(i), n, min(len(x), 3) + 1, x, "SECRET") for i, t in TEXTS.items() for n, x in enumerate(t.split("\n"), 1)]
    assert found == sorted(want)


def test_every_row_is_a_record(spark, sf):
    for name, column in (("meta_history", "seq"), ("survey_findings", "emit_seq")):
        assert sorted(r[column] for r in C.load(spark, sf, name).collect()) == [e for e, _, _ in EVENTS]
    assert sorted((r.seq, r.text) for r in C.load(spark, sf, "word_hidden").collect()) == sorted(TEXTS.items())
    totals = registry.queries()["survey_totals"](spark, sf).first()
    assert (totals.files, totals.refused, totals.hiding, totals.findings) == (12, 2, 12, len(EVENTS))
