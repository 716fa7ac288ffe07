"""Files to records to findings: synthesised packages, refusals, and the folder's survey.

Hand-made packages agree with the formats' descriptions; they prove nothing of real applications.
"""

import struct
import zipfile

import pytest

from underlay.operators import survey
from underlay.plans.scan import scan
from underlay.sources import media, office
from underlay.sources.casefiles import extract
from underlay.sources.records import Sink
from underlay.sources.walk import case_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
ODF = " ".join(f'xmlns:{p}="{u}"' for u, p in office.PREFIXES.items() if "opendocument" in u) + ' xmlns:dc="http://purl.org/dc/elements/1.1/"'


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return path.read_bytes()


def rels(**targets):
    return f"<Relationships {REL}>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def workbook():
    sheet = f'<worksheet {X}><cols><col min="2" max="3" hidden="1"/><col min="5" max="5" hidden="false"/></cols><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1" t="s"><v>0</v></c></row><row r="4" hidden="true"><c r="A4" t="inlineStr"><is><t>four</t></is></c><c r="B4" s="1"><v>45366</v></c></row></sheetData></worksheet>'
    return {
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" state="veryHidden" r:id="r2"/><sheet name="C" sheetId="3" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1="worksheets/s1.xml", r2="/xl/worksheets/s2.xml"),
        "xl/sharedStrings.xml": f"<sst {X}><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {X}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": sheet,
        "xl/worksheets/s2.xml": f'<worksheet {X}><sheetData><row><c><v>77</v></c></row></sheetData></worksheet>',
        "xl/revisions/revisionHeaders.xml": f'<headers {X}><header r:id="r1" userName="Ann" dateTime="2024-01-02"/></headers>',
        "xl/revisions/_rels/revisionHeaders.xml.rels": rels(r1="log1.xml"),
        "xl/revisions/log1.xml": f'<revisions {X}><rcc sId="1"><oc r="A1"><v>9</v></oc><nc r="A1"><v>9</v></nc></rcc><rrc sId="1" ref="A3:B3" action="deleteRow"/></revisions>',
    }


def records(data):
    out = {}
    for inside, record, row in extract(data):
        out.setdefault((inside, record), []).append(row)
    return out


def test_workbook(tmp_path):
    r = records(package(tmp_path / "b.xlsx", workbook()))
    assert [(s["name"], s["hidden"]) for s in r["", "sheets"]] == [("A", None), ("B", "very hidden"), ("C", None)]
    assert [(c["row"], c["col"], c["text"]) for c in r["", "cells"]] == [(1, 1, "1"), (1, 2, "shared"), (4, 1, "four"), (4, 2, "2024-03-15"), (1, 1, "77")]
    assert {(a["axis"], a["idx"]) for a in r["", "hidden_axis"]} == {("column", 2), ("column", 3), ("row", 4)}
    assert [(c["sheet"], c["row"], c["col"], c["previous"], c["author"]) for c in r["", "cell_changes"]] == [("A", 1, 1, "9", "Ann")]
    assert [u["text"] for u in r["", "units"]] == ["1"]
    assert any("missing" in x["text"] for x in r["", "remarks"]) and any("A3:B3" in x["text"] for x in r["", "remarks"])


def test_deck(tmp_path):
    slide = lambda text, show="": f'<p:sld {P}{show}><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sld>'
    notes = f'<p:notes {P}><p:sp><p:nvPr><p:ph type="sldImg"/></p:nvPr><a:p><a:r><a:t>picture</a:t></a:r></a:p></p:sp><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:sp></p:notes>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(r1="slides/s1.xml", r2="slides/s2.xml"),
        "ppt/slides/s1.xml": slide("one"),
        "ppt/slides/_rels/s1.xml.rels": rels(n="../notesSlides/notesSlide1.xml"),
        "ppt/notesSlides/notesSlide1.xml": notes,
        "ppt/slides/s2.xml": slide("two", ' show="0"'),
    }
    r = records(package(tmp_path / "d.pptx", parts))
    assert [(s["number"], s["text"], s["hidden"], s["notes"]) for s in r["", "slides"]] == [(1, "two", True, ""), (2, "one", False, "say this")]


def test_open_document(tmp_path):
    text = f'<office:document-content {ODF}><office:body><office:text><text:tracked-changes><text:changed-region><text:deletion><office:change-info><dc:creator>Bo</dc:creator><dc:date>2024-05-01</dc:date></office:change-info><text:p>gone</text:p></text:deletion></text:changed-region></text:tracked-changes><text:p>kept<office:annotation><dc:creator>Cy</dc:creator><text:p>why</text:p></office:annotation> on<text:s text:c="2"/>x</text:p></office:text></office:body></office:document-content>'
    r = records(package(tmp_path / "n.odt", {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": text}))
    assert [u["text"] for u in r["", "units"]] == ["kept on  x"]
    assert [(x["kind"], x["text"], x["author"]) for x in r["", "revisions"]] == [("deletion", "gone", "Bo")]
    assert [(x["text"], x["author"]) for x in r["", "comments"]] == [("why", "Cy")]
    sheet = f'<office:document-content {ODF}><office:automatic-styles><style:style style:name="h" style:family="table"><style:table-properties table:display="false"/></style:style></office:automatic-styles><office:body><office:spreadsheet><table:table table:name="T"><table:table-column table:number-columns-repeated="2"/><table:table-column table:visibility="collapse"/><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:covered-table-cell/><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row><table:table-row table:visibility="filter" table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>f</text:p></table:table-cell></table:table-row><table:table-row table:visibility="collapse" table:number-rows-repeated="1000000"><table:table-cell/></table:table-row></table:table><table:table table:name="H" table:style-name="h"><table:table-row><table:table-cell><text:p>z</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    r = records(package(tmp_path / "s.ods", {"content.xml": sheet}))
    assert {(a["axis"], a["idx"]) for a in r["", "hidden_axis"]} == {("column", 3), ("filter", 2)}
    assert [(s["name"], s["hidden"]) for s in r["", "sheets"]] == [("T", None), ("H", "hidden")]
    assert [u["text"] for u in r["", "units"]] == ["a"]


def jpeg(w, h, preview=None, xmp=None):
    def segment(marker, body):
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    out = b"\xff\xd8"
    if preview is not None:
        entries = struct.pack("<HHIIHHII", 0x0201, 4, 1, 8 + 2 + 24 + 4, 0x0202, 4, 1, len(preview))
        out += segment(0xE1, b"Exif\0\0" + b"II*\0" + struct.pack("<IH", 8, 2) + entries + struct.pack("<I", 0) + preview)
    if xmp:
        out += segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp)
    return out + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3)) + b"\xff\xda"


XMP = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"
 xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/" xmlns:stEvt="http://ns.adobe.com/xap/1.0/sType/ResourceEvent#" xmlns:stRef="http://ns.adobe.com/xap/1.0/sType/ResourceRef#" xmp:CreatorTool="Tool 1"><dc:creator><rdf:Seq><rdf:li>Di</rdf:li><rdf:li>Ed</rdf:li></rdf:Seq></dc:creator>
<xmpMM:DerivedFrom stRef:documentID="id-7"/><xmpMM:History><rdf:Seq><rdf:li stEvt:action="saved" stEvt:softwareAgent="Tool 2"/><rdf:li rdf:parseType="Resource"><stEvt:action>converted</stEvt:action></rdf:li></rdf:Seq></xmpMM:History></rdf:Description></rdf:RDF></x:xmpmeta>"""


def test_photographs_and_xmp():
    r = records(jpeg(800, 420, jpeg(160, 120), XMP))
    assert r["", "images"] == [{"w": 800, "h": 420, "tw": 160, "th": 120}]
    assert {(f["name"], f["value"], f["role"]) for f in r["", "meta_fields"]} == {("xmp:CreatorTool", "Tool 1", "tool"), ("dc:creator", "Di; Ed", "content"), ("xmpMM:DerivedFrom/documentID", "id-7", "content")}
    assert [(h["action"], h["software"]) for h in r["", "meta_history"]] == [("saved", "Tool 2"), ("converted", None)]
    assert records(jpeg(8, 8))["", "images"] == [{"w": 8, "h": 8, "tw": 0, "th": 0}]
    assert media.preview(b"II*\0" + struct.pack("<I", 1 << 30)) is None


@pytest.mark.parametrize("data", [b"PK\x03\x04junk", b"\xff\xd8\xff\xda", b"a\0b", b"\xff\xfe\x00", b"%PDF-1.4 junk", b"caf\xe9", None, b"PK\x03\x04" + b"\0" * 64])
def test_refusals_are_rows(data):
    (row,) = records(data)["", "files"]
    assert row["refusal"] and not row["searched"]


def test_bombs_are_remarks(tmp_path):
    data = package(tmp_path / "x.docx", {"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    assert any("entities" in x["text"] for x in records(data)["", "remarks"])
    out = Sink()
    media.read_plain("﻿x".encode(), out)
    assert out.rows["units"][0]["text"] == "﻿x"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    (d / "_dir").mkdir()
    (d / ".git").mkdir()
    (d / "_underscore.txt").write_text("a​b")
    (d / "_dir" / "x.txt").write_text("nothing here")
    (d / ".git" / "config").write_text("​")
    (d / "photo.jpg").write_bytes(b"\xff\xd8\xff\xda")
    inner = package(d / "bids.xlsx", workbook())
    body = f'<w:document {W}><w:p><w:r><w:t>Hello</w:t></w:r><w:del w:author="Ann" w:date="2024-01-01"><w:r><w:delText>secret</w:delText></w:r></w:del><w:ins w:author="Ann"><w:r><w:t> you</w:t></w:r></w:ins></w:p></w:document>'
    core = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Anna Bell</dc:creator><dc:title>hello</dc:title></c>'
    package(d / "deal.docx", {"word/document.xml": body, "docProps/core.xml": core, "word/embeddings/in.xlsx": inner})
    return d


def test_underscores_are_read_and_dots_are_not(spark, folder):
    assert sorted(r.rel_path for r in case_files(spark, str(folder)).collect()) == ["_dir/x.txt", "_underscore.txt", "bids.xlsx", "deal.docx", "photo.jpg"]
    assert case_files(spark, str(folder / "_underscore.txt")).count() == 1


def test_scan_and_survey(spark, folder, tmp_path):
    records_, found = scan(spark, str(folder), str(tmp_path / "records"))
    found = found.cache()
    got = {(r.file_id, r.inside, r.detector, r.machine_reads) for r in found.collect()}
    assert ("_underscore.txt", "", "zero-width", "a⟨U+200B⟩b") in got
    for inside, file in (("", "bids.xlsx"), ("in.xlsx", "deal.docx")):
        assert {(d, m) for f, i, d, m in got if f == file and i == inside and d in ("hidden-sheet", "hidden-rows", "hidden-columns", "changed-cell")} == {("hidden-sheet", "77"), ("hidden-rows", "four | 2024-03-15"), ("hidden-columns", "shared | 2024-03-15"), ("changed-cell", "9")}
    assert {d for f, i, d, _ in got if f == "deal.docx" and not i} == {"deleted-text", "revision-history", "undisclosed-metadata", "attached-file"}
    assert ("deal.docx", "", "undisclosed-metadata", "Anna Bell") in got
    files = records_.files()
    assert [r.rel_path for r in survey.refused(files).collect()] == ["photo.jpg"]
    assert [r.rel_path for r in survey.hiding(files, found).collect()] == ["_underscore.txt", "bids.xlsx", "deal.docx"]
    total = survey.totals(files, found).first()
    assert (total.files, total.read, total.refused, total.hiding, total.exit_code) == (5, 4, 1, 3, 1)
    assert survey.totals(files.where("false"), found.where("false")).first().exit_code == 0
    assert survey.totals(files.where("refusal is not null"), found.where("false")).first().exit_code == 2


def test_a_damaged_part_keeps_what_was_read_before(tmp_path):
    parts = workbook()
    parts["xl/worksheets/s2.xml"] = parts["xl/worksheets/s2.xml"].replace("<row>", '<row r="x">').replace("<c>", '<c r="?" t="s">')
    data = package(tmp_path / "b.xlsx", parts)
    r = records(data)
    assert [c["text"] for c in r["", "cells"]][:4] == ["1", "shared", "four", "2024-03-15"] and r["", "files"][0]["refusal"] is None


def test_runs_of_any_length(tmp_path):
    """A mark on a million rows and a cell repeated over all columns."""
    sheet = f'<office:document-content {ODF}><office:body><office:spreadsheet><table:table table:name="T"><table:table-row table:visibility="collapse" table:number-rows-repeated="900000"><table:table-cell table:number-columns-repeated="9000"><text:p>x</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    r = records(package(tmp_path / "s.ods", {"content.xml": sheet}))
    assert len(r["", "cells"]) == 9000 and [(a["axis"], a["idx"]) for a in r["", "hidden_axis"]] == [("row", 1)]


def test_reports_of_a_folder_and_of_its_files(spark, folder, tmp_path):
    import io
    import json

    from underlay.cli import report

    records_, found = scan(spark, str(folder), str(tmp_path / "records"))
    found = found.persist()

    def said(form, as_survey):
        out = io.StringIO()
        assert report("case", records_, found, form, as_survey, out) == 1
        return out.getvalue()

    text = said(None, True)
    assert "case: 3 of 5 files hide something" in text and "bids.xlsx" in text and "searched 4 files; 1 file could not be read" in text
    whole = json.loads(said("json", True))
    assert whole["hiding"] == 3 and [f["file"] for f in whole["files"]] == ["_dir/x.txt", "_underscore.txt", "bids.xlsx", "deal.docx", "photo.jpg"]
    deal = whole["files"][3]
    assert {f["detector"] for f in deal["findings"]} >= {"deleted-text", "hidden-sheet", "attached-file"} and whole["files"][4]["refusal"]
    assert "not read" in said("markdown", True) and "<h2>what was found</h2>" in said("html", True)
    assert "secret" in said(None, False) and "not read: it begins like a JPEG" in said(None, False)
    assert len(said("json", False).splitlines()) == 5


def test_words_of_a_rendered_page():
    from underlay.sources import rendered

    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = "1\t1\t0\t0\t0\t0\t0\t0\t1700\t2200\t-1\t\n5\t1\t1\t1\t1\t1\t200\t100\t300\t50\t91.5\tHello\n5\t1\t1\t1\t1\t2\t600\t100\t10\t50\t40\t \n"
    assert list(rendered.words(head + rows, 3)) == [{"page": 3, "word_no": 1, "text": "Hello", "x0": 72.0, "y0": 738.0, "x1": 180.0, "y1": 756.0, "conf": 91.5}]


def test_made_files_are_dealt_out_over_tasks(spark):
    """Rows that lie in one task, as small tables do, are made into files and parsed by all."""
    from pyspark import TaskContext

    from underlay.plans import packages as P

    rows = spark.range(400).coalesce(1).withColumnRenamed("id", "key")
    (units,) = P.records_of(rows, lambda r: f"task {TaskContext.get().partitionId()}".encode(), "txt", "units")
    got = units.collect()
    assert len({r.file_id for r in got}) == 400 and len({r.text for r in got}) >= spark.sparkContext.defaultParallelism
