import zlib

import pytest

from underlay.plans.scan import scan
from underlay.sources import pdf
from underlay.sources.records import Sink

TEXT = "BT /F1 10 Tf 1 0 0 1 50 700 Tm (Pay 1000 to Smith) Tj ET"


def make(content, extra="", info="", annots="", packed=True, pages=1):
    body = zlib.compress(content.encode("latin-1")) if packed else content.encode("latin-1")
    kids = " ".join(f"{10 + i} 0 R" for i in range(pages))
    objects = [
        f"1 0 obj << /Type /Catalog /Pages 2 0 R {extra} >> endobj",
        f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {pages} /MediaBox [0 0 600 800] >> endobj",
        "3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 32 /Widths [" + " 500" * 95 + "] >> endobj",
        *(f"{10 + i} 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents 5 0 R {annots} >> endobj" for i in range(pages)),
        f"6 0 obj << {info} >> endobj",
    ]
    head = ("%PDF-1.4\n" + "\n".join(objects) + f"\n5 0 obj << /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} >> stream\n").encode("latin-1")
    return head + body + b"\nendstream endobj\ntrailer << /Root 1 0 R /Info 6 0 R >>\nstartxref\n0\n%%EOF\n"


def read(data):
    out = Sink()
    pdf.read_pdf(data, out)
    return out.rows


def test_glyphs_and_shapes():
    r = read(make(f"q 1 0 0 rg 50 690 20 20 re f Q {TEXT} 0 g 70 695 m 95 695 l 95 715 l 70 715 l h f*"))
    assert "".join(g["ch"] for g in r["glyphs"]) == "Pay 1000 to Smith" == r["units"][0]["text"]
    g = r["glyphs"][1]
    assert (g["x0"], g["x1"], g["y0"], g["y1"], g["ox"], g["oy"]) == (55, 60, 697.5, 707.5, 55, 700)
    assert [(s["kind"], s["x0"], s["x1"], s["r"], s["ord"]) for s in r["shapes"]] == [("fill", 50, 70, 1.0, 0), ("fill", 70, 95, 0.0, 2)] and r["glyphs"][0]["ord"] == 1


def test_state_forms_and_text_operators():
    r = read(make("q 0.5 0 0 0.5 0 0 cm 0 0 100 100 re W n 0 0 400 400 re f Q BT /F1 10 Tf 3 Tr 10 TL 1 0 0 1 0 100 Tm [(A) -1000 (B)] TJ (C) ' ET"))
    assert [(s["x1"], s["y1"]) for s in r["shapes"]] == [(50, 50)]
    assert [(g["ch"], g["ox"], g["oy"], g["mode"]) for g in r["glyphs"]] == [("A", 0, 100, 3), ("B", 15, 100, 3), ("C", 0, 90, 3)]


@pytest.mark.parametrize("junk", ["\xff\xfe\x00", ")))", ">>>>", "\0" * 32, "[[[[", "<<<<", "(((", "BI x", "1 2 cm", "/F9 1 Tf (x) Tj", "Q Q Q", "<</A 1 0 R/B[2 0 R 3]/C 4>> BT"])
def test_junk_is_no_crash(junk):
    assert "Pay" in read(make(f"{TEXT} {junk}", packed=False))["units"][0]["text"]


def test_refused():
    for data in (b"%PDF-1.4 junk", make(TEXT).replace(b"/Info 6", b"/Encrypt 6")):
        with pytest.raises(pdf.Refused):
            read(data)


def test_lexer():
    v = pdf.Lexer(rb"<</A 1 0 R /B 7 /C [1 0 R 2] /D (a\(b\)\101\n) /E <41 4> /F#20G -.5 /H true>>").next()
    assert v == {"A": pdf.Ref(1, 0), "B": 7, "C": [pdf.Ref(1, 0), 2], "D": b"a(b)A\n", "E": b"A@", "F G": -0.5, "H": True}


def test_predictors():
    assert pdf._unpredicted(bytes([2, 1, 2, 2, 1, 1, 1, 5, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3, 5, 6])


def test_scan_of_pdfs(spark, tmp_path):
    d = tmp_path / "case"
    d.mkdir()
    bars = f"{TEXT} 0 g 68 690 24 20 re f"
    (d / "bars.pdf").write_bytes(make(bars, info="/Title (Offer) /Producer (Maker 1) /CreationDate (D:20240105100000Z) /ModDate (D:20240101100000Z)", annots="/Annots [<< /Subtype /Text /Contents (look here) /T (Jo) >> << /Subtype /Link >>]"))
    (d / "clean.pdf").write_bytes(make(TEXT))
    first = make(TEXT)
    new = zlib.compress(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (All is well) Tj ET")
    (d / "edited.pdf").write_bytes(first + f"5 0 obj << /Length {len(new)} /Filter /FlateDecode >> stream\n".encode() + new + b"\nendstream endobj\ntrailer << /Root 1 0 R >>\n%%EOF\n")
    hidden = "BT /F1 10 Tf 3 Tr 1 0 0 1 50 700 Tm (unseen) Tj 0 Tr 1 g 1 0 0 1 50 600 Tm (white) Tj 0 g 1 0 0 1 700 500 Tm (beyond) Tj ET"
    (d / "hidden.pdf").write_bytes(make(hidden))
    records, found = scan(spark, str(d), str(tmp_path / "r"))
    got = sorted((r.file_id, r.detector, r.machine_reads) for r in found.collect())
    assert got == sorted([
        ("bars.pdf", "comment", "look here"), ("bars.pdf", "covered-text", "1000"), ("bars.pdf", "metadata-conflict", "ModDate 2024-01-01T10:00:00Z"), ("bars.pdf", "undisclosed-metadata", "Offer"),
        ("edited.pdf", "earlier-revision", "Pay 1000 to Smith"), ("hidden.pdf", "invisible-text", "unseen"), ("hidden.pdf", "low-contrast-text", "white"), ("hidden.pdf", "off-page-text", "beyond"),
    ])
    assert records.files().where("refusal is not null").count() == 0
