"""Files made from the driver's tables, parsed by the readers, and the same records in SQL.

Each builder turns one row into a file of its format with parts that the reader must
tell apart: shown and hidden, kept and deleted.  The files are parsed where they are
made, so a query over them needs no folder.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.casefiles import Records
from ..sources.shared import buckets_for, shared_path

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_ODF = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "text", "table", "style")) + ' xmlns:dc="http://purl.org/dc/elements/1.1/"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _rels(targets: dict[str, str]) -> str:
    return f"<Relationships {_REL}>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def word(r: dict) -> bytes:
    """The customer's name, and a segment that was deleted or inserted; company metadata."""
    run = f"<w:r><w:t>{escape(r['segment'])}</w:t></w:r>"
    change = f'<w:del w:author="{escape(r["author"])}" w:date="2024-01-02T00:00:00Z">{run.replace("w:t>", "w:delText>")}</w:del>' if r["id"] % 2 else f'<w:ins w:author="{escape(r["author"])}">{run}</w:ins>'
    body = f"<w:document {_W}><w:body><w:p><w:r><w:t>{escape(r['name'])}</w:t></w:r></w:p><w:p><w:r><w:t>of </w:t></w:r>{change}</w:p></w:body></w:document>"
    core = f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{escape(r["author"])}</dc:creator></c>'
    return _zip({"word/document.xml": body, "docProps/core.xml": core})


def container(r: dict) -> bytes:
    """A word document of its own, which carries one for each of its rows."""
    own = {"segment": "carries", "author": "A", "id": 1}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(word(own | {"name": f"container {r['key']}"}))) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as more:
        for name in z.namelist():
            more.writestr(name, z.read(name))
        for s in r["rows"]:
            more.writestr(f"word/embeddings/s{s['id']}.docx", word(own | s))
    return out.getvalue()


def workbook(r: dict) -> bytes:
    """A row a supplier; every third is hidden, and so is the column of numbers."""
    rows = "".join(f'<row r="{i}"{" hidden=\"1\"" if s["id"] % 3 == 0 else ""}><c r="A{i}" t="inlineStr"><is><t>{escape(s["name"])}</t></is></c><c r="B{i}"><v>{s["id"]}</v></c></row>' for i, s in enumerate(r["rows"], 1))
    return _zip({
        "xl/workbook.xml": f'<workbook {_X}><sheets><sheet name="All" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels({"r1": "worksheets/s1.xml"}),
        "xl/worksheets/s1.xml": f'<worksheet {_X}><cols><col min="2" max="2" hidden="1"/></cols><sheetData>{rows}</sheetData></worksheet>',
    })


def deck(r: dict) -> bytes:
    """A slide a turn; every third is hidden."""
    n = len(r["rows"])
    parts = {
        "ppt/presentation.xml": f'<p:presentation {_P}>{"".join(f"<p:sldId r:id={chr(34)}r{i}{chr(34)}/>" for i in range(n))}</p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels({f"r{i}": f"slides/s{i}.xml" for i in range(n)}),
    }
    for i, t in enumerate(r["rows"]):
        show = ' show="0"' if t["id"] % 3 == 2 else ""
        parts[f"ppt/slides/s{i}.xml"] = f"<p:sld {_P}{show}><a:p><a:r><a:t>{escape(t['name'])}</a:t></a:r></a:p></p:sld>"
    return _zip(parts)


def open_text(r: dict) -> bytes:
    body = f'<office:document-content {_ODF}><office:body><office:text><text:tracked-changes><text:changed-region><text:deletion><office:change-info><dc:creator>{escape(r["author"])}</dc:creator><dc:date>2024-05-01</dc:date></office:change-info><text:p>{escape(r["segment"])}</text:p></text:deletion></text:changed-region></text:tracked-changes><text:p>{escape(r["name"])}</text:p></office:text></office:body></office:document-content>'
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": body})


def open_sheet(r: dict) -> bytes:
    """A row a supplier; every second is filtered away, every fifth collapsed."""
    seen = lambda i: ' table:visibility="collapse"' if i % 5 == 0 else ' table:visibility="filter"' if i % 2 == 0 else ""
    rows = "".join(f'<table:table-row{seen(s["id"])}><table:table-cell><text:p>{escape(s["name"])}</text:p></table:table-cell></table:table-row>' for s in r["rows"])
    return _zip({"content.xml": f'<office:document-content {_ODF}><office:body><office:spreadsheet><table:table table:name="T">{rows}</table:table></office:spreadsheet></office:body></office:document-content>'})


def portable(r: dict) -> bytes:
    """A page with the name, and the region in a render mode that paints nothing."""
    said = lambda t: "".join("\\" + c if c in "()\\" else c for c in t)
    body = zlib.compress(f"BT /F1 10 Tf 1 0 0 1 50 700 Tm ({said(r['name'])}) Tj 3 Tr 1 0 0 1 50 600 Tm ({said(r['segment'])}) Tj ET".encode("latin-1"))
    objects = [
        "1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        "2 0 obj << /Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 600 800] >> endobj",
        "3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 32 /Widths [" + " 500" * 95 + "] >> endobj",
        "4 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents 5 0 R >> endobj",
        f"6 0 obj << /Author ({said(r['author'])}) >> endobj",
    ]
    head = ("%PDF-1.4\n" + "\n".join(objects) + f"\n5 0 obj << /Length {len(body)} /Filter /FlateDecode >> stream\n").encode("latin-1")
    return head + body + b"\nendstream endobj\ntrailer << /Root 1 0 R /Info 6 0 R >>\nstartxref\n0\n%%EOF\n"


def photograph(r: dict) -> bytes:
    """A header alone: the picture's size, a preview of another, and an XMP packet."""

    def segment(code: int, body: bytes) -> bytes:
        return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body

    def picture(w: int, h: int, more: bytes = b"") -> bytes:
        return b"\xff\xd8" + more + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3)) + b"\xff\xda"

    small = picture(160, 84)
    exif = b"Exif\0\0" + b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIIHHII", 0x0201, 4, 1, 38, 0x0202, 4, 1, len(small)) + struct.pack("<I", 0) + small
    packet = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator><rdf:Seq><rdf:li>{escape(r["name"])}</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'
    return picture(800, r["id"] % 97 + 400, segment(0xE1, exif) + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()))


#: A task makes and parses the files of so many bytes of rows; of large tables more, so that tasks stay under MOST, but never above LARGEST.
DEALT_BYTES, LARGEST, MOST = 1 << 16, 16 << 20, 4096


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all tasks: a row of a few bytes is a file to parse, so what the reader puts into one task by its bytes is far too much."""
    return rows.repartition(max(min(buckets_for(rows, 1, DEALT_BYTES), MOST), buckets_for(rows, 1, LARGEST), 2 * rows.sparkSession.sparkContext.defaultParallelism))


def records_of(rows: DataFrame, build: Callable[[dict], bytes], ending: str, *wanted: str) -> list[DataFrame]:
    """Record tables of the files that build makes of rows (key, and what it reads): parsed once, and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{r['key']}.{ending}" for r in every], pa.string()), pa.array([build(r) for r in every], pa.binary())], names=["rel_path", "content"])

    files = dealt(rows).mapInArrow(run, "rel_path string, content binary")
    records = Records(files, shared_path(rows.sparkSession, "records"), wanted)
    return [records[w] for w in wanted]


def grouped(rows: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """A row a key, with its rows (id, name) in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("id"), F.col(name).alias("name"))))
    return rows.groupBy(F.col(key).alias("key")).agg(listed.alias("rows"))
