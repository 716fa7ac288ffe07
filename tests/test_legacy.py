"""Compound files and Word 97 documents, synthesised from the formats' descriptions."""

import struct

import numpy as np
import pytest

from underlay.operators import metadata, revisions
from underlay.sources import compound, legacy
from underlay.sources.casefiles import extract
from underlay.sources.records import SCHEMAS, Refused

SECTOR, MINI, CUTOFF, END, FREE, FAT = 512, 64, 4096, 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def padded(data, size):
    return data + b"\0" * (-len(data) % size)


def compound_file(streams, storages=()):
    """streams by path; a path's storage must be listed."""
    sectors, fat, mini, mini_fat = [], [], b"", []

    def put(data):
        first = len(sectors)
        count = -(-len(data) // SECTOR)
        sectors.extend(padded(data, SECTOR)[i * SECTOR : (i + 1) * SECTOR] for i in range(count))
        fat.extend([first + i + 1 for i in range(count - 1)] + [END] * (count > 0))
        return first if count else END

    entries = [["Root Entry", 5, FREE, FREE, 1, END, 0]]
    names = [(s, 1, None) for s in storages] + [(n, 2, d) for n, d in streams.items() if "/" not in n]
    inner = {s: [(n.split("/")[1], 2, d) for n, d in streams.items() if n.startswith(f"{s}/")] for s in storages}

    def add(level):
        at = len(entries)
        for i, (name, kind, data) in enumerate(level):
            start, size = END, 0
            if kind == 2:
                size = len(data)
                if size >= CUTOFF:
                    start = put(data)
                elif size:
                    nonlocal mini
                    start, count = len(mini) // MINI, -(-size // MINI)
                    mini += padded(data, MINI)
                    mini_fat.extend([start + j + 1 for j in range(count - 1)] + [END])
            entries.append([name, kind, FREE, at + i + 1 if i + 1 < len(level) else FREE, FREE, start, size])
        return at

    add(names)
    for i, s in enumerate(storages):
        entries[1 + i][4] = add(inner[s]) if inner[s] else FREE
    entries[0][5], entries[0][6] = put(mini), len(mini)
    small = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat))
    directory = b"".join(struct.pack("<64sHBxIII36xIQ", n.encode("utf-16-le"), 2 * len(n) + 2, k, left, right, child, start, size) for n, k, left, right, child, start, size in entries)
    first = put(directory)
    of_fat = -(-4 * (len(fat) + 4) // SECTOR)
    places = [len(sectors) + i for i in range(of_fat)]
    fat.extend([FAT] * of_fat)
    table = struct.pack(f"<{len(fat)}I", *fat)
    table += struct.pack("<I", FREE) * ((of_fat * SECTOR - len(table)) // 4)
    sectors.extend(table[i * SECTOR : (i + 1) * SECTOR] for i in range(of_fat))
    head = compound.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH6x", 0x3E, 3, 0xFFFE, 9, 6) + struct.pack("<IIIIIIIIII", 0, of_fat, first, 0, CUTOFF, small, 1, END, 0, places[0])
    head = head[:76] + struct.pack("<109I", *(places + [FREE] * (109 - len(places))))
    return head + b"".join(sectors)


def property_set(section, values, page=1252):
    rows = [(1, struct.pack("<IhH", 2, page, 0))]
    for number, value in values.items():
        if isinstance(value, int):
            body = struct.pack("<IQ", 64, value)
        else:
            raw = value.encode("cp1252") + b"\0"
            body = struct.pack("<II", 30, len(raw)) + padded(raw, 4)
        rows.append((number, body))
    at, index, data = 8 + 8 * len(rows), b"", b""
    for number, body in rows:
        index += struct.pack("<II", number, at + len(data))
        data += body
    whole = struct.pack("<II", 8 + len(index) + len(data), len(rows)) + index + data
    return struct.pack("<HHI16sI", 0xFFFE, 0, 0, b"\0" * 16, 1) + section + struct.pack("<I", 48) + whole


def sprm(code, value, size):
    return struct.pack("<H", code) + value.to_bytes(size, "little")


def word_file(stories, runs=(), revisers=(), notes=(), wide_from=None, flags=0x0200):
    """stories: texts by number; runs: (first character, past the last, properties); notes: (initials, owner, first, past) in the comments."""
    text = "".join(stories.get(i, "") for _, i in legacy.STORIES)
    wide_from = len(text) if wide_from is None else wide_from
    narrow, wide = text[:wide_from].encode("cp1252"), text[wide_from:].encode("utf-16-le")
    start = 1024
    wide_at = start + len(narrow) + len(narrow) % 2
    body = padded(narrow, 2) + wide
    byte = lambda c: start + c if c <= wide_from and c < len(text) and c < wide_from else (start + c if wide_from == len(text) else wide_at + 2 * (c - wide_from))
    bounds = sorted({0, len(text), *(x for a, b, _ in runs for x in (a, b))})
    if wide_from not in (0, len(text)):
        bounds = sorted({*bounds, wide_from})
    page, offsets, chpx, at = b"", [], b"", 508
    for lo in bounds[:-1]:
        said = next((p for a, b, p in runs if a <= lo < b), b"")
        if not said:
            offsets.append(0)
            continue
        own = padded(bytes([len(said)]) + said, 2)
        at -= len(own)
        chpx = own + chpx
        offsets.append(at // 2)
    page = struct.pack(f"<{len(bounds)}I", *map(byte, bounds)) + bytes(offsets)
    page = page.ljust(at, b"\0") + chpx
    page = page.ljust(511, b"\0") + bytes([len(bounds) - 1])
    main = bytearray(padded(b"\0" * start + body, 512))
    page_number = len(main) // 512
    main += page
    tables, table = {}, b"\0" * 4
    pcd = [(0, min(wide_from, len(text)), (start * 2) | 1 << 30)] * (wide_from > 0) + [(wide_from, len(text), wide_at)] * (wide_from < len(text))
    plex = struct.pack(f"<{len(pcd) + 1}I", *(p[0] for p in pcd), len(text)) + b"".join(struct.pack("<HIH", 0, p[2], 0) for p in pcd)
    tables[legacy.PIECES] = b"\x01" + struct.pack("<H", 2) + b"xx" + b"\x02" + struct.pack("<I", len(plex)) + plex
    tables[legacy.RUN_PAGES] = struct.pack("<III", byte(0), byte(len(text)), page_number)
    tables[legacy.REVISERS] = struct.pack("<HHH", 0xFFFF, len(revisers), 0) + b"".join(struct.pack("<H", len(r)) + r.encode("utf-16-le") for r in revisers)
    if notes:
        owners = sorted({o for _, o, _, _ in notes})
        tables[legacy.NOTE_OWNERS] = b"".join(struct.pack("<H", len(o)) + o.encode("utf-16-le") for o in owners)
        tables[legacy.NOTE_PLACES] = struct.pack(f"<{len(notes) + 1}I", *range(len(notes) + 1)) + b"".join(struct.pack("<H18sH8x", len(i), i.encode("utf-16-le"), owners.index(o)) for i, o, _, _ in notes)
        tables[legacy.NOTE_TEXTS] = struct.pack(f"<{len(notes) + 1}I", *(n[2] for n in notes), notes[-1][3])
    struct.pack_into("<HH6xH", main, 0, legacy.IDENT, 193, flags)
    for _, i in legacy.STORIES:
        struct.pack_into("<I", main, legacy.LENGTHS + 4 * i, len(stories.get(i, "")))
    for number, data in tables.items():
        struct.pack_into("<II", main, legacy.TABLES + 8 * number, len(table), len(data))
        table += data
    return {"WordDocument": bytes(main), "1Table": padded(table, 4)}


def records(data):
    out = {}
    for inside, record, row in extract(data):
        out.setdefault(record, []).append(row)
    return out


WHEN = 30 | 10 << 6 | 5 << 11 | 3 << 16 | 124 << 20  # 2024-03-05, 10:30
SAID = "Before gone and unseen \x13 HYPERLINK \"http://where.example\" \x14shown\x15 after\r"


def document(**more):
    gone = sprm(0x0800, 1, 1) + sprm(0x4863, 1, 2) + sprm(0x6864, WHEN, 4)
    at = lambda word: (SAID.index(word), SAID.index(word) + len(word))
    runs = [(*at("gone "), gone), (*at("unseen "), sprm(0x6A03, 7, 4) + sprm(0x083C, 1, 1)), (*at("after"), sprm(0x0801, 1, 1) + sprm(0x4804, 0, 2))]
    comment = "\x05too bold\r\x05agreed\r"
    return word_file({3: SAID, 4: "\x02 a note\r", 7: comment}, runs, ["Ann", "Bo"], [("AB", "Ann Bell", 0, 10), ("C", "Cy", 10, 18)], **more)


@pytest.mark.parametrize("wide_from", [None, 0, 18])
def test_word(wide_from):
    sets = {legacy.SETS[0]: property_set(compound.SUMMARY, {2: "Offer", 4: "Dora Em", 18: "Word 97", 12: 133500000000000000})}
    r = records(compound_file(document(wide_from=wide_from) | sets))
    assert [u["text"] for u in r["units"]] == ["Before and shown after\n", " a note\n"]
    assert [(x["kind"], x["text"], x["author"], x["date"], x["part"]) for x in r["revisions"]] == [("deletion", "gone ", "Bo", "2024-03-05T10:30:00", "the document"), ("insertion", "after", "Ann", None, "the document")]
    assert [(x["part"], x["text"]) for x in r["word_hidden"]] == [("the document", "unseen ")]
    assert [(c["text"], c["author"], c["initials"]) for c in r["comments"]] == [("too bold", "Ann Bell", "AB"), ("agreed", "Cy", "C")]
    assert {(f["name"], f["value"], f["role"]) for f in r["meta_fields"]} == {("Title", "Offer", "content"), ("Author", "Dora Em", "content"), ("Application Name", "Word 97", "tool"), ("Create Time", "2024-01-17T21:20:00+00:00", "time")}
    assert any("http://where.example" in x["text"] for x in r["remarks"]) and any("searched the document, footnotes" in x["text"] for x in r["remarks"])
    (f,) = r["files"]
    assert f["kind"] == "doc" and f["searched"] and not f["text_unread"] and f["refusal"] is None


def test_detectors_over_a_word_file(spark):
    r = records(compound_file(document()))
    table = lambda name: spark.createDataFrame([("a.doc", "", *(x.get(c.split()[0]) for c in SCHEMAS[name].split("inside string, ")[1].split(", "))) for x in r[name]], SCHEMAS[name])
    assert [(x.machine_reads, x.summary.split(",")[0]) for x in revisions.deleted_text(table("revisions")).collect()] == [("gone ", "5 characters deleted by Bo on 2024-03-05T10:30:00")]
    assert [x.machine_reads for x in revisions.word_hidden(table("word_hidden")).collect()] == ["unseen "]
    assert sorted(x.machine_reads for x in revisions.comments(table("comments")).collect()) == ["agreed", "too bold"]
    assert metadata.undisclosed(spark.createDataFrame([("a.doc", "", 1, "Author", "Dora", "S", "content", "ole2")], SCHEMAS["meta_fields"]), table("units")).count() == 1


def test_large_streams_and_storages():
    long = {3: "line of prose\r" * 3000}
    r = records(compound_file(word_file(long) | {"ObjectPool/one": b"x" * 70}, ["ObjectPool"]))
    assert r["units"][0]["text"] == "line of prose\n" * 3000 and any("ObjectPool" in x["text"] for x in r["remarks"])


@pytest.mark.parametrize("stream, kind", [("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"), ("Other", "ole2")])
def test_text_that_is_not_read_is_said_so(stream, kind):
    user = property_set(compound.DOCUMENT_SUMMARY, {15: "Acme"})
    (f,) = (r := records(compound_file({stream: b"x" * 10, legacy.SETS[1]: user})))["files"]
    assert f["kind"] == kind and f["text_unread"] and not f["searched"] and "units" not in r
    assert any("Company Acme" in x["text"] for x in r["remarks"])


def test_encrypted_and_damaged():
    r = records(compound_file(word_file({3: "x" * 20}, flags=0x0300)))
    assert any("encrypted" in x["text"] for x in r["remarks"]) and r["files"][0]["text_unread"]
    parts = word_file({3: "x" * 20})
    for name in ("WordDocument", "1Table"):
        r = records(compound_file({k: v for k, v in parts.items() if k != name} | {"Workbook": b""} if name == "WordDocument" else {k: v for k, v in parts.items() if k != name}))
        assert r["files"][0]["text_unread"] and r["remarks"]
    main = bytearray(parts["WordDocument"])
    struct.pack_into("<II", main, legacy.TABLES + 8 * legacy.RUN_PAGES, 1 << 20, 12)
    r = records(compound_file(parts | {"WordDocument": bytes(main)}))
    assert "units" not in r and any("could not be read" in x["text"] for x in r["remarks"])
    whole = bytearray(compound_file(parts))
    with pytest.raises(Refused):
        compound.CompoundFile(bytes(whole[:600]))
    loop = np.array([0, 1], "<u4")
    with pytest.raises(Refused):
        compound.CompoundFile._chain(0, loop)


def test_fields_within_fields():
    text = "a\x13 IF \x13 PAGE \x143\x15 > 2 \x14yes\x15b\x13 TOC \x15c"
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    shown, said = legacy._on_page(units)
    assert legacy._text(units[shown]) == "ayesbc" and said == ["PAGE", "IF 3 > 2", "TOC"]
