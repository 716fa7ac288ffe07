"""Word 97 documents, and what Excel 97 and PowerPoint 97 files say of themselves.

A Word document's characters lie end to end, story after story, in pieces of its
main stream; which of them are deleted, inserted or hidden is said of byte ranges
of that stream.  Both are laid onto arrays with one place a character, so a story,
a run of one kind and what a page shows are slices and masks of these arrays.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .compound import CompoundFile, properties
from .records import Refused, Sink

SETS = ("\x05SummaryInformation", "\x05DocumentSummaryInformation")
#: Streams that tell the application, with the kind and its name.
APPLICATIONS = (("WordDocument", "doc", "a Word 97 document"), ("Workbook", "xls", "an Excel 97 workbook"), ("Book", "xls", "an Excel 5 workbook"), ("PowerPoint Document", "ppt", "a PowerPoint 97 presentation"))
#: Roles of property names, lower-cased; anything else is `other`.
ROLES = {
    **dict.fromkeys(("title", "subject", "author", "keywords", "comments", "last saved by", "manager", "company", "category"), "content"),
    "application name": "tool",
    "template": "path",
    **dict.fromkeys(("create time", "last saved time", "last printed"), "time"),
}
#: What makes a field's instruction name a location.
LOCATIONS = ("://", "\\\\", "file:", "C:\\", "/")

#: Fixed values of the format: header, first version with this layout, flags, and tables by their number in the header's list.
IDENT, WORD_97, ENCRYPTED, SECOND_TABLE = 0xA5EC, 193, 0x0100, 0x0200
LENGTHS, TABLES = 0x40, 0x9A
NOTE_PLACES, NOTE_TEXTS, RUN_PAGES, PIECES, NOTE_OWNERS, REVISERS = 4, 5, 12, 33, 36, 51
#: Stories in the order of their characters, by their number among the lengths.
STORIES = (("the document", 3), ("footnotes", 4), ("headers and footers", 5), ("comments", 7), ("endnotes", 8), ("text boxes", 9), ("text boxes in headers and footers", 10))
#: Punctuation of the format and what a page shows in its place.
PUNCTUATION = str.maketrans({"\r": "\n", "\x07": "\n", "\x0b": "\n", "\x0c": "\n", "\x1e": "-", "\x1f": "", "\x01": "", "\x02": "", "\x05": "", "\x08": "", "\x00": ""})
OPENS, PARTS, CLOSES = 0x13, 0x14, 0x15
#: Properties of runs, and the sizes of operands by the property's highest three bits (6: stated by the first byte).
DELETED, INSERTED, HIDDEN = 0x0800, 0x0801, 0x083C
WHO, WHEN = (0x4863, 0x4804), (0x6864, 0x6805)
OPERANDS = (1, 1, 2, 4, 2, 2, None, 3)
PAGE = 512
#: Bytes beyond ASCII of eight-bit pieces; the five that Windows-1252 lacks stand for themselves.
_EIGHT_BIT = np.array([ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(256)], np.uint16)


@dataclass
class Marks:
    """One array a property, a place a character."""

    deleted: np.ndarray
    inserted: np.ndarray
    hidden: np.ndarray
    author: np.ndarray
    date: np.ndarray

    @classmethod
    def none(cls, n: int) -> Marks:
        return cls(*(np.zeros(n, bool) for _ in range(3)), np.full(n, -1, np.int64), np.zeros(n, np.int64))


class WordFile:
    def __init__(self, compound: CompoundFile):
        self.main = compound.read("WordDocument")
        if len(self.main) < TABLES + 8 * (PIECES + 1):
            raise Refused("its main stream is too short for a header")
        ident, version, self.flags = struct.unpack_from("<HH6xH", self.main)
        if ident != IDENT or version < WORD_97:
            raise Refused("its main stream has the header of no version from Word 97 on")
        self.encrypted = bool(self.flags & ENCRYPTED)
        name = "1Table" if self.flags & SECOND_TABLE else "0Table"
        if not self.encrypted and name not in compound.streams:
            raise Refused(f"its header names the stream {name}, which is not there")
        self.tables = b"" if self.encrypted else compound.read(name)

    def table(self, number: int) -> bytes:
        at = TABLES + 8 * number
        start, size = struct.unpack_from("<II", self.main, at) if at + 8 <= len(self.main) else (0, 0)
        if start + size > len(self.tables):
            raise Refused("a table that its header names lies beyond the table stream")
        return self.tables[start : start + size]

    @staticmethod
    def plex(blob: bytes, size: int) -> tuple[np.ndarray, list[bytes]]:
        """Positions, one more than the items of a size that follow them."""
        n = max((len(blob) - 4) // (4 + size), 0)
        at = 4 * (n + 1)
        return np.frombuffer(blob, "<u4", n + 1 if len(blob) >= 4 else 0).astype(np.int64), [blob[at + i * size : at + (i + 1) * size] for i in range(n)]

    def pieces(self) -> list[tuple[int, int, int, int]]:
        """(first character, past the last one, byte in the main stream, bytes a character)."""
        blob, at = self.table(PIECES), 0
        while at + 3 <= len(blob) and blob[at] == 1:
            at += 3 + struct.unpack_from("<H", blob, at + 1)[0]
        if at + 5 > len(blob) or blob[at] != 2:
            raise Refused("its table of pieces is damaged")
        places, items = self.plex(blob[at + 5 : at + 5 + struct.unpack_from("<I", blob, at + 1)[0]], 8)
        out = []
        for lo, hi, item in zip(places[:-1].tolist(), places[1:].tolist(), items):
            (place,) = struct.unpack_from("<I", item, 2)
            narrow = place >> 30 & 1
            place, width = ((place & 0x3FFFFFFF) // 2, 1) if narrow else (place & 0x3FFFFFFF, 2)
            if hi < lo or place + (hi - lo) * width > len(self.main):
                raise Refused("a piece of its text lies beyond the main stream")
            out.append((lo, hi, place, width))
        return out

    def characters(self, pieces: list) -> np.ndarray:
        """UTF-16 units of all stories."""
        out = np.zeros(max((hi for _, hi, _, _ in pieces), default=0), np.uint16)
        for lo, hi, place, width in pieces:
            raw = self.main[place : place + (hi - lo) * width]
            out[lo:hi] = _EIGHT_BIT[np.frombuffer(raw, np.uint8)] if width == 1 else np.frombuffer(raw, "<u2")
        return out

    def marks(self, pieces: list, n: int) -> Marks:
        """Each run of properties, from bytes of the main stream to the characters of the pieces there."""
        out = Marks.none(n)
        for _, item in zip(*self.plex(self.table(RUN_PAGES), 4)):
            at = (struct.unpack("<I", item)[0] & 0x3FFFFF) * PAGE
            page = self.main[at : at + PAGE]
            runs = page[PAGE - 1] if len(page) == PAGE else 0
            if not runs or 5 * runs + 4 >= PAGE:
                raise Refused("a page of run properties is damaged")
            bounds = np.frombuffer(page, "<u4", runs + 1).astype(np.int64)
            for first, past, place in zip(bounds[:-1].tolist(), bounds[1:].tolist(), page[4 * runs + 4 : 5 * runs + 4]):
                said = self._said(page[2 * place + 1 : 2 * place + 1 + page[2 * place]]) if place else {}
                for lo, hi, start, width in pieces if said else ():
                    begin, end = max(first, start), min(past, start + (hi - lo) * width)
                    if begin < end:
                        some = slice(lo + (begin - start) // width, lo + -(-(end - start) // width))
                        for name, value in said.items():
                            getattr(out, name)[some] = value
        return out

    @staticmethod
    def _said(properties_: bytes) -> dict:
        """The properties that decide whether a character is on the page, and who decided; reading stops where a size is unknown."""
        out, at = {}, 0
        while at + 3 <= len(properties_):
            (code,) = struct.unpack_from("<H", properties_, at)
            at += 2
            size = OPERANDS[code >> 13]
            if size is None:
                size = 1 + properties_[at]
            value = int.from_bytes(properties_[at : at + min(size, 4)], "little")
            if at + size > len(properties_):
                break
            at += size
            for codes, name, cast in (((DELETED,), "deleted", bool), ((INSERTED,), "inserted", bool), ((HIDDEN,), "hidden", bool), (WHO, "author", int), (WHEN, "date", int)):
                if code in codes:
                    out[name] = cast(value & 0xFF) if cast is bool else value
        return out

    def names(self, number: int, counted: bool) -> list[str]:
        """Texts with their lengths before them; counted: after a head with their number and extra bytes."""
        blob, out, at, extra = self.table(number), [], 0, 0
        if counted:
            if len(blob) < 6 or blob[:2] != b"\xff\xff":
                return []
            extra, at = struct.unpack_from("<H", blob, 4)[0], 6
        while at + 2 <= len(blob):
            (n,) = struct.unpack_from("<H", blob, at)
            if at + 2 + 2 * n > len(blob) or not (n or counted):
                break
            out.append(blob[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
            at += 2 + 2 * n + extra
        return out


def _text(units: np.ndarray) -> str:
    return units.astype("<u2").tobytes().decode("utf-16-le", "replace")


def _on_page(units: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """units without the signs of fields and their instructions; and the instructions.  Of a field a page shows the result."""
    shown, instructions, open_fields = np.ones(len(units), bool), [], []
    for at in np.flatnonzero((units >= OPENS) & (units <= CLOSES)).tolist():
        shown[at] = False
        if units[at] == OPENS:
            open_fields.append(at)
        elif open_fields and open_fields[-1] is not None and units[at] in (PARTS, CLOSES):
            begin = open_fields[-1]
            own = units[begin + 1 : at][shown[begin + 1 : at]]
            if said := _text(own).translate(PUNCTUATION).strip():
                instructions.append(said)
            shown[begin:at] = False
            open_fields[-1] = None
        if units[at] == CLOSES and open_fields:
            open_fields.pop()
    return shown, instructions


def _date(packed: int) -> str | None:
    """A date of 6, 5, 5, 4 and 9 bits from minutes to years since 1900."""
    minute, hour, day, month, year = (packed >> shift & (1 << bits) - 1 for shift, bits in ((0, 6), (6, 5), (11, 5), (16, 4), (20, 9)))
    good = 1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60
    return f"{1900 + year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:00" if good else None


def _spans(*arrays: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges in which no array changes."""
    n = len(arrays[0])
    cut = np.zeros(max(n - 1, 0), bool)
    for a in arrays:
        cut |= a[1:] != a[:-1]
    bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), n] if n else [0]
    return list(zip(bounds[:-1], bounds[1:]))


def read_word97(compound: CompoundFile, out: Sink) -> None:
    """Units of the stories as a page shows them; deletions, insertions, hidden text and comments as records."""
    word = WordFile(compound)
    if word.encrypted:
        out.remark("the text of this document is encrypted and was not read; that says nothing of what it holds")
        return
    pieces = word.pieces()
    units = word.characters(pieces)
    try:
        marks, known = word.marks(pieces, len(units)), True
    except Refused as e:
        marks, known = Marks.none(len(units)), False
        out.remark(f"which characters of this document are on a page could not be read ({e}), so its text was not searched: deleted and hidden text would look like any other")
    revisers, lengths = word.names(REVISERS, True), struct.unpack_from("<11I", word.main, LENGTHS)
    at, searched, instructions = 0, [], []
    for name, number in STORIES:
        own, at = slice(at, at + lengths[number]), at + lengths[number]
        story, gone, new, unseen = units[own], marks.deleted[own], marks.inserted[own], marks.hidden[own]
        if not len(story):
            continue
        if name == "comments":
            _comments(word, story, out)
            continue
        who, when = marks.author[own], marks.date[own]
        for lo, hi in _spans(gone, new, unseen, who, when):
            text = _text(story[lo:hi][_on_page(story[lo:hi])[0]]).translate(PUNCTUATION)
            if not text.strip():
                continue
            if unseen[lo]:
                out.add("word_hidden", seq=out.count("word_hidden"), part=name, text=text)
            if gone[lo] or new[lo]:
                author = revisers[who[lo]] if 0 <= who[lo] < len(revisers) else None
                out.change("deletion" if gone[lo] else "insertion", text, author, _date(int(when[lo])), name)
        if known:
            left = story[~(gone | unseen)]
            shown, said = _on_page(left)
            instructions += said
            text = _text(left[shown]).translate(PUNCTUATION)
            if text.strip():
                out.unit(text)
                searched.append(name)
    if at > len(units):
        out.remark(f"the document states {at} characters and its pieces hold {len(units)}, so a story is shorter than stated")
    if not known:
        return
    out.text_unread = False
    out.remark("searched " + ", ".join(searched) if searched else "this document has no text on any page that could be searched")
    named = [x for x in instructions if any(mark in x for mark in LOCATIONS)]
    if named:
        out.remark(f"{len(named)} field{'s' if len(named) > 1 else ''} of the text compute what a page shows from a location that it does not show: " + "; ".join(named))
    if rest := len(instructions) - len(named):
        out.remark(f"{rest} field{'s' if rest > 1 else ''} of the text compute what a page shows and name no location")


def _comments(word: WordFile, story: np.ndarray, out: Sink) -> None:
    _, notes = word.plex(word.table(NOTE_PLACES), 30)
    texts = np.frombuffer(word.table(NOTE_TEXTS)[: len(word.table(NOTE_TEXTS)) // 4 * 4], "<u4").tolist()
    owners = word.names(NOTE_OWNERS, False)
    if len(texts) < len(notes) + 1:
        out.remark("the table of comments is damaged, so comments are missing")
    for note, lo, hi in zip(notes, texts[:-1], texts[1:]):
        length, owner = struct.unpack_from("<H18xH", note)
        initials = note[2 : 2 + 2 * min(length, 9)].decode("utf-16-le", "replace")
        text = _text(story[lo:hi]).translate(PUNCTUATION).strip("\n")
        out.comment(text, owners[owner] if owner < len(owners) else None, None, initials)


def read_compound(data: bytes, out: Sink) -> None:
    compound = CompoundFile(data)
    kind, name = next(((kind, name) for stream, kind, name in APPLICATIONS if stream in compound.streams), ("ole2", "a compound file of no known application"))
    out.kind, out.text_unread = kind, True
    for stream in SETS:
        if stream in compound.streams:
            part = stream[1:]
            try:
                for field, value in properties(compound.read(stream)):
                    out.field(field, value, part, ROLES.get(field.lower(), "other"), "ole2")
            except (Refused, ValueError, struct.error, IndexError) as e:
                out.remark(f"{part} could not be read: {e}")
    if not out.count("meta_fields"):
        out.remark("the file says nothing of itself in either of its property sets")
    if kind == "doc":
        try:
            read_word97(compound, out)
        except (Refused, struct.error, IndexError, ValueError) as e:
            out.remark(f"this is {name} whose text could not be read ({e}), so nothing of it was searched")
    else:
        out.remark(f"this is {name}; its text is in a binary form that is not read, so nothing of it was searched and its metadata was not compared with it")
    if storages := compound.storages():
        out.remark("the file carries objects in " + "; ".join(storages) + ", which were not opened")
    said = [f"{r['name']} {r['value']}" for r in out.rows["meta_fields"] if r["role"] == "content"]
    if out.text_unread and said:
        out.remark("the file says of itself: " + "; ".join(said) + "; its text was not read, so nothing was compared")
