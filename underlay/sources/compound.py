"""Compound files, the container of Office 97: a tree of streams in sectors, and the property sets among them."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np

from .records import Refused

#: Fixed values of the format: signature, first sector number that is none, places in the header.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
NO_SECTOR = 0xFFFFFFFA
HEADER, ENTRY, FIRST_DIFAT, IN_HEADER = 512, 128, 76, 109
STORAGE, STREAM, ROOT = 1, 2, 5

#: The sections of property sets as they are stored, and the names of their numbers.
SUMMARY = bytes.fromhex("e0859ff2f94f6810ab9108002b27b3d9")
DOCUMENT_SUMMARY = bytes.fromhex("02d5cdd59c2e1b10939708002b2cf9ae")
USER_DEFINED = bytes.fromhex("05d5cdd59c2e1b10939708002b2cf9ae")
NAMES = {
    SUMMARY: {
        2: "Title",
        3: "Subject",
        4: "Author",
        5: "Keywords",
        6: "Comments",
        7: "Template",
        8: "Last Saved By",
        9: "Revision Number",
        10: "Total Editing Time",
        11: "Last Printed",
        12: "Create Time",
        13: "Last Saved Time",
        14: "Page Count",
        15: "Word Count",
        16: "Character Count",
        18: "Application Name",
    },
    DOCUMENT_SUMMARY: {2: "Category", 3: "Presentation Format", 6: "Slide Count", 8: "Paragraph Count", 9: "Line Count", 14: "Manager", 15: "Company"},
    USER_DEFINED: {},
}


class CompoundFile:
    """The streams of a compound file by path; names of storages and streams are joined by slashes."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < HEADER:
            raise Refused("it begins like a compound file and has no whole header")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not (7 <= shift <= 16 and mini_shift < shift):
            raise Refused("the sector sizes that its header states are none")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff = struct.unpack_from("<I4xI", data, 48)
        small, difat = struct.unpack_from("<I4xI", data, 60)
        listed = [np.frombuffer(data, "<u4", IN_HEADER, FIRST_DIFAT)]
        # Sectors of the list end with the number of the next one; no chain is longer than the file.
        for _ in range(len(data) // self.size + 1):
            if difat >= NO_SECTOR:
                break
            block = np.frombuffer(self._sector(difat), "<u4")
            listed.append(block[:-1])
            difat = int(block[-1])
        fat = np.concatenate(listed)
        self.fat = np.concatenate([np.frombuffer(self._sector(int(s)), "<u4") for s in fat[fat < NO_SECTOR]] or [np.zeros(0, "<u4")])
        self.streams: dict[str, tuple[int, int]] = {}
        entries = self._chained(directory)
        self._walk(entries)
        self.mini_fat = np.frombuffer(self._chained(small), "<u4") if small < NO_SECTOR else np.zeros(0, "<u4")
        start, size = struct.unpack_from("<II", entries, 116)
        self.mini = self._chained(start)[:size] if start < NO_SECTOR else b""

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        if at >= len(self.data):
            raise Refused("a sector that it names lies beyond its end")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def _chain(start: int, table: np.ndarray) -> list[int]:
        """Sector numbers from start on; one that comes twice, or is none of the table, is damage."""
        out, seen = [], np.zeros(len(table), bool)
        while start < NO_SECTOR:
            if start >= len(table) or seen[start]:
                raise Refused("a chain of its sectors is broken")
            seen[start] = True
            out.append(start)
            start = int(table[start])
        return out

    def _chained(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._chain(start, self.fat)))

    def _walk(self, entries: bytes) -> None:
        """The directory is a binary tree of siblings in each storage; entries that come again are passed over."""
        count, seen, waiting = len(entries) // ENTRY, set(), []
        if count:
            waiting.append((struct.unpack_from("<I", entries, 76)[0], ""))
        while waiting:
            number, path = waiting.pop()
            if number >= count or number in seen:
                continue
            seen.add(number)
            raw, length, kind, left, right, child, start, size = struct.unpack_from("<64sHBxIII36xIQ", entries, number * ENTRY)
            name = path + raw[: max(length - 2, 0)].decode("utf-16-le", "replace")
            waiting += [(left, path), (right, path)]
            if kind == STORAGE:
                waiting.append((child, f"{name}/"))
            elif kind == STREAM:
                self.streams[name] = (start, size & 0xFFFFFFFF if self.size == HEADER else size)

    def storages(self) -> list[str]:
        return sorted({path.partition("/")[0] for path in self.streams if "/" in path})

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        if size >= self.cutoff:
            data = self._chained(start)
        else:
            data = b"".join(self.mini[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(start, self.mini_fat)) if size else b""
        if len(data) < size:
            raise Refused(f"its stream {path.lstrip(chr(5))} is shorter than stated")
        return data[:size]


def _number(blob: bytes, at: int, layout: str = "I") -> int:
    return struct.unpack_from(f"<{layout}", blob, at)[0]


def _filetime(ticks: int) -> str | None:
    """Tenths of microseconds since 1601 as an ISO time."""
    try:
        return (datetime.datetime(1601, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=ticks // 10)).isoformat() if ticks > 0 else None
    except OverflowError:
        return None


class Section:
    """One section of a property set."""

    def __init__(self, blob: bytes, known: dict[int, str]):
        self.blob = blob
        count = min(_number(blob, 4), (len(blob) - 8) // 8)
        self.places = dict(struct.iter_unpack("<II", blob[8 : 8 + 8 * count]))
        page = _number(blob, self.places[1] + 4, "H") if 1 in self.places else 1252
        self.coding = {65001: "utf-8", 1200: "utf-16-le"}.get(page, f"cp{page}")
        self.names = known | (self._dictionary(self.places[0]) if 0 in self.places else {})

    def _text(self, raw: bytes) -> str:
        try:
            text = raw.decode(self.coding, "replace")
        except LookupError:
            text = raw.decode("cp1252", "replace")
        return text.partition("\0")[0]

    def _dictionary(self, at: int) -> dict[int, str]:
        """Names of a section's own properties: number, length, text; UTF-16 names are counted in units and padded to four bytes."""
        wide, out = self.coding == "utf-16-le", {}
        left, at = _number(self.blob, at), at + 4
        while left and at + 8 <= len(self.blob):
            number, length = struct.unpack_from("<II", self.blob, at)
            size = 2 * length if wide else length
            out[number] = self._text(self.blob[at + 8 : at + 8 + size])
            at += 8 + (-(-size // 4) * 4 if wide else size)
            left -= 1
        return out

    def _value(self, at: int) -> str | None:
        """Texts, whole numbers and times; other types are passed over."""
        kind, at = _number(self.blob, at) & 0xFFFF, at + 4
        if kind in (30, 31):
            size = _number(self.blob, at) * (kind - 29)
            raw = self.blob[at + 4 : at + 4 + size]
            return (raw.decode("utf-16-le", "replace").partition("\0")[0] if kind == 31 else self._text(raw)) or None
        if kind in (2, 3):
            return str(_number(self.blob, at, "hi"[kind - 2]))
        return _filetime(_number(self.blob, at, "Q")) if kind == 64 else None

    def __iter__(self) -> Iterator[tuple[str, str]]:
        for number, at in self.places.items():
            try:
                value = self._value(at) if number in self.names else None
            except struct.error:
                continue
            if value is not None:
                yield self.names[number], value


def properties(blob: bytes) -> Iterator[tuple[str, str]]:
    """(name, value) of a property set's sections that have names."""
    if len(blob) < 28 or blob[:2] != b"\xfe\xff":
        raise ValueError("it does not begin as a property set does")
    for i in range(min(_number(blob, 24), (len(blob) - 28) // 20)):
        name, at = struct.unpack_from("<16sI", blob, 28 + 20 * i)
        if name in NAMES and at + 8 <= len(blob):
            yield from Section(blob[at : at + max(_number(blob, at), 8)], NAMES[name])
