"""Operator 7, BPE encoding and decoding: a bounded-lookahead streaming transducer.

A merge list has a sufficient lookahead: how many bytes right of a token's end
can still take part in a merge across that end.  Let best(s) be the most bytes
that decide whether a token s is consumed by a merge (s, y): len(y) plus what
decides that merge itself.  For a merge r = (a, b), only merges (s, y) of lower
rank whose s stands on b's right spine (b, b's right part, ..) can undo r, since
until then both ways of reading on agree on the left; so

    need(r) = max over s on the right spine of b of best(s), over merges below r
    best(s) = max over merges r = (s, y) of len(y) + need(r)

in order of rank, and the lookahead is the largest best.  A token that ends that
many bytes before the end of the buffer is final.  WindowEncoder reads a piece of
any length in windows of that size plus a constant and emits tokens once they are
final, so its memory is constant.  A text longer than CHUNK is read a window at a
time (stream), and its tokens go on to digests and decoder as they come.  Pieces (the byte-level pattern's words, numbers,
signs and blanks) of at most SHORT bytes are merged many at a time in numpy, one
merge a piece and round; a bounded cache holds the tokens of recent pieces.
Decoding looks up each token's bytes and passes them, block by block, to an
incremental UTF-8 machine that keeps an unfinished character between blocks.

Special tokens in a text are tokens of their own, as the tokenizers library has
it; the file's truncation and padding are not used.

Cases: a null or empty text has no tokens; texts of any length are read whole,
several windows if need be; repeated rows give equal results, a row each; null ids
are carried like others; of merges of equal rank the leftmost is done first, as the
library does; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import table

U64 = np.uint64
SHORT = 48
CACHE_PIECES = 300_000
CHUNK = 2 << 20
WINDOW = 4096
NONE = 1 << 30
BLOCK_TOKENS = 1 << 16
#: Bytes after a piece that decide where it ends: two characters at most.
MARGIN = 16

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: The code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            out[c] = LETTER if major == "L" else NUMBER
    out[list(WHITE_SPACE)] = BLANK
    return out


_class_table: list[np.ndarray] = []


def piece_starts(points: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern's matches start; border marks the first code point of each text.

    The matches are: an apostrophe with s, t, re, ve, m, ll or d; runs of letters, of
    numbers, of other signs, each with one blank U+0020 before it; blanks up to the
    last one before something else, and that last one.
    """
    if not _class_table:
        _class_table.append(_classes())
    n = len(points)
    kind = _class_table[0][points]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= border
    # The last blank before something else of the same text stands apart, or joins what follows.
    after = np.flatnonzero(start & (kind != BLANK) & ~border)
    after = after[kind[after - 1] == BLANK]
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~border[quote + 1]]
    one = points[quote + 1]
    third = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~border[third], points[third], 0)
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    follow = quote + 1 + length
    follow = follow[follow < n]
    start[follow] = True
    return np.flatnonzero(start)


class BPE:
    """A byte-level merge list, its tables, and its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        char_of = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte_of = {c: b for b, c in char_of.items()}
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in t)
        for t, i in special.items():
            self.bytes[i] = t.encode()
        self.byte_id = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {(a, b): r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()))}
        self.lookahead = self._lookahead()
        self._hash_pairs()
        self.token_size = np.array([len(b) for b in self.bytes], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._cache_reset()

    @classmethod
    def from_file(cls, path: str) -> BPE:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls(spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _lookahead(self) -> int:
        made = {m: (a, b) for a, b, m in reversed(list(zip(self.left.tolist(), self.right.tolist(), self.merged.tolist())))}
        best: dict[int, int] = {}
        for a, b in zip(self.left.tolist(), self.right.tolist()):
            need, s = 0, b
            while s is not None:
                need = max(need, best.get(s, 0))
                s = made[s][1] if s in made else None
            best[a] = max(best.get(a, 0), len(self.bytes[b]) + need)
        return max(best.values(), default=0)

    def _hash_pairs(self) -> None:
        """Two tables of 2**20 slots: a pair sits in the first, or, if its slot is taken, in the second."""
        keys = self.left << 20 | self.right
        self.slots: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo = np.arange(len(keys))
        factor = 0x9E3779B97F4A7C15
        while len(todo) or not self.slots:
            at = self._slot(keys[todo], factor)
            _, first = np.unique(at, return_index=True)
            own, rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NONE, np.int64)
            own[at[first]], rank[at[first]] = keys[todo[first]], todo[first]
            self.slots.append((factor, own, rank))
            todo = np.delete(todo, first)
            factor = factor * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1

    @staticmethod
    def _slot(keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys.astype(U64) * U64(factor) >> U64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        out = np.full(len(keys), NONE, np.int64)
        for factor, own, rank in self.slots:
            at = self._slot(keys, factor)
            hit = own[at] == keys
            out[hit] = rank[at[hit]]
        return out

    def merge_many(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many short pieces laid end to end: (flat tokens, tokens per piece)."""
        total = len(data)
        symbols = self.byte_id[data]
        piece = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(total, NONE, np.int64)
        inner = np.flatnonzero(piece[1:] == piece[:-1]) if total else np.zeros(0, np.int64)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        out_symbols, out_piece = [], []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            length = np.diff(np.append(first, len(symbols)))
            done = least >> 32 >= NONE
            gone = np.repeat(done, length)
            out_symbols.append(symbols[gone])
            out_piece.append(piece[gone])
            at = least[~done] & 0xFFFFFFFF
            if not len(at):
                break
            symbols[at] = self.merged[rank[at]]
            keep = ~gone
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, piece, rank = symbols[keep], piece[keep], rank[keep]
            at = moved[at]
            has = (at + 1 < len(symbols)) & (piece[np.minimum(at + 1, len(symbols) - 1)] == piece[at])
            rank[at[~has]] = NONE
            a = at[has]
            rank[a] = self.ranks(symbols[a], symbols[a + 1])
            b = at[(at > 0) & (piece[np.maximum(at - 1, 0)] == piece[at])] - 1
            rank[b] = self.ranks(symbols[b], symbols[b + 1])
        symbols, piece = np.concatenate(out_symbols or [symbols]), np.concatenate(out_piece or [piece])
        order = np.argsort(piece, kind="stable")
        return symbols[order], np.bincount(piece, minlength=len(sizes))

    def merge_one(self, data: bytes) -> list[int]:
        """Tokens of one buffer, by a heap of ranked pairs over a linked list."""
        symbols = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := self.rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s >= 0]

    def _cache_reset(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """Where the pieces of the texts start, and the places and ids of special tokens, which are pieces of their own."""
        raw = data.tobytes()
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        special_at, special_id = [], []
        for token, i in self.special.items():
            for m in re.finditer(re.escape(token.encode()), raw):
                if not border[m.start() + 1 : m.end()].any():  # a border within: parts of two texts
                    special_at.append(m.start())
                    special_id.append(i)
                    border[[m.start(), m.end()]] = True
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = lead[piece_starts(points, border[lead])]
        if special_at:
            inside = np.zeros(len(data), bool)
            for s, i in zip(special_at, special_id):
                inside[s + 1 : s + len(self.bytes[i])] = True
            starts = starts[~inside[starts]]
        return starts, special_at, special_id

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts of a chunk: (flat tokens, tokens per text)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        starts, special_at, special_id = self._pieces(data, offsets)
        tokens, until = self._encode_pieces(data, starts, len(data), special_at, special_id)
        return tokens, np.diff(until[np.searchsorted(starts, offsets)])

    def stream(self, data: np.ndarray, window: int | None = None) -> Iterator[np.ndarray]:
        """Tokens of one text of any length, a window of it at a time.

        A piece's end is decided by what follows it, so pieces count as read only if MARGIN
        bytes of the window come after their end; the rest is read again with the next
        window.  A piece longer than that goes through the transducer as it comes, with one
        character of it kept before the next window, so that it is known for the same piece.
        """
        window, at, long, kept = window or CHUNK, 0, None, 0
        margin = max([MARGIN, *(len(t.encode()) for t in self.special)])
        while at < len(data):
            end = min(at + kept + window, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            own = data[at:end]
            starts, special_at, special_id = self._pieces(own, np.array([0, len(own)]))
            sure = len(own) if end == len(data) else len(own) - margin
            lo = 0
            if long is not None:
                follows = starts[1] if len(starts) > 1 else len(own)
                lo = int(follows) if follows <= sure or end == len(data) else max(sure, kept)
                while lo < len(own) and own[lo] & 0xC0 == 0x80:
                    lo -= 1
                yield np.fromiter(long.feed(own[kept:lo].tobytes()), np.int64)
                if follows > sure and end < len(data):
                    kept = _last_character(own, lo)
                    at += lo - kept
                    continue
                yield np.fromiter(long.finish(), np.int64)
                long, kept = None, 0
            whole = starts[(starts >= lo) & (starts <= sure)]
            cut = len(own) if end == len(data) else int(whole[-1]) if len(whole) else lo
            if cut > lo:
                some = [k for k, s in enumerate(special_at) if lo <= s < cut]
                yield self._encode_pieces(own, whole[whole < cut], cut, [special_at[k] for k in some], [special_id[k] for k in some])[0]
                at += cut
            elif lo:
                at += lo
            else:
                # The window's first piece goes on beyond it.
                long, upto = WindowEncoder(self), sure
                while own[upto] & 0xC0 == 0x80:
                    upto -= 1
                yield np.fromiter(long.feed(own[:upto].tobytes()), np.int64)
                kept = _last_character(own, upto)
                at += upto - kept
        if long is not None:
            yield np.fromiter(long.finish(), np.int64)

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray, end: int, special_at: list[int], special_id: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces that start at starts, the last one until end, and how many there are before each piece and in all."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ends = np.append(starts[1:], end)
        hashes = K.mix(K.span_hashes(data, starts, ends) + (ends - starts).astype(U64))
        types, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, size = self._lookup(types, data, starts[some], ends[some])
        at, size = self._compared(at[which], size[which], data, starts, ends)
        if special_at:
            # Whole special tokens stand for themselves, whatever their bytes would merge to.
            n = len(self.flat)
            self.flat = np.concatenate([self.flat, np.array(special_id, np.int64)])
            place = np.searchsorted(starts, special_at)
            at, size = at.copy(), size.copy()
            at[place], size[place] = n + np.arange(len(special_at)), 1
        tokens = self.flat[_spread(at, size)]
        if special_at:
            self.flat = self.flat[:n]
        return tokens, np.concatenate([[0], np.cumsum(size)])

    def _compared(self, at: np.ndarray, size: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at and size of pieces that were found by their hashes, with those whose bytes are others' merged on their own."""
        tokens = self.flat[_spread(at, size)]
        sums = np.concatenate([[0], np.cumsum(self.token_size[tokens])])
        last = np.cumsum(size)
        same = sums[last] - sums[last - size] == ends - starts
        if same.all():
            theirs = self.token_bytes[_spread(self.token_start[tokens], self.token_size[tokens])]
            unlike = theirs != data[starts[0] : ends[-1]]
            if not unlike.any():
                return at, size
            same[np.searchsorted(starts, starts[0] + np.flatnonzero(unlike), "right") - 1] = False
        else:
            for i in np.flatnonzero(same).tolist():
                same[i] = b"".join(self.bytes[t] for t in tokens[last[i] - size[i] : last[i]].tolist()) == data[starts[i] : ends[i]].tobytes()
        at, size = at.copy(), size.copy()
        for i in np.flatnonzero(~same).tolist():
            own = np.array(list(WindowEncoder(self).run([data[starts[i] : ends[i]].tobytes()])), np.int64)
            at[i], size[i] = len(self.flat), len(own)
            self.flat = np.concatenate([self.flat, own])
        return at, size

    def _lookup(self, types: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.flat the tokens of each distinct piece stand, and how many; new ones are merged first."""
        if len(self.keys) + len(types) > CACHE_PIECES and len(self.keys):
            self._cache_reset()
        place = np.minimum(np.searchsorted(self.keys, types), max(len(self.keys) - 1, 0))
        known = self.keys[place] == types if len(self.keys) else np.zeros(len(types), bool)
        new = np.flatnonzero(~known)
        if len(new):
            sizes = ends[new] - starts[new]
            short = new[sizes <= SHORT]
            sizes = ends[short] - starts[short]
            until = np.cumsum(sizes)
            bytes_at = np.repeat(starts[short] - (until - sizes), sizes) + np.arange(int(until[-1]) if len(until) else 0)
            tokens, counts = self.merge_many(data[bytes_at], sizes)
            order = short
            long = new[ends[new] - starts[new] > SHORT]
            if len(long):
                each = [list(WindowEncoder(self).run([data[starts[i] : ends[i]].tobytes()])) for i in long]
                tokens = np.concatenate([tokens, np.array([t for e in each for t in e], np.int64)])
                counts = np.concatenate([counts, np.array([len(e) for e in each], np.int64)])
                order = np.concatenate([short, long])
            keys = np.concatenate([self.keys, types[order]])
            at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts) - counts])
            size = np.concatenate([self.size, counts])
            self.flat = np.concatenate([self.flat, tokens])
            by_key = np.argsort(keys)
            self.keys, self.at, self.size = keys[by_key], at[by_key], size[by_key]
            place = np.searchsorted(self.keys, types)
        return self.at[place], self.size[place]

    def decode_bytes(self, tokens: np.ndarray) -> bytes:
        return self.token_bytes[_spread(self.token_start[tokens], self.token_size[tokens])].tobytes()


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size places from each first on, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _last_character(data: np.ndarray, end: int) -> int:
    """Bytes of the character that ends there."""
    n = 1
    while n < end and data[end - n] & 0xC0 == 0x80:
        n += 1
    return n


class WindowEncoder:
    """Tokens of one piece of any length, in constant memory: feed() gives those that are final so far."""

    def __init__(self, bpe: BPE, window: int = WINDOW):
        self.bpe, self.window, self.held = bpe, window, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        for i in range(0, len(data), self.window):
            self.held += data[i : i + self.window]
            if len(self.held) > self.bpe.lookahead + self.window:
                end = 0
                for t in self.bpe.merge_one(bytes(self.held)):
                    if end + len(self.bpe.bytes[t]) > len(self.held) - self.bpe.lookahead:
                        break
                    end += len(self.bpe.bytes[t])
                    yield t
                del self.held[:end]

    def finish(self) -> Iterator[int]:
        yield from self.bpe.merge_one(bytes(self.held))
        self.held.clear()

    def run(self, parts: Iterable[bytes]) -> Iterator[int]:
        for p in parts:
            yield from self.feed(p)
        yield from self.finish()


class Decoder:
    """Text of tokens that come block by block; an unfinished character waits for its other bytes."""

    def __init__(self, bpe: BPE):
        self.bpe, self.machine = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: np.ndarray) -> str:
        return self.machine.decode(self.bpe.decode_bytes(tokens))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode(bpe: BPE, tokens: np.ndarray) -> str:
    d = Decoder(bpe)
    return "".join([*(d.feed(tokens[i : i + BLOCK_TOKENS]) for i in range(0, len(tokens), BLOCK_TOKENS)), d.finish()])


class Result:
    """What is wanted of one text, from its tokens as they come: both digests are fed token block by token block, and no text or id list is held that is not asked for."""

    def __init__(self, want: tuple[str, ...], bpe: BPE, parts: Iterable[np.ndarray]):
        self.n, ids, texts = 0, [], []
        of_ids, of_text, decoder = hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
        decodes = "decoded" in want or "decoded_sha256" in want

        def said(text: str) -> None:
            of_text.update(text.encode())
            if "decoded" in want:
                texts.append(text)

        for tokens in parts:
            self.n += len(tokens)
            if "ids_sha256" in want:
                of_ids.update(tokens.astype("<u4").tobytes())
            if "ids" in want:
                ids.append(tokens)
            for i in range(0, len(tokens), BLOCK_TOKENS) if decodes else ():
                said(decoder.feed(tokens[i : i + BLOCK_TOKENS]))
        if decodes:
            said(decoder.finish())
        self._of = {"ids": lambda: np.concatenate(ids or [np.zeros(0, np.int64)]), "decoded": lambda: "".join(texts), "n_tokens": lambda: self.n, "ids_sha256": of_ids.hexdigest, "decoded_sha256": of_text.hexdigest}

    def of(self, what: str):
        return self._of[what]()


_loaded: dict[str, BPE] = {}


def load(path: str) -> BPE:
    if path not in _loaded:
        _loaded[path] = BPE.from_file(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), want: tuple[str, ...] = ("ids",)) -> DataFrame:
    """carry columns of docs and what is wanted of: ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    path names the tokenizer's file on every executor.
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(k), CHUNK):
                if len(data) > CHUNK:  # one long text
                    results = [Result(want, bpe, bpe.stream(data))]
                else:
                    tokens, counts = bpe.encode_chunk(data, offsets)
                    cuts = np.cumsum(counts)
                    results = [Result(want, bpe, [tokens[e - n : e]]) for e, n in zip(cuts.tolist(), counts.tolist())]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *(pa.array([r.of(w) for r in results], kinds[w][1]) for w in want)], names=[*batch.schema.names[:k], *want])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{w} {kinds[w][0]}" for w in want)])
    return docs.select(*carry, F.col(text_col).alias("text_")).mapInArrow(run, ddl)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), want=("n_tokens", "ids_sha256", "decoded_sha256"))
