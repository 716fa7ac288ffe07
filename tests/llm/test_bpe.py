import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from underlay.llm import bpe as B
from underlay.llm import kernel as K

PATH = B.tokenizer_path()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def encoded(texts):
    b, out = B.load(PATH), []
    for _, _, data, offsets in K.chunks(pa.array(texts, pa.string()), 5000):
        tokens, counts = b.encode_chunk(data, offsets)
        out += [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])]
    return out


def test_against_the_library(reference):
    rng = random.Random(5)
    parts = [*"abcdest 'lrvm  \n\t12é²ñ!.?-_— 　中文😀‍́", "'ll", "'re", "'s", " 's", "<|endoftext|>", "<|endof", "the ", "  ", "\r\n", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 9000, "ab" * 5000 + " x", "=" * 5000 + "<|endoftext|>" + "-" * 7001, " " * 9000, "ﷺ" * 3000]
    got = encoded(texts)
    for t, ids, want in zip(texts, got, reference.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids
        assert B.decode(B.load(PATH), np.array(ids, np.int64)) == reference.decode(ids, skip_special_tokens=False) == t


def test_streams_give_the_tokens_of_the_whole(reference):
    """Windows of a few dozen bytes over texts with runs of all kinds, contractions, special tokens and pieces longer than a window."""
    b, rng = B.load(PATH), random.Random(9)
    parts = [*"abest '\n\t12é.!-— 　中😀", "'ll", " 're", "'s", "<|endoftext|>", "<|endof", "the ", "    ", "=" * 70 + "'s", "x" * 150, "é" * 90, " " * 130, "7" * 111, "don't", "''ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        data = np.frombuffer(t.encode(), np.uint8)
        got = [i for part in b.stream(data, rng.choice([40, 64, 100])) for i in part.tolist()]
        assert got == want.ids, t


def test_a_long_text_is_streamed(spark, reference):
    """Longer than a chunk: the digests are those of the whole."""
    t = ("word " * 1000 + "x" * 3000 + " é😀\n") * 300
    assert len(t.encode()) > B.CHUNK
    want = reference.encode(t, add_special_tokens=False).ids
    r = B.encode(spark.createDataFrame([(1, t)], "doc_id long, text string"), PATH, want=("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")).first()
    assert r.n_tokens == len(want) and r.ids == want and r.decoded == t
    assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_windows_give_the_tokens_of_the_whole():
    b, rng = B.load(PATH), random.Random(2)
    for _ in range(10):
        x = bytes(rng.choice(b"abt he ing") for _ in range(6000))
        parts = [x[i : i + 700] for i in range(0, len(x), 700)]
        w = B.WindowEncoder(b, 64)
        assert list(w.run(parts)) == b.merge_one(x)
        w = B.WindowEncoder(b, 64)
        for p in parts:
            list(w.feed(p))
            assert len(w.held) <= b.lookahead + 64 + max(map(len, b.bytes))


def test_lookahead_of_a_small_list():
    # "c" decides whether "b" goes to it, and so whether "a" gets it: one byte beyond "ab".
    vocab = {chr(c): i for i, c in enumerate(range(0x21, 0x7F))}
    rest = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b)]
    names = [chr(c) for c in (*range(0xA1, 0xAD), *range(0xAE, 0x100))] + [chr(256 + i) for i in range(len(rest))]
    vocab |= {c: len(vocab) + i for i, c in enumerate(names)}
    vocab |= {"bc": 300, "ab": 301}
    b = B.BPE(vocab, [("b", "c"), ("a", "b")], {})
    assert b.lookahead == 2
    assert b.merge_one(b"abc") == [vocab["a"], 300] and b.merge_one(b"abd") == [301, vocab["d"]]


def test_an_unfinished_character_waits():
    b = B.load(PATH)
    ids = np.array(b.merge_one("naïve 😀".encode()))
    d = B.Decoder(b)
    assert "".join([*(d.feed(ids[i : i + 1]) for i in range(len(ids))), d.finish()]) == "naïve 😀"
    one = np.array([int(b.byte_id[0xF0])])
    d = B.Decoder(b)
    assert (d.feed(one), d.finish()) == ("", "�")


def test_operator(docs, texts, none, reference):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode(docs, PATH, want=("n_tokens", "ids_sha256", "decoded_sha256")).collect())
    want = []
    for _, t in texts:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert B.encode(none, PATH).count() == 0
    r = B.encode(docs.where("doc_id = 404"), PATH, want=("ids", "decoded")).first()
    assert r.decoded == "two words" and r.ids == reference.encode("two words").ids
