"""Words that collide by structure under a polynomial modulo a power of two; names and rows that clash."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from underlay.llm import bpe as B
from underlay.llm import decontamination as D
from underlay.llm import jaccard_join as J
from underlay.llm import kernel as K
from underlay.llm import lm_scoring as L
from underlay.llm import sharding as H
from underlay.llm import toxicity as T

from .conftest import prose


def pair(n):
    """The word of Thue and Morse over a and b, and its complement."""
    t = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


PAIRS = [pair(n) for n in (16, 64, 512, 1024, 2048, 4096)]


def test_word_hashes_tell_words_apart():
    words = [w for p in PAIRS for w in p] + ["a", "b", "aa", "ab", "ba", "é", "e", "a" * 63, "a" * 64, "a" * 65, "a" * 64 + "b", "b" + "a" * 64]
    assert len(set(K.text_hashes(words).tolist())) == len(set(words))
    rng = random.Random(3)
    many = list({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 90))) for _ in range(20_000)})
    one = np.concatenate([K.text_hashes([w]) for w in many[:300]])
    assert len(set(K.text_hashes(many).tolist())) == len(many) and (K.text_hashes(many)[:300] == one).all()
    assert (K.text_hashes(["x" * 70_000] * 5 + many[:9])[5:] == one[:9]).all()


def test_lm_counts_both_words(spark):
    df = spark.createDataFrame([(i, f"{t} {u} {t}") for i, (t, u) in enumerate(PAIRS)], "doc_id long, text string")
    model = L.train(df)
    got = {r.doc_id: r for r in L.score(spark.createDataFrame([(1, PAIRS[3][0]), (2, PAIRS[3][1]), (3, pair(8192)[0])], "doc_id long, text string"), model).collect()}
    assert (got[1].n_known, got[2].n_known, got[3].n_known) == (2, 2, 1) and got[1].base_score != got[2].base_score


def test_toxic_word_is_not_its_complement(spark):
    rng = random.Random(4)
    t, u = PAIRS[3]
    rows = [(i, f"{prose(rng, 12)} {t if i % 2 else u} {prose(rng, 12)} {t if i % 2 else u}".replace("idiot", "x")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert np.mean([got[i] > 0.5 for i in range(1, 300, 2)]) > 0.9 and np.mean([got[i] < 0.5 for i in range(0, 300, 2)]) > 0.9


def test_no_link_between_different_words(spark):
    rows = [(2 * i + k, f"one two {w} four five six") for i, p in enumerate(PAIRS) for k, w in enumerate(p)] + [(100, f"one two {PAIRS[4][0]} four five six")]
    got = {r.id: r.component for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (8 if i == 100 else i) for i, _ in rows}


def test_tokens_of_different_pieces():
    b = B.load(B.tokenizer_path())
    for t, u in PAIRS:
        text = f"{t} {u} {t}{u}"
        (got,) = [b.encode_chunk(d, o)[0] for _, _, d, o in K.chunks(pa.array([text]))]
        assert B.decode(b, got) == text


def test_tokens_whatever_the_hash(monkeypatch):
    """Every piece meets the cache under one of three hashes; bytes decide."""
    texts = ["the cat sat on  the mat, don't <|endoftext|> they sat", "cat cat dog", "été 😀 dog's cat"]
    want = [b.tolist() for b in [B.load(B.tokenizer_path()).encode_chunk(d, o)[0] for t in texts for _, _, d, o in K.chunks(pa.array([t]))]]
    true = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda *a: true(*a) % np.uint64(3))
    fresh = B.BPE.from_file(B.tokenizer_path())
    assert [fresh.encode_chunk(d, o)[0].tolist() for t in texts for _, _, d, o in K.chunks(pa.array([t]))] == want


def test_a_window_is_its_words(spark, monkeypatch):
    t, u = PAIRS[3]
    items = spark.createDataFrame([(1, u), (2, f"one two three {u} five six seven eight nine"), (3, "Plain, words here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, t), (2, u), (3, f"one two three {t} five six seven eight nine"), (4, f"ONE two-three {u} five six seven eight nine"), (5, "plain words HERE plain words")], "doc_id long, text string")
    want = {1: (0, []), 2: (1, [1]), 3: (0, []), 4: (9, [1, 2]), 5: (3, [3])}
    run = lambda: {r.doc_id: (r.n_hit, r["items"]) for r in D.contamination(docs, D.build(docs, items)).collect()}
    assert run() == want


def test_bytes_decide_where_hashes_collide():
    block = D.make_block([(1, "ab cd ef"), (2, "xy")], 8)
    text = b"ab cd ef, zz AB-CD ef xy"
    w = K.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), K.NON_ALNUM)
    assert D._spelt_alike(block, np.array([0, 0, 0, 1, 1]), w, np.frombuffer(text, np.uint8), np.array([0, 1, 4, 7, 3])).tolist() == [True, False, True, True, False]


INTERNAL = ["row", "draw", "block", "rank", "until", "again", "cell", "size", "offset", "place", "shard", "slot", "draw_", "block_", "rank_", "until_", "cell_", "offset_", "place_", "again_", "count", "n"]


def test_sharding_with_any_other_names(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), *((F.col("id") % 5).alias(c) for c in INTERNAL))
    got = H.shard(rows)
    assert got.columns == [c for c in rows.columns if c not in ("shard", "slot")] + ["shard", "slot"] and got.count() == 200
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert H.query(spark, str(tmp_path)).select("doc_id").distinct().count() == 200


@pytest.mark.parametrize("rows_of_one_id", [1, 300])
def test_repeated_rows_train_once(spark, rows_of_one_id):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30).replace("idiot", "") + (" scum scum" if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    more = rows + [r for r in rows[:10] for _ in range(rows_of_one_id)] + [(5, "another text of that id")] * rows_of_one_id
    plain = T.train(spark.createDataFrame([*rows, (5, "another text of that id")], "doc_id long, text string"), labels)
    other = T.train(spark.createDataFrame(more, "doc_id long, text string").repartition(7), labels)
    assert (plain.words == other.words).all() and (plain.contexts == other.contexts).all()
    assert np.allclose(plain.word, other.word) and np.allclose(plain.pair, other.pair)
