import re

import pytest

from underlay.llm import decontamination as D

ITEM = "item_id long, text string, doc_id long"


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(texts, items, window=8):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + window]), set()).add(i)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                x = tuple(w[a : a + n])
                if x in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[x]
        out.append((-1 if d is None else d, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(texts):
    rng = dict((i, t) for i, t in texts if i is not None)
    part = lambda i, a, n: " ".join(rng[i].split()[a : a + n])
    return [(1, part(200, 20, 30)), (2, part(300, 25, 12)), (3, part(407, 15000, 40)), (4, "two words"), (5, "x"), (6, None), (7, " .,"), (8, part(200, 20, 30)), (9, "nothing of the kind is anywhere here at all"), (10, part(3, 0, 3))]


def run(spark, docs, items):
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], ITEM)
    out = D.contamination(docs, D.build(docs, bench))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect())


def test_against_brute_force(spark, docs, texts, items):
    got = run(spark, docs, items)
    assert got == brute(texts, items)
    assert any(len(r[3]) > 1 for r in got)


def test_blocks_change_nothing(spark, docs, texts, items, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert run(spark, docs, items) == brute(texts, items)


def test_empty(spark, docs, none, texts):
    assert run(spark, docs, []) == brute(texts, [])
    assert run(spark, none, [(1, "a b c")]) == []


def test_ids_of_items_may_be_texts(spark, docs, texts):
    items = [("b-2", " ".join(dict(texts)[200].split()[:9])), ("b-10", " ".join(dict(texts)[200].split()[3:12])), (None, "x y")]
    got = D.contamination(docs, D.build(docs, spark.createDataFrame(items, "item_id string, text string"))).where("doc_id = 200").first()
    assert got["items"] == ["b-10", "b-2"]
