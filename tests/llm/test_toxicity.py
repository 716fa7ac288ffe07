import random

from underlay.llm import toxicity as T

from .conftest import prose


def table(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(15, 80)).replace("idiot", "person").split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["moron", "scum,", "Loser"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = table(spark, 600, 5)
    model = T.train(docs.where("doc_id % 5 <> 0"), labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_rare_expressions_do_not_vote(spark):
    docs, labels, _ = table(spark, 200, 6)
    odd = spark.createDataFrame([(1000, "unheard words zyx"), (1001, "other unheard qqq")], docs.schema)
    model = T.train(docs, labels)
    a, b = T.score(odd, model).collect()
    assert a.score == b.score


def test_copies_teach_once(spark):
    docs, labels, truth = table(spark, 200, 7)
    more = docs.where("doc_id = 1")
    many = docs
    extra = spark.range(500).selectExpr("id + 5000 AS doc_id").crossJoin(more.select("text"))
    marks = labels.unionAll(spark.range(500).selectExpr("id + 5000 AS doc_id", "0 AS toxic"))
    model = T.train(many.unionAll(extra), marks)
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    assert sum(got[i] == truth[i] for i in truth) / len(truth) > 0.9


def test_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    one_class = T.train(docs, labels)
    got = T.score(docs, one_class).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {1.0}
    assert T.score(none, one_class).count() == 0
    nothing = T.train(none, labels)
    assert {(r.score, r.predicted) for r in T.score(docs, nothing).collect()} == {(0.0, 0)}


def test_models_against_plain_python(spark):
    """Every probability the evidence is made of, counted anew; and each class's words sum to one."""
    import math
    import re
    from collections import Counter, defaultdict

    import numpy as np

    from underlay.llm import kernel as K

    docs, labels, truth = table(spark, 240, 8)
    model = T.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    trained = {r.id: r.toxic for r in docs.selectExpr("doc_id AS id", "pmod(xxhash64(text), 5) AS m").join(labels.withColumnRenamed("doc_id", "id"), "id").where("m <> 0").collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    bigrams = lambda t: list(dict.fromkeys(zip(["<s>", *split(t)], split(t))))
    n, m = (Counter(), Counter()), (Counter(), Counter())
    for i, c in trained.items():
        n[c].update(set(split(texts[i])))
        m[c].update(bigrams(texts[i]))
    contexts = defaultdict(set)
    for h, w in {*m[0], *m[1]}:
        contexts[w].add(h)
    reach = Counter({w: len(h) for w, h in contexts.items()})
    once, twice, total = sum(x == 1 for x in reach.values()), sum(x == 2 for x in reach.values()), sum(reach.values())
    d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    rest = d * len(reach) / total / (len(reach) + 1)
    lower = lambda w: max(reach[w] - d, 0) / total + rest
    sums = [sum(x.values()) for x in n]
    over = lambda toxic, every, share: (lambda x: math.copysign(max(abs(x) - 1 - T.SPREAD * math.sqrt(every * share * (1 - share)), 0), x))(toxic - every * share)

    def factor(c, w):
        every = n[0][w] + n[1][w]
        x = over(n[1][w], every, sums[1] / sum(sums)) if every > 1 else 0
        return max(1 + (x if c else -x) / (sums[c] * every / sum(sums)), 1e-3) if every > 1 else 1.0

    words = {*n[0], *n[1]}
    whole = [rest + sum(factor(c, w) * lower(w) for w in words) for c in (0, 1)]
    h_all = (Counter(), Counter())
    for c in (0, 1):
        for (h, _), k in m[c].items():
            h_all[c][h] += k
    followers = Counter(h for h, _ in {*m[0], *m[1]})

    def p(c, h, w):
        below = factor(c, w) * lower(w) / whole[c] if w in words else rest / whole[c]
        t = h_all[0][h] + h_all[1][h]
        if t < 2:
            return below
        every, pair = m[0][h, w] + m[1][h, w], 0.0
        if every > 1:
            x = over(m[1][h, w], every, h_all[1][h] / t)
            pair = max((every - 1) / t + (x if c else -x) / max(h_all[c][h], 1), (every - 1) / t * 1e-3)
        return followers[h] / t * below + pair

    for c in (0, 1):
        assert abs(sum(factor(c, w) * lower(w) / whole[c] for w in words) + rest / whole[c] - 1) < 1e-9
    some = [*list(texts.values())[:40], "never heard of this loser", "moron"]
    data = [t.encode() for t in some]
    got, sizes = T.evidence(model, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
    assert K.START_WORD and sizes.tolist() == [len(bigrams(t)) for t in some]
    want = [sum(math.log(p(1, h, w)) - math.log(p(0, h, w)) for h, w in bigrams(t)) for t in some]
    assert np.allclose(got, want, atol=1e-6)
