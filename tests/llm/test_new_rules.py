"""Filter audit, quality rules and target resampling: against plain Python, on every defined case."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

from pyspark.sql import functions as F

from underlay.llm import filter_audit as A
from underlay.llm import quality_rules as Q
from underlay.llm import target_resampling as T

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Each row's failed filters, by looking at every other row."""
    out = []
    for i, _, text in rows:
        x = text or ""
        w = SPACE.findall(x)
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", x)) > 5 * len(x) else set()
        f |= {"D"} if re.search("[#$%&*|]", x) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == x for j, _, t in rows) else set()
        out.append(f)
    return out


def audit_by_running(rows, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    failed, want = fails(rows), {}
    for part in {s or "" for _, s, _ in rows}:
        own = [(i, f) for (i, s, _), f in zip(rows, failed) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                want[part, order, k + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), v in want.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in want.items()}


def audited(spark, rows, labels, tmp_path):
    spark.createDataFrame([(i, s, t, 1, True) for i, s, t in rows], "doc_id long, source string, text string, n int, A boolean").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string").write.parquet(f"{tmp_path}/labels.parquet")
    got = A.query(spark, str(tmp_path)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def test_audit_is_every_order_run(spark, texts, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    make = lambda: " ".join(rng.sample(words, rng.choice([20, 60, 80]))) + rng.choice(["", " #", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", " same" * 70])
    pool = [make() for _ in range(25)] + [None, ""]
    rows = [(rng.randint(0, 60), rng.choice(["a", "b", None, ""]), rng.choice(pool)) for _ in range(150)]
    rows += [(None, "a", pool[0]), (None, "c", None), (7, "a", "x"), (7, "a", "x")] + [(i, "t", t) for i, t in texts if i not in (407,)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 80, 2)] + [(4, 1, 0), (None, 1, 1)]
    assert audited(spark, rows, labels, tmp_path) == audit_by_running(rows, labels)


def test_audit_of_nothing_and_of_one_hot_text(spark, tmp_path):
    assert audited(spark, [], [], tmp_path / "none") == {}
    rows = [(i % 40, "s", "same text") for i in range(400)] + [(i, "s", f"other {i}") for i in range(100)]
    got = audited(spark, rows, [(3, 1, 1)], tmp_path / "hot")
    assert got == audit_by_running(rows, [(3, 1, 1)]) and got["s", "EABCD", 1][1] == 390


def test_möbius_for_any_number_of_filters(spark):
    rows = spark.createDataFrame([("p", 2, True, False, True), ("p", 1, True, True, False), ("p", 4, False, False, False)], "part string, n int, X boolean, Y boolean, good boolean").withColumn("toxic", F.lit(False))
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in A.audit(rows, "XY").collect()}
    assert got == {("XY", 1): (4, 3, 0, 2, 2, 5), ("XY", 2): (4, 0, 1, 0, 0, 1), ("YX", 1): (6, 1, 0, 0, 0, 1), ("YX", 2): (4, 2, 1, 2, 2, 5)}


def quality_by_hand(text):
    x = text or ""
    w, lines = SPACE.findall(x), x.split("\n")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(3)}
    dup = sum(bool(SPACE.search(a)) and a in lines[:k] for k, a in enumerate(lines))
    bare = lambda t: len("".join(SPACE.findall(t)))

    def rule(a):
        n = len(SPACE.findall(a))
        if not n:
            return None
        if n <= 30 and re.search(Q.BOILERPLATE, a):
            return "boilerplate"
        if n <= 20 and (len(re.findall(Q.SEPARATOR, a)) >= 2 or re.search(Q.LINKS.replace(r"\z", r"\Z"), a)):
            return "navigation"
        if sum(c in Q.SYMBOLS for c in a) * 8 >= max(n, 8):
            return "symbols"
        return "punctuation" if n <= 8 and not re.search(Q.TERMINAL.replace(r"\z", r"\Z"), a) else None

    kept = "\n".join(a for a in lines if rule(a) is None)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), bare(x), sum(c in Q.SYMBOLS for c in x), dup, len(covered), failed, not failed and bare(kept) * 100 >= bare(x) * 50, kept


def test_quality_rules(spark, texts, none):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("river stone paper winter light copper") + rng.choice("abcdefgh") for _ in range(n)) + "."
    menu = ["Home | About | Contact", "Read more", "Next »", "All rights reserved.", "© 2020 x", "Copyright 2020 Some Firm.", "a # b", "short line", "short line.", "", "  ", "Terms of Service apply here.", "x" + " y" * 40]
    more = ["\n".join(rng.choice([*menu, prose(12), prose(30)]) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    more += ["a b c " * 30, "a a a a", "a b c a b c", "x y " * 40 + prose(60), "\n".join(["one line that repeats here."] * 9), "é É\x0b\x0c ü\x85 x", "w " * 100_000]
    rows = list(texts) + [(5000 + i, t) for i, t in enumerate(more)] * 2
    df = spark.createDataFrame([(i, t, 3, "r") for i, t in rows], "doc_id long, text string, n_words int, row string")
    got = sorted(str(tuple(r)) for r in Q.clean(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_text").collect())
    assert got == sorted(str((i, *quality_by_hand(t))) for i, t in rows)
    assert Q.clean(none).count() == 0


def test_quality_of_the_whole_row(spark):
    """What a page of prose loses, and a page of links."""
    prose = "\n".join(f"River {i} runs {i}a slowly {i}b past {i}c an {i}d old {i}e bridge {i}f." for i in range(8))
    df = spark.createDataFrame([(1, prose + "\nHome | About | Help\nAll rights reserved."), (2, "\n".join(f"link{i} to some{i} place" for i in range(40)))], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.clean(df).collect()}
    assert got[1].kept and got[1].kept_text == prose and (got[1].boilerplate_lines, got[1].navigation_lines) == (1, 1)
    assert not got[2].base_failed and not got[2].kept and got[2].punctuation_lines == 40


def resampled_by_hand(rows, target, least=20):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower())
    feats = lambda w: [zlib.crc32(f) % T.BUCKETS for f in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]
    s, t = [0] * T.BUCKETS, [0] * T.BUCKETS
    for _, x in rows:
        for b in feats(words(x)):
            s[b] += 1
    for x in target:
        for b in feats(words(x)):
            t[b] += 1
    gain = T.gains(s, t)
    out = []
    for i, x in rows:
        w = words(x)
        f = feats(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


def test_resampling(spark, texts, none, tmp_path):
    rng = random.Random(8)
    rows = list(texts) + [(i, " ".join(rng.choice(["Alpha", "beta", "gamma", "ÉTÉ", "K", "x1", "İ"]) for _ in range(rng.randint(0, 60)))) for i in range(1000, 1150)]
    rows += [(2000, "alpha beta " * 30)] * 40 + [(2000, "gamma " * 30)] * 3
    target = ["alpha beta gamma", None, "", "river stone"] * 5
    spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, row string, weight int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(str(tuple(r)) for r in T.query(spark, str(tmp_path)).collect())
    assert got == resampled_by_hand(rows, target)


def test_chunks_own_every_feature_once(spark, texts, docs):
    """Chunks of any size, dealt out or not, give the same counts and weights, and none holds more than its words and the carry."""
    whole = T.bucket_counts(docs)
    gain = T.gains(whole, [i % 5 for i in range(T.BUCKETS)])
    want = sorted(str(tuple(r)) for r in T.weigh(docs, gain).select("doc_id", "n_words", "n_features", "weight").collect())
    for size, n_bytes in ((1, 0), (7, 100), (4096, 1000)):
        deal = {"size": size, "long_bytes": n_bytes}
        assert T.bucket_counts(docs, **deal) == whole
        assert sorted(str(tuple(r)) for r in T.weigh(docs, gain, **deal).select("doc_id", "n_words", "n_features", "weight").collect()) == want
        assert T.dealt(docs.select("doc_id", "text"), "text", **deal)[1].agg(F.max(F.size("words"))).first()[0] <= size + 1
    three = T.bucket_counts(docs, n=3, size=5, long_bytes=50)
    assert three == T.bucket_counts(docs, n=3) and sum(three) > sum(whole)


def test_resampling_of_nothing(spark, none):
    assert T.bucket_counts(none) == [0] * T.BUCKETS and T.draw(T.weigh(none, [0] * 10)).count() == 0
    few = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert [r["rank"] for r in T.draw(T.weigh(few, [0] * 10)).collect()] == [None, None]
