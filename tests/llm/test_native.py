"""License scans, PII and sharding: DataFrame functions alone, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from underlay.llm import license_scan as S
from underlay.llm import pii as P
from underlay.llm import sharding as H

NOTICES = ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "all all rights rights reserved", "cc by cc by", "general public\nlicense"]


def words(t):
    return [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]


def test_license_base(spark, texts):
    rng = random.Random(3)
    rows = [(i, t) for i, t in texts] + [(1000 + i, " ".join(rng.choice([*NOTICES, "plain words"]) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(2000, NOTICES[1])] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, template string")
    got = sorted((-1 if r.doc is None else r.doc, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in S.scan(df).collect())
    want = []
    for i, t in rows:
        w = words(t)
        at = sorted((a, label) for phrase, label in S.BASE for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split())
        want.append((-1 if i is None else i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_license_votes(spark, none):
    rows = [(1, "X licensed under the GNU General Public License, version 3. y"), (2, "licensed under the gnu very general public license version 3"), (3, "licensed under the gnu general public license version 4"), (4, "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software"), (5, "K cc by"), (6, "licensed under")]
    got = {r.doc: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl,gpl-3.0" and got[1].score == 1
    assert "gpl-3.0" in got[2].labels and got[2].score == 1.0  # the base phrase is whole
    assert got[3].labels == "gpl" and got[4].labels == "mit" and 0.75 <= got[4].score < 1
    assert got[5].labels == "cc-by" and got[6].labels == "" and got[6].score == 0
    assert [(s.start, s.end, s.label) for s in got[4].spans] == [(0, 17, "mit")]
    assert S.scan(none).count() == 0


def test_license_spans_are_verified(spark):
    """Against the words themselves: order, coverage, key phrases, and no span that starts before the text does."""
    gpl3, gpl2 = (next(t for t, label, _ in S.TEMPLATES if label == f"gpl-{v}.0" and t.startswith("this")) for v in (3, 2))
    w = gpl3.split()
    rows = [
        (1, "under the mit license foo released under"),
        (2, f"x {gpl3} y"),
        (3, f"{gpl2} and more"),
        (4, gpl3.replace("gnu general", "gnu lesser general")),
        (5, " ".join(w[len(w) // 2 :] + w[: len(w) // 2])),
        (6, gpl3.replace("free software you", "free code and you", 1)),
        (7, " ".join(w[:20])),
        (8, " ".join(w[:16] + ["stray"] * 30 + w[16:])),
    ]
    got = {r.doc: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end, s.label) for s in got[1].spans] == [(0, 4, "mit")]
    spans = lambda i: {(s.start, s.end) for s in got[i].spans if s.label.startswith("gpl-")}
    assert got[2].labels == "gpl,gpl-3.0" and spans(2) == {(1, 1 + len(w))} and got[2].score == 1
    assert got[3].labels == "gpl,gpl-2.0" and got[4].labels == "gpl,lgpl" and "gpl-3.0" in got[6].labels and spans(6) == {(0, len(w) + 1)}
    for i in (5, 7, 8):
        assert not spans(i)
    assert all(0 <= s.start < s.end <= r.n_words for r in got.values() for s in r.spans)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base(t):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))


def test_pii_base(spark):
    rng = random.Random(3)
    parts = [*"ab1.@+-_% ()0929é😀", "4111111111111111", "192.168.1.1", "x@y.z", ".com", "+1 (212) 555-0100", "25", "4"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "a@b" + ".c" * 20_000, "1-" * 20_000, "1." * 3000, "+" + "1 " * 3000, "001.02.255.0256 1.2.3.255"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("doc_id", P.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect():
        assert [tuple(x) for x in r.b] == base(texts[r.doc_id]), texts[r.doc_id]


def test_pii_terms_and_sanitising(spark, none):
    mail = "ann@corp.example.com"
    rows = [(i, f"Note {i}: Marisol Vega wrote from {mail} on day {'xyz'[i % 3]} about the plan {i}\nplain line {i} with the plan") for i in range(6)]
    rows += [(100 + i, f"about the plan and the note number {i} on day x") for i in range(200)] + [(500, "Marisol said nothing"), (501, None), (502, ""), (500, "Marisol said nothing")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    terms = {r.term: r for r in P.disclosing_terms(df).collect()}
    assert {"marisol", "vega"} <= set(terms) and not {"the", "plan", "about", "day"} & set(terms)
    assert terms["vega"].met == 6 and terms["vega"].held == 6 and terms["marisol"].held == 7
    found = P.find(df).select("doc_id", P.listed(F.col("base")).alias("b"), P.listed(F.col("spans")).alias("s"), P.sanitised(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[500].s.startswith("term:0:7") and by[500].clean == " said nothing" and by[501].s == ""
    assert mail not in by[0].clean and "[EMAIL]" in by[0].clean and "Vega" not in by[0].clean
    assert by[0].b in by[0].s and by[100].s == ""
    assert P.find(none).count() == 0


def terms_by_hand(texts):
    """Disclosing terms counted in plain Python."""
    import math

    word = re.compile(P.WORD)
    words = lambda t: {w for w in word.findall(t.lower()) if len(w) >= 3 and re.search("[^0-9]", w)}
    near, held, total = set(), {}, 0
    for t in texts:
        lines = [] if t is None else t.split("\n")
        total += len(lines)
        for i, line in enumerate(lines):
            held.setdefault(line, words(line))
            for a, _, b, kind in base(line):
                above = lines[i - 1][-P.REACH :] if i else ""
                below = lines[i + 1][: P.REACH] if i + 1 < len(lines) else ""
                before, after = f"{above} {line[max(a - P.REACH, 0) : a]}", f"{line[b : b + P.REACH]} {below}"
                near.add((f"{kind}:{line[a:b]}", f"{before[-P.REACH :]} {after[: P.REACH]}"))
    met, of = {}, {}
    for e, around in near:
        of[e] = of.get(e, 0) + 1
        for w in words(around):
            met[w, e] = met.get((w, e), 0) + 1
    out = {}
    for (w, e), n in met.items():
        if n >= P.SUPPORT:
            c = sum(w in x for x in held.values())
            if c and (share := min(n / c, 1)) >= P.DISCLOSURE and math.log2(share * total / of[e]) >= P.BITS:
                out[w, e] = (n, c)
    return out


def test_pii_terms_against_plain_python(spark):
    rng = random.Random(12)
    names, mails = ["Marisol Vega", "Oskar Lind", "Tui Aroha"], ["mv@corp.example.com", "+44 20 7946 0018", "10.20.30.40"]
    texts = [None, ""]
    for i in range(240):
        rows = ["plain " + " ".join(rng.choice("stone river cloud paper winter light".split()) for _ in range(8)) for _ in range(rng.randint(1, 4))]
        if i % 6 == 0:
            k = rng.randrange(3)
            rows[rng.randrange(len(rows)) : 0] = [f"{names[k]} {i}", f"write to {mails[k]} soon"] if i % 12 else [f"{names[k]}, item {i}, at {mails[k]}"]
        texts.append("\n".join(rows))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = terms_by_hand(texts)
    assert {(r.term, r.entity): (r.met, r.held) for r in P.disclosing_terms(df).collect()} == want and {"marisol", "lind", "aroha"} <= {w for w, _ in want}
    terms = {w for w, _ in want}
    for r in P.find(df).select("doc_id", "spans").collect():
        t, own = texts[r.doc_id] or "", [tuple(x) for x in r.spans]
        based = base(t)
        hits = [(m.start(), 4, m.end(), "term") for m in re.finditer(P.WORD, t) if m.group().lower() in terms]
        assert own == sorted(based + [h for h in hits if not any(a < h[2] and h[0] < b for a, _, b, _ in based)])


def shuffled(spark):
    """Bytes of shuffles written so far; what the driver shows lags behind the jobs."""
    import time

    for _ in range(2):
        spark.range(1).count()
        time.sleep(0.5)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", ["marisol vega", ""])
def test_pii_frequent_words_are_not_shuffled_line_by_line(spark, name):
    """Words of every line that meet an entity, with a term that discloses it and with none."""
    rng = random.Random(7)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    line = lambda i: " ".join(rng.choice(words) for _ in range(24)) + (f" {name} mv@corp.example.com" if i % 300 == 0 else "")
    texts = ["\n".join(line(i + k) for k in range(10)) for i in range(0, 6000, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled(spark)
    got = P.disclosing_terms(df)
    sent = shuffled(spark) - before
    want = terms_by_hand(texts)
    assert {(r.term, r.entity): (r.met, r.held) for r in got.collect()} == want and {w for w, _ in want} == set(name.split())
    assert all(r.spans == r.base for r in P.find(df).collect()) or name
    assert sent < 250_000, sent


def test_pieces_are_the_text_and_cut_no_word(spark):
    rng = random.Random(2)
    texts = ["", "x" * 9000, " " * 5000, "a" * 2047 + " b", "a" * 2048 + "b c", " " + "é" * 5000 + "!" * 3000] + ["".join(rng.choice(["a", " ", "\n", "wordé", "x" * 900]) for _ in range(400)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_extract_all("t", F.lit(P.PIECE), F.lit(0)).alias("p"))
    for r in df.collect():
        assert "".join(r.p) == texts[r.i]
        assert [w for x in r.p for w in re.findall(P.WORD, x)] == re.findall(P.WORD, texts[r.i])


def test_many_matches_in_one_text(spark):
    text = "a@b.c 1.2.3.4 " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(P.base_spans(F.col("text")).alias("b")).first().b
    assert len(got) == 40_000 and tuple(got[-1]) == (len(text) - 8, 1, len(text) - 1, "ip")


def test_pii_digest(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(r[0] for r in P.find(df).select(F.sha2(P.listed(F.col("base")), 256)).collect())
    assert got == sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base(t)).encode()).hexdigest() for _, t in texts)


@pytest.mark.parametrize("n", [0, 1, 23, 24, 1000])
def test_sharding_sizes_and_slots(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(8).cast("long").alias("size"), F.lit("x").alias("shard_"))
    got = H.shard(rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r.slot)
    sizes = [len(by.get(s, ())) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_repeats_on_the_same_input(spark):
    rows = spark.range(4800).select(F.col("id").alias("doc_id"))
    place = lambda seed: {r.doc_id: (r["shard"], r.slot) for r in H.shard(rows, seed=seed).collect()}
    first = place(1)
    assert first == place(1) != place(2)
    sizes = H.shard_sizes(1003, 24, 5)
    m = H.communication_matrix([100, 0, 500, 403], sizes, 5)
    assert (m.sum(axis=0) == sizes).all() and m.sum(axis=1).tolist() == [100, 0, 500, 403]


def test_equal_rows_are_shuffled_too(spark):
    rows = spark.range(2000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("text"), F.col("id").alias("was"))
    got = sorted((r.was, r["shard"] * 1000 + r.slot) for r in H.shard(rows).collect())
    assert abs(np.corrcoef(np.array(got).T)[0, 1]) < 0.1
    equal = H.shard(rows.select("doc_id")).groupBy("shard").count().collect()
    assert len(equal) == 24 and max(r["count"] for r in equal) - min(r["count"] for r in equal) <= 1


def test_large_hypergeometric_numbers():
    rng = np.random.default_rng(4)
    good, bad, draws = 40, 25, 22
    from math import comb

    seen = np.bincount([H._by_rejection(rng, good, bad, draws) for _ in range(20_000)], minlength=draws + 1)
    want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if draws - k <= bad else 0 for k in range(draws + 1)]) * 20_000
    some = want > 5
    assert ((seen - want)[some] ** 2 / want[some]).sum() < 2.5 * some.sum() and not seen[want == 0].any()
    for few, many, n in ((3 * 10**12, 10**12, 10**9), (5 * 10**8, 9 * 10**11, 6 * 10**11)):
        x = np.array([H._hypergeometric(rng, few, many, n) for _ in range(3000)], float)
        p = few / (few + many)
        spread = np.sqrt(n * p * (1 - p) * (few + many - n) / (few + many - 1))
        assert abs(x.mean() - n * p) < 5 * spread / np.sqrt(3000) and 0.9 < x.std() / spread < 1.1
        assert len(set(x % 10)) == 10
    sizes = H.shard_sizes(4 * 10**10 + 7, 24, 5)
    m = H.communication_matrix([10**10] * 4 + [7], sizes, 5)
    assert (m.sum(axis=0) == sizes).all() and m.sum(axis=1).tolist() == [10**10] * 4 + [7]


def test_sharding_query_columns(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = H.query(spark, str(tmp_path)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
