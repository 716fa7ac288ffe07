"""The pipeline's stages, each against plain Python on its own input."""

import hashlib

import corpus_pipeline as C

from .test_decontamination import brute as contaminated
from .test_jaccard_join import brute as linked
from .test_line_dedup import brute as lines


def test_stages(spark, texts, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts if i is not None]
    rows += [(2000 + i, f"{'moron scum loser ' if i % 3 == 0 else ''}plain words about stone and river number {i} {'xyz' * (i % 5)} and so on", "en", "s", 9) for i in range(90)]
    rows.append((2500, "a document of its own that quotes one item only " + " ".join(f"only{i}" for i in range(20)), "en", "s", 9))
    seen = next(t for i, t in texts if i == 407).split()
    items = [(1, " ".join(seen[100:140])), (2, " ".join(seen[900:920])), (3, "not in any text of this table at all"), (4, " ".join(f"only{i}" for i in range(5, 15))), (5, "stone and river")]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(2000 + i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, after = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in C.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "bpe" or docs.columns == list(C.COLUMNS)
        after[name] = [r for r in docs.collect()]
    pairs = lambda name: [(r.doc_id, r.text) for r in after[name]]
    kept = {i for i, _ in pairs("toxicity")}
    assert not {2000 + i for i in range(0, 90, 3)} & kept and {2001, 2002, 200, 407} <= kept
    assert sorted(pairs("line_dedup")) == sorted((i, t) for i, _, _, t in lines(pairs("toxicity")))
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"])
    assert sorted({i for i, _ in pairs("ngram_jaccard_join")}) == sorted({i for i, _, c in linked(pairs("line_dedup")) if i == c})
    assert len(pairs("ngram_jaccard_join")) == len({i for i, _ in pairs("ngram_jaccard_join")})
    clean = sorted(i for i, _, hit, _ in contaminated(pairs("ngram_jaccard_join"), items) if hit < 8)
    assert sorted(i for i, _ in pairs("benchmark_decontamination")) == clean and not {407, 2500} & set(clean) and 2001 in clean
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in pairs("benchmark_decontamination")}
    assert {r.doc_id: r.decoded_sha256 for r in after["bpe"]} == want


def test_null_and_repeated_ids(spark):
    """Both in one table: null ids group by text alone, and an id stays once."""
    far = [" ".join(f"{w}{k}" for w in "red blue green amber violet white black brown".split() for k in range(i, i + 9)) for i in range(0, 90, 9)]
    near = f"{far[0]} and one more"
    rows = [(1, far[0]), (1, far[0]), (1, far[1]), (2, near), (3, far[2]), (4, None), (4, " "), (5, far[3]), (5, None)]
    rows += [(None, near), (None, far[1]), (None, far[4]), (None, f"{far[4]} too"), (None, far[5]), (None, far[5]), (None, far[6]), (None, None), (None, None), (None, ""), (None, "")]
    for some in (rows, [r for r in rows if r[0] not in (1, 4, 5)]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept = [(r.doc_id, r.text) for r in C.drop_near_copies(spark, docs, "").collect()]
        # Texts with a null id that no id's text is like: one of far[4] and its near copy, far[5] once, far[6], and every blank one.
        unnamed = [t for i, t in kept if i is None]
        own = {far[4], f"{far[4]} too"} & set(unnamed)
        more = [] if some is rows else [far[1]]
        assert len(own) == 1
        if some is rows:
            assert sorted(unnamed, key=str) == sorted([*own, far[5], far[6], None, None, "", ""], key=str)
            assert sorted(i for i, _ in kept if i is not None) == [1, 3, 4, 5]
        else:
            assert sorted(unnamed, key=str) == sorted([*own, *more, far[5], far[6], None, None, "", ""], key=str)
            assert sorted(kept, key=str) == sorted([*((None, t) for t in unnamed), (2, near), (3, far[2])], key=str)


def test_cases_of_every_stage(spark, none, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, clashing names, an empty table and empty side tables."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, held_out string, root long, h1 long, digest long, items string, score double, text_ string"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "some plain words about a river", "en"), (1, "some plain words about a river", "en"), (None, None, None), (None, "an unknown document of words", "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (5, " \n\n", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "z", 1, 1, 1, "q", 0.5, "x") for i, t, lang in rows], ddl).repartition(3)
    for given, labels in (("full", [(1, 1, 0), (None, 1, 1), (3, 0, None)]), ("none", [])):
        sf = str(tmp_path / given)
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "w1 w2 w3"), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        for start in (docs, docs.where("false")):
            now = start
            for k, (name, stage) in enumerate(C.STAGES):
                path = f"{sf}/{k}-{start is docs}"
                stage(spark, now, sf).write.parquet(path)
                now = spark.read.parquet(path)
                assert name == "bpe" or now.columns == list(C.COLUMNS)
            kept = now.collect()
            if start is not docs:
                assert not kept
                continue
            assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5] and sum(r.doc_id is None for r in kept) == 2
            (held,) = [r for r in kept if r.doc_id == 4]
            assert held.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
