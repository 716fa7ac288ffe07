from pyspark.sql import functions as F

from underlay.llm import line_dedup as D

BLANK = " \t\n\r\x0b\x0c"
LAST = 1 << 63


def brute(texts, min_length=10):
    def key(line):
        k = line.strip(BLANK)
        return k.encode().lower() if len(k) >= min_length else None

    owner = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            k = key(line)
            if k is not None:
                owner[k] = min(owner.get(k, LAST), LAST if i is None else i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or owner[key(x)] == (LAST if i is None else i)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_against_brute_force(docs, texts):
    assert got(D.dedup(docs)) == brute(texts)


def test_any_number_of_batches(docs, texts):
    for batches in (1, 2, 7):
        assert got(D.dedup(docs, batches=batches)) == brute(texts)


def test_runs_are_compacted(spark):
    runs = D.LineRuns(spark, 2)
    rows = lambda lo: spark.range(lo, lo + 10).select(F.col("id"), F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"))
    for i in range(5):
        assert runs.add(rows(10 * i)).count() == 0
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.add(rows(25)).count() == 10
    runs.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_as_they_lie(spark):
    """Neither the anti-join nor the compaction exchanges or sorts a run again."""
    runs = D.LineRuns(spark, 3)
    rows = lambda lo: spark.range(lo, lo + 50).repartition(2).select(F.col("id"), F.col("id").alias("h1"), (F.col("id") * 7 % 5).alias("h2"))
    runs.fan = 9
    for i in range(3):
        runs.add(rows(40 * i))
    with runs._as_they_lie():
        fresh, merged = runs.fresh(rows(100)), runs.compacted(runs.levels[0][:2])
        assert sorted(r.h1 for r in fresh.collect()) == list(range(130, 150))
        assert merged.count() == 90
        for text in (plan(fresh), plan(merged)):
            assert text.count("Bucketed: true") >= 2 and "disabled by" not in text
        assert plan(fresh).split("== Initial")[0].count("Exchange hashpartitioning") == 1 and plan(fresh).split("== Initial")[0].count("Sort [") == 1
        assert "Exchange hashpartitioning" not in plan(merged) and "Sort [" not in plan(merged)
    runs.close()


def test_a_store_is_opened_again(docs, texts, tmp_path):
    """The later half is held against the runs that the earlier one left."""
    store = str(tmp_path / "store")
    first = got(D.dedup(docs.where("doc_id < 200"), store=store))
    second = got(D.dedup(docs.where("doc_id >= 200 or doc_id is null"), store=store))
    assert sorted(first + second) == brute(texts)
    again = D.dedup(docs.where("doc_id < 200"), store=store)
    assert again.where("n_dropped = 0").count() == sum(all(len(x.strip(BLANK)) < 10 for x in (t or "").split("\n")) for i, t in texts if i is not None and i < 200)


def test_empty(none):
    assert D.dedup(none).count() == 0
