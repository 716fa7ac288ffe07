"""Merged states of a survey against the survey made anew."""

import random

import pytest

from underlay.operators import rollup, survey

FILES = "file_id string, rel_path string, refusal string"
FINDINGS = "file_id string, emit_phase int, emit_seq long, detector string, page int, line int, `column` int"


def made(spark, n, seed=5):
    rng = random.Random(seed)
    files = [(f"f{i}", "/".join([*(rng.choice("ab") for _ in range(rng.randrange(4))), f"f{i}"]), "no" if rng.random() < 0.1 else None) for i in range(n)]
    found = [(f"f{rng.randrange(n)}", 1, k, rng.choice(["x", "y", "z"]), rng.choice([None, 1, 2]), rng.randrange(5), None) for k in range(3 * n)]
    return files, found


def expected(files, found):
    """(folder, detector) -> (files, read, refused, hiding, findings, first) by brute force."""
    out = {}
    for folder in {"/".join(path.split("/")[:k]) for _, path, _ in files for k in range(len(path.split("/")))}:
        below = {i: path for i, path, _ in files if not folder or path.startswith(folder + "/")}
        for d in (None, "x", "y", "z"):
            hits = [r for r in found if r[0] in below and d in (None, r[3])]
            if not hits and d:
                continue
            refused = sum(why is not None for i, _, why in files if i in below)
            first = min((below[r[0]].split("/") for r in hits), default=None)
            out[folder, d] = (*((None,) * 3 if d else (len(below), len(below) - refused, refused)), len({r[0] for r in hits}), len(hits), first and "/".join(first))
    return out


def got(df):
    return {(r.folder, r.detector): (r.files, r.read, r.refused, r.hiding, r.findings, r["first"]) for r in df.collect()}


def test_batches_merge_to_the_whole(spark, tmp_path):
    files, found = made(spark, 120)
    f, g = spark.createDataFrame(files, FILES), spark.createDataFrame(found, FINDINGS)
    grown = rollup.Growing(spark, str(tmp_path / "s"))
    for number, (lo, hi) in enumerate(((0, 50), (40, 90), (80, 120))):  # arrivals overlap: a known file is passed over
        grown.add(number, spark.createDataFrame(files[lo:hi], FILES), g)
    want = expected(files, found)
    assert got(grown.totals()) == want
    grown.add(2, spark.createDataFrame(files[80:], FILES), g)  # again, as after a failure
    assert got(grown.totals()) == want
    grown.settle(1)
    assert grown.state().where("subject = 'read'").count() > 0 and got(grown.totals()) == want
    grown.settle(2)
    assert got(rollup.Growing(spark, str(tmp_path / "s")).totals()) == want
    numbers = [r.number for r in spark.read.parquet(str(tmp_path / "s" / "register")).select("number").collect()]
    assert sorted(numbers) == list(range(1, 121))
    kinds = {r.detector: (r.files, r.findings, r["first"]) for r in survey.files_per_kind(f, g).collect()}
    assert kinds == {d: want["", d][3:] for d in "xyz"}


def test_numbers_follow_paths_and_states_cross_buckets(spark, tmp_path):
    """More files than a bitmap holds; a repeated row is one file."""
    files = spark.range(70_000).selectExpr("concat('f', id) AS file_id", "concat('d', id % 2, '/', lpad(id, 6, '0')) AS rel_path", "cast(null AS string) AS refusal")
    register = rollup.numbered(files.unionAll(files.limit(10)), 7, str(tmp_path / "r"))
    rows = sorted((r.number, r.rel_path.split("/")) for r in register.collect())
    assert [n for n, _ in rows] == list(range(8, 70_008)) and [p for _, p in rows] == sorted(p for _, p in rows)
    findings = spark.range(70_000).selectExpr("concat('f', id) AS file_id", "1 AS emit_phase", "id AS emit_seq", "if(id % 3 = 0, 'x', 'y') AS detector", "1 AS page", "1 AS line", "1 AS `column`")
    whole = got(rollup.totals(rollup.partial(register, findings)))
    assert whole["", None][:5] == (70_000, 70_000, 0, 70_000, 70_000) and whole["d1", None][0] == 35_000 and whole["", "x"][3] == 23_334


def test_nothing_and_refusals_alone(spark, tmp_path):
    grown = rollup.Growing(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], FINDINGS)
    grown.add(0, spark.createDataFrame([], FILES), none)
    assert grown.totals().count() == 0
    grown.add(1, spark.createDataFrame([("a", "a", "no")], FILES), none)
    assert got(grown.totals()) == {("", None): (1, 0, 1, 0, 0, None)}


def test_a_batch_that_failed_half_way_is_added_again(spark, tmp_path):
    """Its files were registered before the findings failed; they are not taken for known ones."""
    files, found = made(spark, 40)
    f, g = spark.createDataFrame(files, FILES), spark.createDataFrame(found, FINDINGS)
    grown = rollup.Growing(spark, str(tmp_path / "s"))
    grown.add(0, f.limit(10), g)
    with pytest.raises(Exception, match="lost"):
        grown.add(1, f, g.selectExpr("file_id", "emit_phase", "emit_seq", "if(emit_seq = 7, raise_error('lost'), detector) AS detector", "page", "line", "`column`"))
    grown.add(1, f, g)
    assert got(grown.totals()) == expected(files, found)
