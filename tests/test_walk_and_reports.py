"""The walk by executors, and reports that they write."""

import json
import os

import pytest

from underlay import cli
from underlay.operators import characters
from underlay.operators.findings import union
from underlay.sources import reports, walk

UNIT = "file_id string, inside string, unit_no int, page int, text string"
FILES = "file_id string, kind string, searched boolean, sha256 string, refusal string"
REMARK = "file_id string, inside string, seq long, text string"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for i in range(300):
        folder = root / f"d{i % 7}" / f"_e{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i} ü%.txt").write_text(f"text {i}")
    (root / "empty").mkdir()
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x").write_text("no")
    (root / "d0" / ".x").write_text("no")
    (root / "d0" / "round").symlink_to(root)
    (root / "top.bin").write_bytes(bytes(range(256)))
    return root


def test_walk_is_the_whole_tree(spark, tree):
    want = {}
    for folder, names, files in os.walk(tree):
        names[:] = [n for n in names if not n.startswith(".")]
        want |= {os.path.relpath(os.path.join(folder, f), tree): os.path.join(folder, f) for f in files if not f.startswith(".")}
    rows = walk.case_files(spark, str(tree)).collect()
    assert len(rows) == 301 and {r.rel_path: r.path for r in rows} == want
    assert all(bytes(r.content) == open(r.path, "rb").read() and r.length == len(r.content) for r in rows)
    assert walk.case_files(spark, f"file://{tree}").count() == 301
    assert [r.rel_path for r in walk.case_files(spark, str(tree / "top.bin")).collect()] == ["top.bin"]
    assert walk.case_files(spark, str(tree / "empty")).count() == 0


def test_a_folder_that_cannot_be_listed_is_a_row(tmp_path):
    system, _ = walk.filesystem(str(tmp_path))
    assert list(walk._entries(system, str(tmp_path / "gone"), "a/gone")) == [(str(tmp_path / "gone"), "a/gone", 0, False, False)]
    batch = walk._batch([(str(tmp_path / "gone"), "a/gone", 0, False), (str(tmp_path / "away"), "away", 3, True)], walk.pa.schema([*[walk._NAMES.field(i) for i in range(3)], walk._NAMES.field("listed")]))
    (out,) = walk._opener(str(tmp_path))([batch])
    assert out.column(3).to_pylist() == [None, None]


def whole(spark):
    found = union(characters.detect(spark.createDataFrame([("a/b", "", 0, None, "x​y"), ("c", "", 0, None, "plain"), ("é" * 200, "", 0, None, "u​v\n​w")], UNIT)))
    files = spark.createDataFrame([("a/b", "text", True, "00", None), ("c", "text", True, "01", None), ("é" * 200, "text", True, "02", None), ("no", "", False, "03", "damaged")], FILES)
    return files.repartition(3), found, spark.createDataFrame([("c", "", 0, "hm")], REMARK)


@pytest.mark.parametrize("form", reports.FORMS)
def test_reports_and_manifest(spark, tmp_path, form):
    out = tmp_path / "out"
    made = reports.write(*whole(spark), form, str(out))
    assert (made["reports"], made["hiding"], made["findings"], made["refused"]) == (4, 2, 3, 1)
    assert {p.name for p in out.iterdir()} == {"manifest.json", *(p["folder"] for p in made["parts"])}
    lines = {r["file"]: (out / p["folder"] / r["report"], r) for p in made["parts"] for r in map(json.loads, (out / p["folder"] / "reports.jsonl").read_text().splitlines())}
    assert set(lines) == {"a/b", "c", "é" * 200, "no"} and lines["no"][1]["refused"] == "damaged"
    said = lines["a/b"][0].read_text().replace("\\-", "-")
    assert "zero-width" in said and "x⟨U+200B⟩y" in said and "hm" in lines["c"][0].read_text()
    again = reports.write(*whole(spark), form, str(out))
    assert again["reports"] == 4 and {p.name for p in out.iterdir()} == {"manifest.json", *(p["folder"] for p in again["parts"])}
    assert reports.write(*whole(spark), form, str(out), overwrite=False)["reports"] == 8


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    kept = reports.write(*whole(spark), "text", str(out))
    rows = reports.per_report(*whole(spark), "text")
    bad = rows.repartition(4).selectExpr("if(file_id = 'no', raise_error('lost'), file_id) AS file_id", "findings", "refusal", "searched", "found", "said")
    with pytest.raises(Exception, match="lost|abort|fail"):
        bad.write.format("underlay-reports").option("form", "text").mode("append").save(str(out))
    assert reports.read_manifest(str(out)) == kept
    assert {p.name for p in out.iterdir()} == {"manifest.json", *(p["folder"] for p in kept["parts"])}


def test_an_attempt_that_did_not_count_goes(tmp_path):
    rows = [{"file_id": "a", "findings": 0, "refusal": None, "json": "{}"}]
    writer = reports.Writer(str(tmp_path), "json", False)
    writer.write(iter(rows))  # an attempt whose message never came
    second = writer.write(iter(rows))
    writer.commit([second, None])
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == [second.folder] and reports.read_manifest(str(tmp_path))["reports"] == 1


def test_names_differ():
    ids = ["a/b", "a%2Fb", "a b", "x" * 300, "x" * 299 + "y", "é" * 300]
    assert len({reports.report_name(i, "md") for i in ids}) == len(ids) and all(len(reports.report_name(i, "md").encode()) < 255 for i in ids)


def test_command_line_writes_reports(spark, tree, tmp_path, capsys):
    (tree / "odd.txt").write_text("a​b")
    assert cli.main([str(tree / "d0"), "--out", str(tmp_path / "o"), "--json", "--only", "zero-width"]) == 0
    assert cli.main([str(tree), "--out", str(tmp_path / "o"), "--json", "--only", "zero-width"]) == 1
    made = reports.read_manifest(str(tmp_path / "o"))
    assert made["reports"] == 302 and made["hiding"] == 1 and "302 reports" in capsys.readouterr().out
